"""Token ids of texts by a word-level BPE tokenizer file of the ``tokenizers`` library, word by word.

White space never lies inside a token of such a tokenizer (the normaliser folds it, the pre-tokeniser drops
it), so a text's ids are the ids of its words (cut at ASCII white space) in order.  Words repeat, so their ids are kept
(a bounded number).  Plain words that are new in a batch are merged together, one merge of every word per
numpy step; anything else (digits, marks, long or unusual words, special strings) goes to the library.

Words and their ids are held in Arrow and numpy arrays throughout (ids of many words one after the other, with the
number of ids of each), so no step touches one word at a time but the library's.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The normaliser and split pattern for which the merging below is exact.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: words that are merged here: letters of Latin scripts, composed and each with a lower case of one letter (so not U+0130),
#: and marks of ASCII behind them
PLAIN = r"^(?P<core>[A-Za-z\x{0c0}-\x{0d6}\x{0d8}-\x{0f6}\x{0f8}-\x{12f}\x{131}-\x{24f}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
NONE = np.int64(2**40)


def _byte_chars() -> list[str]:
    """The printable stand-in for every byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Ids:
    """Ids of several words: ``flat`` one after the other, ``sizes`` of each."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat.astype(np.uint32, copy=False), sizes.astype(np.int64, copy=False)

    @classmethod
    def of(cls, lists: list[list[int]]) -> Ids:
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return cls(np.fromiter((i for x in lists for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes)

    def take(self, which: np.ndarray) -> Ids:
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(self.flat)).take(pa.array(which))
        return Ids(lists.flatten().to_numpy(), self.sizes[which])

    def __add__(self, other: Ids) -> Ids:
        return Ids(np.concatenate([self.flat, other.flat]), np.concatenate([self.sizes, other.sizes]))


class WordIds:
    """Ids of words and texts."""

    def __init__(self, tokenizer_json: str, remembered: int = 400_000, widest: int = 24):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.words, self.ids = pa.array([""], pa.string()), Ids.of([[]])
        self.remembered, self.widest = remembered, widest
        spec = json.loads(tokenizer_json)
        model, normal, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or [{}]
        self.plain = (model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout")
                      and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
                      and [n["type"] for n in normal.get("normalizers", [])] == NORMALIZERS
                      and steps[0].get("pattern", {}).get("Regex") == SPLIT and len(steps) == 2)
        if self.plain:
            self._prepare(model)
            self.tails: dict[str, list[int]] = {"": []}  # a closing run of marks is a piece of its own

    def _prepare(self, model: dict) -> None:
        vocab, end, chars = model["vocab"], model["end_of_word_suffix"], _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = np.append(keys[order], 1 << 60), np.append(order, 0), made

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b  # absent symbols are negative, so their keys are found nowhere
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def _merge(self, words: pa.Array) -> Ids:
        """Ids of plain words (after normalisation): in every step each word's first pair of least rank becomes one
        symbol, until no word has a pair left."""
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        n, width = len(words), int(sizes.max())
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
        starts = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + n + 1]
        text = data[starts[0]:starts[-1]]
        sym = np.full((n, width + 1), -1, dtype=np.int64)
        inside = np.arange(width + 1) < sizes[:, None]
        sym[inside] = self.inner[text]
        sym[np.arange(n), sizes - 1] = self.last[text[starts[1:] - starts[0] - 1]]
        ranks = self._ranks(sym[:, :-1], sym[:, 1:])
        out, rows, cols = np.full_like(sym, -1), np.arange(n), np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            ended = low == NONE
            if ended.any():
                out[rows[ended]] = sym[ended]
                go = ~ended
                rows, sym, ranks, at, low = rows[go], sym[go], ranks[go], at[go], low[go]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            later = cols > at[:, None]
            sym[here, at] = self.made[low]
            # what lies behind the merged pair moves up by one place
            sym = np.take_along_axis(sym, np.minimum(cols + later, width), axis=1)
            sym[:, -1] = -1
            moved = np.minimum(cols[:-1] + later[:, :-1], width - 1)
            ranks = np.take_along_axis(ranks, moved, axis=1)
            ranks[:, -1] = NONE
            ranks[here, at] = self._ranks(sym[here, at], sym[here, at + 1])
            before = np.maximum(at - 1, 0)
            fresh = self._ranks(sym[here, before], sym[here, before + 1])
            ranks[here, before] = np.where(at > 0, fresh, ranks[here, before])
        kept = out >= 0
        return Ids(out[kept], kept.sum(axis=1))

    def _by_library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _merged(self, cores: pa.Array) -> Ids:
        """Ids of distinct plain words."""
        size = pc.binary_length(cores).to_numpy()
        order = np.argsort(size, kind="stable")
        few = int(np.searchsorted(size[order], self.widest, side="right"))
        out = Ids.of(self._by_library(cores.take(pa.array(order[few:])).to_pylist()))
        for i in range(few // 20_000 * 20_000, -1, -20_000):
            if part := order[i:min(i + 20_000, few)].tolist():
                out = self._merge(cores.take(pa.array(part))) + out
        return out.take(np.argsort(order, kind="stable"))

    def _learn(self, words: pa.Array) -> Ids:
        """Ids of distinct words."""
        if not len(words):
            return Ids.of([])
        parts = pc.extract_regex(words, pattern=PLAIN) if self.plain else None
        plain = parts.is_valid().to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(words), dtype=bool)
        other = Ids.of(self._by_library(words.filter(pa.array(~plain)).to_pylist()))
        place = np.empty(len(words), dtype=np.int64)
        place[~plain] = np.arange(len(other.sizes))
        if not plain.any():
            return other
        parts = parts.filter(pa.array(plain))
        core = pc.utf8_lower(pc.struct_field(parts, "core")).dictionary_encode()
        tail = pc.struct_field(parts, "tail").dictionary_encode()
        marks = tail.dictionary.to_pylist()
        fresh = [m for m in marks if m not in self.tails]
        known = self.tails | dict(zip(fresh, self._by_library(fresh)))
        if len(self.tails) < 10_000:
            self.tails = known
        cores, tails = self._merged(core.dictionary), Ids.of([known[m] for m in marks])
        # the pieces of every word side by side: its letters, then its marks
        n = len(core)
        which = np.empty(2 * n, dtype=np.int64)
        which[0::2] = core.indices.to_numpy()
        which[1::2] = tail.indices.to_numpy().astype(np.int64) + len(cores.sizes)
        pieces = (cores + tails).take(which)
        place[plain] = np.arange(n) + len(other.sizes)
        return (other + Ids(pieces.flat, pieces.sizes.reshape(n, 2).sum(axis=1))).take(place)

    def _known(self, words: pa.Array) -> Ids:
        """Ids of distinct words, remembered ones or new ones."""
        at = pc.index_in(words, value_set=self.words)
        fresh = words.filter(at.is_null())
        learnt = self._learn(fresh)
        place = at.to_numpy(zero_copy_only=False)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        place = np.where(missing, 0, place).astype(np.int64)
        place[missing] = np.arange(len(fresh)) + len(self.ids.sizes)
        both = self.ids + learnt
        room = self.remembered - len(self.words)
        if room > 0 and len(fresh):
            self.words = pa.concat_arrays([self.words, fresh.slice(0, room)])
            kept = self.ids.sizes.size + min(room, len(fresh))
            self.ids = Ids(both.flat[:int(both.sizes[:kept].sum())], both.sizes[:kept])
        return both.take(place)

    def texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids start (with the end of the last).

        Arrow splits the texts and numbers their distinct words; only those are looked up."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        out = self._known(words.dictionary.cast(pa.string())).take(codes)
        first = np.concatenate([[0], np.cumsum(out.sizes)])
        words_before = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return out.flat, first[words_before.astype(np.int64)]
