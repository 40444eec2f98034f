"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

The ordinary dictionary holds stretches of ordinary documents, each from a place fixed by a hash.  The toxic one holds
the same and all words of toxic documents that hold telling grams: byte sequences used in many different contexts there
and hardly ever in ordinary text (contexts, not documents, are counted, so copied passages carry no weight).  A window that the toxic dictionary compresses
shorter than the ordinary one is evidence; since the dictionaries share their ordinary part, ordinary text comes
out alike in both.

A document is read in overlapping byte windows over its whole length.  Windows with a gain are read again word
by word, which leaves the gain of single words.  The calibrated features are the best
window, the best word, the best three words, whether and how many words are found whole, and the number of gaining
windows; a logistic regression, fitted on
documents that had no part in the dictionaries they are scored with, turns them into a probability.

Learnt on the driver from a bounded sample (``PER_CLASS`` documents with label 0 and 1, ``MOST_CHARS`` characters
of each).  Defined results: null and empty texts get the score of a text without any evidence; without labels of
both classes every score is the share of toxic labels (0 if there are none); null or repeated ids and ties are
scored row by row; an empty table gives an empty result; further columns are ignored (and kept by ``not_toxic``).
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm import labelled
from loglens.llm.common import prepare

#: documents with label 0 and 1 in the sample, characters of each, and documents of each class in the calibration
PER_CLASS, MOST_CHARS, CHECKED = (5_000, 3_000), 20_000, 1_500
FOLDS = 2
CUTOFF = 0.3
WINDOW, STEP, GAIN = 96, 72, 1
#: share of the largest possible gain from which a word counts as found whole
WHOLE = 0.75
#: bytes of the ordinary dictionary, and of one document's stretch in it
ORDINARY_BYTES, STRETCH = 16_384, 256
#: telling grams (bytes of words with their bounds) have at least so many contexts in toxic text, and so many times
#: the rate of ordinary text (the calibration chooses)
GRAM, CONTEXTS, TIMES = 5, 8, (10.0, 30.0)
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: letters (every byte beyond ASCII counts as one)
BARE = re.compile(rb"[a-z\x80-\xff]+")
#: Stands behind words and windows, and twice at the end of both dictionaries: the library starts no match in the last
#: eight bytes of its input, indexes none there in a dictionary, and leaves very short inputs as they are.
PAD = bytes(x for x in range(1, 32) if x not in (9, 10, 11, 12, 13))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]


def compressor(content: bytes):
    import zstandard as zs

    how = zs.ZstdCompressionParameters(window_log=max(17, (len(content) + WINDOW).bit_length() + 1), chain_log=15, hash_log=15, search_log=4, min_match=4, target_length=32, strategy=zs.STRATEGY_GREEDY,
                                       write_content_size=0, write_dict_id=0, write_checksum=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
    words = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(dict_data=words, compression_params=how)


class Windows:
    """Gains of the toxic over the ordinary dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        end = b"\x00" + PAD + PAD
        # windows: the ordinary part at the same distance in both, so that ordinary text comes out alike
        self.plain, self.toxic = (compressor(x + end).compress for x in (ordinary, toxic + ordinary))
        # words: the toxic part nearest, so that references to it are short
        self.plain_word, self.toxic_word = self.plain, compressor(ordinary + toxic + end).compress
        self.words: dict[bytes, tuple[int, bool]] = {}
        self.least = min((len(self.toxic_word(b" " + w + b" " + PAD)) for w in toxic.split()), default=0)

    def word(self, word: bytes) -> tuple[int, bool]:
        """A word's gain, and whether it is most of what a word found whole would gain."""
        got = self.words.get(word)
        if got is None:
            size = len(self.plain_word(b" " + word + b" " + PAD))
            gain = size - len(self.toxic_word(b" " + word + b" " + PAD))
            got = max(0, gain), gain >= max(2, WHOLE * (size - self.least))
            if len(self.words) < 100_000:
                self.words[word] = got
        return got

    def features(self, text: str) -> tuple[float, ...]:
        data = b" " + text.lower().encode() + b" "
        plain, toxic = self.plain, self.toxic
        best, gaining, words = 0, 0, set()
        for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP):
            part = data[i:i + WINDOW]
            padded = part + PAD
            d = len(plain(padded)) - len(toxic(padded))
            if d >= GAIN:
                gaining += 1
                best = max(best, d)
                words.update(BARE.findall(part))
        found = sorted((self.word(w) for w in words if len(w) < WINDOW), reverse=True)
        gains = [g for g, _ in found[:3]] + [0, 0, 0]
        whole = sum(w for _, w in found)
        return float(best), float(gains[0]), float(sum(gains[:3])), float(whole > 0), float(np.log1p(whole)), float(np.log1p(gaining))


N_FEATURES = 6


def _contexts(texts: list[str]) -> tuple[dict[bytes, int], int]:
    """For every word the number of different words before it or after it, whichever is less (so the copies of a
    passage count once), and the number of words in all.  Words are numbered, and contexts are pairs of numbers."""
    number: dict[bytes, int] = {b"": 0}
    parts = [np.zeros(1, dtype=np.int64)]
    for t in texts:
        words = (BARE.search(w) or WORD.search(w) for w in WORD.findall(t.lower().encode()))
        parts.append(np.array([*(number.setdefault(m[0], len(number)) for m in words), 0], dtype=np.int64))
    row = np.concatenate(parts)
    at = np.flatnonzero(row)
    least = None
    for side in (-1, 1):
        pairs = np.unique(row[at] * len(number) + row[at + side])
        seen = np.bincount(pairs // len(number), minlength=len(number))
        least = seen if least is None else np.minimum(least, seen)
    return {w: n for w, n in zip(number, least.tolist()) if w}, max(len(at), 1)


def _stretch(text: str) -> bytes:
    """STRETCH bytes of a text from a place fixed by its content."""
    data = text.lower().encode()
    at = zlib.crc32(data) % max(1, len(data) - STRETCH + 1)
    return data[at:at + STRETCH]


def _grams(word: bytes) -> set[bytes]:
    bounded = b" " + word + b" "
    return {bounded[i:i + GRAM] for i in range(max(1, len(bounded) - GRAM + 1))}


@dataclass
class Counts:
    """What the dictionaries are made from: contexts of words and of their grams in toxic and ordinary text."""

    bad: dict[bytes, int]
    good: dict[bytes, int]
    bad_grams: dict[bytes, int]
    good_grams: dict[bytes, int]
    rate: float  # words of toxic text for one of ordinary text
    ordinary: bytes


def _counts(rows: list[tuple[str, int]]) -> Counts:
    toxic, plain = ([t for t, y in rows if y == k] for k in (1, 0))
    (bad, bad_total), (good, good_total) = _contexts(toxic), _contexts(plain)
    grams: list[dict[bytes, int]] = []
    for words in (bad, good):
        grams.append(found := defaultdict(int))
        for w, n in words.items():
            for g in _grams(w):
                found[g] += n
    ordinary = b"\n".join(map(_stretch, plain[:ORDINARY_BYTES // STRETCH]))
    good = {w: good[w] for w in bad if w in good}  # no other word is asked for
    return Counts(bad, good, *grams, bad_total / good_total, ordinary[:ORDINARY_BYTES])


def _dictionaries(c: Counts, times: float) -> tuple[bytes, bytes]:
    telling = {g for g, n in c.bad_grams.items() if n >= CONTEXTS and n > times * c.rate * (c.good_grams.get(g, 0) + 0.5)}
    words = [w for w, n in c.bad.items() if len(w) < WINDOW and n > times * c.rate * c.good.get(w, 0) and not telling.isdisjoint(_grams(w))]
    words.sort(key=lambda w: (c.bad[w], w))  # the most frequent ones last, nearest to what is compressed
    return c.ordinary, b" " + b" ".join(words) + b" " if words else b""


def fit(rows: list[tuple[str, int]], sizes: dict[int, int]) -> Model:
    """``rows``: (text, label) in a random order.  Each fold is scored with the dictionaries of the others: that
    calibrates the model and chooses its ``TIMES``.  The model's dictionaries come from all rows."""
    known = sum(sizes.values())
    classes = [[r for r in rows if r[1] == label] for label in (0, 1)]
    folds = [[r for c in classes for r in c[k::FOLDS]] for k in range(FOLDS)]  # each with its share of both classes
    if any({y for _, y in f} != {0, 1} for f in folds):
        share = sizes.get(1, 0) / known if known else 0.0
        return Model(b"", b"", [0.0] * N_FEATURES + [float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))])
    x, y = {t: [] for t in TIMES}, []
    for k, fold in enumerate(folds):
        counts = _counts([r for j, f in enumerate(folds) if j != k for r in f])
        checked = [r for label in (1, 0) for r in [r for r in fold if r[1] == label][:CHECKED // FOLDS]]
        y += [float(v) for _, v in checked]
        for times in TIMES:
            windows = Windows(*_dictionaries(counts, times))
            x[times] += [windows.features(t) for t, _ in checked]
        del counts
    found = []
    for times in TIMES:
        w = labelled.fit_logistic(np.array(x[times]), np.array(y))
        p = labelled.sigmoid(np.array(x[times]) @ w[:-1] + w[-1])
        found.append((-float(np.where(np.array(y) == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12)).mean()), times, w))
    _, times, w = min(found, key=lambda f: f[:2])
    w[-1] += labelled.prior_shift(sizes, {k: sum(v == k for v in y) for k in (0, 1)})
    return Model(*_dictionaries(_counts(rows), times), w.tolist())


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: tuple[int, int] = PER_CLASS) -> Model:
    prepare(docs)
    return fit(*labelled.sample(docs, labels, label_col, learnable, per_class, MOST_CHARS, id_col, text_col))


def _scores(model: Model, column: str, returned: list[str], below: float | None = None):
    """Batches -> the returned columns and ``score``; with ``below`` only the rows scored below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, w = Windows(model.ordinary, model.toxic), np.array(model.weights)
        for b in batches:
            x = np.array([windows.features(t or "") for t in b[column].to_pylist()]).reshape(-1, N_FEATURES)
            got = labelled.sigmoid(x @ w[:-1] + w[-1])
            out = pa.RecordBatch.from_arrays([*[b[c] for c in returned], pa.array(got)], names=[*returned, "score"])
            yield out if below is None else out.filter(pa.array(got < below))

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(id_col, score, predicted) of every whole text."""
    prepare(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    out = rows.mapInArrow(_scores(model, "body", ["id"]), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, model: Model, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` scored below the cutoff, all columns as they were."""
    prepare(docs)
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    rows = docs.toDF(*at.values())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", score double"
    return rows.mapInArrow(_scores(model, at[text_col], rows.columns, cutoff), schema).drop("score").toDF(*names)
