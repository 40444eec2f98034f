"""Token counts with a whole-token shortcut.

A sentencepiece model without inner-space pieces never merges across the start of a run of spaces, and never
across a line end when no piece contains one; both are read off the vocabulary (``cuts``).  A text therefore
falls into pre-tokens whose counts add up.  ``whole_tokens`` proves, by encoding every vocabulary string once,
which pre-tokens are a single token; those are counted by look-up and only the rest is merged by the library
(and remembered, up to a bounded number of pre-tokens per worker).

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are counted one by one, so null or
repeated ids and ties do no harm; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import body, prepare

SPACE = "▁"
#: pre-tokens that a worker remembers besides the whole tokens
REMEMBERED = 400_000


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def whole_tokens(model: bytes) -> list[str]:
    """The words (without their leading space mark) that the library encodes alone as one token."""
    sp = _processor(model)
    pieces = [sp.id_to_piece(i) for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    words = [p[1:] for p in pieces if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:]]
    return [w for w, ids in zip(words, sp.encode(words, num_threads=1)) if len(ids) == 1]


def cuts(model: bytes) -> tuple[bool, bool]:
    """Whether texts may be cut before runs of spaces, and around line ends: no piece lies across."""
    sp = _processor(model)
    pieces = [sp.id_to_piece(i) for i in range(len(sp))]
    at_space = all(SPACE not in p.lstrip(SPACE) for p in pieces) and len(sp.encode("a")) >= 1
    at_line = all("\n" not in p for p in pieces) and len(sp.encode("\n")) == 2
    keeps_spaces = sp.decode(sp.encode("a  b \n c")) == "a  b \n c"
    return at_space and keeps_spaces, at_space and keeps_spaces and at_line


class PreTokenCounts(dict):
    """Counts by pre-token (a key is what follows the first space mark); unknown ones are merged on demand."""

    def __init__(self, model: bytes, known: list[str], by_line: bool, remembered: int = REMEMBERED):
        super().__init__(dict.fromkeys(known, 1))
        self.sp, self.by_line, self.most = _processor(model), by_line, remembered + len(known)
        self.after_line: dict[str, int] = {}
        self[""] = 1  # the space mark alone

    def __missing__(self, key: str) -> int:
        if self.by_line and "\n" in key:  # line ends are tokens of their own
            first, *others = key.split("\n")
            return self[first] + sum(1 + (self._tail(x) if x else 0) for x in others)
        n = len(self.sp.encode(key))
        if len(self) + len(self.after_line) < self.most:
            self[key] = n
        return n

    def _tail(self, part: str) -> int:
        n = self.after_line.get(part)
        if n is None:
            n = len(self.sp.encode("\n" + part)) - 2  # without the space mark and the line end
            if len(self) + len(self.after_line) < self.most:
                self.after_line[part] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " not in text and text[-1] != " " and text[0] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        return sum(map(self.__getitem__, (x[1:] for x in re.findall(" +[^ ]+| +$", " " + text))))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit): tokens of every whole text, as the library counts them."""
    spark = prepare(docs)
    with open(model_path, "rb") as f:
        model = f.read()
    by_space, by_line = cuts(model)
    known = whole_tokens(model) if by_space else []
    shared = spark.sparkContext.broadcast((model, known))  # the vocabulary: a few MB whatever the table holds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = PreTokenCounts(*shared.value, by_line)
        one = counts.count if by_space else lambda t: len(counts.sp.encode(t))
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n_bytes": b["n_bytes"], "n_tokens": pd.Series([one(t) for t in b["body"]], dtype="int64")})

    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(body(text_col)).cast("long").alias("n_bytes"), body(text_col).alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
