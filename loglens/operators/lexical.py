"""Built-in lexical encoder: term-frequency vectors and their cosine.

The cosine of two texts is the sum over shared tokens of the products of their counts, over the product of the two
norms.  The right side (a taxonomy or a table of passages, of any size) is counted by tasks and written as numbered
blocks of bounded rows and bytes in the shared folder; nothing of it reaches the driver.  The left texts are scored
where they are, in narrow kernels that go through the blocks one after the other: no shuffle, no row for a pair of
texts, and a worker holds one block.

A block is held as sparse postings (token -> texts and counts).  Its ``FREQUENT`` most frequent tokens are also kept as
a dense matrix of that many rows, whose product with a batch gives part of every score at once; what the other, short
posting lists can add is bounded by the norms of the rest (Cauchy-Schwarz).  The best match is therefore exact
although only texts whose bound reaches the best partial score are finished, and a block whose vocabulary holds too
little of a text to beat its best so far is skipped for that text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loglens.operators.blocks import write_blocks

# Tokens: maximal runs of Unicode letters/digits, after lower-casing.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# right-hand texts in one block, by number and by the bytes of their tokens and counts
BLOCK_ROWS, BLOCK_BYTES = 16_384, 64 << 20
# tokens of a block that are kept densely
FREQUENT = 64
# cells of one (left texts x right texts) score matrix, left texts counted together
STEP_CELLS, STEP_ROWS = 2_000_000, 1024
# left tokens that meet the blocks together where there are several blocks
HELD_TOKENS = 4_000_000


def tokens(text_col: str):
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)


# ------------------------------------------------------------ inside tasks
def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, code) of every token, and the distinct tokens; null lists are empty."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), size), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()


class Counts:
    """Token counts of a batch of texts: sorted (row, code, count), the distinct tokens, squared norms."""

    def __init__(self, lists: pa.Array):
        row, code, self.words = _flat(lists)
        n = max(1, len(self.words))
        key, times = np.unique(row * n + code, return_counts=True)
        self.rows, self.row, self.code, self.times = len(lists), key // n, key % n, times.astype(np.float64)
        self.square = np.bincount(self.row, self.times**2, minlength=self.rows)


class Postings:
    """A block of right-hand texts (columns) by token."""

    def __init__(self, terms: pa.Array, times: pa.Array, frequent: int = FREQUENT):
        col, code, words = _flat(terms)
        tf = np.asarray(times.flatten(), dtype=np.float64)
        self.columns, self.number = len(terms), {w: i for i, w in enumerate(words)}
        self.norm = np.sqrt(np.bincount(col, tf**2, minlength=self.columns))
        size = np.bincount(code, minlength=len(words))
        self.place = np.full(len(words), -1)  # row of the dense part
        dense = np.argsort(-size, kind="stable")[:frequent]
        self.place[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), self.columns))
        often = self.place[code] >= 0
        self.dense[self.place[code[often]], col[often]] = tf[often]
        rare = ~often
        order = np.argsort(code[rare], kind="stable")
        self.col, self.tf = col[rare][order], tf[rare][order]
        self.size = np.where(self.place >= 0, 0, size)
        self.start = np.cumsum(self.size) - self.size
        self.rest = np.sqrt(np.bincount(self.col, self.tf**2, minlength=self.columns))

    def known(self, counts: Counts) -> np.ndarray:
        """Number here (or -1) of every distinct token of a batch."""
        return np.fromiter((self.number.get(w, -1) for w in counts.words), dtype=np.int64, count=len(counts.words))

    def partial(self, row: np.ndarray, token: np.ndarray, times: np.ndarray, rows: int) -> np.ndarray:
        """The frequent tokens' part of all products."""
        often = self.place[token] >= 0
        left = np.zeros((rows, len(self.dense)))
        left[row[often], self.place[token[often]]] = times[often]
        return left @ self.dense  # integer counts: exact

    def add_rest(self, dots: np.ndarray, row: np.ndarray, token: np.ndarray, times: np.ndarray, wanted: np.ndarray | None) -> None:
        """Adds the other tokens' part, where ``wanted``."""
        n = self.size[token]
        cuts = np.searchsorted(np.cumsum(n), np.arange(STEP_CELLS, int(n.sum()) + STEP_CELLS, STEP_CELLS))
        for a, z in zip([0, *cuts[:-1]], [*cuts[:-1], len(n)]):  # a bounded number of postings at a time
            size = n[a:z]
            if not size.sum():
                continue
            at = np.repeat(self.start[token[a:z]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            r, c, v = np.repeat(row[a:z], size), self.col[at], np.repeat(times[a:z], size) * self.tf[at]
            if wanted is not None:
                keep = wanted[r, c]
                r, c, v = r[keep], c[keep], v[keep]
            dots += np.bincount(r * self.columns + c, v, minlength=dots.size).reshape(dots.shape)

    def _steps(self, counts: Counts, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, row in the step, token here, count) of some texts at a time, with the tokens that this block has."""
        token = self.known(counts)[counts.code] if len(counts.code) else counts.code
        have = token >= 0
        row, token, times = counts.row[have], token[have], counts.times[have]
        rows = np.arange(counts.rows) if rows is None else rows
        step = max(1, STEP_CELLS // max(1, self.columns))
        starts, ends = np.searchsorted(row, np.arange(counts.rows)), np.searchsorted(row, np.arange(counts.rows), side="right")
        for lo in range(0, len(rows), step):
            some = rows[lo:lo + step]
            n = ends[some] - starts[some]
            at = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield some, np.repeat(np.arange(len(some)), n), token[at], times[at]

    def cosines(self, counts: Counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(texts, cosines with all columns), some texts at a time."""
        for some, row, token, times in self._steps(counts):
            dots = self.partial(row, token, times, len(some))
            self.add_rest(dots, row, token, times, None)
            den = np.sqrt(counts.square[some])[:, None] * self.norm[None, :]
            yield some, np.divide(dots, den, out=np.zeros_like(dots), where=den > 0)

    def best(self, counts: Counts, ids: np.ndarray, best: np.ndarray, cos: np.ndarray) -> dict[str, int]:
        """Raises ``cos`` to the best cosine of every text with this block and sets ``best`` to its id (equal cosines:
        the smaller id; columns are in the order of ids).  Returns how much was skipped."""
        told = {"texts": counts.rows, "skipped_texts": 0, "pairs": 0, "finished_pairs": 0}
        token = self.known(counts)[counts.code] if len(counts.code) else counts.code
        here = np.sqrt(np.bincount(counts.row[token >= 0], counts.times[token >= 0] ** 2, minlength=counts.rows))
        norm = np.sqrt(counts.square)
        # a cosine here is at most the share of the text's norm that this vocabulary holds
        live = np.flatnonzero((here > 0) & (here * (1 + 1e-9) >= cos * norm))
        told["skipped_texts"] = counts.rows - len(live)
        for some, row, token, times in self._steps(counts, live):
            dots = self.partial(row, token, times, len(some))
            den = norm[some][:, None] * self.norm[None, :]
            rare = np.sqrt(np.bincount(row[self.place[token] < 0], times[self.place[token] < 0] ** 2, minlength=len(some)))
            reach = np.maximum((dots / np.where(den > 0, den, np.inf)).max(axis=1), cos[some])
            wanted = (dots + rare[:, None] * self.rest[None, :]) * (1 + 1e-9) >= reach[:, None] * den
            told["pairs"] += wanted.size
            told["finished_pairs"] += int(wanted.sum())
            self.add_rest(dots, row, token, times, wanted)
            got = np.divide(dots, den, out=np.zeros_like(dots), where=(den > 0) & wanted)
            k = got.argmax(axis=1)
            top = got[np.arange(len(some)), k]
            better = top > cos[some]
            tie = np.flatnonzero((top == cos[some]) & (top > 0))
            better[tie] = ids[k[tie]] < best[some[tie]]
            best[some[better]], cos[some[better]] = ids[k[better]], top[better]
        return told


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the tokens of every text by its distinct tokens (``terms``) and their counts (``times``)."""
    for b in batches:
        for i in range(0, b.num_rows, STEP_ROWS):
            part = b.slice(i, STEP_ROWS)
            counts = Counts(part["toks"])
            ends = pa.array(np.searchsorted(counts.row, np.arange(counts.rows + 1)), pa.int32())
            words = pa.array(counts.words, pa.string()).take(pa.array(counts.code))
            keys = [n for n in part.schema.names if n != "toks"]
            yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(counts.times.astype(np.int32)))],
                                             names=[*keys, "terms", "times"])


def _stored(right: DataFrame, keys: list[str], text_col: str, most_rows: int, most_bytes: int, distinct: tuple[str, ...] = ()):
    """The right-hand texts as blocks of (keys, terms, times)."""
    from loglens.config import ship_package

    ship_package(right.sparkSession)
    rows = right.select(*keys, tokens(text_col).alias("toks"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return write_blocks(rows.mapInArrow(_counted, f"{kept}, terms array<string>, times array<int>"), most_rows, most_bytes, distinct)


def _spans(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.Table]:
    """Batches as they come; where each meets several blocks, some of them together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if not several or sum(len(x["_toks"].flatten()) for x in held) >= HELD_TOKENS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _parts(t: pa.Table) -> list[tuple[int, Counts]]:
    lists = t["_toks"].combine_chunks()
    return [(i, Counts(lists.slice(i, STEP_ROWS))) for i in range(0, len(lists), STEP_ROWS)]


# ------------------------------------------------------------ frames
def lexical_best(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str,
                 block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(left_id, right_id, cos): for every left text its best right text by cosine (ties: the smaller right id); left
    texts that share no token with any are absent.  Rows on the right without an id take no part; their ids are
    whole numbers or texts."""
    rows = right.where(F.col(right_id).isNotNull()).select(F.col(right_id).alias("id"), F.col(right_text).alias("text"))
    stored, _ = _stored(rows, ["id"], "text", block_rows, block_bytes)
    id_type = right.schema[right_id].dataType
    pa_type = to_arrow_type(id_type)
    schema = T.StructType([left.schema[left_id], T.StructField(right_id, id_type), T.StructField("cos", T.DoubleType())])

    def by_id(t: pa.Table) -> tuple[np.ndarray, Postings]:
        t = t.sort_by("id")
        return t["id"].to_numpy(), Postings(t["terms"].combine_chunks(), t["times"].combine_chunks())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = stored.reader(by_id)
        for t in _spans(batches, len(stored.names) > 1):
            parts = _parts(t)
            found = [(np.zeros(c.rows, dtype=object), np.zeros(c.rows)) for _, c in parts]
            for ids, postings in blocks():
                for (_, counts), (best, cos) in zip(parts, found):
                    postings.best(counts, ids, best, cos)
            if not parts:
                continue
            best, cos = (np.concatenate(x) for x in zip(*found))
            hit = pa.array(np.flatnonzero(cos > 0))
            kept = t[left_id].combine_chunks().take(hit)
            yield pa.RecordBatch.from_arrays([kept, pa.array(best[cos > 0].tolist(), pa_type), pa.array(cos[cos > 0])], names=[left_id, right_id, "cos"])

    if not stored.names:  # nothing on the right
        return left.sparkSession.createDataFrame([], schema)
    return left.select(F.col(left_id), tokens(left_text).alias("_toks")).mapInArrow(score, schema)


def lexical_similarities(
    df: DataFrame,
    prototypes: DataFrame,
    id_col: str = "session_id",
    text_col: str = "combined_prompt",
    max_broadcast_protos: int = BLOCK_ROWS,
):
    """Append ``{axis}_{kind}_sim`` arrays of lexical cosines (see ``scoring``).

    A narrow kernel, so the session rows are read once and keep their partitioning.  ``prototypes``: (category_type,
    ord, code, kind, text), of any number, in blocks of at most ``max_broadcast_protos``; only their categories, one
    array element each, reach the driver.
    """
    from loglens.operators import scoring

    keys = ["category_type", "ord", "code", "kind"]
    stored, found = _stored(prototypes, keys, "text", max_broadcast_protos, BLOCK_BYTES, tuple(keys))
    _, cats = scoring.categories_of(sorted(found.collect(), key=lambda r: (r["ord"], r["code"])))
    groups = [(axis, kind, code) for axis in scoring.AXES for kind in scoring.KINDS for code in cats[axis].codes]
    number = {g: i for i, g in enumerate(groups)}
    fields, at = [], 0
    for axis in scoring.AXES:
        for kind in scoring.KINDS:
            fields.append((scoring.sims_field(axis, kind), at, at + len(cats[axis].codes)))
            at = fields[-1][2]
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.ArrayType(T.DoubleType())) for n, _, _ in fields])
    names = df.columns

    def by_group(t: pa.Table) -> tuple[np.ndarray, np.ndarray, Postings]:
        of = np.array([number.get(g, -1) for g in zip(*(t[c].to_pylist() for c in ("category_type", "kind", "code")))], dtype=np.int64)
        order = np.argsort(of, kind="stable")
        order = order[of[order] >= 0]
        present, first = np.unique(of[order], return_index=True)
        t = t.take(pa.array(order))
        return present, first, Postings(t["terms"].combine_chunks(), t["times"].combine_chunks())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = stored.reader(by_group)
        for t in _spans(batches, len(stored.names) > 1):
            parts, best = _parts(t), np.full((t.num_rows, len(groups)), -np.inf)
            for present, first, postings in blocks():
                for lo, counts in parts:
                    for some, cos in postings.cosines(counts) if len(present) else ():
                        at = np.ix_(lo + some, present)
                        best[at] = np.maximum(best[at], np.maximum.reduceat(cos, first, axis=1))
            arrays = []
            for _, a, z in fields:
                ends = pa.array(np.arange(t.num_rows + 1) * (z - a), pa.int32())
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(best[:, a:z]).reshape(-1))))
            for b in pa.Table.from_arrays([*(t[n] for n in names), *arrays], names=[*names, *(n for n, _, _ in fields)]).to_batches():
                yield b

    return df.withColumn("_toks", tokens(text_col)).mapInArrow(score, schema), cats
