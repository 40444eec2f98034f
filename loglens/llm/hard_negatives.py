"""Hard-negative mining: integer inner products of anchors with all rows by Strassen's multiplication, kept in heaps.

Components are quantised to integers.  Anchors lie in numbered blocks of bounded size in the shared folder; tasks go
through their candidates in tiles, multiply each tile with one anchor block after the other (Strassen's recursion on
int64 matrices padded with zeros, exact additions only), and keep per anchor a heap of its best rows.  Heaps merge:
tile into task, tasks by a window that Spark limits before its shuffle.  A first pass finds every anchor's positives,
the best other rows of its label.  A second one finds, for each anchor and positive, the best rows of other labels
whose score lies in a window below the positive's score.

Scale: the query set against all rows is quadratic by its definition; what is held by a task is one anchor block, one
span of candidates and one tile of scores.  No vector is shuffled but to spread a few large input files, no label or
anchor forms a group of rows, and what leaves a task is at most ``heap`` rows per anchor, positive and span.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part.  Vectors
of different lengths don't score with each other; empty vectors score 0 with each other.  Quantised components beyond
``2 ** 24`` in size are taken at that size, so that scores of up to 8,192 components fit 64 bits.  Ties go to the smaller
id.  Rows that share an id are rows of their own, except that a row is no positive of an anchor of its own id; each
anchor row gets its own results.  An anchor without positives, or a positive without negatives, gives no row.  An
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import prepare
from loglens.operators.blocks import Blocks, write_blocks

SCALE, HEAP = 256, 5
#: bounds of a negative's score, in hundredths of the positive's
LOW, HIGH = 80, 100
#: anchors in a block, candidates in a tile and in a span (the rows a task holds)
ANCHORS, TILE, SPAN = 512, 2048, 32_768
#: anchor-candidate cells that make a task of their own, and candidates that one has at least
TASK_CELLS, TASK_ROWS = 1 << 23, 4096
#: matrices of at most this extent are multiplied outright
LEAF = 32
MOST = 1 << 24
NONE = np.iinfo(np.int64).min


# ------------------------------------------------------------ inside tasks
def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of integer matrices by seven products of halves; odd extents are padded with zeros."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    a, b = _even(a), _even(b)
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    out = np.empty((2 * h, 2 * j), dtype=np.int64)
    c11, c12, c21, c22 = out[:h, :j], out[:h, j:], out[h:, :j], out[h:, j:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:n, :m]


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2))) if x.shape[0] % 2 or x.shape[1] % 2 else x


class Heaps:
    """Per row the ``size`` best (score, id): higher scores first, ties by the smaller id; NONE where there are fewer."""

    def __init__(self, rows: int, size: int):
        self.score = np.full((rows, size), NONE)
        self.ident = np.zeros((rows, size), dtype=np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Merges the allowed cells of a tile, whose ids ascend."""
        size, at = self.score.shape[1], np.arange(len(scores))
        left = np.where(allowed, scores, NONE)
        # rows whose best cell cannot enter are done
        live = at[left.max(axis=1, initial=NONE) >= np.maximum(self.score[:, -1], NONE + 1)]
        if not len(live):
            return
        left, here = left[live], np.arange(len(live))
        score, ident = np.full((len(live), size), NONE), np.zeros((len(live), size), dtype=np.int64)
        for k in range(size):
            best = left.argmax(axis=1)  # the first of equal ones: the smallest id
            score[:, k], ident[:, k] = left[here, best], ids[best]
            left[here, best] = NONE
        score, ident = np.hstack([self.score[live], score]), np.hstack([self.ident[live], ident])
        order = np.lexsort((ident, -(score + 1)), axis=1)[:, :size]  # NONE + 1 can be negated
        self.score[live], self.ident[live] = np.take_along_axis(score, order, axis=1), np.take_along_axis(ident, order, axis=1)


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b["v"]
            x = np.floor(np.asarray(v.flatten(), dtype=np.float64) * scale).clip(-MOST, MOST).astype(np.int32)
            offsets = v.offsets.to_numpy()
            quantised = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["anchor"], quantised], names=["id", "label", "anchor", "q"])

    return run


def _by_length(t: pa.Table | pa.RecordBatch, order: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, int64 matrix) for the vectors of every length in a table."""
    q = t["q"].combine_chunks() if isinstance(t, pa.Table) else t["q"]
    sizes = np.diff(q.offsets.to_numpy())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size) if order is None else order[sizes[order] == size]
        yield int(size), rows, np.asarray(q.take(pa.array(rows)).flatten(), dtype=np.int64).reshape(len(rows), size)


def _labels(t: pa.Table) -> np.ndarray:
    return t["label"].to_numpy(zero_copy_only=False) if not isinstance(t, pa.Table) else t["label"].to_numpy()


def _anchors(t: pa.Table) -> list[dict]:
    found = []
    for size, rows, m in _by_length(t):
        part = t.take(pa.array(rows))
        one = {"size": size, "m": m, "no": part["no"].to_numpy(), "id": part["id"].to_numpy(), "label": _labels(part)}
        if "low" in t.column_names:
            one |= {k: np.array(part[k].to_pylist(), dtype=np.int64) for k in ("low", "high")}
        found.append(one)
    return found


def _mine(blocks: Blocks, heap: int, windows: bool):
    """Candidates (id, label, q) -> the heaps of the anchors: (no, place, score, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = blocks.reader(_anchors)

        def span(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, labels = t["id"].to_numpy(), _labels(t)
            candidates = {size: (rows, np.ascontiguousarray(m.T)) for size, rows, m in _by_length(t, np.argsort(ids, kind="stable"))}
            for block in each():
                for a in block:
                    if a["size"] not in candidates:
                        continue
                    rows, m = candidates[a["size"]]
                    heaps = [Heaps(len(a["no"]), heap) for _ in range(a["low"].shape[1] if windows else 1)]
                    for i in range(0, len(rows), TILE):
                        at = rows[i:i + TILE]
                        scores = strassen(a["m"], m[:, i:i + TILE])
                        same = a["label"][:, None] == labels[at][None, :]
                        if not windows:
                            heaps[0].offer(scores, ids[at], same & (a["id"][:, None] != ids[at][None, :]))
                        else:
                            for k, h in enumerate(heaps):
                                h.offer(scores, ids[at], ~same & (scores >= a["low"][:, k, None]) & (scores <= a["high"][:, k, None]))
                    for k, h in enumerate(heaps):
                        r, c = np.nonzero(h.score > NONE)
                        if len(r):
                            yield pa.RecordBatch.from_arrays([pa.array(a["no"][r]), pa.array(np.full(len(r), k, dtype=np.int32)), pa.array(h.score[r, c]), pa.array(h.ident[r, c])],
                                                             names=["no", "place", "score", "other"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SPAN:
                yield from span(pa.Table.from_batches(held).combine_chunks())
                held = []
        if held:
            yield from span(pa.Table.from_batches(held).combine_chunks())

    return run


def _limits(positives: list, low: int, high: int) -> list[tuple[int, int]]:
    return [(-(-low * p // 100), high * p // 100) for p in positives]


def _windows(heap: int, low: int, high: int):
    """Adds each anchor's score windows, an empty one where it has no such positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limits = [(_limits(p, low, high) + [(1, 0)] * heap)[:heap] for p in b["scores"].to_pylist()]
            sides = [pa.array([[x[side] for x in row] for row in limits], pa.list_(pa.int64())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([b["no"], b["id"], b["label"], b["q"], *sides], names=["no", "id", "label", "q", "low", "high"])

    return run


# ------------------------------------------------------------ frames
def _merged(found: DataFrame, heap: int) -> DataFrame:
    """The heaps of all tasks as one: (no, place, rank, score, other).  The limit on the rank also holds before the shuffle."""
    w = Window.partitionBy("no", "place").orderBy(F.col("score").desc(), F.col("other").asc())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= heap)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         scale: int = SCALE, positives: int = HEAP, negatives: int = HEAP, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the columns of ``vectors``; ids are whole numbers, labels numbers or texts."""
    spark = prepare(vectors)
    kind = vectors.schema[id_col].dataType.simpleString()
    label_kind = vectors.schema[label_col].dataType.simpleString()
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite
    rows = vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    n, anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    rows = rows.mapInArrow(_quantise(scale), f"id long, label {label_kind}, anchor boolean, q array<int>")
    tasks = min(-(-n * anchors // TASK_CELLS), -(-n // TASK_ROWS))
    if tasks > rows.rdd.getNumPartitions():
        rows = rows.repartition(tasks)
    rows = rows.withColumn("no", F.monotonically_increasing_id()).checkpoint()  # the numbers hold from here on
    chosen = rows.filter("anchor").select("no", "id", "label", "q")
    candidates = rows.select("id", "label", "q")
    found = "no long, place int, score long, other long"
    size = 64 << 20

    blocks, _ = write_blocks(chosen, ANCHORS, size)
    best = _merged(candidates.mapInArrow(_mine(blocks, positives, False), found), positives).checkpoint()

    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])  # at most ``positives`` entries
    held = best.groupBy("no").agg(scores.alias("scores"))
    wide = chosen.join(held.withColumnRenamed("no", "at"), F.col("no") == F.col("at")).select("no", "id", "label", "q", "scores")
    wide = wide.mapInArrow(_windows(positives, low, high), f"no long, id long, label {label_kind}, q array<int>, low array<long>, high array<long>")
    blocks, _ = write_blocks(wide, ANCHORS, size)
    hard = _merged(candidates.mapInArrow(_mine(blocks, negatives, True), found), negatives)

    first = best.select(F.col("no").alias("pn"), (F.col("rank") - 1).alias("pp"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(first, (F.col("no") == F.col("pn")) & (F.col("place") == F.col("pp")))
    named = chosen.select(F.col("no").alias("an"), F.col("id").alias("anchor_id"))
    out = out.join(named, F.col("no") == F.col("an"))
    return out.select(F.col("anchor_id").cast(kind), F.col("positive_id").cast(kind), "rank", F.col("other").cast(kind).alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))
