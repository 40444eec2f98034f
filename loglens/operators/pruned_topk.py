"""Exact top-k by cosine that reads only the blocks which can matter.

The prototypes (any number) are ordered by their nearest of a few pivots and the angle to it, so that a block of
consecutive ones lies together, and written as blocks of bounded size in the shared folder.  Of every block the centre
and the greatest angle from it to a member (its radius) are kept in a small table beside them.  Angles obey the
triangle inequality: no member of a block is nearer to a vector than the centre's angle less the radius.  A task
meets the blocks in the order of these bounds and stops for a row as soon as no block left can beat its k-th best; a
block that no row of the batch needs is not read at all.  The result is that of the full scan, ties included.

What reaches the driver: the pivots (a fixed number of vectors) and the list of files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.config import ship_package
from loglens.operators.blocks import Blocks, write_blocks
from loglens.operators.scoring import BLOCK_BYTES, _unit_rows

PIVOTS, BLOCK_PROTOS = 64, 16_384
#: rows that go through the blocks together
ROWS = 2048
#: an angle's slack for rounding (arccos is steep near 1: 1e-16 in a cosine is 1e-8 there)
SLACK = 1e-7


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cos = _unit_rows(_vectors(b["vec"])) @ pivots.T
            pivot = cos.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b["id"], b["vec"], pa.array(pivot.astype(np.int32)), pa.array(_angle(cos[np.arange(len(cos)), pivot]))], names=["id", "vec", "pivot", "angle"])

    return run


def _summaries(stored: Blocks):
    """Numbers of blocks -> (block, centre, radius)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no in b["block"].to_pylist():
                for m in Blocks(stored.folder, (stored.names[no],)).reader(lambda t: _unit_rows(_vectors(t["vec"])))():
                    centre = _unit_rows(m.mean(axis=0, keepdims=True))[0]
                    yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(_angle(m @ centre).max())])],
                                                     names=["block", "centre", "radius"])

    return run


def write_ordered(protos: DataFrame, id_col: str, vec_col: str, block_rows: int = BLOCK_PROTOS, pivots: int = PIVOTS) -> tuple[Blocks, Blocks]:
    """The prototypes as ordered blocks, and the blocks' (block, centre, radius)."""
    spark = protos.sparkSession
    ship_package(spark)
    rows = protos.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vec").collect()  # a fixed number of vectors
    kind = rows.schema["vec"].dataType.simpleString()
    if not some:
        return write_blocks(rows, block_rows, BLOCK_BYTES)[0], write_blocks(rows, block_rows, BLOCK_BYTES)[0]
    near = rows.mapInArrow(_nearest(_unit_rows(np.array([r["vec"] for r in some], dtype=np.float64))), f"id long, vec {kind}, pivot int, angle double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = near.repartitionByRange(parts, "pivot", "angle", "id").sortWithinPartitions("pivot", "angle", "id").select("id", "vec")
    stored, _ = write_blocks(ordered, block_rows, BLOCK_BYTES)
    numbers = spark.range(len(stored.names)).select(F.col("id").cast("int").alias("block"))
    summary, _ = write_blocks(numbers.mapInArrow(_summaries(stored), "block int, centre array<double>, radius double"), 1 << 30, 1 << 40)
    return stored, summary


def cosine_topk(df: DataFrame, protos: DataFrame, k: int, id_col: str = "session_id", vec_col: str = "vec", proto_id_col: str = "proto_id",
                proto_vec_col: str = "vec", block_rows: int = BLOCK_PROTOS, pivots: int = PIVOTS, rows: int = ROWS, skipped=None) -> DataFrame:
    """The ``k`` most similar prototypes per row: (id, rank, proto_id, cos), as ``scoring.cosine_topk`` gives them: ties
    go to the smaller prototype id, a zero vector has cosine 0 with all.  Vectors are finite and of one length.

    ``skipped``: an accumulator to which the number of (row, block) pairs that were not compared is added."""
    stored, summary = write_ordered(protos, proto_id_col, proto_vec_col, block_rows, pivots)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("rank", T.LongType()), T.StructField(proto_id_col, T.LongType()), T.StructField("cos", T.DoubleType())])
    if not stored.names:
        return df.sparkSession.createDataFrame([], schema)

    def block(no: int) -> tuple[np.ndarray, np.ndarray]:
        for t in Blocks(stored.folder, (stored.names[no],)).reader(lambda t: t)():
            ids = t["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            return ids[order], _unit_rows(_vectors(t["vec"]))[order]
        raise ValueError(f"block {no} is empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(summary.reader(lambda t: t)())
        number = np.concatenate([t["block"].to_numpy() for t in tables])
        centre = np.concatenate([_vectors(t["centre"]) for t in tables])
        radius = np.concatenate([t["radius"].to_numpy() for t in tables])
        held: dict[int, tuple] = {}
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                v = _unit_rows(_vectors(part["vec"]))
                nearest = _angle(v @ centre.T) - radius[None, :] - SLACK  # no member is nearer than that
                nearest[~v.any(axis=1)] = 0.0  # a zero vector is as near to all
                cos, pid = np.full((len(v), k), -np.inf), np.full((len(v), k), np.iinfo(np.int64).max)
                compared = 0
                for at in np.argsort(nearest.min(axis=0), kind="stable"):
                    best = np.cos(np.clip(nearest[:, at], 0.0, np.pi))
                    need = np.flatnonzero((best >= cos[:, -1]) | ~np.isfinite(cos[:, -1]))
                    if not len(need):
                        continue
                    if number[at] not in held:
                        held.clear()
                        held[number[at]] = block(int(number[at]))
                    ids, m = held[number[at]]
                    compared += len(need)
                    sims = v[need] @ m.T
                    kk = min(k, len(ids))
                    # the k largest, the smaller id first where they are equal (ids ascend)
                    top = np.argsort(-sims, axis=1, kind="stable")[:, :kk]
                    some_cos = np.hstack([cos[need], np.take_along_axis(sims, top, axis=1)])
                    some_pid = np.hstack([pid[need], ids[top]])
                    order = np.lexsort((some_pid, -some_cos), axis=-1)[:, :k]
                    cos[need], pid[need] = np.take_along_axis(some_cos, order, axis=1), np.take_along_axis(some_pid, order, axis=1)
                if skipped is not None:
                    skipped.add(len(v) * len(number) - compared)
                r, c = np.nonzero(np.isfinite(cos))
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(r)), pa.array(c + 1), pa.array(pid[r, c]), pa.array(cos[r, c])], names=[id_col, "rank", proto_id_col, "cos"])

    return df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).mapInArrow(run, schema)
