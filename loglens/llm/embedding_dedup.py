"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised and projected on Gaussian directions; each projection is shifted, divided by a width
and rounded down, and ``k`` of them make a bucket of one of ``L`` tables.  ``k`` and ``L`` follow from the number
of distinct vectors and the target recall at the threshold (``plan_tables``), so nothing is capped: buckets of
any size are compared, in blocks.  Inside buckets an 8-bit copy of the vectors filters pairs (with a margin
wider than its error); what passes forms candidate classes, and all pairs within a class are then decided by
their cosine in double precision.

Equal vectors are one node with a count, so a vector that makes up a third of all rows is compared once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing
and are their own component; vectors of different lengths never link; rows with a null id link with nothing
(component null, kept); repeated rows link to each other like any equal vectors; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm import linkage
from loglens.llm.common import prepare

THRESHOLD, RECALL, WIDTH = 0.9, 0.999, 2.0
#: unrelated vectors expected in a bucket, and the most that are compared in one group
BUCKET, BLOCK = 32, 256
#: how far the cosine of 8-bit copies may lie below the exact one
MARGIN = 0.03


def collision(distance: float, width: float) -> float:
    """Probability that two vectors at a Euclidean distance share one quantised projection."""
    s = width / distance
    tail = 0.5 * math.erfc(s / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * s) * (1 - math.exp(-s * s / 2))


def plan_tables(n: int, threshold: float, recall: float, width: float) -> tuple[int, int]:
    """(k, L): enough projections that unrelated vectors rarely meet, enough tables for the recall."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(1, round(math.log(max(n / BUCKET, 1)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _hash_tables(k: int, tables: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = {}
        for b in batches:
            vectors = b["v"]
            sizes = np.diff(vectors.offsets.to_numpy())
            node = b["node"].to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.asarray(vectors.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(len(rows), size)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that the norm neither overflows nor vanishes
                small = np.rint(x * 127).astype(np.int8)  # one scale for each vector
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if size not in drawn:
                    rng = np.random.default_rng([seed, int(size)])
                    drawn = {size: (rng.standard_normal((size, k * tables)), rng.uniform(0, width, k * tables),
                                    rng.integers(1, 2**63, (tables, k), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, tables, dtype=np.uint64))}
                lines, shift, odd, start = drawn[size]
                step = max(1, 1_000_000 // (k * tables))
                for i in range(0, len(rows), step):
                    cell = np.floor((x[i:i + step] @ lines + shift) / width).astype(np.int64).astype(np.uint64).reshape(-1, tables, k)
                    keys = ((cell * odd).sum(axis=2) + start) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(29)
                    m = len(keys)
                    at = pa.array(np.arange(m + 1) * tables, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[rows[i:i + step]]), pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1).view(np.int64))), pa.array([r.tobytes() for r in small[i:i + step]], pa.binary())],
                        names=["node", "keys", "small"])

    return run


def _small_links(threshold: float):
    """Stars of the members of each bucket whose 8-bit copies are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in linkage.grouped(batches, ["key", "bi", "bj"]):
            node, own = t["node"].to_numpy(), t["own"].to_numpy()
            bi, bj = t["bi"].to_numpy(), t["bj"].to_numpy()
            small = t["small"].to_pylist()
            out_a, out_b = [], []
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                if e - s < 2 or len({len(x) for x in small[s:e]}) > 1:
                    continue  # vectors of different lengths don't share buckets but by chance
                x = np.frombuffer(b"".join(small[s:e]), dtype=np.int8).reshape(e - s, -1).astype(np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                near = np.triu(x @ x.T >= threshold, 1)
                if bi[s] != bj[s]:
                    near &= own[s:e, None] != own[None, s:e]
                a, b = np.nonzero(near)
                if len(a):
                    root = linkage.star_roots(e - s, a, b)
                    moved = np.flatnonzero(root != np.arange(e - s))
                    out_a.append(node[s:e][moved])
                    out_b.append(node[s:e][root[moved]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return run


def _cosine_links(threshold: float):
    def links(g: pa.Table) -> np.ndarray | None:
        v = g["v"].combine_chunks()
        sizes = np.diff(v.offsets.to_numpy())
        linked = np.zeros((len(v), len(v)), dtype=bool)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            x = np.asarray(v.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(len(rows), size)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norm = np.linalg.norm(x, axis=1)
            linked[np.ix_(rows, rows)] = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
        return linked

    return links


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 recall: float = RECALL, width: float = WIDTH, seed: int = 5) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of ``vectors``."""
    prepare(vectors)
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col(id_col).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable, v).alias("v"))
    nodes = (rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
             .withColumn("node", F.monotonically_increasing_id()).checkpoint())  # the numbers hold from here on
    k, tables = plan_tables(nodes.count(), threshold, recall, width)
    hashed = nodes.select("node", "v").mapInArrow(_hash_tables(k, tables, width, seed), "node long, keys array<long>, small binary")
    buckets = linkage.bucket_rows(hashed.select("node", "small", F.explode("keys").alias("key")), "key", "node", BLOCK)
    near = linkage.by_group(buckets, ["key", "bi", "bj"]).mapInArrow(_small_links(threshold - MARGIN), "a long, b long")
    classes = linkage.components(near)
    members = classes.join(nodes, "node")
    found = linkage.class_links(members, ["v"], _cosine_links(threshold))
    found = found.select("node", "links", F.col("root").alias("part"))
    nodes = nodes.join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = nodes.groupBy("part").agg(F.min("least").alias("component"))
    nodes = nodes.join(least, "part").select(F.col("v").alias("nv"), "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    # equality of arrays treats null as no match, so unusable rows pass through unlinked
    out = rows.join(nodes, F.col("v") == F.col("nv"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
