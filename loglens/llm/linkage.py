"""From candidate buckets to exact links: shared by the near-duplicate joins.

1. ``bucket_rows``: bucketed rows, large buckets dealt out in block pairs so that no group exceeds two blocks.
2. ``grouped`` / ``local_stars``: inside tasks, the pairs of a group that pass a filter become a star per
   connected part (at most one edge for each member), never the list of pairs.
3. ``components``: connected components of the edges by alternating large and small stars.
4. ``class_links``: the members of each candidate class, again in blocks, are compared exactly; every pair is
   evaluated once, and per member only the number of its links and its stars leave the task.

Nothing is collected to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import spread
from loglens.operators.sizes import BROADCAST_BYTES, broadcast_if_small


# ------------------------------------------------------------ inside tasks
def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by ``keys`` -> tables of whole groups, with the start of each group."""
    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if carry is not None:
            t = pa.concat_tables([carry, t]).combine_chunks()
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        if starts[-1]:
            yield t.slice(0, starts[-1]), starts[:-1]
        carry = t.slice(starts[-1])
    if carry is not None:
        yield carry, np.zeros(1, dtype=np.int64)


def star_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member connected to each of 0..n-1 by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)  # the old roots follow
        root = root[root]
        if (root == before).all():
            break
    return root


# ------------------------------------------------------------ frames
def bucket_rows(rows: DataFrame, key: str, node: str, block: int, counts: DataFrame | None = None) -> DataFrame:
    """Rows with (bi, bj): rows of a key with up to ``block`` members are (0, 0); those of a larger key get a
    block by a hash of the node and one row for each pair of blocks that holds theirs."""
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    large = (counts.filter(F.col("n") > block)
             .select(F.col(key).alias("large_key"), F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))).checkpoint()
    # large keys are few (rows / block at most); they are sent to the rows if their bytes allow it
    rows = rows.join(broadcast_if_small(large), F.col(key) == F.col("large_key"), "left").drop("large_key")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.col(node), F.lit(77)), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return (rows.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
            .drop("blocks", "other"))


def whole_buckets(rows: DataFrame) -> DataFrame:
    """Rows whose keys are known to be small, in the form of ``bucket_rows``."""
    return rows.withColumns({c: F.lit(0) for c in ("own", "bi", "bj")})


def by_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whole within partitions and sorted, for a streaming pass."""
    return rows.repartition(spread(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the smallest node of its component.

    Each round replaces every node's neighbours by links to the smallest of them (large star for the greater
    ones, small star for the others) and is cut by a checkpoint; a fixed point is reached in a logarithmic
    number of rounds.  The smallest neighbours come from aggregations that combine map-side; a node with very many
    neighbours meets its row by a broadcast, or beyond its bound by a join whose sides adaptive execution splits.
    """
    e = (edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()).checkpoint()
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        low = _one_each(low, 2 * state[0])
        e = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _one_each(e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), 2 * state[0])
        own = low.select(F.col("k").alias("u"), F.col("m").alias("v"))
        moved = e.join(low, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = own.unionByName(moved).distinct().checkpoint()
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _one_each(low: DataFrame, most: int) -> DataFrame:
    """A table of at most ``most`` rows of two numbers for a join: broadcast where that fits, else written, so that the
    join's sides are plain exchanges, which adaptive execution can split."""
    return F.broadcast(low) if 48 * most <= BROADCAST_BYTES else low.checkpoint()


def _state(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def class_links(members: DataFrame, payload: list[str], links_of: Callable, block: int = 100) -> DataFrame:
    """(node, links, root): links of every member with members of its candidate class, exactly.

    ``members`` has (root, node, weight, *payload).  ``links_of(table)`` runs in tasks on the rows of one block or
    block pair and returns their boolean link matrix (or None if the payload of none is usable); a row may be
    dropped by an all-false row.  ``links`` sums the weights of linked members; ``root`` is the smallest node
    that links lead to.  Nodes without links are absent.
    """
    rows = bucket_rows(members.select("root", "node", "weight", *payload), "root", "node", block)
    keys = ["root", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in grouped(batches, keys):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                g = t.slice(s, e - s)
                if g.num_rows < 2:
                    continue
                node, first = np.unique(g["node"].to_numpy(), return_index=True)  # a repeated row counts once
                g = g.take(pa.array(first))
                own, bi, bj = g["own"].to_numpy(), g["bi"][0].as_py(), g["bj"][0].as_py()
                linked = links_of(g)
                if linked is None:
                    continue
                np.fill_diagonal(linked, False)
                if bi != bj:  # pairs within a block belong to that block's own group
                    linked &= own[:, None] != own[None, :]
                a, b = np.nonzero(np.triu(linked))
                if not len(a):
                    continue
                root = node[star_roots(len(node), a, b)]
                got = linked @ g["weight"].to_numpy()
                some = linked.any(axis=1)
                out.append((node[some], got[some], root[some]))
            if out:
                node, links, root = (np.concatenate(x).astype(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])

    found = by_group(rows, keys).mapInArrow(run, "node long, links long, root long").checkpoint()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return links.join(roots, "node")
