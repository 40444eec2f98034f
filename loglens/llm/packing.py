"""Packing documents into fixed-length sequences: first-fit decreasing in randomised groups.

A document's ids (with the end id) fill whole sequences of its own as far as they go; what is left over, less
than one sequence, goes to a group chosen at random (by a hash of the id and the text) of bounded expected size.  In a
group the left-overs are placed longest first into the first bin that has room, found by a tournament tree
over the bins' free space.  Gaps that remain are then filled by cutting the pieces of the emptiest bins, so a
group ends with at most one sequence that is not full.

Only left-over ids and one checksum per whole sequence are shuffled, not texts or all ids.  Groups run
independently; their number follows from the number of rows, so no task grows with the table.

Defined results: null text counts as empty, and an empty document is its end id alone; null or shared ids spread by
their texts; repeated rows are packed one by one, and where one is repeated more often than a group has rows, its
copies are numbered (the numbers written before they are used) and spread by number; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import body, prepare, spread
from loglens.llm.word_ids import WordIds
from loglens.operators.sizes import broadcast_if_small

LENGTH, END_ID = 2048, 1
#: documents in one group on average
GROUP_ROWS = 2048
#: texts tokenised at a time, by bytes
BLOCK_BYTES = 5 << 20


class Tournament:
    """Free space of bins in a fixed order; finds the first bin with enough of it in logarithmic time."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.most = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin that has ``need`` free (there must be one)."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.most[at] < need:
                at += 1
        return at - self.leaves

    def take(self, bin_no: int, amount: int) -> None:
        at = bin_no + self.leaves
        self.most[at] -= amount
        while at > 1:
            at //= 2
            best = max(self.most[2 * at], self.most[2 * at + 1])
            if self.most[at] == best:
                break
            self.most[at] = best


def pack(sizes: list[int], capacity: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start in the item, length).  At most one bin is not full; items are cut only to fill gaps."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree, bins = Tournament(max(1, len(sizes)), capacity), []
    for i in order:
        b = tree.first(sizes[i])
        if b == len(bins):
            bins.append([])
        tree.take(b, sizes[i])
        bins[b].append((i, 0, sizes[i]))
    used = [sum(n for _, _, n in b) for b in bins]
    open_bins = sorted((b for b in range(len(bins)) if used[b] < capacity), key=lambda b: (-used[b], b))
    lo, hi = 0, len(open_bins) - 1  # the fullest open bin is filled from the emptiest one
    while lo < hi:
        a, z = open_bins[lo], open_bins[hi]
        if used[a] == capacity:
            lo += 1
        elif not bins[z]:
            hi -= 1
        else:
            item, start, n = bins[z].pop()
            cut = min(n, capacity - used[a])
            bins[a].append((item, start, cut))
            used[a] += cut
            used[z] -= cut
            if cut < n:
                bins[z].append((item, start + cut, n - cut))
    return [b for b in bins if b]


def _cut_documents(tokenizer, length: int, end_id: int):
    """Documents -> (id, tokens, checksums of whole sequences, left-over ids)."""
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer.value)
        for b in batches:
            text = b["body"]
            ends = np.cumsum(np.asarray(pa.compute.binary_length(text)), dtype=np.int64)
            at = 0
            while at < len(text):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
                ids, first = words.texts(text[at:upto])
                rows = []
                for a, z in zip(first[:-1], first[1:]):
                    doc = np.concatenate([ids[a:z], end])
                    whole = len(doc) // length
                    rows.append((len(doc), [zlib.crc32(doc[k * length:(k + 1) * length].tobytes()) for k in range(whole)], doc[whole * length:].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [b["id"][at:upto], b["grp"][at:upto], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary())],
                    names=["id", "grp", "doc_tokens", "whole", "rest"])
                del ids, rows
                pa.default_memory_pool().release_unused()  # executors count what idle workers hold
                at = upto

    return run


def _pack_group(length: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("doc_tokens", "ascending"), ("rest", "ascending")])
        whole, rest = t["whole"].to_pylist(), t["rest"].to_pylist()
        pieces = []  # (row, start, length, checksum, sequence, offset)
        seq = 0
        for row, sums in enumerate(whole):
            for k, crc in enumerate(sums):
                pieces.append((row, k * length, length, crc, seq, 0))
                seq += 1
        rows = [i for i, r in enumerate(rest) if r]
        for b in pack([len(rest[i]) // 4 for i in rows], length):
            offset = 0
            for item, start, n in b:
                i = rows[item]
                crc = zlib.crc32(rest[i][start * 4:(start + n) * 4])
                pieces.append((i, len(whole[i]) * length + start, n, crc, seq, offset))
                offset += n
            seq += 1
        row, start, n, crc, at, offset = (np.array(x, dtype=np.int64) for x in (zip(*pieces) if pieces else [()] * 6))
        group = t["grp"][0].as_py()
        return pa.table({"id": t["id"].take(pa.array(row)), "start": start, "length": n, "ids_crc32": crc, "doc_tokens": t["doc_tokens"].take(pa.array(row)),
                         "sequence_id": group * 2**31 + at, "offset": offset})

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, end_id: int = END_ID, group_rows: int = GROUP_ROWS, seed: int = 11) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    spark = prepare(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # a file of a few MB
    groups = max(1, -(-docs.count() // group_rows))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body")).withColumn("named", F.xxhash64("id", "body", F.lit(seed)))
    often = rows.groupBy("named").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows).select(F.col("named").alias("o")).checkpoint()
    if not often.isEmpty():
        same = F.col("named") == F.col("o")
        copies = rows.join(broadcast_if_small(often), same, "left_semi").withColumn("copy", F.monotonically_increasing_id()).checkpoint()
        copies = copies.withColumn("named", F.xxhash64("named", "copy")).drop("copy")
        rows = rows.join(broadcast_if_small(often), same, "left_anti").unionByName(copies)
    rows = rows.select("id", F.pmod("named", F.lit(groups)).alias("grp"), "body")
    cut = rows.mapInArrow(_cut_documents(tokenizer, length, end_id), f"id {kind}, grp long, doc_tokens long, whole array<long>, rest binary")
    cut = cut.repartition(max(spread(spark), min(groups, 2 * spread(spark))), "grp")
    out = cut.groupBy("grp").applyInArrow(_pack_group(length), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
