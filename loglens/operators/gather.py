"""Ordered gathering of the rows of a key, whatever their number.

``groupBy(key).agg(collect_list(...))`` brings all rows of a key into one task and one value.  Here only keys of up to
``piece_rows`` rows are gathered that way.  The rows of larger keys are range-partitioned by key and order, so that one
key spreads over as many tasks as its rows need; each task streams through its sorted range and cuts it into pieces
of at most ``piece_rows`` rows.  Pieces are numbered per key, so their items one after the other are the key's items
in order.  Rows that agree in their order come by a hash of the item, then by the item; so a key whose rows all
share one order value is split too, and rows repeated in full only lengthen one task's stream.

``gathered`` joins the pieces to one row per key, for results whose contract is a row per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.config import ensure_checkpoint_dir, ship_package

#: rows of one key that are gathered in one task, and items of one piece
PIECE_ROWS = 100_000
#: rows of large keys that one task puts in order
TASK_ROWS = 200_000


def large_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """(large_key, n) of the keys with more than ``most`` rows: at most rows / most of them, written once.  A table with
    no more rows in all has none; else the count per key reads the key alone and combines map-side."""
    if df.count() <= most:
        return df.sparkSession.createDataFrame([], df.select(F.col(key).alias("large_key"), F.lit(0).cast("long").alias("n")).schema)
    ensure_checkpoint_dir(df.sparkSession)
    counts = df.groupBy(F.col(key).alias("large_key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).checkpoint()


def _cut(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, None

        def pieces(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            """What can be cut off the front, and the rest, which may go on in the next batch."""
            nonlocal number
            code = pc.dictionary_encode(t["key"].combine_chunks(), null_encoding="encode").indices.to_numpy()
            runs = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            starts = np.concatenate([np.arange(a, z, most) for a, z in zip(runs, np.r_[runs[1:], len(code)])])
            upto = len(code) if last else int(starts[-1])
            starts = starts[starts < upto]
            if not len(starts):
                return None, t
            items = t["item"].slice(0, upto).combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, upto], pa.int32()), items)
            out = pa.RecordBatch.from_arrays([t["key"].combine_chunks().take(pa.array(starts)), pa.array(np.full(len(starts), part, dtype=np.int32)),
                                              pa.array(np.arange(number, number + len(starts))), lists], names=["key", "part", "no", "items"])
            number += len(starts)
            return out, t.slice(upto)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            out, held = pieces(t if held is None or not held.num_rows else pa.concat_tables([held, t]), False)
            if out is not None:
                yield out
        if held is not None and held.num_rows:
            yield pieces(held, True)[0]

    return run


def ordered_pieces(df: DataFrame, key: str, order: list[str], item: Column, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(key, piece, of, items): the items of every key in order, in numbered pieces of at most ``piece_rows``, and the
    key's number of pieces.  A null key is a key like any other."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(key).alias("key"), F.struct(*order).alias("o"), item.alias("item"))
    rows = rows.withColumn("h", F.xxhash64("item"))
    large = large_keys(df, key, piece_rows)
    normal = rows if large.isEmpty() else rows.join(large, F.col("key").eqNullSafe(F.col("large_key")), "left_anti")
    whole = normal.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "h", "item"))).alias("s"))
    out = whole.select("key", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("of"), F.transform("s", lambda x: x["item"]).alias("items"))
    if not large.isEmpty():
        n = large.agg(F.sum("n")).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
        hot = rows.join(large, F.col("key").eqNullSafe(F.col("large_key")), "left_semi")
        ranged = hot.repartitionByRange(parts, "key", "o", "h").sortWithinPartitions("key", "o", "h", "item").select("key", "item")
        kinds = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
        # written once, so that the numbers below hold
        cut = ranged.mapInArrow(_cut(piece_rows), f"key {kinds['key']}, part int, no long, items array<{kinds['item']}>").checkpoint()
        numbers = cut.select(F.col("key").alias("nk"), F.col("part").alias("np"), F.col("no").alias("nn"))
        w = Window.partitionBy("nk")  # a row per piece, without its items
        numbers = numbers.withColumns({"piece": (F.row_number().over(w.orderBy("np", "nn")) - 1).cast("long"), "of": F.count(F.lit(1)).over(w)})
        same = F.col("key").eqNullSafe(F.col("nk")) & (F.col("part") == F.col("np")) & (F.col("no") == F.col("nn"))
        out = out.unionByName(cut.join(numbers, same).select("key", "piece", "of", "items"))
    return out.withColumnRenamed("key", key)


def gathered(pieces: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """One row per key from what was made of its pieces: ``columns`` names array columns ("list") and text columns
    ("text"), whose values are joined in the order of the pieces."""
    g = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("piece", *columns))).alias("_p"))
    def joined(name: str, kind: str) -> Column:
        parts = F.transform("_p", lambda x: x[name])
        return (F.flatten(parts) if kind == "list" else F.array_join(parts, "")).alias(name)

    return g.select(key, *[joined(name, kind) for name, kind in columns.items()])
