"""Exact duplicates: group by a 128-bit content hash, compare the bytes inside groups, keep one stable id.

The group key is ``(md5(text), text)``: the hash spreads the rows and the text, being part of the key, is
compared byte by byte wherever two rows meet, so texts that only share a hash stay apart.  Copies collapse in
the partial aggregation before the shuffle: a text that makes up a third of all rows leaves each map task once.

Defined results
* null text counts as empty; all empty texts are copies of each other.
* null ids never win: ``keep_id`` is the extreme of the non-null ids, null if there are none.
* repeated rows (same id and text) count in ``group_size``; ``flag_copies`` marks each of them as kept when it
  carries ``keep_id``, ``drop_copies`` returns one of them.
* an empty table gives an empty result; further columns are ignored by ``flag_copies`` and returned unchanged
  (from the kept row) by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import body, prepare


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                   content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per distinct text: (h, body, keep_id, group_size)."""
    chosen = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body"))
    return (rows.select("id", "body", content_hash(F.col("body")).alias("h"))
            .groupBy("h", "body").agg(chosen("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def flag_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) for every row of ``docs``, dropped ones included.

    The rows get their group by the hash alone where the byte comparison found one text per hash, and by hash
    and text in the (practically absent) case of a collision.  The join is a plain equi-join, whose hot
    partitions adaptive execution splits.
    """
    prepare(docs)
    groups = distinct_texts(docs, id_col, text_col, keep, content_hash)
    # without the texts this table is narrow; written once, it is read for the collision test and the join
    slim = groups.select("h", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256")).checkpoint()
    collided = slim.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body"))
    rows = rows.select("id", "body", content_hash(F.col("body")).alias("h"))
    if collided:
        found = rows.join(groups.withColumn("text_sha256", F.sha2("body", 256)), ["h", "body"])
    else:
        found = rows.drop("body").join(slim, "h")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size",
                        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The kept row of every distinct text, all columns as they were.  One shuffle; no join."""
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}  # own names, so clashing ones do no harm
    rows = docs.toDF(*at.values())
    text, ident = F.col(at[text_col]), F.col(at[id_col])
    rest = [c for c in at.values() if c != at[text_col]]
    row = F.struct(text.isNull().alias("absent"), *rest)
    # a struct is never null, so rows without an id take part and lose against any id
    order = F.struct(ident.isNotNull(), ident) if keep == "max" else F.struct(ident.isNull(), ident)
    pick = F.max_by(row, order) if keep == "max" else F.min_by(row, order)
    full = (rows.withColumn("body", F.coalesce(text, F.lit(""))).withColumn("h", content_hash(F.col("body")))
            .groupBy("h", "body").agg(pick.alias("row")))
    back = {at[text_col]: F.when(~F.col("row.absent"), F.col("body"))}
    return full.select(*[back.get(a, F.col(f"row.{a}")).alias(c) for c, a in at.items()])
