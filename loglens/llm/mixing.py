"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets.

Every source gets a target (a share of all words by weight, at most ``cap`` times its own words; what a capped
source leaves is shared again by weight).  Complete epochs of a source come first; the remaining words are
drawn without replacement: each document has the exponential key ``-ln(u) / w`` with ``w`` its quality weight
and ``u`` fixed by its id and text, keys are sorted within the source and documents are taken while the prefix sum of
their sizes stays nearest the budget.  The weight is an expression of the caller's, a classifier's score for instance;
by default a plain measure of the text.

Nothing is sorted whole.  Keys fall into buckets; sums per (source, bucket) give the one bucket of each source in
which the budget ends, which is split into finer buckets until it is small, whatever the weights are.  Only that last
bucket is sorted, rows repeated in full counting as one.  The outcome is one threshold per source, and how many of the
rows that lie on it are taken, so documents are marked by a join with a table of one row per source.

Defined results: null text has size 0; null source is a source of its own, sorted last; rows with null or shared ids
draw by their texts; rows repeated in full get equal keys, and where the budget ends among them as many are taken as
it has room for (any of them: they are numbered in a written table); null weights count as the least weight; sources
without words get target 0; empty tables give empty results; further columns are ignored by ``mix`` and kept by
``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import body, prepare
from loglens.operators.sizes import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: binary digits of a key's fraction by which buckets are split, and rows in a bucket that is sorted
DIGITS, BUCKET_ROWS = (10, 20, 30, 40), 20_000
LEAST_WEIGHT = 0.25


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(body(text_col), F.lit(WORD)).cast("long")


def text_weight(text_col: str = "text") -> Column:
    """Weight of a text without a classifier: 0.25 to 1, by its share of letters of any script."""
    text = body(text_col)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.lit(LEAST_WEIGHT) + F.lit(1 - LEAST_WEIGHT) * (letters / F.greatest(F.length(text), F.lit(1)))


def score_weight(score: Column) -> Column:
    """Weight by a classifier's probability: 0.25 to 1."""
    return F.lit(LEAST_WEIGHT) + F.lit(1 - LEAST_WEIGHT) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.cast("double"), F.lit(0.0))))


def exponential_key(id_col: str, text_col: str, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of md5(id : md5(text) : seed): the same in every run."""
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(body(text_col)), F.lit(":" + seed))
    bits = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.coalesce(weight, F.lit(LEAST_WEIGHT))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    A source is capped when the common level ``words per weight`` exceeds ``cap * source_size / weight``.
    Sources in the order of that ratio: the level follows from the first one that its level does not exceed.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source only
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    limited = (sizes.withColumn("w", cycle).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
               .withColumn("ratio", F.col("limit") / F.col("w")))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    zero = F.lit(0.0)
    level = ((F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), zero))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero)))
    levels = limited.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return (levels.withColumn("at", fits)
            .select("source", "source_size", F.coalesce(F.least(F.col("limit"), F.col("w") * F.col("at")), F.col("limit")).alias("target")))


def _keyed(docs: DataFrame, id_col, source_col, text_col, weight, seed) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
                       exponential_key(id_col, text_col, weight, seed).alias("key"))


def _same_source(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def thresholds(keyed: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(m_source, source_size, target, epochs, whole, edge, copies), one row per source: rows are taken once more where
    ``whole``, or where (key, id) is less than ``edge``; of the rows that are equal to ``edge``, ``copies`` are."""
    targets = source_targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    targets = (targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
               .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).checkpoint())
    rows, ends = keyed, targets.select(F.col("source").alias("e_source"), "rest", F.lit(0).cast("long").alias("start"))
    for digits in DIGITS:
        # (source, bucket) sums of the rows that are still in question; the bucket in which the budget ends
        bucket = F.floor(F.col("key") * F.lit(float(1 << digits))).cast("long")
        rows = rows.withColumn("bucket", bucket)
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.join(broadcast_if_small(ends), _same_source("source", "e_source")).withColumn("end", F.col("start") + F.sum("words").over(run))
        found = sums.filter("end > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("end") - F.col("words")).alias("start"), "rest", "n")).alias("b"))
        found = found.select(F.col("source").alias("e_source"), F.col("b.bucket").alias("e_bucket"), "b.start", "b.rest", "b.n").checkpoint()
        ends = found.select("e_source", "rest", "start")
        inside = found.select(F.col("e_source").alias("i_source"), "e_bucket")
        rows = rows.join(broadcast_if_small(inside), _same_source("source", "i_source") & (F.col("bucket") == F.col("e_bucket"))).select("id", "source", "size", "key")
        if (found.agg(F.max("n")).first()[0] or 0) <= BUCKET_ROWS:
            break
    # rows repeated in full are one group of copies; the groups of the last bucket are sorted
    groups = rows.groupBy("source", "key", "id").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.max("size").alias("each"))
    order = F.struct("key", "id")
    before = Window.partitionBy("source").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.join(broadcast_if_small(ends), _same_source("source", "e_source")).withColumn("begin", F.col("start") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    # the j-th copy is taken if its middle does not lie beyond the budget
    room = F.when(F.col("each") > 0, F.floor((F.col("rest") - F.col("begin")) / F.col("each") + F.lit(0.5))).otherwise(F.when(F.col("begin") <= F.col("rest"), F.col("n")).otherwise(0))
    groups = groups.withColumn("copies", F.least(F.col("n"), F.greatest(F.lit(0), room)).cast("long"))
    # the first group that is not taken whole; if all are, the last one
    group = F.struct(order.alias("edge"), "copies")
    edge = groups.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("copies") < F.col("n"), group)), F.max(group)).alias("e"))
    edge = edge.select(F.col("source").alias("g_source"), "e.edge", "e.copies")
    reached = ends.select(F.col("e_source").alias("r_source"), F.lit(True).alias("reached"))
    out = targets.join(reached, _same_source("source", "r_source"), "left").join(edge, _same_source("source", "g_source"), "left")
    return out.select(F.col("source").alias("m_source"), "source_size", "target", "epochs", F.col("reached").isNull().alias("whole"), "edge",
                      F.coalesce("copies", F.lit(0)).alias("copies")).checkpoint()


def _marked(rows: DataFrame, marks: DataFrame, key: str, ident: str, source: str) -> DataFrame:
    """Adds ``times``: a source's epochs, and once more for the rows before its edge and some of those on it."""
    rows = rows.join(broadcast_if_small(marks), _same_source(source, "m_source"))
    here = F.struct(F.col(key).alias("key"), F.col(ident).alias("id"))
    on_edge = F.coalesce(here == F.col("edge"), F.lit(False)) & (F.col("copies") > 0)
    before = F.coalesce(here < F.col("edge"), F.lit(False))
    plain = rows.filter(~on_edge).withColumn("times", F.col("epochs") + F.when(F.col("whole") | before, 1).otherwise(0))
    # the rows on the edges, numbered in each partition of a written table: the first ones of each source
    edge = rows.filter(on_edge).withColumn("no", F.monotonically_increasing_id()).checkpoint()
    edge = edge.withColumn("part", F.shiftright("no", 33))
    counts = edge.groupBy(F.col(source).alias("p_source"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("p_n"))
    w = Window.partitionBy("p_source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("p_before", F.coalesce(F.sum("p_n").over(w), F.lit(0)))
    edge = edge.join(broadcast_if_small(counts), _same_source(source, "p_source") & (F.col("part") == F.col("p")))
    rank = F.row_number().over(Window.partitionBy(source, "part").orderBy("no"))  # the rows of one partition at most
    edge = edge.withColumn("rank", rank).withColumn("times", F.col("epochs") + F.when(F.col("p_before") + F.col("rank") <= F.col("copies"), 1).otherwise(0))
    return plain.unionByName(edge.select(*plain.columns))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weight: Column | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """(id_col, source_col, size, source_size, target, times, taken) for every row of ``docs``.  ``weight`` is a positive
    expression of its columns."""
    prepare(docs)
    weight = text_weight(text_col) if weight is None else weight
    keyed = _keyed(docs, id_col, source_col, text_col, weight, seed).checkpoint()  # narrow: texts are read once
    out = _marked(keyed, thresholds(keyed, weights, share, cap), "key", "id", "source")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                      F.col("times").cast("long").alias("times"), (F.col("times") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight: Column | None = None,
               weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns unchanged.  The rows move
    nowhere: they meet a table of one row per source."""
    prepare(docs)
    weight = text_weight(text_col) if weight is None else weight
    marks = thresholds(_keyed(docs, id_col, source_col, text_col, weight, seed).checkpoint(), weights, share, cap)
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    # the key is taken from the columns under their own names, then all get names that clash with nothing
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in at.items()], exponential_key(id_col, text_col, weight, seed).alias("key"))
    rows = _marked(rows, marks, "key", at[id_col], at[source_col]).withColumn("times", F.col("times").cast("int")).filter("times > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(a).alias(c) for c, a in at.items()])
