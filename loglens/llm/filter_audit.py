"""Filter interaction audit: what every filter removes in every order of the filters.

Each document fails some of the filters, a combination of bits.  Filters on a text alone are expressions; the copy
filter fails a document whose text is identical to that of any smaller id in the table, whatever other filters do:
a left-semi join on the hash, the exact text and the smaller id marks it.  The marked ids are united with the
documents' other failures, and the combinations are counted per part.  All orders and steps follow from these
counts: a filter applied after others removes the combinations that hold its bit and none of theirs.

Scale: the copy filter shuffles only texts whose hash occurs more than once (as far as the list of such hashes
passes the broadcast check; else all texts once); the right side has one row per distinct text, the left side of a
text with many copies is salted.  After that only ids and bits move, and a part ends as one row of at most
``2 ** filters`` counts.

Defined results: null text counts as empty, null parts as the empty string; rows with a null id fail no copy filter,
fail nobody else's and have no label; repeated rows are counted one by one (copies need a smaller id, so they don't
fail each other), rows that share an id are judged by their own texts; a label is 1 if any row of the labels says so
for the id, null labels say nothing; ties don't arise; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import body, prepare
from loglens.operators.sizes import BROADCAST_BYTES, broadcast_if_small, bytes_of

WHITE, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
#: left rows of one text that share a salt
SALT_ROWS = 1024

#: (letter, condition of failure) over the columns text, words, distinct_words
TEXT_FILTERS: list[tuple[str, Callable[[], Column]]] = [
    ("A", lambda: F.col("words") < 50),
    ("B", lambda: F.col("distinct_words") * 100 < F.col("words") * 65),
    ("C", lambda: F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * 5),
    ("D", lambda: F.col("text").rlike(MARKS)),
]
COPY_FILTER = "E"


def failures(docs: DataFrame, filters=None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, h, bits): every document with the bits of the text filters that it fails."""
    filters = TEXT_FILTERS if filters is None else filters
    rows = _texts(docs, id_col, text_col, part_col).withColumn("w", F.filter(F.split("text", WHITE), lambda x: x != ""))
    rows = rows.select("id", "part", "h", "text", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"))
    bits = F.lit(0)
    for k, (_, fails) in enumerate(filters):
        bits = bits + F.when(fails(), F.lit(1 << k)).otherwise(F.lit(0))
    return rows.select("id", "part", "h", bits.alias("bits"))


def _texts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    text = body(text_col)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("h"), text.alias("text"))


def marked_copies(docs: DataFrame, hashes: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                  salt_rows: int = SALT_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, part, h) of the rows whose exact text some smaller id has too.  ``hashes`` holds h once per row."""
    repeated = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = repeated.select(F.col("h").alias("rh"), F.ceil(F.col("n") / F.lit(salt_rows)).cast("int").alias("salts")).checkpoint()
    texts = _texts(docs, id_col, text_col, part_col).filter("id IS NOT NULL")
    if bytes_of(repeated) <= most_bytes:  # texts without a second one of their hash stay where they are
        texts = texts.join(F.broadcast(repeated), F.col("h") == F.col("rh"))
    else:
        hot = broadcast_if_small(repeated.filter("salts > 1"))
        texts = texts.join(hot, F.col("h") == F.col("rh"), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    texts = texts.drop("rh")
    first = texts.groupBy("h", "text", "salts").agg(F.min("id").alias("least"))
    first = first.select(F.col("h").alias("fh"), F.col("text").alias("ft"), "least", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("fs"))
    left = texts.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.col("salts")).cast("int"))
    same = (F.col("h") == F.col("fh")) & (F.col("salt") == F.col("fs")) & (F.col("text") == F.col("ft")) & (F.col("least") < F.col("id"))
    return left.join(first, same, "left_semi").select("id", "part", "h")


def combinations(docs: DataFrame, labels: DataFrame | None = None, filters=None, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source", salt_rows: int = SALT_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(part, bits, n, good, toxic): documents, and those labelled quality 1 and toxic 1, by combination of failures."""
    prepare(docs)
    filters = TEXT_FILTERS if filters is None else filters
    flags = failures(docs, filters, id_col, text_col, part_col).checkpoint()
    copies = marked_copies(docs, flags.select("h"), id_col, text_col, part_col, salt_rows, most_bytes)
    every = flags.withColumn("n", F.lit(1)).unionByName(copies.withColumns({"bits": F.lit(1 << len(filters)), "n": F.lit(0)}))
    # rows that agree in id, part and hash are copies of each other and fail alike
    each = every.groupBy("id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    each = each.groupBy("id", "part", "bits").agg(F.sum("n").alias("n"))  # null ids end as a few rows
    if labels is None:
        return each.groupBy("part", "bits").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.select(F.col(id_col).alias("k"), "quality", "toxic").filter("k IS NOT NULL").groupBy("k").agg(says("quality"), says("toxic"))
    each = each.join(known, F.col("id") == F.col("k"), "left")
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("part", "bits").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame | None = None, filters=None, copy_filter: str = COPY_FILTER, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "source", salt_rows: int = SALT_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per part, order of the filters and step: (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley)."""
    filters = TEXT_FILTERS if filters is None else filters
    letters = [x for x, _ in filters] + [copy_filter]
    sets = 1 << len(letters)
    counted = combinations(docs, labels, filters, id_col, text_col, part_col, salt_rows, most_bytes)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # at most 2 ** filters entries

    def survivors(what: str) -> Column:
        """By set of filters: the documents that fail none of them."""
        hit = lambda s: F.filter("c", lambda e: e["bits"].bitwiseAND(s) == 0)
        return F.transform(F.sequence(F.lit(0), F.lit(sets - 1)), lambda s: F.aggregate(hit(s), F.lit(0).cast("long"), lambda a, e: a + e[what]))

    parts = parts.select("part", "c", *[survivors(x).alias(f"{x}_left") for x in ("n", "good", "toxic")])
    rows = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit_of = F.create_map(*[x for k, letter in enumerate(letters) for x in (F.lit(letter), F.lit(1 << k))])
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda a, k: a + F.when(k > 0, bit_of[F.substring(F.col("filter_order"), k, F.lit(1))]).otherwise(F.lit(0)))
    rows = rows.select("*", bit_of[F.substring(F.col("filter_order"), F.col("step"), F.lit(1))].alias("bit"), before.alias("before"))
    left = lambda what, s: F.get(F.col(f"{what}_left"), s)
    after = F.col("before") + F.col("bit")
    lost = lambda what: left(what, F.col("before")) - left(what, after)
    alone = F.aggregate(F.filter("c", lambda e: e["bits"] == F.col("bit")), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    return rows.select("part", "filter_order", "step", left("n", after).alias("kept"), lost("n").alias("removed"),
                       (left("n", F.lit(0)) - left("n", F.col("bit")) - lost("n")).alias("redundant"), alone.alias("unique_fails"),
                       lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), _over_orders(len(letters)).alias("shapley"))


def _over_orders(n: int) -> Column:
    """What the filter ``bit`` removes, summed over all orders: a set of s others precedes it in s! (n - 1 - s)! of them."""
    def factorial(k: int) -> int:
        return 1 if k < 2 else k * factorial(k - 1)

    orders = F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)])
    free = F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    gone = lambda s: F.get(F.col("n_left"), s) - F.get(F.col("n_left"), s + F.col("bit"))
    return F.aggregate(free, F.lit(0).cast("long"), lambda a, s: a + F.get(orders, F.bit_count(s)) * gone(s))
