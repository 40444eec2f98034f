"""Input views derived from the driver tables (ids F1-F10 of FIXTURES.md).

Each view is a deterministic projection/derivation of whole driver tables, so
every query's work grows with the tables.  ``loglens.plans.oracle`` holds the
same derivations written independently in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.functions.text import explode_positions

from loglens.sources.tables import table

# Values the F1 derivation cycles through (chosen to hit mode ties, a blank
# mode, substring misfires of the department prior, and text needing strip /
# lower-casing).
DIVISIONS = ["Market Risk ", "Equities", "Trading Desk", "HR", "Compliance", "People Ops", "Ventures", None]
USER_TYPES = [" Analyst", "ASSOCIATE", None]
COS = ["CO-A ", "co-b"]
# Three fragments that occur in the generated prose; order matters.
FIXTURE_WATCHLIST = ["bleed", "eaux", "lich"]
# Router thresholds for the F2 score range.
FIXTURE_LOW, FIXTURE_HIGH = 0.18, 0.21
# Router thresholds for the lexical classifier over F1 (benchmark taxonomy).
FLAGSHIP_LOW, FLAGSHIP_HIGH = 0.20, 0.30


def _pick(index: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(index == i, lit) if expr is None else expr.when(index == i, lit)
    return expr


def _pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


SHORT_TURNS = ["ok", "and then ?", "go on", "thanks a lot"]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user turns of ``conversations`` as a chat-log table, whole texts, with
    short turns added between them (``seq`` is ten times the turn, plus the
    number of the added turn)."""
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where(F.col("role") == "user")
    conv_id, turn = F.col("conv_id"), F.col("turn")
    minute = F.floor(turn / 4).cast("bigint")
    ts_text = F.concat(F.lit("2024-01-01 "), _pad2(F.floor(minute / 60).cast("bigint")), F.lit(":"), _pad2(minute % 60), F.lit(":00"))
    base = conv.select(
        conv_id.alias("session_id"),
        turn.alias("seq"),
        F.when(turn == 5, F.lit("not a date")).otherwise(ts_text).alias("query_timestamp"),
        F.concat(F.lit("u"), ((conv_id * 3 + turn) % 50).cast("string")).alias("username"),
        F.col("text").alias("prompt"),
        _pick(turn % 2, COS).alias("co"),
        _pick(conv_id % 3, USER_TYPES).alias("user_type"),
        _pick((conv_id + F.when(turn % 4 == 0, 1).otherwise(0)) % 8, DIVISIONS).alias("division"),
    )
    # every third turn is followed by one or two short turns of the same minute
    third = (F.col("session_id") * 7 + F.col("seq")) % 3 == 0
    n_short = F.when(third, 1 + F.col("session_id") % 2).otherwise(0).cast("int")
    extra = F.when(n_short > 0, F.sequence(F.lit(0), n_short)).otherwise(F.array(F.lit(0)))
    rows = base.withColumn("k", F.explode(extra))
    short = _pick((F.col("seq") + F.col("k")) % len(SHORT_TURNS), SHORT_TURNS)
    return rows.withColumn("prompt", F.when(F.col("k") == 0, F.col("prompt")).otherwise(short)).withColumn(
        "seq", F.col("seq") * 10 + F.col("k")).drop("k")


def _embedding_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def proto_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 prototypes: every third vector, in turn domain and intent; kind by rank in (axis, label)."""
    e = _embedding_roles(spark, sf_dir).where(F.col("vec_id") % 3 == 0)
    axis = F.when(F.col("vec_id") % 6 == 0, F.lit("domain")).otherwise(F.lit("intent"))
    e = e.withColumn("category_type", axis)
    rnk = F.row_number().over(Window.partitionBy("category_type", "label").orderBy("vec_id"))
    code = F.concat(F.when(F.col("category_type") == "domain", F.lit("D")).otherwise(F.lit("I")), _pad2(F.col("label") + 1))
    return e.select(
        "category_type",
        F.col("label").alias("ord"),
        code.alias("code"),
        F.when(rnk == 1, F.lit("definition")).when(rnk % 2 == 0, F.lit("keyword")).otherwise(F.lit("phrase")).alias("kind"),
        F.col("vec_id").alias("proto_id"),
        F.col("embedding").alias("vec"),
    )


def session_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 sessions: the other vectors; session 1 gets a zero vector; prior on even ids."""
    e = _embedding_roles(spark, sf_dir).where(F.col("vec_id") % 3 != 0)
    vec = F.when(F.col("vec_id") == 1, F.transform("embedding", lambda x: x * F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    prior = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("D"), _pad2(F.col("vec_id") % 10 + 1)))
    return e.select(F.col("vec_id").alias("session_id"), vec.alias("vec"), prior.alias("domain_prior"))


# --------------------------------------------------- taxonomy and governance
N_BENCH_CATEGORIES = 10  # 5 domains + 5 intents


def benchmark_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category rows of a taxonomy built from ``benchmark`` passages.

    Category = item_id % 10 (0-4 domains D01-D05, 5-9 intents I01-I05);
    with k = item_id div 10: k = 0 gives the definition, odd k keywords,
    even k > 0 phrases (sorted, so the lists are deterministic).
    """
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    cat = F.col("item_id") % N_BENCH_CATEGORIES
    half = N_BENCH_CATEGORIES // 2
    k = F.floor(F.col("item_id") / N_BENCH_CATEGORIES)
    b = b.select(
        F.when(cat < half, F.lit("domain")).otherwise(F.lit("intent")).alias("category_type"),
        (cat % half).cast("int").alias("ord"),
        F.concat(F.when(cat < half, F.lit("D")).otherwise(F.lit("I")), _pad2(cat % half + 1)).alias("code"),
        k.alias("k"), "text",
    )
    return b.groupBy("category_type", "ord", "code").agg(
        F.concat(F.lit("Category "), F.col("code")).alias("name"),
        F.max(F.when(F.col("k") == 0, F.col("text"))).alias("definition"),
        F.array_sort(F.collect_list(F.when(F.col("k") % 2 == 1, F.col("text")))).alias("keywords"),
        F.array_sort(F.collect_list(F.when((F.col("k") % 2 == 0) & (F.col("k") > 0), F.col("text")))).alias("phrases"),
    ).select("category_type", "ord", "code", F.concat(F.lit("Category "), F.col("code")).alias("name"),
             "definition", "keywords", "phrases")


def benchmark_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prototypes of ``benchmark_categories`` as rows, straight from the passages: (category_type, ord, code,
    name, kind, text)."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    cat, half = F.col("item_id") % N_BENCH_CATEGORIES, N_BENCH_CATEGORIES // 2
    k = F.floor(F.col("item_id") / N_BENCH_CATEGORIES)
    code = F.concat(F.when(cat < half, F.lit("D")).otherwise(F.lit("I")), _pad2(cat % half + 1))
    return b.where(F.col("text").isNotNull()).select(
        F.when(cat < half, F.lit("domain")).otherwise(F.lit("intent")).alias("category_type"),
        (cat % half).cast("int").alias("ord"), code.alias("code"), F.concat(F.lit("Category "), code).alias("name"),
        F.when(k == 0, F.lit("definition")).when(k % 2 == 1, F.lit("keyword")).otherwise(F.lit("phrase")).alias("kind"), "text",
    )


# The governance pairs (domain, intent, level) of the shipped
# risk matrix, high-risk list first, then medium-risk; reasons here are
# neutral texts.  The last entry is a made-up repeat of an earlier pair with a
# different level, to exercise "later entry wins".
GOVERNANCE_PAIRS = [
    ("D01", "I06", "HIGH"), ("D01", "I03", "HIGH"), ("D02", "I06", "HIGH"), ("D02", "I03", "HIGH"),
    ("D02", "I04", "HIGH"), ("D05", "I03", "HIGH"), ("D05", "I06", "HIGH"), ("D04", "I03", "HIGH"),
    ("D01", "I05", "MEDIUM"), ("D03", "I05", "MEDIUM"), ("D03", "I06", "MEDIUM"), ("D02", "I05", "MEDIUM"),
    ("D04", "I04", "MEDIUM"), ("D06", "I06", "MEDIUM"),
    ("D04", "I03", "MEDIUM"),
]


def matrix_entries(spark: SparkSession) -> DataFrame:
    """F10 as ordered entries (list_no, i, domain, intent, level, reason)."""
    rows = [
        (0 if lvl == "HIGH" else 1, i, d, it, lvl, f"{lvl.lower()} risk pair {d}/{it}")
        for i, (d, it, lvl) in enumerate(GOVERNANCE_PAIRS)
    ]
    return spark.createDataFrame(rows, "list_no int, i int, domain string, intent string, level string, reason string")


def order_flag_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governance entries derived from ``orders``: urgent/high priorities form
    the high-risk list, the rest the medium-risk list, each in order-key
    order; pair = (D + custkey % 10, I + orderkey % 7)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.select(
        F.when(high, F.lit(0)).otherwise(F.lit(1)).alias("list_no"),
        F.col("o_orderkey").alias("i"),
        F.concat(F.lit("D"), _pad2(F.col("o_custkey") % 10 + 1)).alias("domain"),
        F.concat(F.lit("I"), _pad2(F.col("o_orderkey") % 7 + 1)).alias("intent"),
        F.when(high, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("level"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("reason"),
    )


# ---------------------------------------------------------- documents (F5)
def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 pages: each line of a document is a page (1-based page_no)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return explode_positions(d, ["doc_id"], F.split(F.col("text"), "\n", -1), "pos", "line").select(
        "doc_id", (F.col("pos") + 1).cast("int").alias("page_no"), F.col("line").alias("text")
    )


def doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document metadata with gaps: title missing for doc_id % 4 = 0,
    keywords for doc_id % 3 = 0; dates unknown."""
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Report "), F.col("doc_id").cast("string"))).alias("title"),
        F.col("source").alias("author"),
        F.col("lang").alias("subject"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.col("lang"), F.lit(","), F.col("source"))).alias("keywords"),
        F.lit(None).cast("string").alias("creation_date"),
        F.lit(None).cast("string").alias("modification_date"),
    )


NOTE_PARAGRAPH = "Delivery note for the order line. \n\n"
NOTE_REPEAT = 100


def order_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part_seq, text, is_boundary) parts of one text per order.

    Per line item: ``\\nSection n: Items ...``, ``\\n1.n Terms of delivery by
    <date>``, ``\\nIV. Risk level ...``, ``\\n2.n Payment schedule ...`` (each
    a section start) and, for quantities >= 45, a long note of blank-line
    separated paragraphs; urgent orders get ``\\nArticle IV: Urgent
    handling`` and finished orders end in the all-caps ``\\nFINAL NOTICE``.
    """
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    s = lambda c: F.col(c).cast("string")
    qty = F.col("l_quantity").cast("bigint").cast("string")
    price = F.floor(F.col("l_extendedprice")).cast("bigint").cast("string")
    # (l_orderkey, l_linenumber) repeats in the data: number the lines of an
    # order by the unique key (linenumber, partkey, suppkey, extendedprice).
    li = li.withColumn("li", F.row_number().over(
        Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    ln = F.col("li")
    order_level = o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.array(
            F.struct(F.lit(0).alias("part_seq"),
                     F.concat(F.lit("Order "), s("o_orderkey"), F.lit(" for customer "), s("o_custkey"), F.lit(".")).alias("text"),
                     F.lit(False).alias("is_boundary")),
            F.struct(F.lit(1).alias("part_seq"),
                     F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("\nArticle IV: Urgent handling")).alias("text"),
                     F.lit(True).alias("is_boundary")),
            F.struct(F.lit(1000).alias("part_seq"),
                     F.when(F.col("o_orderstatus") == "F", F.lit("\nFINAL NOTICE")).alias("text"),
                     F.lit(True).alias("is_boundary")),
        ).alias("parts"),
    ).select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*").where(F.col("text").isNotNull())
    lines = li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.array(
            F.struct((ln * 10 + 1).alias("part_seq"), F.concat(F.lit("\nSection "), s("l_linenumber"), F.lit(": Items part "), s("l_partkey"), F.lit(" qty "), qty).alias("text"), F.lit(True).alias("is_boundary")),
            F.struct((ln * 10 + 2).alias("part_seq"), F.concat(F.lit("\n1."), s("l_linenumber"), F.lit(" Terms of delivery by "), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("text"), F.lit(True).alias("is_boundary")),
            F.struct((ln * 10 + 3).alias("part_seq"), F.concat(F.lit("\nIV. Risk level "), s("l_linenumber"), F.lit(" price "), price).alias("text"), F.lit(True).alias("is_boundary")),
            F.struct((ln * 10 + 4).alias("part_seq"), F.concat(F.lit("\n2."), s("l_linenumber"), F.lit(" Payment schedule "), price).alias("text"), F.lit(True).alias("is_boundary")),
            F.struct((ln * 10 + 5).alias("part_seq"),
                     F.when(F.col("l_quantity") >= 45, F.concat(F.lit("\n\n"), F.lit(NOTE_PARAGRAPH * NOTE_REPEAT), F.lit("End of note."))).alias("text"),
                     F.lit(False).alias("is_boundary")),
        ).alias("parts"),
    ).select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*").where(F.col("text").isNotNull())
    return order_level.unionByName(lines)


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the parts of ``order_text_parts`` joined in part order.  Orders and line items meet as they are,
    a few numbers a row; the texts are written where they have met."""
    s = lambda c: c.cast("string")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    order = F.struct(
        F.concat(F.lit("Order "), s(F.col("o_orderkey")), F.lit(" for customer "), s(F.col("o_custkey")), F.lit(".")).alias("head"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), (F.col("o_orderstatus") == "F").alias("final"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    none = lambda c, df: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    rows = o.select(F.col("o_orderkey").alias("doc_id"), order.alias("o"), none(line, li).alias("l")).unionByName(
        li.select(F.col("l_orderkey").alias("doc_id"), none(order, o).alias("o"), line.alias("l")))
    # the texts are many times as long as what meets: a number of tasks of its own, not one by the bytes shuffled
    met = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").groupBy("doc_id").agg(F.collect_list("o").alias("o"), F.array_sort(F.collect_list("l")).alias("l"))

    def written(x: Column) -> Column:
        n, price = s(x["l_linenumber"]), s(F.floor(x["l_extendedprice"]).cast("bigint"))
        note = F.concat(F.lit("\n\n"), F.lit(NOTE_PARAGRAPH * NOTE_REPEAT), F.lit("End of note."))
        return F.concat_ws(
            "",
            F.concat(F.lit("\nSection "), n, F.lit(": Items part "), s(x["l_partkey"]), F.lit(" qty "), s(x["l_quantity"].cast("bigint"))),
            F.concat(F.lit("\n1."), n, F.lit(" Terms of delivery by "), F.date_format(x["l_shipdate"], "yyyy-MM-dd")),
            F.concat(F.lit("\nIV. Risk level "), n, F.lit(" price "), price),
            F.concat(F.lit("\n2."), n, F.lit(" Payment schedule "), price),
            F.when(x["l_quantity"] >= 45, note))

    def flagged(name: str, text: str) -> Column:
        return F.repeat(F.lit(text), F.size(F.filter("o", lambda x: x[name])))

    # part 1000 stands behind line 99
    lines = lambda part: F.array_join(F.transform(part, written), "")
    heads = F.array_join(F.array_sort(F.transform("o", lambda x: x["head"])), "")
    text = F.concat(heads, flagged("urgent", "\nArticle IV: Urgent handling"), lines(F.slice("l", 1, 99)), flagged("final", "\nFINAL NOTICE"),
                    lines(F.slice("l", 100, 2_147_483_000)))
    # a text of which no part is known is no text
    some = F.exists("o", lambda x: x["head"].isNotNull() | x["urgent"] | x["final"]) | F.exists("l", _has_part)
    return met.where(F.coalesce(some, F.lit(False))).select("doc_id", text.alias("text"))


def _has_part(x: Column) -> Column:
    known = x["l_linenumber"].isNotNull() & ((x["l_partkey"].isNotNull() & x["l_quantity"].isNotNull()) | x["l_shipdate"].isNotNull() | x["l_extendedprice"].isNotNull())
    return known | (F.coalesce(x["l_quantity"], F.lit(0)) >= 45)


# ------------------------------------------------------------ e-mails (F3, F9)
def _order_mail_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("email_no", F.row_number().over(w))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one thread per customer, one mail per order in (date, key) order;
    every third mail quotes the previous one below its own text."""
    o = _order_mail_parts(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    cc = F.when(F.col("o_orderkey") % 2 == 0, F.lit("\nCc: audit@example.com; legal@example.com")).otherwise(F.lit(""))
    header = F.concat(
        F.lit("From: Cust "), s("o_custkey"), F.lit(" &lt;c"), s("o_custkey"), F.lit("@example.com&gt;"),
        F.lit("\nSent: "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("\nTo: ops"), (F.col("o_orderkey") % 7).cast("string"), F.lit("@example.com;desk&amp;"), s("o_orderstatus"), F.lit("@example.com"),
        cc,
        F.lit("\nSubject: Order "), s("o_orderkey"), F.lit(" "), s("o_orderpriority"),
    )
    own = F.concat(header, F.lit("\n\nPlease process order "), s("o_orderkey"), F.lit(". Total "),
                   F.floor("o_totalprice").cast("bigint").cast("string"), F.lit("."))
    w = Window.partitionBy("o_custkey").orderBy("email_no")
    o = o.withColumn("own", own).withColumn("prev", F.lag("own").over(w))
    body = F.when((F.col("email_no") % 3 == 0) & F.col("prev").isNotNull(), F.concat(F.col("own"), F.lit("\n\n"), F.col("prev"))).otherwise(F.col("own"))
    return o.select(F.col("o_custkey").alias("thread_id"), F.col("email_no").cast("int").alias("email_no"), body.alias("body"))


def thread_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a model's JSON answer per e-mail; empty lists are left out;
    'not json' for o_orderkey % 17 = 0, empty text for % 19 = 0."""
    o = _order_mail_parts(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    obj = F.struct(
        F.array(F.concat(F.lit("process order "), s("o_orderkey"))).alias("new_commitments"),
        F.array(F.floor("o_totalprice").cast("bigint").cast("string")).alias("monetary_mentions"),
        F.array(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("deadlines"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("breach"))).alias("legal_triggers"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("urgent"))).alias("escalation_flags"),
        F.concat(F.lit("order "), s("o_orderkey"), F.lit(" "), s("o_orderstatus")).alias("summary_update"),
    )
    out = (F.when(F.col("o_orderkey") % 17 == 0, F.lit("not json"))
           .when(F.col("o_orderkey") % 19 == 0, F.lit(""))
           .otherwise(F.to_json(obj)))
    return o.select(F.col("o_custkey").alias("thread_id"), F.col("email_no").cast("int").alias("email_no"), out.alias("out"))


# ------------------------------------------------------------- HTML (F6, F7)
TABLE_BUCKET = 50
SUPPLIER_HEADERS = ["Name of the supplier", "Nation", "Balance"]
CUSTOMER_HEADERS = ["Customer", "Segment of the market"]


def _cells(*cols: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cols], F.lit("</tr>"))


def _rows_in_order(key: str, row: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("r")))), lambda x: x["r"]), "")


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with tables: suppliers by (nation, suppkey div 50) under a <th>
    header row; customers by (nation, custkey div 50) with the header in the
    first row's <td> and a one-cell closing row."""
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s_rows = s.withColumn("b", F.floor(F.col("s_suppkey") / TABLE_BUCKET)).groupBy("s_nationkey", "b", "n_name").agg(
        _rows_in_order("s_suppkey", _cells(F.col("s_name"), F.col("n_name"), F.floor("s_acctbal").cast("bigint").cast("string"))).alias("rows"))
    th = "".join(f"<th>{h}</th>" for h in SUPPLIER_HEADERS)
    sup = s_rows.select(
        (F.lit(1_000_000_000) + F.col("s_nationkey") * 1_000_000 + F.col("b")).cast("bigint").alias("page_id"),
        F.concat(F.lit("<html><body><h2>Suppliers of "), F.col("n_name"), F.lit(f"</h2><table><tr>{th}</tr>"), F.col("rows"),
                 F.lit("</table></body></html>")).alias("html"))
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    c_rows = c.withColumn("b", F.floor(F.col("c_custkey") / TABLE_BUCKET)).groupBy("c_nationkey", "b").agg(
        _rows_in_order("c_custkey", _cells(F.col("c_name"), F.col("c_mktsegment"))).alias("rows"))
    head = "".join(f"<td>{h}</td>" for h in CUSTOMER_HEADERS)
    cus = c_rows.select(
        (F.lit(2_000_000_000) + F.col("c_nationkey") * 1_000_000 + F.col("b")).cast("bigint").alias("page_id"),
        F.concat(F.lit(f"<html><body><table><tr>{head}</tr>"), F.col("rows"),
                 F.lit("<tr><td>Total</td></tr></table></body></html>")).alias("html"))
    return sup.unionByName(cus)


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the ``pages`` table plus the table pages."""
    return table(spark, sf_dir, "pages", "page_id", "html").unionByName(table_pages(spark, sf_dir))


def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each page wrapped as an API document {body: {storage: {value: html}}}."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    doc = F.struct(F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"))
    return p.select("page_id", F.to_json(doc).alias("json"))


# ---------------------------------------------------------- source tree (F4)
BROKEN_EVERY = 13


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src/s<k>.py`` per supplier importing ``p<partkey>`` for every part
    it supplies (``from p.core import x`` for even keys, ``import p.core as c``
    for odd), plus relative imports (``from . import``, ``from .s<k>``,
    ``from .util``) and ``import sys`` inside a function; every 13th supplier's
    file does not parse.  ``lib/p<k>.py`` for every part;
    ``old/p<k>.py`` (importing p<k+1>) for p_size = 1, which wins the name
    clash; ``notes/s<k>.txt`` files that are not Python."""
    pairs = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").distinct()
    per_supp = pairs.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("pks"))
    sup = table(spark, sf_dir, "supplier", "s_suppkey").join(per_supp, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    k = F.col("s_suppkey").cast("string")
    lines = F.transform(
        F.coalesce(F.col("pks"), F.array().cast("array<bigint>")),
        lambda pk: F.when(pk % 2 == 0, F.concat(F.lit("from p"), pk.cast("string"), F.lit(".core import x\n")))
        .otherwise(F.concat(F.lit("import p"), pk.cast("string"), F.lit(".core as c"), pk.cast("string"), F.lit("\n"))),
    )
    content = F.concat(
        F.lit('"""Supplier '), k, F.lit('."""\n'), F.array_join(lines, ""),
        F.lit("from . import sibling\nfrom .s"), k, F.lit(" import y\nfrom .util import z\n\n"),
        F.lit("def helper():\n    import sys\n    return sys\n"),
        F.when(F.col("s_suppkey") % BROKEN_EVERY == 0, F.lit("def broken(:\n")).otherwise(F.lit("")),
    )
    src = sup.select(F.concat(F.lit("src/s"), k, F.lit(".py")).alias("path"), content.alias("content"))
    notes = sup.select(F.concat(F.lit("notes/s"), k, F.lit(".txt")).alias("path"), F.lit("import p1\n").alias("content"))
    part = table(spark, sf_dir, "part", "p_partkey", "p_size")
    pk = F.col("p_partkey").cast("string")
    lib = part.select(
        F.concat(F.lit("lib/p"), pk, F.lit(".py")).alias("path"), F.concat(F.lit("VALUE = "), pk, F.lit("\n")).alias("content"))
    legacy = part.where(F.col("p_size") == 1).select(
        F.concat(F.lit("old/p"), pk, F.lit(".py")).alias("path"),
        F.concat(F.lit("import p"), (F.col("p_partkey") + 1).cast("string"), F.lit("\n")).alias("content"))
    return src.unionByName(notes).unionByName(lib).unionByName(legacy)


# ------------------------------------------------------------- replay (F8)
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: one record per user turn: the user text (``Prompt``), the next
    assistant text (``response``, NULL when there is none), the previous turn
    (``contexts``) and a benchmark passage as ``expected``."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w)) \
         .withColumn("prev_text", F.lag("text").over(w))
    bench = table(spark, sf_dir, "benchmark", "item_id", "text").withColumnRenamed("text", "expected")
    u = c.where(F.col("role") == "user")
    u = u.join(bench, (u["conv_id"] % F.lit(max(bench.count(), 1))) == bench["item_id"], "left")
    return u.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("record_id"),
        F.col("text").alias("Prompt"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("response"),
        "expected",
        F.col("prev_text").alias("contexts"),
    )
