"""Category taxonomy: read (file or JSON text), flatten to prototype rows,
and flatten the governance matrix.

Taxonomy document shape::

    {"domains": [{"code", "name", "definition", "keywords": [..], "phrases": [..]}, ...],
     "intents": [ same ],
     "governance_flag_matrix": {"high_risk": [{"domain", "intent", "reason"}, ...],
                                "medium_risk": [ same ]}}
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens import defaults

CATEGORY = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("definition", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("phrases", T.ArrayType(T.StringType())),
])
FLAG = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("reason", T.StringType()),
])
TAXONOMY_SCHEMA = T.StructType([
    T.StructField("domains", T.ArrayType(CATEGORY)),
    T.StructField("intents", T.ArrayType(CATEGORY)),
    T.StructField("governance_flag_matrix", T.StructType([
        T.StructField("high_risk", T.ArrayType(FLAG)),
        T.StructField("medium_risk", T.ArrayType(FLAG)),
    ])),
])
PROTOTYPE_COLUMNS = ["category_type", "ord", "code", "name", "kind", "text"]


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """One row per taxonomy file, explicit schema (no inference pass)."""
    return spark.read.schema(TAXONOMY_SCHEMA).option("multiLine", True).json(path)


def parse_taxonomy(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Taxonomy documents held as JSON text in a column -> the same shape."""
    return df.select(F.from_json(F.col(json_col), TAXONOMY_SCHEMA).alias("t")).select("t.*")


def _categories(tax: DataFrame, field: str, axis: str) -> DataFrame:
    return tax.select(F.posexplode(field).alias("ord", "c")).select(
        F.lit(axis).alias("category_type"), F.col("ord").cast("int").alias("ord"), "c.*"
    )


def categories(tax: DataFrame) -> DataFrame:
    """One row per category: (category_type, ord, code, name, definition, keywords, phrases);
    ``ord`` is the position in its list (taxonomy order, used for arg-max ties)."""
    return _categories(tax, "domains", "domain").unionByName(_categories(tax, "intents", "intent"))


def flatten_taxonomy(tax: DataFrame) -> DataFrame:
    """One row per definition, keyword and phrase: ``PROTOTYPE_COLUMNS``."""
    return flatten_categories(categories(tax))


def flatten_categories(cats: DataFrame) -> DataFrame:
    """Category rows -> one prototype row per definition, keyword and phrase
    (one ``explode`` per category row)."""
    def tagged(kind, texts):
        return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    items = F.concat(
        F.array(F.struct(F.lit("definition").alias("kind"), F.col("definition").alias("text"))),
        tagged("keyword", F.coalesce(F.col("keywords"), F.array().cast("array<string>"))),
        tagged("phrase", F.coalesce(F.col("phrases"), F.array().cast("array<string>"))),
    )
    return cats.select("category_type", "ord", "code", "name", F.explode(items).alias("p")).select(
        "category_type", "ord", "code", "name", "p.kind", "p.text")


def governance_matrix(tax: DataFrame) -> DataFrame:
    """(domain, intent, level, reason): high-risk entries, then medium-risk
    ones; on a repeated (domain, intent) pair the later entry wins."""
    m = tax.select("governance_flag_matrix.*")
    high = m.select(F.posexplode("high_risk").alias("i", "e")).select(
        F.lit(0).alias("list_no"), "i", F.lit(defaults.FLAG_HIGH).alias("level"), "e.*")
    med = m.select(F.posexplode("medium_risk").alias("i", "e")).select(
        F.lit(1).alias("list_no"), "i", F.lit(defaults.FLAG_MEDIUM).alias("level"), "e.*")
    return latest_per_pair(high.unionByName(med), F.struct("list_no", "i"))


def latest_per_pair(entries: DataFrame, position: Column) -> DataFrame:
    """Keep the entry with the greatest ``position`` per (domain, intent).

    ``max_by`` is a partial aggregate, so repeated pairs are reduced before
    the shuffle however many copies one pair has.
    """
    picked = F.max_by(F.struct("level", "reason"), position)
    return entries.groupBy("domain", "intent").agg(picked.alias("p")).select("domain", "intent", "p.level", "p.reason")
