"""Confidence routing, governance flags, run summaries and the one-pass output write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens import defaults
from loglens.functions.text import first_match, strip_chars
from loglens.operators.sizes import broadcast_if_small
from loglens.sources.logs import CSV_READ, CSV_TEXT, FILE_RECORDS


def watchlist_reason(text: Column, words: Sequence[str] = defaults.WATCHLIST) -> Column:
    """Reason text of the first watchlist entry found (case-insensitive), else NULL."""
    entries = [(w, defaults.WATCHLIST_REASON_PREFIX + w + defaults.WATCHLIST_REASON_SUFFIX) for w in words]
    return first_match(text, entries, case_insensitive=True)


def with_watchlist(df: DataFrame, text_col: str = "combined_prompt", words: Sequence[str] = defaults.WATCHLIST) -> DataFrame:
    reason = watchlist_reason(F.col(text_col), words)
    return df.withColumn("watchlist_reason", F.coalesce(reason, F.lit(""))).withColumn(
        "watchlist_hit", reason.isNotNull()
    )


def route_confidence(
    df: DataFrame,
    high: float = defaults.HIGH_CONF_THRESHOLD,
    low: float = defaults.LOW_CONF_THRESHOLD,
    conf_col: str = "combined_confidence",
) -> DataFrame:
    """label_source: ``semantic`` (>= high), ``llm_classify`` (>= low), else ``unclassified``."""
    c = F.col(conf_col)
    return df.withColumn(
        "label_source",
        F.when(c >= F.lit(high), F.lit(defaults.LABEL_SEMANTIC)).when(c >= F.lit(low), F.lit(defaults.LABEL_LLM))
        .otherwise(F.lit(defaults.LABEL_UNCLASSIFIED)),
    )


def label_distribution(df: DataFrame, col: str = "label_source") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def apply_governance(
    df: DataFrame,
    matrix: DataFrame,
    words: Sequence[str] = defaults.WATCHLIST,
    text_col: str = "combined_prompt",
    flag_sources: Sequence[str] = (defaults.LABEL_SEMANTIC,),
) -> DataFrame:
    """governance_flag / governance_reason.

    The matrix level and reason apply only to rows whose label_source is in
    ``flag_sources``; a watchlist hit sets HIGH for any row and appends its
    reason as ``(reason + ' | ' + hit).strip(' |')``.  The matrix holds at
    most one row per (domain, intent) pair, so it is broadcast after a size
    check.
    """
    m = matrix.select(
        F.col("domain").alias("_gd"), F.col("intent").alias("_gi"),
        F.col("level").alias("_gl"), F.col("reason").alias("_gr"),
    )
    m = broadcast_if_small(m)
    cond = (
        (F.col("predicted_domain") == F.col("_gd"))
        & (F.col("predicted_intent") == F.col("_gi"))
        & F.col("label_source").isin(list(flag_sources))
    )
    joined = with_watchlist(df.join(m, cond, "left"), text_col, words)
    base_reason = F.coalesce(F.col("_gr"), F.lit(""))
    hit = F.col("watchlist_hit")
    return (
        joined.withColumn(
            "governance_flag",
            F.when(hit, F.lit(defaults.FLAG_HIGH)).when(F.col("_gl").isNotNull(), F.col("_gl")).otherwise(F.lit(defaults.FLAG_NONE)),
        )
        .withColumn(
            "governance_reason",
            F.when(hit, strip_chars(F.concat(base_reason, F.lit(defaults.GOVERNANCE_REASON_SEPARATOR), F.col("watchlist_reason")),
                                    defaults.GOVERNANCE_REASON_SEPARATOR)).otherwise(base_reason),
        )
        .drop("_gd", "_gi", "_gl", "_gr")
    )


def fallback_queue(df: DataFrame, truncate: int | None = None) -> DataFrame:
    """Sessions waiting for the fallback classifier, with the prompt that it would
    receive: the whole one, or its first ``truncate`` characters where asked for."""
    prompt = F.col("combined_prompt")
    excerpt = prompt if truncate is None else F.substring(prompt, 1, truncate)
    return df.where(F.col("label_source") == defaults.LABEL_LLM).withColumn("prompt_excerpt", excerpt)


def llm_fallback(df: DataFrame, classify=None) -> DataFrame:
    """Fallback stage hook: identity by default (rows stay ``llm_classify``)."""
    return df if classify is None else classify(df)


def sinks() -> list[tuple[str, Column | None]]:
    """(sink name, condition); ``None`` = every row."""
    return [
        (defaults.SINK_ALL, None),
        (defaults.SINK_HIGH, F.col("governance_flag") == defaults.FLAG_HIGH),
        (defaults.SINK_MEDIUM, F.col("governance_flag") == defaults.FLAG_MEDIUM),
        (defaults.SINK_LLM, F.col("label_source") == defaults.LABEL_LLM),
        (defaults.SINK_UNCLASSIFIED, F.col("label_source") == defaults.LABEL_UNCLASSIFIED),
    ]


def route_outputs(df: DataFrame) -> DataFrame:
    """(sink, record...) rows: every session goes to the full log and to each
    conditional sink it qualifies for.  A single pass; sinks with no rows
    simply produce no rows."""
    tags = F.array(*[F.lit(name) if cond is None else F.when(cond, F.lit(name)) for name, cond in sinks()])
    return df.withColumn("sink", F.explode(F.filter(tags, lambda x: x.isNotNull())))


def write_outputs(df: DataFrame, out_dir: str, run_ts: str, columns: Sequence[str] = defaults.OUTPUT_COLUMNS) -> str:
    """One job, one partitioned CSV write: ``out_dir/run_ts=<ts>/sink=<name>/``.  Writing a run again replaces it as a
    whole, a sink that is now empty included; other runs stay."""
    target = f"{out_dir.rstrip('/')}/run_ts={run_ts}"
    out = route_outputs(df.select(*columns)).write.mode("overwrite").partitionBy("sink").option("maxRecordsPerFile", FILE_RECORDS)
    out.options(**CSV_TEXT).csv(target)
    return target


def read_outputs(spark: SparkSession, out_dir: str, schema: T.StructType, run_ts: str | None = None, sink: str | None = None) -> DataFrame:
    """(run_ts, sink, <columns>) of written outputs: all of them, or one run's or one sink's, of which only the folders
    are read.  ``schema`` has the types of the written columns."""
    fields = [*schema.fields, T.StructField("run_ts", T.StringType()), T.StructField("sink", T.StringType())]
    df = spark.read.schema(T.StructType(fields)).options(**CSV_READ).option("multiLine", True).csv(out_dir)
    for name, value in (("run_ts", run_ts), ("sink", sink)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.select("run_ts", "sink", *schema.names)


def run_summary(sessions: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """(metric, n) rows: totals per label source and flag level, plus the
    short-prompt turn count, rows dropped for a missing session id, and turns
    whose timestamp text fits no known layout."""
    c = F.col
    agg = sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(c("label_source") == defaults.LABEL_SEMANTIC).alias("labelled_semantic"),
        F.count_if(c("label_source") == defaults.LABEL_LLM).alias("llm_queue"),
        F.count_if(c("label_source") == defaults.LABEL_UNCLASSIFIED).alias("unclassified"),
        F.count_if(c("governance_flag") == defaults.FLAG_HIGH).alias("high_governance"),
        F.count_if(c("governance_flag") == defaults.FLAG_MEDIUM).alias("medium_governance"),
    )
    names = ["total_sessions", "labelled_semantic", "llm_queue", "unclassified", "high_governance", "medium_governance"]
    out = agg.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names))).alias("metric", "n"))
    if turns is not None:
        t = turns.agg(
            F.count_if(c("is_short_prompt")).alias("short_prompts"),
            F.count_if(c("session_id").isNull()).alias("dropped_null_session"),
            F.count_if(c("timestamp_unparsed")).alias("unparsed_timestamps"),
        )
        tn = ["short_prompts", "dropped_null_session", "unparsed_timestamps"]
        out = out.unionByName(
            t.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in tn]), F.array(*tn))).alias("metric", "n"))
        )
    return out
