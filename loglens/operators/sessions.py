"""Turn logs into sessions: normalise, order, merge short turns, roll up.

Plan shape (one shuffle): every window and the roll-up are keyed on
``session_id``, so Spark hash-partitions the turns once and the windows, the
partial/final aggregation and the ordered prompt join all run on that
partitioning.  Sessions that hold more rows than one task should take are
split by :mod:`loglens.operators.hot_sessions` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens import defaults
from loglens.functions.text import first_match, py_token_count, to_clean_text

ORDER_COLS = ["_ts_null", "query_timestamp", "seq"]


def require_columns(df: DataFrame, required: Sequence[str] = defaults.REQUIRED_LOG_COLUMNS) -> DataFrame:
    """Raise ``ValueError`` naming the absent columns (driver-side, no job)."""
    if absent := sorted(set(required) - set(df.columns)):
        raise ValueError(f"the log table lacks {', '.join(absent)}")
    return df


def parse_timestamp(df: DataFrame, column: str, formats: Sequence[str] = defaults.TIMESTAMP_FORMATS) -> Column:
    """The column as a timestamp: ISO forms first, then each format in order;
    NULL where none fits."""
    if df.schema[column].dataType.simpleString().startswith("timestamp"):
        return F.col(column).cast("timestamp_ntz")
    text = F.trim(F.col(column).cast("string"))
    tried = [F.expr(f"try_cast(trim(CAST(`{column}` AS STRING)) AS TIMESTAMP_NTZ)")]
    tried += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tried)


def normalise_logs(df: DataFrame, min_tokens: int = defaults.MIN_PROMPT_TOKENS,
                   formats: Sequence[str] = defaults.TIMESTAMP_FORMATS) -> DataFrame:
    """Clean text fields, parse the timestamp, count tokens, flag short prompts.

    ``prompt`` keeps its case; ``division``, ``user_type`` and ``co`` are
    lower-cased; ``timestamp_unparsed`` tells where a timestamp text fits no
    layout.  A ``seq`` column (input order) is required for stable
    ordering of equal timestamps; it is added from the file position when
    missing.
    """
    require_columns(df)
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.monotonically_increasing_id())
    return (
        df.withColumn("prompt", to_clean_text(F.col("prompt")))
        .withColumn("division", to_clean_text(F.col("division"), lower=True))
        .withColumn("user_type", to_clean_text(F.col("user_type"), lower=True))
        .withColumn("co", to_clean_text(F.col("co"), lower=True))
        .withColumn("timestamp_unparsed", F.col("query_timestamp").isNotNull() & parse_timestamp(df, "query_timestamp", formats).isNull())
        .withColumn("query_timestamp", parse_timestamp(df, "query_timestamp", formats))
        .withColumn("prompt_token_count", py_token_count(F.col("prompt")).cast("bigint"))
        .withColumn("is_short_prompt", F.col("prompt_token_count") < F.lit(min_tokens))
    )


def _turn_window() -> Window:
    return Window.partitionBy("session_id").orderBy(*ORDER_COLS)


def order_turns(turns: DataFrame) -> DataFrame:
    """Position of each turn in its session: time ascending, unknown time last,
    equal times in input order (``seq``)."""
    return (
        turns.where(F.col("session_id").isNotNull())
        .withColumn("_ts_null", F.col("query_timestamp").isNull())
        .withColumn("rn", F.row_number().over(_turn_window()))
    )


def mark_merges(ordered: DataFrame) -> DataFrame:
    """Closed form of the short-turn pair merge.

    Walking the turns in order, a short turn with a successor is joined to it
    and both are consumed.  Equivalently: with ``last_long`` the position of
    the last long turn before this one (0 if none), a turn is consumed by its
    predecessor iff ``rn - 1 - last_long`` is odd.
    """
    w = _turn_window()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_long = F.coalesce(F.max(F.when(~F.col("is_short_prompt"), F.col("rn"))).over(before), F.lit(0))
    nxt = F.lead("prompt").over(w)
    return (
        ordered.withColumn("_last_long", last_long)
        .withColumn("_next_prompt", nxt)
        .withColumn("kept", ((F.col("rn") - 1 - F.col("_last_long")) % 2) == 0)
        .withColumn(
            "merged_prompt",
            F.when(
                F.col("is_short_prompt") & F.col("_next_prompt").isNotNull(),
                F.concat(F.col("prompt"), F.lit(" "), F.col("_next_prompt")),
            ).otherwise(F.col("prompt")),
        )
        .drop("_last_long", "_next_prompt")
    )


#: Turns from which a session is split over tasks.
HOT_SESSION_ROWS = 1_000_000


def merge_short_turns(turns: DataFrame, hot_session_rows: int | None = HOT_SESSION_ROWS) -> DataFrame:
    """Kept (merged) turns: one row per element of the session's prompt list.
    Sessions of any size: those above ``hot_session_rows`` are split over tasks."""
    if hot_session_rows is None:
        return mark_merges(order_turns(turns)).where("kept")
    from loglens.operators.hot_sessions import marked_turns

    return marked_turns(turns, hot_session_rows).where("kept")


def ordered_join(key: Column, value: Column, sep: str) -> Column:
    """``sep.join(values ordered by key)`` as an aggregate (NULL values skipped)."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(key.alias("k"), value.alias("v"))))),
                    lambda x: x["v"]),
        sep,
    )


def session_aggregates(department_map: Sequence[tuple[str, str]]) -> list[Column]:
    order_key = F.struct(*[F.col(c) for c in ORDER_COLS])
    return [
        F.min_by("username", order_key).alias("username"),
        F.mode("co", True).alias("co"),
        F.mode("user_type", True).alias("user_type"),
        F.mode("division", True).alias("division"),
        ordered_join(F.col("rn"), F.when(F.col("kept"), F.col("merged_prompt")), " | ").alias("combined_prompt"),
        F.count(F.lit(1)).alias("turn_count"),
        F.min("query_timestamp").alias("first_timestamp"),
        F.max("query_timestamp").alias("last_timestamp"),
    ]


SESSION_COLUMNS = [
    "session_id", "username", "co", "user_type", "division", "combined_prompt",
    "turn_count", "domain_prior", "first_timestamp", "last_timestamp",
]


def add_domain_prior(sessions: DataFrame, department_map=defaults.DEPARTMENT_DOMAIN_MAP) -> DataFrame:
    return sessions.withColumn("domain_prior", first_match(F.col("division"), department_map))


def build_sessions(
    turns: DataFrame,
    department_map: Sequence[tuple[str, str]] = defaults.DEPARTMENT_DOMAIN_MAP,
    hot_session_rows: int | None = HOT_SESSION_ROWS,
) -> DataFrame:
    """Normalised turns -> one row per session (see ``SESSION_COLUMNS``).

    ``hot_session_rows``: sessions with more turns than this are split across
    tasks (see :mod:`loglens.operators.hot_sessions`); ``None`` keeps the
    single-shuffle plan for all sessions.  All session queries and jobs share
    this plan and its default.
    """
    if hot_session_rows is not None:
        from loglens.operators.hot_sessions import build_sessions_skew_aware

        return build_sessions_skew_aware(turns, department_map, hot_session_rows)
    marked = mark_merges(order_turns(turns))
    sessions = marked.groupBy("session_id").agg(*session_aggregates(department_map))
    return add_domain_prior(sessions, department_map).select(*SESSION_COLUMNS)
