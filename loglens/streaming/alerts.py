"""Streaming governance alerts: the watchlist applied to turns as they arrive.

Stateless (filter + projection), so every micro-batch is independent and the
output equals the batch job over the same files.  Checkpoints live under the
session's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loglens import defaults
from loglens.config import ensure_checkpoint_dir
from loglens.operators import routing, sessions
from loglens.sources.logs import LOG_SCHEMA

ALERT_COLUMNS = ["session_id", "seq", "username", "query_timestamp", "prompt", "watchlist_reason"]


def turn_alerts(turns: DataFrame, words: Sequence[str] = defaults.WATCHLIST) -> DataFrame:
    """Turns whose prompt hits the watchlist (batch or streaming input)."""
    t = routing.with_watchlist(sessions.normalise_logs(turns), "prompt", words)
    return t.where("watchlist_hit").select(*ALERT_COLUMNS)


def start_alert_stream(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    words: Sequence[str] = defaults.WATCHLIST,
    schema: T.StructType = LOG_SCHEMA,
    max_files_per_trigger: int = 100,
    available_now: bool = True,
    name: str = "turn_alerts",
) -> StreamingQuery:
    """Parquet turn files -> alert rows appended to ``out_dir`` (parquet)."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    # stable per stream name, so a restarted stream resumes where it stopped
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = turn_alerts(src, words).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.queryName(name).start()
