"""Skew-aware session building: sessions too large for one task are split.

A session with millions of turns would put one window partition into one
task.  Here:

1. Sessions with more than ``hot_session_rows`` turns are found with a
   partial-aggregated count; their ids (at most total_rows /
   hot_session_rows of them) are written once.
2. Other sessions take the single-shuffle plan of :mod:`sessions`.
3. Turns of hot sessions are range-partitioned on the full sort key
   (session, time, input order), so one session spreads over many
   partitions ("segments"), each holding a contiguous run of its turns.
4. Windows run per (session, segment); a per-segment summary (row count,
   last long turn, first prompt), at most #hot sessions x #partitions rows
   carries positions, the last long turn and the next
   segment's first prompt across segment boundaries, so the short-turn merge
   is exact.
5. The prompt list is joined per segment first, then the segment strings are
   concatenated per session in segment order; the other roll-up columns are
   partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens import defaults
from loglens.config import ensure_checkpoint_dir
from loglens.operators import sessions as S

def hot_session_ids(turns: DataFrame, hot_session_rows: int) -> DataFrame:
    """Ids of the sessions with more turns.  A log with no more turns in all has none,
    which one count without a shuffle tells.  Else the turns are counted per session:
    that reads only ``session_id`` (column pruning) and combines map-side; the few ids
    (at most total rows / ``hot_session_rows``) are written once, and whether they are
    broadcast is left to their size in bytes."""
    if turns.count() <= hot_session_rows:
        return turns.sparkSession.createDataFrame([], turns.select("session_id").schema)
    ensure_checkpoint_dir(turns.sparkSession)
    counts = turns.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > hot_session_rows).select("session_id").checkpoint()


def _segment_rollup(hot_turns: DataFrame, partitions: int | None) -> DataFrame:
    """Marked turns (kept / merged_prompt / global rn) of hot sessions."""
    t = hot_turns.withColumn("_ts_null", F.col("query_timestamp").isNull())
    n = partitions or int(hot_turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartitionByRange(n, "session_id", *S.ORDER_COLS).withColumn("_seg", F.spark_partition_id())
    w = Window.partitionBy("session_id", "_seg").orderBy(*S.ORDER_COLS)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("_lrn", F.row_number().over(w))
        .withColumn("_llong", F.max(F.when(~F.col("is_short_prompt"), F.col("_lrn"))).over(before))
        .withColumn("_lnext", F.lead("prompt").over(w))
    )
    # read twice below (segment summary, join back), with the same segments: written
    # once, so a lost executor does not deal them anew
    t = t.checkpoint()
    seg = t.groupBy("session_id", "_seg").agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.max(F.when(~F.col("is_short_prompt"), F.col("_lrn"))).alias("_seg_long"),
        F.min_by("prompt", "_lrn").alias("_first_prompt"),
    )
    ws = Window.partitionBy("session_id").orderBy("_seg")
    seg = (
        seg.withColumn("_off", F.coalesce(F.sum("_cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_seg_long_g", F.col("_seg_long") + F.col("_off"))
        .withColumn("_carry_long", F.max("_seg_long_g").over(ws.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_next_first", F.lead("_first_prompt").over(ws))
        .select("session_id", "_seg", "_cnt", "_off", "_carry_long", "_next_first")
    )
    # at most (#hot sessions x #partitions) rows; broadcast if they turn out small
    t = t.join(seg, ["session_id", "_seg"])
    rn = F.col("_off") + F.col("_lrn")
    last_long = F.coalesce(F.col("_llong") + F.col("_off"), F.col("_carry_long"), F.lit(0))
    nxt = F.when(F.col("_lrn") == F.col("_cnt"), F.col("_next_first")).otherwise(F.col("_lnext"))
    return (
        t.withColumn("rn", rn)
        .withColumn("kept", ((F.col("rn") - 1 - last_long) % 2) == 0)
        .withColumn(
            "merged_prompt",
            F.when(F.col("is_short_prompt") & nxt.isNotNull(), F.concat(F.col("prompt"), F.lit(" "), nxt)).otherwise(F.col("prompt")),
        )
    )


MARKED = ["rn", "kept", "merged_prompt"]


def marked_turns(turns: DataFrame, hot_session_rows: int, partitions: int | None = None) -> DataFrame:
    """All turns with their position and merge (``rn``, ``kept``, ``merged_prompt``),
    the hot sessions' by segments."""
    turns = turns.where(F.col("session_id").isNotNull())
    hot = hot_session_ids(turns, hot_session_rows)
    if hot.isEmpty():
        return S.mark_merges(S.order_turns(turns))
    keep = [*turns.columns, *MARKED]
    normal = S.mark_merges(S.order_turns(turns.join(hot, "session_id", "left_anti")))
    split = _segment_rollup(turns.join(hot, "session_id", "left_semi"), partitions)
    return normal.select(*keep).unionByName(split.select(*keep))


def build_sessions_skew_aware(
    turns: DataFrame,
    department_map: Sequence[tuple[str, str]] = defaults.DEPARTMENT_DOMAIN_MAP,
    hot_session_rows: int = 1_000_000,
    partitions: int | None = None,
) -> DataFrame:
    turns = turns.where(F.col("session_id").isNotNull())
    hot = hot_session_ids(turns, hot_session_rows)
    if hot.isEmpty():
        return S.build_sessions(turns, department_map, None)
    # two scans of the input, each filtered by the few hot ids; nothing is kept
    normal = turns.join(hot, "session_id", "left_anti")
    marked = S.mark_merges(S.order_turns(normal))
    normal_sessions = marked.groupBy("session_id").agg(*S.session_aggregates(department_map))

    hot_turns = turns.join(hot, "session_id", "left_semi")
    m = _segment_rollup(hot_turns, partitions)
    # prompt list: per segment (rows of a segment are co-located), then per session
    seg_text = m.groupBy("session_id", "_seg").agg(
        S.ordered_join(F.col("rn"), F.when(F.col("kept"), F.col("merged_prompt")), " | ").alias("_t"),
        F.count_if(F.col("kept")).alias("_k"),
    )
    text = seg_text.groupBy("session_id").agg(
        S.ordered_join(F.col("_seg"), F.when(F.col("_k") > 0, F.col("_t")), " | ").alias("combined_prompt")
    )
    order_key = F.struct(*[F.col(c) for c in S.ORDER_COLS])
    rest = hot_turns.withColumn("_ts_null", F.col("query_timestamp").isNull()).groupBy("session_id").agg(
        F.min_by("username", order_key).alias("username"),
        F.mode("co", True).alias("co"),
        F.mode("user_type", True).alias("user_type"),
        F.mode("division", True).alias("division"),
        F.count(F.lit(1)).alias("turn_count"),
        F.min("query_timestamp").alias("first_timestamp"),
        F.max("query_timestamp").alias("last_timestamp"),
    )
    hot_sessions = rest.join(text, "session_id")
    cols = [c for c in S.SESSION_COLUMNS if c != "domain_prior"]
    out = normal_sessions.select(*cols).unionByName(hot_sessions.select(*cols))
    return S.add_domain_prior(out, department_map).select(*S.SESSION_COLUMNS)
