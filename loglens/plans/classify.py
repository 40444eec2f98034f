"""The log-classification job end to end.

turns -> sessions (one shuffle on session_id) -> similarity arrays (lexical
token join, or a dense encoder + broadcast matrix kernel) -> hybrid scores,
arg-max, rounded confidences -> routing -> fallback hook -> governance flags
(broadcast matrix, watchlist) -> optional one-pass partitioned write.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loglens import defaults
from loglens.operators import lexical, routing, scoring, sessions
from loglens.operators.encoders import encode_column
from loglens.sources import logs as logs_source


def classify_sessions(
    sess: DataFrame,
    prototypes: DataFrame,
    matrix: DataFrame,
    encoder_factory: Callable | None = None,
    watchlist: Sequence[str] = defaults.WATCHLIST,
    high: float = defaults.HIGH_CONF_THRESHOLD,
    low: float = defaults.LOW_CONF_THRESHOLD,
    flag_sources: Sequence[str] = (defaults.LABEL_SEMANTIC,),
    fallback: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Session rows -> scored, routed and flagged rows (score maps included)."""
    if encoder_factory is None:
        sims, cats = lexical.lexical_similarities(sess, prototypes)
    else:
        svec = encode_column(sess, "combined_prompt", "_vec", encoder_factory)
        pvec = encode_column(prototypes, "text", "vec", encoder_factory)
        sims, cats = scoring.dense_similarities(svec, pvec, vec_col="_vec")
        sims = sims.drop("_vec")
    scored = scoring.with_best_category(scoring.with_hybrid_scores(sims, cats), cats)
    routed = routing.llm_fallback(routing.route_confidence(scored, high=high, low=low), fallback)
    drop = [scoring.sims_field(a, k) for a in scoring.AXES for k in scoring.KINDS] + ["domain_scores", "intent_scores"]
    return routing.apply_governance(routed.drop(*drop), matrix, watchlist, flag_sources=flag_sources)


def classify_logs(
    logs: DataFrame,
    prototypes: DataFrame,
    matrix: DataFrame,
    department_map=defaults.DEPARTMENT_DOMAIN_MAP,
    hot_session_rows: int | None = sessions.HOT_SESSION_ROWS,
    **kw,
) -> DataFrame:
    turns = sessions.normalise_logs(logs)
    sess = sessions.build_sessions(turns, department_map, hot_session_rows=hot_session_rows)
    return classify_sessions(sess, prototypes, matrix, **kw)


def run_job(logs: DataFrame, prototypes: DataFrame, matrix: DataFrame, out_dir: str, **kw) -> str:
    """Classify and write the five outputs in one partitioned write."""
    labelled = classify_logs(logs, prototypes, matrix, **kw)
    return routing.write_outputs(labelled, out_dir, datetime.now().strftime("%Y%m%d_%H%M%S"))


def run_files(spark: SparkSession, path: str, fmt: str, prototypes: DataFrame, matrix: DataFrame, out_dir: str, rejects_dir: str, **kw) -> tuple[str, DataFrame]:
    """``run_job`` over CSV or JSON log files: records that do not parse go to ``rejects_dir`` as (file, record, raw).
    Returns the run's folder and its summary: the counts of the sessions, the turns and the records."""
    log = logs_source.read_logs_checked(spark, path, fmt)
    run_ts = datetime.now().strftime("%Y%m%d_%H%M%S")
    log.rejects.write.mode("overwrite").parquet(f"{rejects_dir.rstrip('/')}/run_ts={run_ts}")
    labelled = classify_logs(log.rows, prototypes, matrix, **kw)
    target = routing.write_outputs(labelled, out_dir, run_ts)
    types = T.StructType([labelled.schema[c] for c in defaults.OUTPUT_COLUMNS])
    written = routing.read_outputs(spark, out_dir, types, run_ts, defaults.SINK_ALL)  # nothing is scored twice
    return target, routing.run_summary(written, sessions.normalise_logs(log.rows)).unionByName(log.counts())
