"""End-to-end jobs: read -> compute -> write, one per workload.

Each job is a thin composition of the operators; outputs are Parquet/JSON
folders written in one job each.  The log classifier's job is
:func:`loglens.plans.classify.run_job`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions.text import explode_positions

from loglens.operators import chunking, completion, email, html_text, imports, long_documents, replay, rounds, threads
from loglens.sources import documents
from loglens.sources.logs import read_eval_log
from loglens.sources.source_tree import read_source_tree


def summarise_documents(
    pages: DataFrame,
    out_path: str,
    info: DataFrame | None = None,
    fn: Callable[[str], str] | None = None,
    completion_factory=None,
    is_financial: bool = True,
    chunk_size: int = 2000,
) -> None:
    """pages (doc_id, page_no, text) [+ metadata] -> one JSON summary per document."""
    docs = documents.assemble_documents(pages, info)
    b = chunking.with_chunks(docs, chunk_size=chunk_size)
    chunks = explode_positions(b, ["doc_id", *completion.META], F.col("chunks"), "chunk_idx", "chunk")
    completion.write_summaries(completion.summarise(chunks, fn, completion_factory, is_financial), out_path)


def review_threads(
    emails: DataFrame,
    out_path: str,
    fn: Callable[[str], str] | None = None,
    completion_factory=None,
    flavour: str = "findings",
) -> None:
    """emails (thread_id, email_no, body) -> per-e-mail fold rows (``steps``) and,
    for the findings flavour, the closing report of every thread (``reports``),
    made from the written steps, so no model call runs twice."""
    steps = f"{out_path.rstrip('/')}/steps"
    threads.fold_threads(emails, fn, completion_factory, flavour=flavour).write.mode("overwrite").parquet(steps)
    if flavour == "findings":
        reports = threads.fold_reports(emails.sparkSession.read.parquet(steps), fn, completion_factory)
        reports.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/reports")


def review_threads_in_rounds(
    emails: DataFrame,
    out_path: str,
    fn: Callable[[str], str] | None = None,
    completion_factory=None,
    batch_factory=None,
    flavour: str = "findings",
    per_round: int = rounds.PER_ROUND,
) -> None:
    """``review_threads`` by the fold in rounds: model calls are batched across threads, and a job that was killed is
    resumed by starting it again with the same arguments.  ``out_path`` gets ``run`` (the rounds), ``steps`` (what every
    e-mail added) and, for the findings flavour, ``reports``."""
    base = out_path.rstrip("/")
    steps = rounds.fold_in_rounds(emails, f"{base}/run", fn, completion_factory, batch_factory, flavour, per_round=per_round)
    steps.write.mode("overwrite").parquet(f"{base}/steps")
    if flavour == "findings":
        spark = emails.sparkSession
        reports = rounds.fold_reports(spark, f"{base}/run", spark.read.parquet(f"{base}/steps"), fn, completion_factory)
        reports.write.mode("overwrite").parquet(f"{base}/reports")


def chunk_long_documents(pages: DataFrame, out_path: str, **kw) -> None:
    """pages (doc_id, page_no, text) -> (doc_id, chunk_idx, chunk), no document being one value."""
    long_documents.chunk_pages(pages, **kw).write.mode("overwrite").parquet(out_path)


def report_threads(outputs: DataFrame, out_path: str, fn=None, completion_factory=None) -> None:
    """Known per-e-mail model outputs (thread_id, email_no, out) -> findings,
    rejects and the final conclusion per thread."""
    f = threads.joined_findings(threads.thread_finding_pieces(outputs))
    threads.thread_reports(f, fn, completion_factory).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/reports")
    threads.finding_rejects(outputs).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/rejects")


def email_headers(mails: DataFrame, out_path: str, text_col: str = "body", **kw) -> None:
    email.extract_headers(mails, text_col, **kw).write.mode("overwrite").parquet(out_path)


def pages_to_text(pages: DataFrame, out_path: str, id_col: str = "page_id", html_col: str = "html") -> None:
    """Whole-page text and table rows (two Parquet folders)."""
    html_text.html_to_text(pages, id_col, html_col).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/text")
    rows = html_text.html_table_rows(pages, id_col, html_col)
    rows.withColumn("row_text", html_text.row_text(F.col("headers"), F.col("values"))) \
        .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/tables")


def import_graph(spark: SparkSession, source_root: str, out_path: str) -> None:
    """Source tree -> nodes and edges (Parquet)."""
    imports.write_graph(read_source_tree(spark, source_root), out_path)


def replay_eval(spark: SparkSession, csv_path: str, out_path: str) -> list[str]:
    """Recorded runs (CSV) -> replayed records with built-in scores for the
    metrics the columns allow; returns the chosen metric names."""
    log = read_eval_log(spark, csv_path)
    mapping = replay.detect_columns(log.columns)
    metrics = replay.pick_metrics(mapping)
    scored = replay.overlap_scores(replay.replay_frame(log, mapping), metrics)
    scored.write.mode("overwrite").parquet(out_path)
    return metrics
