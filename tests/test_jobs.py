"""End-to-end jobs: written outputs, the user-encoder path, readers and writers."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from loglens.plans import classify, jobs
from loglens.plans import fixtures as fx
from loglens.sources import taxonomy

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _inputs(spark):
    protos = taxonomy.flatten_categories(fx.benchmark_categories(spark, SF))
    matrix = taxonomy.latest_per_pair(fx.matrix_entries(spark), F.struct("list_no", "i"))
    return fx.logs(spark, SF), protos, matrix


def test_run_job_writes_sinks(spark, tmp_path):
    logs, protos, matrix = _inputs(spark)
    target = classify.run_job(logs, protos, matrix, str(tmp_path), watchlist=fx.FIXTURE_WATCHLIST,
                              high=fx.FLAGSHIP_HIGH, low=fx.FLAGSHIP_LOW)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(target)
    sinks = {r.sink: r["count"] for r in back.groupBy("sink").count().collect()}
    assert sinks["classification_logs"] == logs.select("session_id").distinct().count()
    assert set(sinks) <= {"classification_logs", "governance_alerts", "governance_monitoring", "llm_classify_queue", "unclassified"}
    assert len(back.columns) == 19


def test_user_encoder_path(spark):
    logs, protos, matrix = _inputs(spark)
    from loglens.operators.encoders import hashing_encoder

    out = classify.classify_logs(logs, protos, matrix, encoder_factory=hashing_encoder(32), high=0.9, low=0.5)
    rows = out.collect()
    assert len(rows) > 0 and all(r.predicted_domain.startswith("D") for r in rows)
    assert all(-1.0 <= r.combined_confidence <= 1.0 for r in rows)


def test_log_reader_csv_and_missing(spark, tmp_path):
    from loglens.sources.logs import read_logs

    p = tmp_path / "logs.csv"
    p.write_text("session_id,seq,query_timestamp,username,prompt,co,user_type,division\n"
                 '1,0,2024-01-01 00:00:00,u,"hello, world",c,t,Trading\n')
    df = read_logs(spark, str(p), fmt="csv")
    assert df.first().prompt == "hello, world"
    with pytest.raises(ValueError):
        read_logs(spark, str(p), fmt="csv", schema=None, required=["session_id", "missing_col"])


ROWS = [("S-1", "2024-01-01 00:00:00", "bob", "hello, world", "c", "t", "Trading"), ("S-1", "02/01/2024 10:00", "bob", "again", "c", "t", "Trading"),
        ("17", "13.5.2024 8:05", "eve", "the third one of them", "d", "u", "Risk")]
NAMES = ["session_id", "query_timestamp", "username", "prompt", "co", "user_type", "division"]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
@pytest.mark.parametrize("order", [NAMES, sorted(NAMES), [*NAMES[::-1], "extra"]])
def test_log_reader_goes_by_name(spark, tmp_path, fmt, order):
    from loglens.operators.sessions import build_sessions, normalise_logs
    from loglens.sources.logs import read_logs

    rows = spark.createDataFrame(ROWS, NAMES).withColumn("extra", F.lit("x")).coalesce(1).select(*order)
    rows.write.format(fmt).option("header", True).save(str(tmp_path / "t"))
    got = read_logs(spark, str(tmp_path / "t"), fmt=fmt)
    assert sorted(map(tuple, got.select(*NAMES).collect())) == sorted(ROWS)
    turns = normalise_logs(got)
    assert sorted(str(r[0]) for r in turns.select("query_timestamp").collect()) == ["2024-01-01 00:00:00", "2024-02-01 10:00:00", "2024-05-13 08:05:00"]
    assert {r.session_id: r.turn_count for r in build_sessions(turns).collect()} == {"S-1": 2, "17": 1}
    for gone in ("prompt", "session_id"):
        rows.drop(gone).write.format(fmt).option("header", True).save(str(tmp_path / gone))
        with pytest.raises(ValueError, match=gone):
            read_logs(spark, str(tmp_path / gone), fmt=fmt)


def test_summary_and_graph_writers(spark, tmp_path):
    from loglens.operators import completion, imports

    rows = [(1, i, f"chunk {i}", "T", "A", "", "K", "", "", 2) for i in range(2)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_idx int, chunk string, title string, author string, "
                                         "subject string, keywords string, creation_date string, modification_date string, page_count int")
    completion.write_summaries(completion.summarise(chunks), str(tmp_path / "sum"))
    line = json.loads(open(next((tmp_path / "sum").glob("part-*.json"))).readline())
    assert line["chunk_count"] == 2 and line["metadata"]["title"] == "T"
    files = spark.createDataFrame([("a.py", "import b"), ("b.py", "")], "path string, content string")
    imports.write_graph(files, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).count() == 1


def test_chat_and_report_completion(spark):
    from loglens.operators import completion, threads

    conv = spark.createDataFrame([(1, 0, "system", "be brief"), (1, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    out = completion.chat_complete(completion.chat_transcript(conv), fn=lambda p: str(len(p))).first()
    assert out.prompt == "<|system|>be brief<|end|><|user|>hi<|end|><|assistant|>" and out.completion == str(len(out.prompt))
    f = threads.thread_findings(spark.createDataFrame([(1, 1, '{"deadlines": ["d"]}')], "thread_id long, email_no int, out string"))
    r = threads.thread_reports(f).first()
    assert r.conclusion == f"completion of {len(r.report_prompt)} characters, {hashlib.md5(r.report_prompt.encode()).hexdigest()}"


def test_workload_jobs(spark, tmp_path):
    from loglens.plans import jobs

    pages = fx.doc_pages(spark, SF)
    jobs.summarise_documents(pages, str(tmp_path / "sum"), info=fx.doc_info(spark, SF))
    assert spark.read.json(str(tmp_path / "sum")).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    jobs.pages_to_text(fx.html_pages(spark, SF), str(tmp_path / "html"))
    assert spark.read.parquet(str(tmp_path / "html" / "tables")).where("row_text <> ''").count() > 0
    jobs.email_headers(fx.emails(spark, SF), str(tmp_path / "hdr"))
    assert spark.read.parquet(str(tmp_path / "hdr")).count() > 0
    jobs.report_threads(fx.thread_outputs(spark, SF), str(tmp_path / "thr"))
    assert spark.read.parquet(str(tmp_path / "thr" / "reports")).count() > 0
    csv = tmp_path / "runs.csv"
    csv.write_text("Question,Answer,kb\nwhat is spark,spark is an engine,an engine for data\n")
    assert jobs.replay_eval(spark, str(csv), str(tmp_path / "ev")) == ["answer_relevance", "context_relevance", "groundedness", "coherence"]
    assert spark.read.parquet(str(tmp_path / "ev")).first().answer_relevance == 0.6667  # {is, spark} of {what, is, spark}


def test_run_files_with_damaged_records(spark, tmp_path):
    from loglens.sources import logs as source

    logs, protos, matrix = _inputs(spark)
    texts = logs.withColumn("session_id", F.col("session_id").cast("string")).withColumn("seq", F.col("seq").cast("long"))
    source.write_logs(texts, str(tmp_path / "in"), "json")
    (tmp_path / "in" / "more.json").write_text('{"session_id": "x"\nnonsense\n')
    kw = {"watchlist": fx.FIXTURE_WATCHLIST, "high": fx.FLAGSHIP_HIGH, "low": fx.FLAGSHIP_LOW}
    target, summary = classify.run_files(spark, str(tmp_path / "in"), "json", protos, matrix, str(tmp_path / "out"), str(tmp_path / "rejects"), **kw)
    counts = {r["metric"]: r["n"] for r in summary.collect()}
    assert counts["records_rejected"] == 2 and counts["records_read"] == logs.count() and counts["unparsed_timestamps"] > 0
    assert counts["total_sessions"] == logs.select("session_id").distinct().count()
    assert sorted(r["raw"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()) == ['nonsense', '{"session_id": "x"']
    want = {r["session_id"]: r["label_source"] for r in classify.classify_logs(texts, protos, matrix, **kw).collect()}
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(target).where("sink = 'classification_logs'")
    assert {r["session_id"]: r["label_source"] for r in back.collect()} == want


def test_thread_review_in_rounds_and_long_documents(spark, tmp_path):
    from loglens.operators import rounds

    mails = fx.emails(spark, SF).where("thread_id % 40 = 1")
    for where in ("a", "b"):
        if where == "a":
            jobs.review_threads(mails, str(tmp_path / "a"), fn=rounds.digest_finding)
        else:
            jobs.review_threads_in_rounds(mails, str(tmp_path / "b"), fn=rounds.digest_finding, per_round=4)
    a, b = ({r["thread_id"]: (r["summary"], r["conclusion"]) for r in spark.read.parquet(str(tmp_path / x / "reports")).collect()} for x in ("a", "b"))
    assert a == b and len(a) > 3
    pages = fx.doc_pages(spark, SF).where("doc_id < 20")
    jobs.chunk_long_documents(pages, str(tmp_path / "chunks"), piece_pages=3)
    assert spark.read.parquet(str(tmp_path / "chunks")).select("doc_id").distinct().count() == 20
