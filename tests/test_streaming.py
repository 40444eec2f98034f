import os
import uuid

import pytest
from pyspark.sql import functions as F

from loglens.plans import fixtures as fx
from loglens.streaming import alerts, thread_state

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_alert_stream_equals_batch(spark, tmp_path):
    logs = fx.logs(spark, SF)
    src = str(tmp_path / "src")
    # several files so the stream runs several micro-batches
    logs.repartition(4, "session_id").write.parquet(src)
    q = alerts.start_alert_stream(spark, src, str(tmp_path / "out"), words=fx.FIXTURE_WATCHLIST,
                                  schema=logs.schema, max_files_per_trigger=1, name=f"t_alerts_{uuid.uuid4().hex}")
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*alerts.ALERT_COLUMNS).collect())
    want = sorted(tuple(r) for r in alerts.turn_alerts(logs, fx.FIXTURE_WATCHLIST).collect())
    assert got == want and len(want) > 0


@pytest.mark.parametrize("api", ["applyInPandasWithState", "transformWithStateInPandas"])
def test_thread_stream_equals_batch(spark, tmp_path, api):
    from loglens.operators import threads

    outs = fx.thread_outputs(spark, SF)
    src = str(tmp_path / "src")
    # arrival in e-mail order: one file per e-mail number band
    for lo in range(1, 40, 4):
        part = outs.where((F.col("email_no") >= lo) & (F.col("email_no") < lo + 4))
        part.coalesce(1).write.mode("append").parquet(f"{src}/band={lo:03d}")
    q = thread_state.start_thread_stream(spark, src, str(tmp_path / "out"), max_files_per_trigger=1,
                                         name=f"t_threads_{uuid.uuid4().hex}", api=api)
    q.awaitTermination(300)
    res = spark.read.parquet(str(tmp_path / "out"))
    got = {r.thread_id: (r.summary, *[list(r[n]) for n in threads.LIST_NAMES]) for r in thread_state.gathered(res).collect()}
    batch = threads.thread_findings(outs).collect()
    want = {r.thread_id: (r.summary, *[list(r[n]) for n in threads.LIST_NAMES]) for r in batch}
    assert got == want
    rejected = {(r.thread_id, r.email_no) for r in res.where("kind = 'rejected'").collect()}
    assert rejected == {(r.thread_id, r.email_no) for r in threads.finding_rejects(outs).collect()}


def test_thread_stream_reports_late_mail(spark, tmp_path):
    src = str(tmp_path / "src")
    first = [(1, -1, '{"deadlines": ["a"]}'), (1, 3, '{"deadlines": ["c"]}')]
    later = [(1, 2, '{"deadlines": ["b"]}'), (1, 4, '{"deadlines": ["d"]}')]
    schema = "thread_id long, email_no int, out string"
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(src)
    q = thread_state.start_thread_stream(spark, src, str(tmp_path / "out"), max_files_per_trigger=1, name=f"t_late_{uuid.uuid4().hex}")
    q.awaitTermination(120)
    res = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.kind, r.email_no) for r in res.where("kind = 'late'").collect()} == {("late", 2)}
    assert res.where("kind = 'delta'").count() == 2
    assert list(thread_state.gathered(res).first().deadlines) == ["a", "c", "d"]


def test_thread_stream_by_buckets(spark, tmp_path):
    """Few buckets of many threads, the null thread, ids beyond doubles, repeated numbers."""
    big = 2**60 + 1
    first = [(t, n, '{"deadlines": ["%s-%d", null]}' % (t, n)) for t in [None, 0, -5, big, *range(1, 60)] for n in (1, 2)]
    later = [(big, 2, '{"deadlines": ["x"]}'), (big, 3, "no"), (None, 7, '{"deadlines": ["n"]}'), (7, 9, '{"summary_update": "u"}'), (7, 9, '{"deadlines": ["again"]}')]
    schema = "thread_id long, email_no int, out string"
    src, name = str(tmp_path / "src"), f"t_buckets_{uuid.uuid4().hex}"
    for rows in (first, later):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    found = thread_state.thread_findings_stream(stream, buckets=3)
    q = (found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).queryName(name).start())
    q.awaitTermination(120)
    res = spark.read.parquet(str(tmp_path / "out"))
    told = sorted(((r.thread_id, r.email_no, r.kind) for r in res.where("kind <> 'delta'").collect()), key=str)
    assert told == sorted([(7, 9, "late"), (big, 2, "late"), (big, 3, "rejected")], key=str)
    lists = {r.thread_id: list(r.deadlines) for r in thread_state.gathered(res).collect()}
    assert len(lists) == 63 and lists[big] == [f"{big}-1", None, f"{big}-2", None] and lists[None] == ["None-1", None, "None-2", None, "n"]
