"""Log files with damaged records, written and read back; outputs read back by run and sink."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.operators import routing
from loglens.sources import logs

COLUMNS = logs.LOG_SCHEMA.names
ROWS = [
    ("s1", 10, "2024-01-01 00:00:00", "u", 'a "quoted", text\nwith lines\r\nand ends ', "c", None, " padded "),
    ("s1", 20, "not a date", "u", "", "c", "", "d"),
    (None, None, None, None, None, None, None, None),
    ("s,2", 30, "2024-01-01", "ü", "\\N \\ back'slash \t", "", "x", "y"),
]


def names_of(df):
    return df.select(F.element_at(F.split("file", "/"), -1)).distinct().collect()


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_values_survive_writing_and_reading(spark, tmp_path, fmt):
    df = spark.createDataFrame(ROWS * 3, logs.LOG_SCHEMA).select(*reversed(COLUMNS))
    logs.write_logs(df, str(tmp_path / "t"), fmt, records=2)
    got = logs.read_logs_checked(spark, str(tmp_path / "t"), fmt)
    assert sorted(map(str, got.rows.select(*COLUMNS).collect())) == sorted(map(str, df.select(*COLUMNS).collect()))
    assert got.rejects.count() == 0
    assert {r["metric"]: r["n"] for r in got.counts().collect()} == {"records_read": 12, "records_rejected": 0}


def test_damaged_json_lines(spark, tmp_path):
    good = {c: "x" for c in COLUMNS if c != "seq"}
    lines = [json.dumps(good | {"seq": 1}), "{broken", json.dumps(good | {"seq": "abc"}), json.dumps(good | {"seq": 2, "more": [1]}), '"text"', json.dumps(good)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "t" / "b.json").write_text("\n".join([*["not json"] * 2, json.dumps(good | {"seq": 3})]))
    got = logs.read_logs_checked(spark, str(tmp_path / "t"))
    assert sorted(r["seq"] or 0 for r in got.rows.collect()) == [0, 1, 2, 3]
    rejects = sorted((r["file"].rsplit("/", 1)[1], r["record"], r["raw"]) for r in got.rejects.collect())
    assert rejects == [("a.json", 2, "{broken"), ("a.json", 3, lines[2]), ("a.json", 5, '"text"'), ("b.json", 1, "not json"), ("b.json", 2, "not json")]
    # the verdict does not depend on which columns are used
    assert got.rows.select("session_id").count() == 4 and got.rows.select("prompt").distinct().count() == 1 and got.rejects.count() == 5


def test_damaged_csv_records(spark, tmp_path):
    head = ",".join(COLUMNS)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text(f'{head}\ns1,1,t,u,"two\nlines",c,t,d\ns2,2,t,u,short\ns3,no number,t,u,p,c,t,d\ns4,4,t,u,p,c,t,d\ns5,5,t,u,p,c,t,d,too,many\n')
    for multi_line in (True, False):
        got = logs.read_logs_checked(spark, str(tmp_path / "t"), "csv", multi_line=multi_line)
        if multi_line:
            assert sorted(r["session_id"] for r in got.rows.collect()) == ["s1", "s4"]
            assert sorted(r["record"] for r in got.rejects.collect()) == [2, 3, 5]
            assert got.rows.where("session_id = 's1'").first()["prompt"] == "two\nlines"
        else:  # the value with a line end is two broken records
            assert [r["session_id"] for r in got.rows.collect()] == ["s4"]
            assert sorted(r["record"] for r in got.rejects.collect()) == [1, 2, 3, 4, 6]


def test_record_numbers_in_split_files(spark, tmp_path):
    good = {c: "x" * 50 for c in COLUMNS if c != "seq"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text("\n".join("bad" if i % 97 == 0 else json.dumps(good | {"seq": i}) for i in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = logs.read_logs_checked(spark, str(tmp_path / "t"))
        assert got.rejects.rdd.getNumPartitions() and sorted(r["record"] for r in got.rejects.collect()) == [i for i in range(1, 2001) if i % 97 == 0]
        assert got.rows.count() == 2000 - 2000 // 97
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_columns_that_are_absent(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join(['{"session_id": "s"}'] * 5))
    with pytest.raises(ValueError, match="co, division"):
        logs.read_logs_checked(spark, str(tmp_path / "t.json"))
    late = {c: "x" for c in COLUMNS if c != "seq"}
    (tmp_path / "late.json").write_text("\n".join(['{"session_id": "s"}'] * 1500 + [json.dumps(late)]))
    got = logs.read_logs_checked(spark, str(tmp_path / "late.json"))  # the columns come after the first records
    assert got.rows.count() == 1501 and got.rows.where("seq IS NOT NULL").count() == 0
    (tmp_path / "t.csv").write_text("session_id,prompt\na,b\n")
    with pytest.raises(ValueError, match="user_type"):
        logs.read_logs_checked(spark, str(tmp_path / "t.csv"), "csv")
    with pytest.raises(ValueError):
        logs.read_logs_checked(spark, str(tmp_path / "t.csv"), "parquet")


def outputs(spark, n=6):
    df = spark.range(n).select(F.concat(F.lit("s"), "id").alias("session_id"), F.when(F.col("id") % 2 == 0, F.lit('a "b",\n c ')).otherwise(F.lit("")).alias("combined_prompt"),
                               F.when(F.col("id") == 0, "HIGH").when(F.col("id") == 1, "MEDIUM").otherwise("NONE").alias("governance_flag"),
                               F.when(F.col("id") < 3, "semantic").otherwise("unclassified").alias("label_source"), (F.col("id") / 3).alias("combined_confidence"),
                               F.lit(None).cast("string").alias("domain_prior"), F.timestamp_seconds(F.col("id") * 1000).cast("timestamp_ntz").alias("first_timestamp"))
    return df


def test_outputs_read_back_by_run_and_sink(spark, tmp_path):
    df, folder = outputs(spark), str(tmp_path / "out")
    columns = df.columns
    for _ in range(2):  # a rerun leaves one copy
        routing.write_outputs(df, folder, "1", columns)
    routing.write_outputs(df.where("session_id = 's5'"), folder, "2", columns)
    schema = T.StructType(df.schema.fields)
    got = routing.read_outputs(spark, folder, schema, run_ts="1")
    want = [("1", r["sink"], *[r[c] for c in columns]) for r in routing.route_outputs(df).collect()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert routing.read_outputs(spark, folder, schema, run_ts="2").count() == 2 and routing.read_outputs(spark, folder, schema).count() == len(want) + 2
    one = routing.read_outputs(spark, folder, schema, "1", "governance_alerts")
    assert [r["session_id"] for r in one.collect()] == ["s0"]
    assert len(one.inputFiles()) < len(got.inputFiles()) or "PartitionFilters: [isnotnull(run_ts" in one._jdf.queryExecution().toString()
    # a sink that is empty in the rerun is gone
    routing.write_outputs(df.where("governance_flag <> 'HIGH'"), folder, "1", columns)
    assert routing.read_outputs(spark, folder, schema, "1", "governance_alerts").count() == 0
