"""Queries run the way the driver runs them: a fresh interpreter, a plain
session, and a working directory outside the repository (Python workers must
still import the package)."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as E
print("entry", E.entry(spark).count())
for n in ["html_tables", "classify_logs", "thread_fold", "stream_thread_findings"]:
    print(n, E.queries()[n](spark, {SF!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_queries_from_outside_the_repo(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), capture_output=True, text=True, timeout=900)
    lines = dict(line.split(" ", 1) for line in out.stdout.splitlines() if line.count(" ") == 1)
    assert set(lines) >= {"entry", "html_tables", "classify_logs", "thread_fold", "stream_thread_findings"}, out.stderr[-3000:]
    assert all(int(v) > 0 for v in lines.values())
