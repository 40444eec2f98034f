"""Every catalogued query against its DuckDB oracle on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from loglens.plans import catalog, oracle
from scripts.check_oracle import TABLES, rows_of

SF = os.environ.get("LOGLENS_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalog.QUERIES) <= set(q)
    assert set(catalog.QUERIES) - set(o) == {"html_text_pages"}


def test_oracle_reads_no_file_of_the_install(monkeypatch):
    import builtins
    import zipfile

    def refuse(*a, **k):
        raise FileNotFoundError(a)

    monkeypatch.setattr(zipfile, "ZipFile", refuse)
    monkeypatch.setattr(builtins, "open", refuse)
    assert set(oracle.oracle_sql()) == set(catalog.QUERIES) - {"html_text_pages"}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_rows, s_cols = rows_of(df.columns, df.collect())
    res = con.execute(oracle.oracle_sql()[name])
    o_rows, o_cols = rows_of([d[0] for d in res.description], res.fetchall())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["session_id", "username", "co"]
    assert df.count() > 0
