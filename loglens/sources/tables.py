"""Access to the parquet tables of a data folder.

Only the named columns are read, so the parquet scan's ``ReadSchema`` holds
just what the query uses; filters written on the result reach the scan as
``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
