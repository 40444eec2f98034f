"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.config import ensure_checkpoint_dir, ship_package


def prepare(df: DataFrame) -> SparkSession:
    """The frame's session, with the package importable in workers and the shared checkpoint folder known."""
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder (as a URI or path, as configured)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def body(text_col: str = "text") -> Column:
    """The whole text, with null counted as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for repartitions by key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
