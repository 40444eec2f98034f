"""Source trees as (path, content) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_source_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """(path, content): one row per file under ``root`` matching ``glob``
    (recursive; each file is read whole by one task)."""
    # keyword form: ``text()`` would reset a ``wholetext`` set through ``option``
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
