"""Chat-log and evaluation-log readers (CSV, Parquet or JSON).

``read_logs`` takes a table as it is.  ``read_logs_checked`` reads CSV and JSON files with an explicit schema, so there
is no inference pass, and puts every record that does not parse into a table of rejects with its file and its number
there, instead of failing or turning it into nulls.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens import defaults
from loglens.operators.sessions import require_columns

#: Columns of a chat log with the types they are read as.  ``seq`` (input order) may be absent.
LOG_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("query_timestamp", T.StringType()), T.StructField("username", T.StringType()),
    T.StructField("prompt", T.StringType()), T.StructField("co", T.StringType()),
    T.StructField("user_type", T.StringType()), T.StructField("division", T.StringType()),
])


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header: columns by their names in the file, all of them text."""
    return (spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
            .option("multiLine", True).option("escape", '"').csv(path))


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = LOG_SCHEMA,
              required=defaults.REQUIRED_LOG_COLUMNS) -> DataFrame:
    """Read a chat-log table by its own column names, in any order, and check the
    required ones against the file.

    CSV and JSON values are read as text; then the columns of ``schema`` that the
    file has are cast to its types (Parquet columns too, where they differ).
    Further columns stay as they are.  Text ids stay text."""
    if fmt == "csv":
        df = _csv(spark, path)
    elif fmt == "json":
        df = spark.read.option("primitivesAsString", True).json(path)
    else:
        df = spark.read.format(fmt).load(path)
    df = require_columns(df, required)
    for f in schema.fields if schema is not None else []:
        if f.name in df.columns and df.schema[f.name].dataType != f.dataType:
            timestamp = f.name == "query_timestamp" and df.schema[f.name].dataType.simpleString().startswith("timestamp")
            if not timestamp:  # a real timestamp needs no detour through text
                df = df.withColumn(f.name, F.col(f"`{f.name}`").try_cast(f.dataType))
    return df


# ------------------------------------------------------------ with quarantine
CORRUPT = "_corrupt_record"
#: what keeps text as it is, in both directions: quotes are doubled, blanks at the ends stay, line ends lie inside quotes
CSV_TEXT = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: reading: an empty value is null without quotes and the empty text with them (a null sign that no text has keeps them apart)
CSV_READ = CSV_TEXT | {"nullValue": "\x00"}
#: records in a written file; a CSV file with line ends inside values is read by one task
FILE_RECORDS = 500_000


@dataclass(frozen=True)
class CheckedLogs:
    """``rows``: the records that parse, with the columns of the schema.  ``rejects``: (file, record, raw) of the
    others; ``record`` counts a file's records from 1, a CSV's header not included."""

    rows: DataFrame
    rejects: DataFrame

    def counts(self) -> DataFrame:
        """(metric, n): records read and rejected, for the run summary."""
        read = self.rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("records_read").alias("metric"), "n")
        return read.unionByName(self.rejects.agg(F.count(F.lit(1)).alias("n")).select(F.lit("records_rejected").alias("metric"), "n"))


def write_logs(logs: DataFrame, path: str, fmt: str = "csv", records: int = FILE_RECORDS) -> None:
    """A log table as files of bounded size from which ``read_logs_checked`` gets the same values back."""
    out = logs.write.mode("overwrite").option("maxRecordsPerFile", records)
    for k, v in (CSV_TEXT if fmt == "csv" else {}).items():
        out = out.option(k, v)
    out.format(fmt).save(path)


def _csv_schema(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """The columns of the header (which Spark reads from one file), those of ``schema`` with its types."""
    names = spark.read.options(**CSV_READ).option("multiLine", True).csv(path).columns
    return T.StructType([schema[n] if n in schema.names else T.StructField(n, T.StringType()) for n in names])


def _json_columns(spark: SparkSession, path: str, wanted: Sequence[str]) -> set[str]:
    """Which of the names occur: looked for in some records, and in all only if one is not among them."""
    keys = F.json_object_keys("value")
    lines = spark.read.text(path)
    some = {k for r in lines.limit(1000).select(keys.alias("k")).collect() for k in r["k"] or []}
    if set(wanted) <= some:
        return some
    seen = lines.agg(*[F.bool_or(F.array_contains(keys, n)).alias(f"c{i}") for i, n in enumerate(wanted)]).first()
    return {n for i, n in enumerate(wanted) if seen[i]}


def read_logs_checked(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = LOG_SCHEMA,
                      required: Sequence[str] = defaults.REQUIRED_LOG_COLUMNS, multi_line: bool = True) -> CheckedLogs:
    """Reads CSV files (with a header, the same in all files) or JSON lines; raises ``ValueError`` where a required
    column is in no record.

    A record is rejected when it does not parse, has more or fewer values than the header, or a value does not fit
    its column's type.  ``multi_line=False`` says that no CSV value holds a line end; large CSV files are then split
    over tasks.  Empty files have no records; a column of the schema that is in no file is null.
    """
    if fmt == "csv":
        known = _csv_schema(spark, path, schema)
        present = set(known.names)
    elif fmt == "json":
        known, present = schema, _json_columns(spark, path, required)
    else:
        raise ValueError("checked reading is for csv and json files")
    if absent := sorted(set(required) - present):
        raise ValueError(f"the log table lacks {', '.join(absent)}")
    reader = spark.read.schema(T.StructType([*known.fields, T.StructField(CORRUPT, T.StringType())])).option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        # the header's names are compared with every file's
        raw = reader.options(**CSV_READ).option("enforceSchema", False).option("multiLine", multi_line).csv(path)
    else:
        raw = reader.json(path)
    # says nothing, but needs every column: all uses below parse the same values and so agree on what is corrupt
    parsed = F.hash(*[F.col(f"`{n}`") for n in known.names]) >= F.lit(-(1 << 31))
    raw = raw.where(parsed)
    at = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    rows = raw.where(F.col(CORRUPT).isNull())
    rows = rows.select(*[F.col(f"`{n}`") for n in known.names], *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in known.names])

    # a record's number: its place in its part of the file, after the records of the parts before
    parts = at.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_file").alias("pf"), F.col("_start").alias("ps"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bad = at.where(F.col(CORRUPT).isNotNull())
    rejects = bad.join(parts, (F.col("_file") == F.col("pf")) & (F.col("_start") == F.col("ps")))
    rejects = rejects.select(F.col("_file").alias("file"), (F.col("before") + F.col("_id") - F.col("first") + 1).alias("record"), F.col(CORRUPT).alias("raw"))
    return CheckedLogs(rows, rejects)


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    """A recorded-runs CSV with a header; every column is read as text."""
    return _csv(spark, path)
