"""Import graph of a Python source tree.

Nodes are module names (file name without ``.py``); when two files share a
name the greatest path wins (deterministic; collisions are reported by
``module_collisions``).  Edges go from a module to each imported top-level
name that is itself a module of the tree; self-edges are kept.  Parsing uses
the standard ``ast`` module, some files at a time in a child process that is replaced after a bounded amount of text
(``import_names``); a file that does not parse contributes no imports and is reported with its error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.operators.import_names import Parser, top_level_imports  # noqa: F401
from loglens.operators.sizes import BROADCAST_BYTES, broadcast_if_small, bytes_of

MODULE_PATTERN = r"([^/]+)\.py$"
#: import names that leave a task at a time
OUT_ROWS = 16_384
#: files, and characters of their texts, that go to the parser at a time (a longer file goes alone)
PARSE_FILES, PARSE_CHARS = 1_000, 1 << 20


def python_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Keep ``.py`` files; add ``module``."""
    return files.where(F.col(path_col).endswith(".py")).withColumn(
        "module", F.regexp_extract(F.col(path_col), MODULE_PATTERN, 1)
    )


def _parsed(paths: pa.Array, sources: pa.Array) -> Iterator[tuple[str | None, list[str], str | None]]:
    """(path, names, error) of every file; few texts are Python values at a time."""
    parser, held, size = Parser(), [], 0
    try:
        for path, src in zip(paths, sources):
            src = src.as_py() or ""
            if held and (len(held) >= PARSE_FILES or size + len(src) > PARSE_CHARS):
                some, held, size = held, [], 0
                yield from ((p, *found) for (p, _), found in zip(some, parser([s for _, s in some])))
            held.append((path.as_py(), src))
            size += len(src)
        if held:
            yield from ((p, *found) for (p, _), found in zip(held, parser([s for _, s in held])))
    finally:
        parser.close()


def import_batches(paths: pa.Array, sources: pa.Array, columns: list[str], keep_empty: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of ``extract_imports`` for some files, at most OUT_ROWS at a time."""
    out: tuple[list, list, list] = ([], [], [])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=columns)
        for x in out:
            x.clear()
        return made

    for path, names, err in _parsed(paths, sources):
        if err is not None or (keep_empty and not names):
            names = [None]
        while names:
            some = names[:OUT_ROWS - len(out[0])]
            names = names[len(some):]
            for column, values in zip(out, ([path] * len(some), some, [err] * len(some))):
                column.extend(values)
            if len(out[0]) >= OUT_ROWS:
                yield batch()
    if out[0]:
        yield batch()


def extract_imports(files: DataFrame, path_col: str = "path", content_col: str = "content",
                    keep_empty: bool = False) -> DataFrame:
    """(path, import, parse_error): one row per import statement name; a file
    that fails to parse gives one row with ``import`` NULL and the error;
    with ``keep_empty`` a file without imports gives one row with NULLs."""
    schema = T.StructType([
        T.StructField(path_col, T.StringType()), T.StructField("import", T.StringType()),
        T.StructField("parse_error", T.StringType()),
    ])

    def run(batches):
        for b in batches:
            yield from import_batches(b.column(0), b.column(1), schema.fieldNames(), keep_empty)

    return files.select(F.col(path_col).cast("string"), F.col(content_col).cast("string")).mapInArrow(run, schema)


def module_nodes(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(module, path): one node per module name; the greatest path wins."""
    return python_files(files, path_col).groupBy("module").agg(F.max(path_col).alias(path_col))


def module_collisions(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Module names defined by more than one file, with all their paths."""
    g = python_files(files, path_col).groupBy("module").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(path_col)).alias("paths"))
    return g.where("n > 1")


def import_edges(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Distinct (src, dst) module pairs; dst must be a module of the tree.

    The list of modules comes from the paths alone.  A module's file is the one with the greatest path: the other
    files of its name, few as clashes are, are left out before anything is parsed.  Imports meet the list of modules
    by a broadcast after a check of its size (beyond that by a shuffle of distinct pairs), and only pairs that stay are
    made distinct.
    """
    py = python_files(files, path_col)
    nodes = py.groupBy("module").agg(F.max(path_col).alias("winner"), F.count(F.lit(1)).alias("n"))
    clashes = nodes.where("n > 1").select(F.col("module").alias("clash"), "winner")
    losers = py.select(path_col, "module").join(broadcast_if_small(clashes), F.col("module") == F.col("clash"))
    losers = losers.where(F.col(path_col) != F.col("winner")).select(F.col(path_col).alias("loser"))
    py = py.join(broadcast_if_small(losers), F.col(path_col) == F.col("loser"), "left_anti")
    # files of all sizes are dealt to all tasks: large ones that stand together would fill an Arrow batch
    py = py.repartition(int(py.sparkSession.conf.get("spark.sql.shuffle.partitions")), path_col)
    imports = extract_imports(py, path_col, content_col).where(F.col("import").isNotNull())
    pairs = imports.select(F.regexp_extract(F.col(path_col), MODULE_PATTERN, 1).alias("src"), F.col("import").alias("dst"))
    modules = nodes.select(F.col("module").alias("dst"))
    if bytes_of(modules) <= BROADCAST_BYTES:
        return pairs.join(F.broadcast(modules), "dst", "left_semi").select("src", "dst").distinct()
    return pairs.distinct().join(modules, "dst", "left_semi").select("src", "dst")


def write_graph(files: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """Nodes and edges as Parquet tables under ``out_dir``."""
    module_nodes(files).write.mode(mode).parquet(f"{out_dir.rstrip('/')}/nodes")
    import_edges(files).write.mode(mode).parquet(f"{out_dir.rstrip('/')}/edges")
