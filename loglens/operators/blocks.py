"""Rows in blocks of bounded size in the shared folder, for kernels whose tasks meet every one of them.

Tasks write their own rows as Arrow files of bounded rows and bytes under names of the attempt; only the list
of files (and the distinct values of named key columns) reaches the driver.  A block is some of these files,
within the same bounds.  Reading tasks load one block after the other and never hold two.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filesystem(folder: str):
    from pyarrow import fs

    folder = re.sub(r"^s3[an]://", "s3://", folder)  # Hadoop's names for the store
    return fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+.-]*://|file:", folder) else (fs.LocalFileSystem(), folder)


def _write(folder: str, keys: list[str], most_rows: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, root = filesystem(folder)
        where.create_dir(root, recursive=True)
        task = TaskContext.get()
        parts: list[pa.RecordBatch] = []
        number = 0

        def close() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(parts)
            name = f"part-{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.arrow"
            with where.open_output_stream(f"{root}/{name}") as sink, pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            said = [pa.array([name]), pa.array([t.num_rows], pa.int64()), pa.array([t.nbytes], pa.int64())]
            if keys:
                distinct = t.select(keys).group_by(keys).aggregate([]).select(keys)
                said.append(pa.array([distinct.to_pylist()], pa.list_(pa.struct(list(distinct.schema)))))
            number += 1
            parts.clear()
            return pa.RecordBatch.from_arrays(said, names=["name", "n", "size", "keys"][:len(said)])

        for b in batches:
            at = 0
            while at < b.num_rows:
                n, size = sum(p.num_rows for p in parts), sum(p.nbytes for p in parts)
                each = -(-b.nbytes // b.num_rows)
                room = min(most_rows - n, (most_bytes - size) // max(1, each))
                if room < 1 and parts:
                    yield close()
                    continue
                parts.append(b.slice(at, max(1, room)))
                at += parts[-1].num_rows
        if parts:
            yield close()

    return run


@dataclass(frozen=True)
class Blocks:
    """Files of every block, below a folder."""

    folder: str
    names: tuple[tuple[str, ...], ...]

    def reader(self, made: Callable[[pa.Table], Any]) -> Callable[[], Iterator[Any]]:
        """Inside a task: a function that goes through the blocks as ``made`` of their tables.  The last one is
        held, so a lone block is loaded once."""
        held: dict[tuple[str, ...], Any] = {}

        def each() -> Iterator[Any]:
            where, root = filesystem(self.folder)
            for names in self.names:
                if names not in held:
                    held.clear()
                    tables = []
                    for name in names:
                        with where.open_input_file(f"{root}/{name}") as source:
                            tables.append(pa.ipc.open_stream(source).read_all())
                    held[names] = made(pa.concat_tables(tables).combine_chunks())
                yield held[names]

        return each


def write_blocks(df: DataFrame, most_rows: int, most_bytes: int, keys: tuple[str, ...] = ()) -> tuple[Blocks, DataFrame | None]:
    """The rows of ``df`` in blocks, and the distinct ``keys`` of all rows.  ``df`` is evaluated once."""
    from loglens.config import ensure_checkpoint_dir, ship_package

    ship_package(df.sparkSession)
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    schema = "name string, n long, size long"
    if keys:
        schema += ", keys array<" + df.select(*keys).schema.simpleString() + ">"
    files = df.mapInArrow(_write(folder, list(keys), most_rows, most_bytes), schema).checkpoint()
    blocks: list[list[str]] = []
    rows = size = 0
    for f in files.select("name", "n", "size").orderBy("name").collect():  # a row for each file
        if not blocks or rows + f["n"] > most_rows or size + f["size"] > most_bytes:
            blocks.append([])
            rows = size = 0
        blocks[-1].append(f["name"])
        rows, size = rows + f["n"], size + f["size"]
    found = files.select(F.explode("keys").alias("k")).select("k.*").distinct() if keys else None
    return Blocks(folder, tuple(tuple(b) for b in blocks)), found
