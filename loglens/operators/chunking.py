"""Section-aware chunking.

* boundaries: start offset of every match of each section pattern, matched
  independently on the whole text (successive non-overlapping matches, as
  ``re.finditer``), plus 0, de-duplicated and sorted.  One Arrow UDF runs the
  compiled patterns over each text and returns character and byte offsets;
  cutting and packing stay JVM-side.
* strategy: sections when 1 < #boundaries < 30, else paragraph packing.
* a section longer than 1.5 x chunk_size is re-packed by paragraphs.
* packing: greedy over ``split(text, '\\n\\n')``; a paragraph is added while
  ``len(current) + len(paragraph) < chunk_size`` and is followed by the
  separator; this is an ``aggregate`` fold inside the row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens import defaults
from loglens.functions.text import explode_positions

# paragraphs in one block of the packing fold
_BLOCK = 128
# (characters, bytes) packed as characters * 2^32 + bytes: offsets leave Python as plain longs
_LOW = (1 << 32) - 1


def boundary_offsets(text: str, patterns: Sequence[re.Pattern]) -> list[int]:
    """0 and the starts of all matches of each pattern, in characters, sorted, once each."""
    return sorted({0}.union(*({m.start() for m in p.finditer(text)} for p in patterns)))


def _boundary_udf(patterns: Sequence[str]):
    """Arrow UDF: texts -> packed (character, byte) offsets of their boundaries.  One
    text is held at a time besides its batch; the work is linear in its length."""
    compiled = [re.compile(p) for p in patterns]

    def packed(text: str) -> list[int]:
        at = boundary_offsets(text, compiled)
        if text.isascii():
            return [c << 32 | c for c in at]
        out, size = [], 0
        for before, c in zip([0, *at], at):
            size += len(text[before:c].encode("utf-8"))
            out.append(c << 32 | size)
        return out

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def offsets(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else packed(t) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return offsets


def with_boundary_pairs(df: DataFrame, text_col: str = "text", patterns: Sequence[str] = defaults.SECTION_PATTERNS,
                        name: str = "_bp") -> DataFrame:
    """Adds ``name``: sorted distinct boundaries as (c, b) structs, always including 0."""
    df = df.withColumn(f"{name}_packed", _boundary_udf(patterns)(F.col(text_col)))
    pairs = F.transform(f"{name}_packed", lambda k: F.struct(F.shiftright(k, 32).cast("int").alias("c"), k.bitwiseAND(F.lit(_LOW)).cast("int").alias("b")))
    return df.withColumn(name, pairs).drop(f"{name}_packed")


def with_boundaries(df: DataFrame, text_col: str = "text", patterns: Sequence[str] = defaults.SECTION_PATTERNS,
                    out_col: str = "boundaries") -> DataFrame:
    """Adds ``out_col``: sorted distinct boundary offsets (characters), including 0."""
    d = with_boundary_pairs(df, text_col, patterns, "_bp")
    return d.withColumn(out_col, F.transform("_bp", lambda x: x["c"])).drop("_bp")


def cut_bytes(utf8: Column, pairs: Column) -> Column:
    """Sections of a text given its UTF-8 bytes and sorted boundary pairs.

    Both arguments must be column references: binary ``substring`` at byte
    offsets costs the length of the piece only, so cutting is linear in the
    text length however many sections there are.
    """
    ends = F.concat(F.slice(F.transform(pairs, lambda x: x["b"]), 2, F.greatest(F.size(pairs) - 1, F.lit(0))),
                    F.array(F.octet_length(utf8)))
    return F.zip_with(pairs, ends, lambda st, e: F.decode(F.substring(utf8, st["b"] + 1, e - st["b"]), "UTF-8"))


def pack_starts(paras: Column, chunk_size: int = defaults.CHUNK_SIZE, keep_empty: bool = True,
                sep: str = defaults.PARAGRAPH_SEP) -> Column:
    """1-based index of the first paragraph of every chunk (greedy packing).

    A paragraph joins the current chunk while ``len(chunk) + len(paragraph) <
    chunk_size``; every paragraph is followed by ``sep`` in its chunk.
    ``keep_empty=True`` reproduces the size-based path exactly, including the
    empty first chunk emitted when the first paragraph alone reaches
    ``chunk_size`` (two equal starts); ``False`` never emits an empty chunk.
    The fold carries integers only.
    """
    seplen = len(sep)
    # chunk starts are kept in blocks of at most 128 (the open block plus a
    # list of closed ones), so appending stays cheap for documents with many
    # chunks; the blocks are flattened at the end
    init = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array(F.lit(1)).alias("open"),
                    F.lit(0).alias("cur"), F.lit(0).alias("i"))

    def step(acc, par):
        i = acc["i"] + 1
        fits = acc["cur"] + F.length(par) < F.lit(chunk_size)
        grown = F.concat(acc["open"], F.array(i))
        if not keep_empty:  # an empty current chunk is replaced, not closed (cur == 0 only before the first paragraph)
            grown = F.when(acc["cur"] > 0, grown).otherwise(F.array(i))
        full = F.size(grown) >= F.lit(_BLOCK)
        done = F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"])
        opened = F.when(full, F.array().cast("array<int>")).otherwise(grown)
        kept = F.struct(acc["done"].alias("done"), acc["open"].alias("open"),
                        (acc["cur"] + F.length(par) + seplen).alias("cur"), i.alias("i"))
        closed = F.struct(done.alias("done"), opened.alias("open"), (F.length(par) + seplen).alias("cur"), i.alias("i"))
        return F.when(fits, kept).otherwise(closed)

    return F.aggregate(paras, init, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["open"]))))


def chunks_from_starts(paras: Column, starts: Column, sep: str = defaults.PARAGRAPH_SEP) -> Column:
    """Chunk strings: the paragraphs of each chunk joined, each followed by ``sep``."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(paras) + 1))
    return F.zip_with(
        starts, ends,
        lambda a, b: F.when(b > a, F.concat(F.array_join(F.slice(paras, a, b - a), sep), F.lit(sep))).otherwise(F.lit("")),
    )


def pack_paragraphs(paras: Column, chunk_size: int = defaults.CHUNK_SIZE, keep_empty: bool = True,
                    sep: str = defaults.PARAGRAPH_SEP) -> Column:
    """Greedy paragraph packing of an array of paragraphs -> array of chunks.

    ``paras`` is read inside lambdas, so it must be cheap to evaluate (a column
    reference or an element of one), never a ``split`` expression.
    """
    return chunks_from_starts(paras, pack_starts(paras, chunk_size, keep_empty, sep), sep)


def with_chunks(
    docs: DataFrame,
    text_col: str = "text",
    out_col: str = "chunks",
    chunk_size: int = defaults.CHUNK_SIZE,
    patterns: Sequence[str] = defaults.SECTION_PATTERNS,
    max_boundaries: int = defaults.MAX_SECTION_BOUNDARIES,
    resplit_factor: float = defaults.RESPLIT_FACTOR,
    keep_empty: bool = True,
    sep: str = defaults.PARAGRAPH_SEP,
) -> DataFrame:
    """Adds ``boundaries`` (character offsets) and ``out_col`` (the chunks).

    Sections when 1 < #boundaries < ``max_boundaries`` (each re-packed by
    paragraphs when longer than ``resplit_factor`` x ``chunk_size``),
    otherwise paragraph packing of the whole text.  Intermediate arrays
    (boundary pairs, UTF-8 bytes, sections, paragraphs) are columns, so every
    lambda reads them by reference and the whole step stays linear in the
    text length.
    """
    lim = chunk_size * resplit_factor
    t = F.col(text_col)
    d = with_boundary_pairs(docs, text_col, patterns, "_bp")
    use_sections = (F.size("_bp") > 1) & (F.size("_bp") < max_boundaries)
    d = d.withColumn("_utf8", F.when(use_sections, F.encode(t, "UTF-8")))
    d = d.withColumn("_secs", F.when(use_sections, cut_bytes(F.col("_utf8"), F.col("_bp"))))
    d = d.withColumn("_spars", F.transform("_secs", lambda x: F.when(F.length(x) > F.lit(lim), F.split(x, sep, -1))))
    d = d.withColumn("_paras", F.when(~use_sections, F.split(t, sep, -1)))
    n_sec = F.size("_secs")
    resplit = F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n_sec, F.lit(1))),
        lambda i: F.when(F.element_at("_spars", i).isNotNull(),
                         pack_paragraphs(F.element_at("_spars", i), chunk_size, keep_empty=False, sep=sep))
        .otherwise(F.array(F.element_at("_secs", i))),
    ))
    d = d.withColumn("_starts", pack_starts(F.col("_paras"), chunk_size, keep_empty, sep))
    whole = chunks_from_starts(F.col("_paras"), F.col("_starts"), sep)
    return (
        d.withColumn(out_col, F.when(use_sections, resplit).otherwise(whole))
        .withColumn("boundaries", F.transform("_bp", lambda x: x["c"]))
        .drop("_bp", "_utf8", "_secs", "_spars", "_paras", "_starts")
    )


def with_sections(docs: DataFrame, text_col: str = "text", out_col: str = "sections",
                  patterns: Sequence[str] = defaults.SECTION_PATTERNS) -> DataFrame:
    """Adds ``boundaries`` and ``out_col``: the text cut at every boundary
    (any number of them; linear in the text length)."""
    d = with_boundary_pairs(docs, text_col, patterns, "_bp").withColumn("_utf8", F.encode(F.col(text_col), "UTF-8"))
    return (d.withColumn(out_col, cut_bytes(F.col("_utf8"), F.col("_bp")))
            .withColumn("boundaries", F.transform("_bp", lambda x: x["c"])).drop("_bp", "_utf8"))


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(id, chunk_idx 0-based, chunk) rows, one per chunk."""
    c = with_chunks(docs.select(id_col, text_col), text_col, "chunks", **kw)
    return explode_positions(c, [id_col], F.col("chunks"), "chunk_idx", "chunk")
