"""Document pages -> one text per document, plus document metadata.

Input contract: a pages table (doc_id, page_no 1-based, text) and an
optional metadata table (doc_id, title, author, subject, keywords,
creation_date, modification_date).  Decoding PDF bytes is left to the
producer of the pages table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens import defaults
from loglens.functions.text import py_strip

METADATA_FIELDS = ["title", "author", "subject", "keywords", "creation_date", "modification_date"]


def assemble_pages(pages: DataFrame, sep: str = defaults.PARAGRAPH_SEP) -> DataFrame:
    """(doc_id, text): non-blank pages as ``[Page n] <text>`` joined by ``sep``
    in page order.  ``collect_list`` combines map-side, so a document's pages
    are pre-aggregated per input partition before the shuffle."""
    keep = F.when(py_strip(F.col("text")) != "", F.struct(F.col("page_no").alias("k"),
                                                         F.concat(F.lit("[Page "), F.col("page_no").cast("string"), F.lit("] "), F.col("text")).alias("v")))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(keep)), lambda x: x["v"]), sep).alias("text")
    )


def document_metadata(pages: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, author, subject, keywords, creation_date,
    modification_date, page_count): title/author default to ``Unknown``, the
    other fields to ``''``; ``page_count`` counts blank pages too."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    if info is None:
        out = counts
        for f in METADATA_FIELDS:
            out = out.withColumn(f, F.lit(None).cast("string"))
    else:
        out = counts.join(info.select("doc_id", *METADATA_FIELDS), "doc_id", "left")
    for f in METADATA_FIELDS:
        default = defaults.UNKNOWN if f in ("title", "author") else ""
        out = out.withColumn(f, F.coalesce(F.col(f), F.lit(default)))
    return out.select("doc_id", *METADATA_FIELDS, F.col("page_count").cast("int").alias("page_count"))


def assemble_documents(pages: DataFrame, info: DataFrame | None = None, sep: str = defaults.PARAGRAPH_SEP) -> DataFrame:
    """Text and metadata per document from one aggregation over the pages:
    (doc_id, text, title, author, subject, keywords, creation_date,
    modification_date, page_count)."""
    keep = F.when(py_strip(F.col("text")) != "", F.struct(F.col("page_no").alias("k"),
                                                         F.concat(F.lit("[Page "), F.col("page_no").cast("string"), F.lit("] "), F.col("text")).alias("v")))
    g = pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(keep)), lambda x: x["v"]), sep).alias("text"),
        F.count(F.lit(1)).cast("int").alias("page_count"),
    )
    out = g if info is None else g.join(info.select("doc_id", *METADATA_FIELDS), "doc_id", "left")
    for f in METADATA_FIELDS:
        default = defaults.UNKNOWN if f in ("title", "author") else ""
        col = F.col(f) if info is not None else F.lit(None).cast("string")
        out = out.withColumn(f, F.coalesce(col, F.lit(default)))
    return out.select("doc_id", "text", *METADATA_FIELDS, "page_count")
