"""Corpus pipeline: from raw documents to packed sequences.

``STAGES`` lists the stages in their order; each takes (spark, docs, sf_dir) and returns a frame, which is written
as Parquet and read again as the next stage's documents.  Every stage works on all rows that the one before kept:

1. toxicity: documents that the compression-distance classifier rejects go;
2. exact_dedup: of equal texts the row with the largest id stays;
3. near_dedup: of documents linked by a 5-gram Jaccard of 0.8 or more one stays for each connected class;
4. mixing: sources are sampled to their target weights; a document appears as often as it is taken;
5. packing: what is left is cut and packed into sequences (one row per piece).

All but the last return the columns of the documents.  Nulls, empty tables, repeated rows and further columns are
treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loglens.llm import exact_dedup, labelled, mixing, packing, shingle_join, toxicity
from loglens.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnable = ~labelled.held_out("doc_id", 4, 2)
    return toxicity.not_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), learnable))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: the classifier and the tokenizer have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
