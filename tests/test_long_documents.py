"""Chunks from pieces of pages equal the chunks of the assembled text."""

import random

import pytest
from pyspark.sql import functions as F

from loglens.operators import chunking, long_documents
from loglens.sources import documents

LINES = ["plain words of prose go on", "Section 3: Terms", "1.2 Scope of work", "IV. Risk level", "ARTICLE X: Money", "FINAL NOTICE", "FINAL NOTICE (", "some (more", "closed)", ")", "", "",
         "é ü ß", "x" * 400, "word " * 120, "2 A", "IV. B"]


def page(rng):
    return "\n".join(rng.choices(LINES, k=rng.randrange(0, 7))) + "\n" * rng.randrange(0, 4)


def pages_of(rng, docs):
    rows = [(d, n, page(rng)) for d in range(docs) for n in range(1, rng.randrange(2, 14))]
    rows += [(1000, 1, " \n"), (1000, 2, ""), (1001, 1, None), (1002, 3, "only one"), (1003, 1, "y" * 5000), (1003, 2, "\n\n"), (1003, 4, "z\n\n\n" * 3)]
    # an open parenthesis in capitals that the very end of the text closes, and the same closed before
    rows += [(1004, 1, "intro\nOPEN HEADER (starts here"), (1004, 2, "goes on"), (1004, 3, "and ends here)\n")]
    rows += [(1005, 1, "intro\nOPEN HEADER (starts here"), (1005, 2, "closed) early"), (1005, 3, "\nOTHER HEADER (ends here)")]
    rows += [(1006, 1, "a\nFIRST HEADER (x"), (1006, 2, "b\nSECOND HEADER (y"), (1006, 3, "c\nTHIRD (z)"), (1007, 1, "a)\nFIRST HEADER (x"), (1007, 2, "end")]
    # many sections: the size-based path; few long ones: sections packed again
    rows += [(1008, n, f"text\nSection {n}: Name\n" + "word " * 50) for n in range(1, 45)]
    rows += [(1009, n, ("\nSection 1: Long\n" if n == 2 else "") + "\n\n".join("para " * rng.randrange(1, 90) for _ in range(6)) + "\n" * (n % 3)) for n in range(1, 9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece_pages", [1, 2, 5, 10_000])
@pytest.mark.parametrize("chunk_size", [120, 2000])
def test_pieces_give_the_same_chunks(spark, piece_pages, chunk_size):
    df = spark.createDataFrame(pages_of(random.Random(piece_pages), 60), "doc_id long, page_no int, text string").repartition(3)
    want = chunking.chunk_documents(documents.assemble_pages(df), chunk_size=chunk_size)
    got = long_documents.chunk_pages(df, chunk_size=chunk_size, piece_pages=piece_pages)
    a = {(r["doc_id"], r["chunk_idx"]): r["chunk"] for r in want.collect()}
    b = {(r["doc_id"], r["chunk_idx"]): r["chunk"] for r in got.collect()}
    for k in sorted(a.keys() | b.keys()):
        assert a.get(k) == b.get(k), k


def test_a_long_document_takes_several_tasks(spark):
    df = spark.range(1, 3001).select(F.lit("big").alias("doc_id"), F.col("id").cast("int").alias("page_no"), F.concat(F.lit("page "), F.col("id"), F.lit("\n\nmore")).alias("text"))
    got = long_documents.chunk_pages(df, piece_pages=50)
    want = chunking.chunk_documents(documents.assemble_pages(df))
    assert sorted((r["chunk_idx"], r["chunk"]) for r in got.collect()) == sorted((r["chunk_idx"], r["chunk"]) for r in want.collect())
    assert long_documents.chunk_pages(df.limit(0), piece_pages=50).count() == 0


def test_texts_are_not_written_on_the_way(spark):
    import hashlib
    from pathlib import Path

    from loglens.config import ensure_checkpoint_dir

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    rows = [(d, n, "".join(hashlib.sha512(f"{d} {n} {i}".encode()).hexdigest() for i in range(8))) for d in range(40) for n in range(1, 51)]
    df, before = spark.createDataFrame(rows, "doc_id long, page_no int, text string"), held()
    got = long_documents.chunk_pages(df, piece_pages=2).collect()
    assert sum(r["chunk"].count("[Page ") for r in got) == len(rows)
    assert held() - before < 200_000  # of 2 MB of text


def test_repeated_and_unknown_pages(spark):
    rows = [(7, 1, "a"), (7, 2, "b\n"), (7, 2, "b\n"), (7, 2, "b\n"), (7, None, "x"), (7, 4, "c"), (None, 1, "n"), (None, 2, "\nSection 1: Two\nm"), (8, None, "only"), (9, 3, None)]
    rows += [(10, n % 3, "\n\nSection 2: Same\n" + "para\n\n" * 40) for n in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(4)
    want = chunking.chunk_documents(documents.assemble_pages(df), chunk_size=100).collect()
    got = long_documents.chunk_pages(df, chunk_size=100, piece_pages=2).collect()
    plain = lambda found: sorted((str(r["doc_id"]), r["chunk_idx"], r["chunk"]) for r in found)
    assert plain(got) == plain(want)
