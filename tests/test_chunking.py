import random
import re

from pyspark.sql import functions as F

from loglens import defaults
from loglens.operators import chunking


def boundaries(text):
    found = {0}
    for p in defaults.SECTION_PATTERNS:
        found.update(m.start() for m in re.finditer(p, text))
    return sorted(found)


def packed(text, size, keep_empty):
    chunks, cur = [], ""
    for par in text.split("\n\n"):
        if len(cur) + len(par) < size:
            cur = cur + par + "\n\n"
            continue
        if cur or keep_empty:
            chunks.append(cur)
        cur = par + "\n\n"
    return chunks + ([cur] if cur else [])


def expected_chunks(text, size=2000):
    b = boundaries(text)
    if not (1 < len(b) < 30):
        return packed(text, size, keep_empty=True)
    out = []
    for lo, hi in zip(b, b[1:] + [len(text)]):
        sec = text[lo:hi]
        out.extend(packed(sec, size, keep_empty=False) if len(sec) > size * 1.5 else [sec])
    return out


ATOMS = ["\nSection 3: Intro", "é\n\nü", "日本語 ", "\n1.2 Terms and More", "\nIV. Risk Factors", "\nRISK FACTORS", "\nArticle IV: Terms",
         "\n\n", "abc def ", "x" * 700, " é ", "\n  2 Big Title", "\nII.  Next", "\nSECTION 12. word",
         "\nALL CAPS (note)", "\n", "123 ", "Ünïcode ", "\r\n", " "]


def test_chunker_random_equivalence(spark):
    rnd = random.Random(3)
    texts = ["", "\n\nEND", "plain", "x" * 2500 + "\n\nshort", "x" * 1999, "x" * 1998 + "\n\n"]
    texts += ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 45))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    res = chunking.with_sections(chunking.with_chunks(df, "t", "c"), "t", "s").collect()
    for r in res:
        t = texts[r.id]
        b = boundaries(t)
        assert list(r.boundaries) == b, repr(t)
        assert list(r.c) == expected_chunks(t), repr(t)
        assert list(r.s) == [t[lo:hi] for lo, hi in zip(b, b[1:] + [len(t)])], repr(t)


def test_empty_first_chunk_parity_and_option(spark):
    t = "y" * 2100 + "\n\nz"
    df = spark.createDataFrame([(t,)], "t string")
    df = df.withColumn("p", F.split("t", "\n\n", -1))
    keep = df.select(chunking.pack_paragraphs(F.col("p"), 2000, keep_empty=True)).first()[0]
    drop = df.select(chunking.pack_paragraphs(F.col("p"), 2000, keep_empty=False)).first()[0]
    assert keep[0] == "" and keep[1:] == drop


def test_caps_header_only_at_end(spark):
    df = spark.createDataFrame([("intro\nRISK FACTORS\nmore",), ("intro\nRISK FACTORS",)], "t string")
    got = [list(r.boundaries) for r in chunking.with_boundaries(df, "t").collect()]
    assert got == [[0], [0, 5]]


def test_large_document_is_linear(spark):
    """A 4 MB single document: no per-chunk re-evaluation of the text (this
    took about a minute before chunking was made linear)."""
    import time

    para = "word " * 60
    text = "\n\n".join([para] * 13_000)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunking.chunk_documents(df).count()  # warm-up
    t0 = time.time()
    n = chunking.chunk_documents(df).count()
    assert n == len(packed(text, 2000, keep_empty=True))
    assert time.time() - t0 < 20


def test_no_expression_duplication_in_plan(spark):
    df = spark.createDataFrame([(1, "a\n\nb")], "doc_id long, text string")
    plan = chunking.chunk_documents(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1  # the patterns run once per text


def test_many_matches_are_linear(spark):
    """80,000 numbered lines, each a boundary."""
    import time

    text = "intro" + "".join(f"\n1.{i % 9 + 1} Terms of item {i}" for i in range(80_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t0 = time.time()
    b = chunking.with_boundaries(df).first().boundaries
    assert list(b) == boundaries(text)
    assert time.time() - t0 < 60


def test_order_texts_equal_their_parts(spark, tmp_path):
    """Texts written after the meeting are the parts in order: nulls, repeated orders, more than 99 lines."""
    from datetime import date

    from loglens.plans import fixtures as fx

    orders = [(1, 7, "F", "1-URGENT"), (1, 8, "O", "1-URGENT"), (2, None, "F", None), (3, 9, None, "2-HIGH"), (None, 5, "F", "1-URGENT"), (None, None, None, None), (6, None, "O", "3")]
    lines = [(1, n % 7, n, 100 - n, float(n % 50), n + 0.5, date(2024, 1, 1 + n % 28)) for n in range(120)]
    lines += [(2, None, 1, 1, 50.0, 1.0, date(2024, 1, 1)), (4, 1, None, 1, None, None, None), (5, 1, None, None, 45.0, 2.0, None), (None, 2, 3, 4, 5.0, 6.0, None), (8, 1, 2, 3, 4.0, 5.5, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {}
    for r in sorted(fx.order_text_parts(spark, str(tmp_path)).collect(), key=lambda r: (r.part_seq, r.text)):
        want[r.doc_id] = want.get(r.doc_id, "") + r.text
    texts = fx.order_texts(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in texts.collect()} == want and 1 in want and None in want
    plan = fx.order_texts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Delivery note" not in plan[plan.index("Exchange"):]  # notes are written behind the shuffle
