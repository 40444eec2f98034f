"""Exact duplicates, mixing, token counts, packing: against brute force, the libraries, and on odd rows."""

import hashlib
import os
import random
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loglens.llm import exact_dedup, mixing, packing, queries, token_counts
from loglens.llm.word_ids import WordIds
from scripts.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.01"
have_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (None, "a b c", None, None, None), (3, "", "en", "t", 0),
    (4, None, "en", "t", None), (5, "x " * 9000, "en", None, 1), (6, "Ünï cödé▁ \x00\x1c　", "de", "u", 2),
    (6, "Ünï cödé▁ \x00\x1c　", "de", "u", 2), (7, "<|endoftext|> it's 1,234!! <s>", "en", "u", 3), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"id": F.lit("x"), "body": F.lit(1), "h": F.lit(2), "row": F.lit(3), "key": F.lit("k"), "grp": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@have_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, res = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    got, want = rows_of(df.columns, df.collect()), rows_of([d[0] for d in res.description], res.fetchall())
    assert got == want


# ---------------------------------------------------------------- exact duplicates
@pytest.mark.parametrize("weak", [False, True])  # a hash of one bit: collisions everywhere
@pytest.mark.parametrize("keep", ["min", "max"])
def test_flag_copies_odd_rows(spark, odd, weak, keep):
    how = (lambda t: F.substring(F.unhex(F.md5(t)), 1, 1)) if not weak else (lambda t: F.substring(F.md5(t), 1, 0).cast("binary"))
    got = sorted((tuple(r) for r in exact_dedup.flag_copies(odd, keep=keep, content_hash=how).collect()), key=str)
    want = []
    for i, t, *_ in ODD:
        same = [j for j, u, *_ in ODD if (u or "") == (t or "")]
        best = {"min": min, "max": max}[keep]((j for j in same if j is not None), default=None)
        want.append((i, best, len(same), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_drop_copies_odd_rows(odd, empty):
    out = exact_dedup.drop_copies(odd, keep="max")
    assert out.columns == odd.columns
    rows = sorted((r["doc_id"], r["text"], r["lang"]) for r in out.collect())
    assert [r[0] for r in rows] == [2, 4, 5, 6, 7] and rows[1][1] is None and rows[0][2] == "en"
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.flag_copies(empty).count() == 0


# ---------------------------------------------------------------- mixing
def test_mix_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    size = {r["source"]: r["source_size"] for r in rows}
    assert size == {None: 9003, "s": 6, "t": 0, "u": 2 * 3 + 4}
    target = {r["source"]: r["target"] for r in rows}
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_rows(odd)
    assert out.columns == odd.columns and out.count() == sum(r["times"] for r in rows)


def test_targets_by_resharing(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i:02d}": rng.randint(0, 10 ** rng.randint(0, 5)) for i in range(rng.randint(1, 12))} | {None: 50}
        got = {r[0]: r[2] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        names = sorted((s for s in sizes if s), key=str) + [None]
        w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        capped, total = set(), 1.5 * sum(sizes.values())
        while True:
            free = [s for s in names if s not in capped]
            left = total - sum(2 * sizes[s] for s in capped)
            t = {s: 2 * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
            over = [s for s in free if t[s] > 2 * sizes[s]]
            if not over:
                break
            capped |= set(over)
        assert got == {s: pytest.approx(v) for s, v in t.items()}


def test_mix_takes_near_target_and_prefers_quality(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)  # many key buckets
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"),
                                    F.when(F.col("id") % 2 == 0, F.repeat(F.lit("word "), 20)).otherwise(F.repeat(F.lit("#### "), 20)).alias("text"))
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for s in ("s0", "s1", "s2", "s3"):
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 10
    mixed = mixing.mix(docs.withColumn("source", F.lit("one")), share=0.5).collect()
    share = [sum(r["times"] for r in mixed if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert share[0] > 1.5 * share[1]


# ---------------------------------------------------------------- token counts
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_library(spark, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((tuple(r) for r in token_counts.count_tokens(odd, MODEL).collect()), key=str)
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in ODD]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(empty, MODEL).count() == 0
    model = open(MODEL, "rb").read()
    rng, alphabet = random.Random(5), ["a", "b", " ", "  ", "\n", "\t", "▁", ".", "é", "<s>", "\r", "the", "　", "😀", "\x00"]
    for remembered in (0, 1000):
        counts = token_counts.PreTokenCounts(model, token_counts.whole_tokens(model), True, remembered)
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
            assert counts.count(text) == len(sp.encode(text)), repr(text)


# ---------------------------------------------------------------- packing
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_library():
    import pyarrow as pa

    words = WordIds(open(TOKENIZER, encoding="utf-8").read(), remembered=50)
    rng = random.Random(7)
    alphabet = ["a", "The", "ß", "É", "é", " ", "\n", "\x1c", " ", ".", ",!!", "'s", "’", "Σ", "İ", "12", "<|endoftext|>", "ation", "ﬁ", "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(6000)]
    for part in (texts[:3000], texts[3000:]):
        ids, first = words.texts(pa.array(part, pa.large_string()))
        for t, a, z in zip(part, first[:-1], first[1:]):
            assert ids[a:z].tolist() == words.library.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_ids_of_every_letter_range():
    import pyarrow as pa

    words = WordIds(open(TOKENIZER, encoding="utf-8").read(), remembered=300)
    rng = random.Random(9)
    letters = [chr(c) for c in [*range(33, 0x250), *range(0x250, 0x600, 7), 0x1E9E, 0x2126, 0x212A, 0x212B, 0xFB01, 0x301, 0x308]]
    texts = letters + [f"a{c}b" for c in letters] + [f"{c}." for c in letters]
    texts += ["".join(rng.choices(letters[:500], k=rng.randrange(1, 9))) + rng.choice(["", "!", " x", "'s", "..."]) for _ in range(20_000)]
    texts += ["x" * n for n in (23, 24, 25, 300)] + ["é" * 13, ""]
    for i in range(0, len(texts), 5000):
        ids, first = words.texts(pa.array(texts[i:i + 5000], pa.string()))
        for t, a, z in zip(texts[i:i + 5000], first[:-1], first[1:]):
            assert ids[a:z].tolist() == words.library.encode(t, add_special_tokens=False).ids, repr(t)


def test_copies_of_one_row_spread_over_groups(spark):
    rows = [(1, "same text")] * 300 + [(None, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"named": F.lit(1), "o": F.lit(2), "copy": F.lit(3)})
    out = packing.pack_documents(df, TOKENIZER, group_rows=20, length=16).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["doc_id"], set()).add(r["sequence_id"] >> 31)
    assert len(groups[1]) > 10 and len(groups[None]) > 10
    words = WordIds(open(TOKENIZER, encoding="utf-8").read())
    assert sum(r["length"] for r in out) == sum(len(words.library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def check_pieces(rows, docs, words):
    import numpy as np

    docs = sorted(docs, key=str)
    by_id, by_seq = {}, {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in docs:
        ids = np.array(words.library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        mine = sorted((r for r in by_id[i] if r["doc_tokens"] == len(ids)), key=lambda r: r["start"])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
        if [i for i, _ in docs].count(i) == 1:
            at = 0
            for r in mine:
                assert r["start"] == at
                at += r["length"]
            assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 2048
    return by_seq


def test_packing_odd_rows(spark, odd, empty):
    words = WordIds(open(TOKENIZER, encoding="utf-8").read())
    rows = packing.pack_documents(odd, TOKENIZER, group_rows=3).collect()
    check_pieces(rows, [(r[0], r[1]) for r in ODD], words)
    total = sum(len(words.library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)
    assert sum(r["length"] for r in rows) == total
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


@have_data
def test_packing_documents(spark):
    words = WordIds(open(TOKENIZER, encoding="utf-8").read())
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op6_packing(spark, SF).collect()
    by_seq = check_pieces(rows, docs, words)
    assert sum(sum(r["length"] for r in s) < 2048 for s in by_seq.values()) <= 1


def test_pack_fills_all_but_one():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 700):
        sizes = [rng.choice([rng.randint(1, 2047), rng.randint(1, 40), 1024]) for _ in range(n)]
        bins = packing.pack(sizes)
        used = [sum(x[2] for x in b) for b in bins]
        assert all(0 < u <= 2048 for u in used) and sum(u < 2048 for u in used) <= 1 and sum(used) == sum(sizes)
        parts = sorted((i, s, k) for b in bins for i, s, k in b)
        assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:]))


def test_first_fit_decreasing_by_tournament():
    rng = random.Random(2)
    tree, free = packing.Tournament(40, 100), [100] * 40
    for _ in range(40):
        need = rng.randint(1, 60)
        b = tree.first(need)
        assert b == next(i for i, f in enumerate(free) if f >= need)
        tree.take(b, need)
        free[b] -= need


# ---------------------------------------------------------------- mixing: ids that are not unique
@pytest.mark.parametrize("bucket_rows", [3, 20_000])
def test_mix_with_null_shared_and_repeated_ids_is_near_its_targets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = [(None if i % 2 else i % 40, f"text {i} " + "w " * (i % 17), "a") for i in range(2000)]  # null and shared ids
    rows += [(7, "the very same row " * 3, "b")] * 1500 + [(i, "x y z", "b") for i in range(300)]  # one row repeated
    rows += [(1, None, "c"), (None, "", "c"), (2, "one", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "key", "size", "edge", "copies", "no", "part", "times")})
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    for s in ("a", "b", "c", None):
        mine = [r for r in mixed if r["source"] == s]
        largest = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= largest / 2 + 1e-6, s
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    times = sorted((str(r["doc_id"]), r["size"], str(r["source"]), r["times"]) for r in mixed)
    assert times == sorted((str(r["doc_id"]), r["size"], str(r["source"]), r["times"]) for r in mixing.mix(docs).collect())
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    taken = sum(mixing_words(r["text"]) for r in out.collect())
    assert taken == sum(r["taken"] for r in mixed)


def mixing_words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_takes_the_callers_weight(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2).cast("double").alias("good"))
    rows = mixing.mix(docs, weight=mixing.score_weight(F.col("good")), share=0.5).collect()
    share = [sum(r["times"] for r in rows if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert share[1] > 1.5 * share[0]
