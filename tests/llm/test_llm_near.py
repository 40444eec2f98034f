"""Near-duplicate joins against brute force, and on odd rows."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import embedding_dedup, linkage, queries, shingle_join

SF = "/root/testdata/sf0.01"
have_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
DOCS = "doc_id long, text string, source string"


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_force(rows):
    """{id: (class, number of links)} of (id, text) rows with distinct ids."""
    sets = [shingles(t) for _, t in rows]
    by_token = {}
    for k, s in enumerate(sets):
        for x in s:
            by_token.setdefault(x, []).append(k)
    common = {}
    for ks in by_token.values():
        for pair in itertools.combinations(ks, 2):
            common[pair] = common.get(pair, 0) + 1
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (least[find(k)], links[k]) for k, (i, _) in enumerate(rows)}


def near_group(rng, n, words=120, changed=4):
    base = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changed)):
            w[rng.randrange(words)] = f"x{rng.randint(0, 99999)}"
        out.append(" ".join(w))
    return out


def answer(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_near_documents_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = near_group(rng, 60) + near_group(rng, 25, 40, 2) + near_group(rng, 30, 300, 12) + ["same text here for all of them"] * 40 + ["one two"] * 3 + ["one"] + [""] * 3
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"y{rng.randint(0, 9999)}" for _ in range(rng.randint(20, 200))) for _ in range(80)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)
    want = brute_force(rows)
    assert answer(shingle_join.near_documents(df)) == want
    # small buckets and blocks: several levels, pivots, block pairs
    monkeypatch.setattr(shingle_join, "BUCKET", 10)
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    assert answer(shingle_join.near_documents(df)) == want


@have_data
def test_near_documents_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op8_shingle_join(spark, SF)
    assert answer(got) == brute_force([tuple(r) for r in docs])


def test_near_documents_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " end", None), (None, text, "a"), (3, None, "a"), (4, "", "a"), (5, "long " * 50_000, "a"), (2, "other words that are here now", "b")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"id": F.lit(1), "sh": F.lit("x"), "node": F.lit(2), "body": F.lit("z")})
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"], r["n_links"], r["kept"]) for r in shingle_join.near_documents(df).collect())
    assert got == [(0, 0, 1, 0, True), (1, 1, 3, 2, True), (1, 1, 3, 2, True), (2, 1, 3, 2, False), (2, 2, 1, 0, True), (3, 3, 1, 0, True), (4, 4, 1, 0, True), (5, 5, 1, 0, True)]
    assert shingle_join.near_documents(df.limit(0)).count() == 0
    left = shingle_join.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 1, 3, 4, 5]


def shared_id_rows():
    """Pairs of near documents, and 20 other texts under the smaller id of each pair."""
    rng, rows = random.Random(9), []
    for i in range(0, 20, 2):
        a, b = near_group(rng, 2, 120, 1)
        rows += [(i, a, "first"), (i + 1, b, "second")]
        rows += [(i, " ".join(f"z{rng.randint(0, 99999)}" for _ in range(60)), "other") for _ in range(20)]
    rng.shuffle(rows)
    return rows


def test_near_documents_that_share_an_id(spark):
    got = shingle_join.near_documents(spark.createDataFrame(shared_id_rows(), DOCS)).collect()
    linked = sorted((r["doc_id"], r["class_id"], r["class_size"], r["n_links"], r["kept"]) for r in got if r["n_links"])
    assert linked == [(i, i - i % 2, 2, 1, i % 2 == 0) for i in range(20)]
    assert len(got) == 220


def test_stage_drops_the_linked_row_alone(spark):
    import corpus_pipeline

    rows = [(19 - i, t, s) for i, t, s in shared_id_rows()]  # the other texts now share the id of the dropped document
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([*rows, (None, rows[0][1], "first")], DOCS), SF)
    assert got.columns == ["doc_id", "text", "source"]
    want = [r for r in rows if r[2] != "first"] + [(None, rows[0][1], "first")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_runs_reach_the_recall():
    for levels in (1, 2, 3):
        assert (1 - shingle_join.survival(levels)) ** shingle_join.runs_for(0.9999, levels) <= 1e-4


# ---------------------------------------------------------------- embeddings
def cosines(rows):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _ in rows}, {k: k for k in range(len(ok))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(ok)), 2):
        x, y = ok[a][1], ok[b][1]
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            links[ok[a][0]] += 1
            links[ok[b][0]] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(ok):
        least[find(k)] = min(i, least.get(find(k), i))
    part = {i: least[find(k)] for k, (i, _) in enumerate(ok)}
    return {i: (n, part.get(i, i)) for i, n in links.items()}


def check_vectors(df, rows):
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}
    assert got == cosines(rows)


def test_near_vectors_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for spread, n in ((0.02, 40), (0.12, 30), (0.06, 30)):
        base = rng.standard_normal(24)
        rows += [(base + spread * rng.standard_normal(24) * np.linalg.norm(base) / 2) * rng.uniform(0.1, 9) for _ in range(n)]
    rows += list(rng.standard_normal((300, 24))) + [rows[0]] * 20
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check_vectors(embedding_dedup.near_vectors(df), rows)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 6)
    monkeypatch.setattr(linkage.class_links, "__defaults__", (7,))
    check_vectors(embedding_dedup.near_vectors(df), rows)


@have_data
def test_near_vectors_of_the_table(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_vectors(queries.op10_embedding_dedup(spark, SF), rows)


def test_near_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-30, 0.0]), (11, [3e38, 1e37])]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0])], "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "node": F.lit(2), "id": F.lit(0), "label": F.lit(None)})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert got == {None: (0, None, True), 1: (3, 1, True), 2: (3, 1, False), 10: (3, 1, False), 11: (3, 1, False), **alone}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------- components
def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    for n, m in ((60, 50), (400, 380), (50, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2001 + k) for k in range(100)]
        parent = {x: x for e in edges for x in e}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        got = {r["node"]: r["root"] for r in linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        touched = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: find(x) for x in touched}


def test_star_roots():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = 30, int(rng.integers(0, 40))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        parent = list(range(n))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for x, y in zip(a, b):
            parent[max(find(x), find(y))] = min(find(x), find(y))
        assert linkage.star_roots(n, a, b).tolist() == [find(i) for i in range(n)]


def test_kept_rows_with_shared_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    rows = [(5, " ".join(base), "a"), (5, " ".join(near), "b"), (7, "quite " + " ".join(base), "c"), (9, "one two three four five six", "d"), (9, "one two three four five six", "d"),
            (9, "seven eight nine ten eleven twelve", "e"), (3, "", "f"), (3, None, "g"), (None, " ".join(base), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r["doc_id"] or 0, r["source"]) for r in shingle_join.kept_rows(df).collect())
    # of the class of 5, 5 and 7 one text stays, of the rows repeated under 9 and 3 one each, and the row without an id
    assert len(kept) == 5 and [x for x in kept if x[0] == 9] == [(9, "d"), (9, "e")] and (0, "h") in kept
    assert len([x for x in kept if x[0] == 5]) == 1 and not [x for x in kept if x[0] == 7]
    assert [x[0] for x in kept].count(3) == 1
