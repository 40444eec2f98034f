import numpy as np
from pyspark.sql import functions as F

from loglens.operators import scoring


def _data(spark, rnd, n_sessions=60, dim=8):
    protos = []
    pid = 0
    for axis in scoring.AXES:
        for ord_ in range(4):
            code = ("D" if axis == "domain" else "I") + f"{ord_ + 1:02d}"
            for kind, k in (("definition", 1), ("keyword", 3), ("phrase", 2)):
                for _ in range(k):
                    protos.append((axis, ord_, code, kind, pid, rnd.normal(size=dim).astype(np.float32).tolist()))
                    pid += 1
    sess = [(i, (rnd.normal(size=dim) if i else np.zeros(dim)).astype(np.float32).tolist(), "D02" if i % 2 else None)
            for i in range(n_sessions)]
    p = spark.createDataFrame(protos, "category_type string, ord int, code string, kind string, proto_id long, vec array<float>")
    s = spark.createDataFrame(sess, "session_id long, vec array<float>, domain_prior string")
    return protos, sess, p, s


def _brute(protos, sess):
    def cos(a, b):
        a, b = np.asarray(a, float), np.asarray(b, float)
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        return 0.0 if na == 0 or nb == 0 else float(a @ b / (na * nb))

    out = {}
    for sid, v, prior in sess:
        for axis in scoring.AXES:
            codes = sorted({p[2] for p in protos if p[0] == axis})
            for code in codes:
                m = {k: max(cos(v, p[5]) for p in protos if p[2] == code and p[3] == k) for k in scoring.KINDS}
                sc = 0.5 * m["phrase"] + 0.3 * m["keyword"] + 0.2 * m["definition"]
                if axis == "domain" and prior == code:
                    sc = min(sc * 1.2, 1.0)
                out[(sid, code)] = sc
    return out


def test_kernel_matches_brute_force_and_blocks(spark):
    rnd = np.random.default_rng(5)
    protos, sess, p, s = _data(spark, rnd)
    expect = _brute(protos, sess)
    for block in (10_000, 7):  # single broadcast, and blocks of 7 prototypes
        sims, cats = scoring.dense_similarities(s, p, max_broadcast_protos=block)
        hyb = scoring.with_hybrid_scores(sims, cats)
        for r in hyb.collect():
            for axis in scoring.AXES:
                for code, sc in zip(cats[axis].codes, r[f"{axis}_scores"]):
                    assert abs(sc - expect[(r.session_id, code)]) < 1e-9


def test_argmax_tie_takes_first(spark):
    from loglens.operators.scoring import Categories

    cats = {"domain": Categories("domain", ("D01", "D02", "D03"), (0, 1, 2)),
            "intent": Categories("intent", ("I01", "I02"), (0, 1))}
    df = spark.createDataFrame([([0.2, 0.5, 0.5], [0.3, 0.3])], "domain_scores array<double>, intent_scores array<double>")
    r = scoring.with_best_category(df, cats).first()
    assert (r.predicted_domain, r.predicted_intent) == ("D02", "I01")
    assert r.combined_confidence == 0.4 and r.all_domain_scores == {"D01": 0.2, "D02": 0.5, "D03": 0.5}


def test_round4_half_up(spark):
    df = spark.createDataFrame([(0.12345,), (0.74995,), (-0.00005,)], "x double")
    assert [r[0] for r in df.select(scoring.round4(F.col("x"))).collect()] == [0.1235, 0.75, 0.0]


def test_lexical_blocks_equal_single_pass(spark):
    from loglens.operators import lexical

    protos = []
    words = ["alpha beta", "beta gamma", "gamma delta", "delta alpha", "epsilon", "beta beta alpha"]
    for axis in scoring.AXES:
        for ord_ in range(3):
            code = ("D" if axis == "domain" else "I") + f"{ord_ + 1:02d}"
            for j, kind in enumerate(("definition", "keyword", "keyword", "phrase")):
                protos.append((axis, ord_, code, kind, words[(ord_ + j) % len(words)]))
    p = spark.createDataFrame(protos, "category_type string, ord int, code string, kind string, text string")
    s = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta gamma", "delta", "", "zeta Beta"])],
                              "session_id long, combined_prompt string")
    one, _ = lexical.lexical_similarities(s, p)
    blk, _ = lexical.lexical_similarities(s, p, max_broadcast_protos=5)
    cols = [scoring.sims_field(a, k) for a in scoring.AXES for k in scoring.KINDS]
    a = {r.session_id: [list(r[c]) for c in cols] for r in one.collect()}
    b = {r.session_id: [list(r[c]) for c in cols] for r in blk.collect()}
    assert a == b and a[2][0] == [0.0, 0.0, 0.0]


def test_row_blocks_do_not_change_results(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    protos, sess, p, s = _data(spark, rnd, n_sessions=40)
    full, cats = scoring.dense_similarities(s, p)
    want = {r.session_id: list(r.domain_phrase_sim) for r in full.collect()}
    monkeypatch.setattr(scoring, "MAX_BLOCK_CELLS", 30)  # 1 row per block
    small, _ = scoring.dense_similarities(s, p)
    got = {r.session_id: list(r.domain_phrase_sim) for r in small.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in got)  # BLAS blocking: last-bit differences
    top_small = sorted((r.session_id, r.rank, r.proto_id) for r in scoring.cosine_topk(s, p, k=3).collect())
    monkeypatch.setattr(scoring, "MAX_BLOCK_CELLS", 16_000_000)
    assert top_small == sorted((r.session_id, r.rank, r.proto_id) for r in scoring.cosine_topk(s, p, k=3).collect())


def test_boost_pushes_negative_down_and_caps(spark):
    from loglens.operators.scoring import Categories

    cats = {"domain": Categories("domain", ("D01", "D02"), (0, 1)), "intent": Categories("intent", ("I01",), (0,))}
    df = spark.createDataFrame(
        [("D01", [-0.5, 1.0], [0.0, 1.0], [0.0, 1.0], [0.1], [0.1], [0.1]),
         ("D02", [-0.5, 1.0], [0.0, 1.0], [0.0, 1.0], [0.1], [0.1], [0.1])],
        "domain_prior string, domain_phrase_sim array<double>, domain_keyword_sim array<double>, "
        "domain_definition_sim array<double>, intent_phrase_sim array<double>, intent_keyword_sim array<double>, "
        "intent_definition_sim array<double>")
    got = [r.domain_scores for r in scoring.with_hybrid_scores(df, cats).collect()]
    assert abs(got[0][0] - (-0.25 * 1.2)) < 1e-12 and got[0][1] == 1.0   # boosted negative gets lower
    assert got[1][1] == 1.0                                              # min(1.0 * 1.2, 1.0)


def _collected_columns(monkeypatch, df):
    """Records the columns of every frame whose rows come to the driver."""
    seen = []
    for name in ("collect", "toLocalIterator", "toPandas"):
        def spy(self, *args, _of=getattr(type(df), name), **kw):
            seen.append(self.columns)
            return _of(self, *args, **kw)
        monkeypatch.setattr(type(df), name, spy)
    return seen


def test_topk_over_blocks_of_any_number(spark):
    rnd = np.random.default_rng(3)
    protos, sess, p, s = _data(spark, rnd)
    # every vector twice, far apart: ties go to the smaller id, across blocks
    twice = p.unionByName(p.withColumn("proto_id", F.col("proto_id") + 1000)).repartition(3)
    vecs = np.array([q[5] for q in protos])
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    for block in (10_000, 7):  # one block, and more prototypes than one block holds
        got = {}
        for r in scoring.cosine_topk(s, twice, k=4, max_broadcast_protos=block).collect():
            got.setdefault(r.session_id, {})[r.rank] = (r.proto_id, r.cos)
        assert len(got) == len(sess)
        for sid, v, _ in sess:
            n = np.linalg.norm(v)
            cos = vecs @ np.asarray(v) / (n if n else 1.0)
            want = sorted(((-c, i + d) for i, c in enumerate(cos) for d in (0, 1000)))[:4]
            assert [got[sid][k][0] % 1000 for k in (1, 2, 3, 4)] == [i % 1000 for _, i in want] or n == 0
            assert np.allclose([got[sid][k][1] for k in (1, 2, 3, 4)], [-c for c, _ in want], atol=1e-9)
        assert [got[0][k][0] for k in (1, 2, 3, 4)] == [0, 1, 2, 3]  # the zero vector ties with all


def test_prototype_vectors_stay_off_the_driver(spark, monkeypatch):
    _, _, p, s = _data(spark, np.random.default_rng(4))
    seen = _collected_columns(monkeypatch, p)
    for block in (10_000, 7):
        scoring.dense_similarities(s, p, max_broadcast_protos=block)
        scoring.cosine_topk(s, p, k=3, max_broadcast_protos=block)
    assert seen and not [c for c in seen if "vec" in c]


def test_blocks_hold_every_row_within_bounds(spark):
    from loglens.operators import blocks

    df = spark.range(0, 5000, numPartitions=3).select("id", (F.col("id") % 5).alias("k"), F.lpad(F.lit("x"), 100, "y").alias("t"))
    stored, keys = blocks.write_blocks(df, 10_000, 50_000, ("k",))
    sizes, ids = [], []
    for t in stored.reader(lambda t: t)():
        sizes.append(t.nbytes)
        ids += t["id"].to_pylist()
    assert sorted(ids) == list(range(5000)) and len(sizes) > 5000 * 100 // 50_000
    assert max(sizes) <= 55_000 and sorted(r["k"] for r in keys.collect()) == [0, 1, 2, 3, 4]
    assert blocks.write_blocks(df.limit(0), 10, 10)[0].names == ()
