"""Feature hashing in the JVM and in Python, and the pruned exact top-k."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.operators import encoders, pruned_topk, scoring


def test_jvm_and_python_hashing_agree(spark):
    texts = ["", None, "one Two two", "Straße épée ÉPÉE", "a_b 12 x1", "日本 語, текст!", "word " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for dim in (4, 64):
        both = encoders.encode_column(df.withColumn("j", encoders.hashed_vector(F.col("t"), dim)), "t", "p", encoders.signed_hashing_encoder(dim)).collect()
        for r in both:
            assert list(r["j"]) == list(r["p"]) and len(r["j"]) == dim
    assert sum(map(abs, both[6]["j"])) == 500


def clustered(n, dim=16, clusters=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim)) * 4
    return centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim)) * 0.3


@pytest.mark.parametrize("block_rows, pivots, rows", [(10_000, 4, 2048), (40, 8, 50), (7, 1, 3)])
def test_pruned_topk_is_the_full_scan(spark, block_rows, pivots, rows):
    protos, left = clustered(600), clustered(90, seed=1)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(protos)] + [(i + 1000, protos[i].tolist()) for i in range(50)], "proto_id long, vec array<double>").repartition(5)
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(left)] + [(500, [0.0] * 16), (501, protos[3].tolist())], "session_id long, vec array<double>")
    skipped = spark.sparkContext.accumulator(0)
    got = {}
    for r in pruned_topk.cosine_topk(s, p, 4, block_rows=block_rows, pivots=pivots, rows=rows, skipped=skipped).collect():
        got.setdefault(r["session_id"], {})[r["rank"]] = (r["proto_id"], r["cos"])
    want = {}
    for r in scoring.cosine_topk(s, p, k=4).collect():
        want.setdefault(r["session_id"], {})[r["rank"]] = (r["proto_id"], r["cos"])
    assert got.keys() == want.keys()
    for i in want:
        for rank in (1, 2, 3, 4):
            assert abs(got[i][rank][1] - want[i][rank][1]) < 1e-12
            assert got[i][rank][0] == want[i][rank][0] or abs(want[i][rank][1] - want[i].get(rank + 1, want[i][rank])[1]) < 1e-12 or rank > 1 and abs(want[i][rank][1] - want[i][rank - 1][1]) < 1e-12
    assert [got[501][k][0] for k in (1, 2)] == [3, 1003] and [got[500][k][0] for k in (1, 2, 3, 4)] == [0, 1, 2, 3]
    if block_rows == 40:  # clustered prototypes: most blocks are not compared
        assert skipped.value > 0.5 * 92 * (650 // 40)


def test_pruned_topk_of_few_or_no_prototypes(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0])], "session_id long, vec array<double>")
    p = spark.createDataFrame([(5, [0.0, 2.0]), (4, [3.0, 0.0])], "proto_id long, vec array<double>")
    assert [(r["rank"], r["proto_id"], r["cos"]) for r in pruned_topk.cosine_topk(s, p, 5).orderBy("rank").collect()] == [(1, 4, 1.0), (2, 5, 0.0)]
    assert pruned_topk.cosine_topk(s, p.limit(0), 2).count() == 0 and pruned_topk.cosine_topk(s.limit(0), p, 2).count() == 0
