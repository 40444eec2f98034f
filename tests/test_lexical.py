"""Lexical cosines on sparse postings: against plain counting, over several blocks, with pruning."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loglens.operators import lexical, scoring

WORDS = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "épée", "x1", "Straße"] + [f"w{i}" for i in range(60)]


def text(rng, n):
    return " ".join(rng.choices(WORDS, weights=[40, 30, 20] + [3] * (len(WORDS) - 3), k=n))


def plain(a, b):
    x, y = (Counter(re.findall(r"[^\W_]+", (t or "").lower())) for t in (a, b))
    dot = sum(v * y[k] for k, v in x.items())
    return dot / (math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))) if dot else 0.0


def best_by_hand(left, right):
    out = {}
    for i, t in left:
        scored = sorted((-plain(t, u), j) for j, u in right if j is not None)
        if scored and scored[0][0] < 0:
            out[i] = (scored[0][1], -scored[0][0])
    return out


@pytest.mark.parametrize("block_rows, cells", [(10_000, 2_000_000), (7, 2_000_000), (7, 50), (1, 2_000_000)])
def test_best_match_over_blocks(spark, monkeypatch, block_rows, cells):
    rng = random.Random(block_rows)
    right = [(i, text(rng, rng.randrange(1, 25))) for i in range(40)]
    right += [(i + 100, t) for i, t in right[:10]] + [(200, ""), (201, None), (None, "alpha"), (202, "!!")]  # ties, empty, nameless
    left = [(i, text(rng, rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, "unknown words only"), (102, right[3][1]), (103, "ALPHA, Alpha")]
    monkeypatch.setattr(lexical, "STEP_CELLS", cells)
    l, r = spark.createDataFrame(left, "i long, t string"), spark.createDataFrame(right, "j long, u string").repartition(4)
    got = {x["i"]: (x["j"], x["cos"]) for x in lexical.lexical_best(l, "i", "t", r, "j", "u", block_rows=block_rows).collect()}
    want = best_by_hand(left, right)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12, (i, got[i], want[i])


def test_text_ids_and_empty_sides(spark):
    l = spark.createDataFrame([(1, "a b"), (2, "c")], "i int, t string")
    r = spark.createDataFrame([("z", "a b"), ("y", "b a"), ("x", "c c")], "j string, u string")
    assert sorted((x["i"], x["j"]) for x in lexical.lexical_best(l, "i", "t", r, "j", "u").collect()) == [(1, "y"), (2, "x")]
    assert lexical.lexical_best(l, "i", "t", r.limit(0), "j", "u").count() == 0
    assert lexical.lexical_best(l.limit(0), "i", "t", r, "j", "u").count() == 0


def block(texts, frequent):
    rows = next(lexical._counted([pa.RecordBatch.from_arrays([pa.array([t.split() for t in texts], pa.list_(pa.string()))], names=["toks"])]))
    return lexical.Postings(rows["terms"], rows["times"], frequent)


def test_pruning_skips_and_stays_exact():
    rng = random.Random(5)
    right = [text(rng, 30) for _ in range(300)]
    left = [right[i] + " and more" for i in range(50)] + [text(rng, 40) for _ in range(50)]
    counts = lexical.Counts(pa.array([t.split() for t in left], pa.list_(pa.string())))
    told = Counter()
    best, cos = np.zeros(100, dtype=object), np.zeros(100)
    for lo in range(0, 300, 100):  # three blocks
        told.update(block(right[lo:lo + 100], 20).best(counts, np.arange(lo, lo + 100), best, cos))
    # a block without the words of the texts is skipped for them as a whole
    strange = block(["zebra zebra", "the yak"], 1).best(counts, np.arange(300, 302), best, cos)
    assert strange["skipped_texts"] > 90
    assert told["finished_pairs"] < 0.5 * told["pairs"]
    split = [(t, Counter(t.split())) for t in right]
    for i, t in enumerate(left):
        x = Counter(t.split())
        norm = math.sqrt(sum(v * v for v in x.values()))
        want = max(((sum(v * y[k] for k, v in x.items()) / (norm * math.sqrt(sum(v * v for v in y.values()))), -j) for j, (_, y) in enumerate(split)))
        assert best[i] == -want[1] and abs(cos[i] - want[0]) < 1e-12


def test_worker_memory_does_not_grow_with_the_vocabulary():
    """A block of many different words is as large as its words, not words x texts."""
    texts = [" ".join(f"t{i}v{j}" for j in range(50)) for i in range(2000)]  # 100,000 words, 2,000 texts
    p = block(texts[:1000], 64)
    held = sum(v.nbytes for v in vars(p).values() if isinstance(v, np.ndarray))
    assert held < 64 * 1000 * 8 + 50_000 * 8 * 8


@pytest.mark.parametrize("per_block", [10_000, 5, 1])
def test_similarities_against_plain_counting(spark, per_block):
    rng = random.Random(1)
    protos = [(axis, o, f"{axis[0].upper()}{o}", kind, text(rng, rng.randrange(1, 12))) for axis in scoring.AXES for o in range(3)
              for kind in scoring.KINDS for _ in range(1 if kind == "definition" else rng.randrange(1, 5))]
    rows = [(i, text(rng, rng.randrange(0, 30)), i % 2 == 0) for i in range(40)] + [(99, None, None)]
    p = spark.createDataFrame(protos, "category_type string, ord int, code string, kind string, text string")
    s = spark.createDataFrame(rows, "session_id long, combined_prompt string, other boolean")
    out, cats = lexical.lexical_similarities(s, p, max_broadcast_protos=per_block)
    assert cats["domain"].codes == ("D0", "D1", "D2")
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict((i, x) for i, x, _ in rows)[r["session_id"]]
        for axis in scoring.AXES:
            for kind in scoring.KINDS:
                want = [max(plain(t, u) for a, _, c, k, u in protos if (a, k, c) == (axis, kind, code)) for code in cats[axis].codes]
                assert np.allclose(r[scoring.sims_field(axis, kind)], want, atol=1e-12)


def test_prototypes_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    for name in ("collect", "toLocalIterator", "toPandas"):
        def spy(self, *args, _of=getattr(DataFrame, name), **kw):
            seen.append(self.columns)
            return _of(self, *args, **kw)
        monkeypatch.setattr(DataFrame, name, spy)
    rng = random.Random(2)
    p = spark.createDataFrame([(a, 0, a, k, text(rng, 9)) for a in scoring.AXES for k in scoring.KINDS], "category_type string, ord int, code string, kind string, text string")
    s = spark.createDataFrame([(1, "alpha")], "session_id long, combined_prompt string")
    lexical.lexical_similarities(s, p, max_broadcast_protos=2)
    lexical.lexical_best(s, "session_id", "combined_prompt", p, "code", "text")
    assert seen and not [c for c in seen if {"text", "terms", "toks"} & set(c)]
