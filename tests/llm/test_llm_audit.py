"""Filter audit, hard negatives and secret scan: against brute force, and on odd rows."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import filter_audit, hard_negatives, queries, secret_scan

SF = "/root/testdata/sf0.01"
have_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

# ---------------------------------------------------------------- filter audit
SCHEMA = "doc_id long, text string, source string"
WORDS = " ".join(f"word{i}" for i in range(60))


def audit_docs():
    rng = random.Random(11)
    rows = [(1, WORDS, "s"), (2, WORDS, "s"), (3, WORDS, "t"), (2, WORDS, "s"), (None, WORDS, "s"), (4, None, None), (5, "", ""),
            (6, "\x0b \t", "t"), (7, "A B# " * 40, "t"), (8, "a " * 30_000, "u"), (9, "ÀÉ % x", "u"), (9, WORDS + " Zz", "u"), (None, None, None)]
    pool = ["ok", "go on | then", WORDS + " $", WORDS.upper(), "a b " * 40]
    rows += [(20 + i, rng.choice(pool), rng.choice("stu")) for i in range(60)]
    return rows


def audit_by_hand(rows, labels):
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        parts[s or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = sum(d[0][f] for d in docs)
                unique = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), unique, sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("broadcast, salt", [(True, 1024), (True, 2), (False, 2)])
def test_audit_against_brute_force(spark, broadcast, salt):
    rows = audit_docs()
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, None, 1), (None, 1, 1), (30, 1, None), (999, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("id", "part", "h", "bits", "n", "quality", "words", "k", "salts")})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"n": F.lit(1), "bits": F.lit(2)})
    got = filter_audit.audit(docs, said, salt_rows=salt, most_bytes=1 << 20 if broadcast else 0).collect()
    assert len(got) == 4 * 600
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == audit_by_hand(rows, labels)


def test_audit_without_labels_other_filters_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b", "s")], SCHEMA)
    rows = filter_audit.audit(docs, None, [("X", lambda: F.col("text") == "a")]).collect()
    assert sorted(tuple(r) for r in rows) == [("s", "EX", 1, 2, 1, 0, 0, 0, 0, 1), ("s", "EX", 2, 1, 1, 1, 1, 0, 0, 3),
                                              ("s", "XE", 1, 1, 2, 0, 1, 0, 0, 3), ("s", "XE", 2, 1, 0, 1, 0, 0, 0, 1)]
    assert filter_audit.audit(docs.limit(0), None).count() == 0


# ---------------------------------------------------------------- hard negatives
def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for n, k, m in ((1, 1, 1), (5, 3, 9), (67, 64, 130), (33, 129, 70), (40, 0, 50), (0, 4, 4)):
        a, b = rng.integers(-2**20, 2**20, (n, k)), rng.integers(-2**20, 2**20, (k, m))
        for leaf in (1, 4, 32):
            assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


def test_heaps_merge_like_a_sort():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(-6, 6, (20, 300)), np.sort(rng.permutation(10_000)[:300])
    allowed = rng.random(scores.shape) < 0.3
    allowed[3] = False
    scores[4, :], heaps = hard_negatives.NONE + 1, hard_negatives.Heaps(20, 4)
    for i in (128, 0, 256):  # tiles in any order
        heaps.offer(scores[:, i:i + 128], ids[i:i + 128], allowed[:, i:i + 128])
    for r in range(20):
        want = sorted((-int(s), int(i)) for s, i, ok in zip(scores[r], ids, allowed[r]) if ok)[:4]
        full = heaps.score[r] > hard_negatives.NONE
        assert list(zip((-heaps.score[r][full]).tolist(), heaps.ident[r][full].tolist())) == want


VECTORS = [(100, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.2], 2), (3, [0.5, 0.25], 2), (4, [0.5, 0.25], 2), (5, None, 1), (6, [0.1, None], 1),
           (7, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2), (9, [0.3, 0.3], None), (None, [0.5, 0.25], 1), (10, [], 1), (11, [0.5, 0.25, 0.1], 1),
           (200, [-0.5, 0.1], 2), (12, [0.45, 0.3], 2), (13, [0.4, 0.4], 1), (100, [0.5, 0.24], 1), (300, [0.0, 0.0], 1), (14, [0.45, 0.3], 2), (400, [3e38, 1.0], 5),
           (500, [], 3), (15, [], 3), (16, [], 4)]


def hard_by_hand(rows, is_anchor, k=5):
    ok = [(i, [min(max(math.floor(np.float32(x).astype(float) * 256), -2**24), 2**24) for x in v], y) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in ok:
        if not is_anchor(a[0]):
            continue
        scored = [(-sum(p * q for p, q in zip(a[1], c[1])), c[0], c[2]) for c in ok if len(c[1]) == len(a[1])]
        for s, i, _ in sorted(c for c in scored if c[2] == a[2] and c[1] != a[0])[:k]:
            hard = sorted(c for c in scored if c[2] != a[2] and 80 * -s <= 100 * -c[0] <= 100 * -s)[:k]
            out += [(a[0], i, r, c[1], -s, -c[0]) for r, c in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives_odd_rows(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("id", "no", "q", "score", "rank", "anchor", "v")})
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())
    want = hard_by_hand(VECTORS, lambda i: i % 100 == 0)
    assert got == want and len(want) > 10
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_hard_negatives_small_blocks_and_text_labels(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-4, 5) / 8 for _ in range(5)], rng.choice("abc")) for i in range(400)]
    for name, value in (("ANCHORS", 3), ("TASK_CELLS", 500), ("TASK_ROWS", 100)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string")
    mined = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in mined.collect()) == hard_by_hand(rows, lambda i: i % 10 == 0)
    assert dict(mined.dtypes)["positive_id"] == "int"


# ---------------------------------------------------------------- secret scan
def spans_by_hand(text):
    """The three patterns as stated, each match tested for its length."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_pattern_spans_against_the_stated_patterns():
    rng = random.Random(13)
    pieces = ["password", "PassWD", "secret", "ToKen", "api_key", "APIKEY", "api__key", '"', "'", " ", "  ", ":", "=", "==", "abcdefgh", "abc", "AKIA", "AKIAAKIA", "QWERTY012345",
              "0123456789abcdef", "deadbeef" * 4, "é", "ſecret", "toKen", "\n", "\t", "/+_.-", "Z", "\U0001f600"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert secret_scan.pattern_spans(text) == spans_by_hand(text), text


def test_network_gradients_are_numerical_ones():
    rng = np.random.default_rng(3)
    windows = [("abc ", "x" * 16 + "0a" * 3, " !é"), ("", "Q9" * 20, "token"), ("password=", "deadbeef" * 3, "")]
    codes, middle = zip(*(secret_scan._sequence(w, secret_scan.CROP) for w in windows))
    y = np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0]], dtype=np.float32)
    params = [rng.standard_normal((secret_scan.CHARS, secret_scan.VECTOR)), rng.standard_normal((secret_scan.WIDTH * secret_scan.VECTOR, secret_scan.FILTERS)),
              rng.standard_normal(secret_scan.FILTERS), rng.standard_normal((secret_scan.FEATURES + 1, 3))]

    def loss():
        model = secret_scan.Model(params[0], params[1], params[2], params[3])
        z = plain_features(model, windows) @ params[3][:-1] + params[3][-1]
        return float(np.mean(np.sum(np.log1p(np.exp(z)) - y * z, axis=1)))

    for p, g in zip(params, secret_scan.gradients(params, list(codes), list(middle), y)):
        for at in zip(*(rng.integers(0, n, 6) for n in p.shape)):
            keep = p[at]
            p[at] = keep + 1e-5
            up = loss()
            p[at] = keep - 1e-5
            down = loss()
            p[at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 2e-3 * max(1, abs(g[at]))


def plain_features(model, windows):
    """The network's features by plain loops over positions and filters."""
    out = []
    for before, inside, after in windows:
        code = lambda c: ord(c) if ord(c) < 128 else secret_scan.OTHER
        pad = [secret_scan.PAD]
        left, mid, right = ([code(c) for c in s] for s in (before, inside, after))
        seq = pad * (secret_scan.CONTEXT - len(left)) + left + mid + right + pad * (secret_scan.CONTEXT - len(right))
        where = [0] * secret_scan.CONTEXT + [1] * len(mid) + [2] * secret_scan.CONTEXT
        seq = pad * 2 + seq + pad * 2
        act = [[max(0.0, float(np.concatenate([model.vectors[c] for c in seq[i:i + 5]]) @ model.filters[:, f] + model.bias[f])) for f in range(secret_scan.FILTERS)] for i in range(len(where))]
        tops = [max(a[f] for a, w in zip(act, where) if w == part) for part in range(3) for f in range(secret_scan.FILTERS)]
        means = [sum(a[f] for a, w in zip(act, where) if w == 1) / len(mid) for f in range(secret_scan.FILTERS)]
        out.append([*tops, *means, math.log1p(len(mid)) / 4])
    return np.array(out)


def test_features_of_whole_candidates_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    model = secret_scan.Model(rng.standard_normal((secret_scan.CHARS, 8)).astype(np.float32), rng.standard_normal((40, 16)).astype(np.float32), rng.standard_normal(16).astype(np.float32),
                              np.zeros((secret_scan.FEATURES + 1, 3), np.float32))
    windows = [("a" * 24, "b" * 16, "c" * 24), ("", "Zq0" * 70, "é"), ("x", "0123456789abcdef", "")]
    want = plain_features(model, windows)
    for block in (7, 64, 1 << 16):
        monkeypatch.setattr(secret_scan, "BLOCK", block)
        assert np.allclose(secret_scan.features(model, windows), want, atol=1e-4)


@have_data
def test_scan_whole_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op13_secret_scan"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = spans_by_hand(docs[r["doc_id"]])
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        kept = [x for x in r["spans"].split(",") if x and not x.startswith("net_")]
        assert ",".join(kept) == joined


def planted(n, seed):
    """Texts with labelled findings: keys after 'credential', which no pattern knows, among ordinary long words and numbers."""
    rng = random.Random(seed)
    rows, findings = [], []
    for i in range(n):
        key = "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=24))
        other = rng.choice(["internationalisation", "4493759588808516", "www.example.com/some/path"])
        text = f"said {other} and " + (f"credential {key} to them" if i % 2 else "nothing of the kind")
        rows.append((i, text))
        if i % 2:
            at = text.index(key)
            findings.append((i, "access", at, at + len(key)))
    return rows, findings


def test_learns_given_findings(spark):
    rows, findings = planted(400, 1)
    model = secret_scan.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(findings, "doc_id long, kind string, start long, end long"))
    assert np.isfinite(model.thresholds[1]) and np.isinf(model.thresholds[[0, 2]]).all()
    fresh, known = planted(400, 2)
    found = secret_scan.scan_texts(model, [t for _, t in fresh])
    hits = {(i, s["start"], s["end"]) for i, spans in enumerate(found) for s in spans}
    want = {(i, a, z) for i, _, a, z in known}
    assert len(hits & want) >= 0.95 * len(want) and len(hits - want) <= 0.05 * len(want)


def test_scan_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "token=abcdefgh"), (3, "x AKIAABCDEFGH1234 y"), (3, "x AKIAABCDEFGH1234 y"), (4, "secret: " + "Ab0" * 200_000), (5, "é\U0001f600 " + "f" * 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "body", "spans", "kinds", "before", "kind")})
    model = secret_scan.learn(docs)
    got = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["kind"].startswith("net_")]) for r in secret_scan.scan(docs, model).collect()), key=str)
    want = [(i, [(secret_scan.KINDS[k], s, e) for s, k, e in spans_by_hand(t or "")]) for i, t in rows]
    assert got == sorted(want, key=str)
    empty = docs.limit(0)
    assert secret_scan.scan(empty, secret_scan.learn(empty)).count() == 0


def test_learns_from_every_finding(spark, monkeypatch):
    """All findings reach the shards or are kept back; shards together learn what one does."""
    rows, findings = planted(1600, 5)
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(findings, "doc_id long, kind string, start long, end long")
    seen, plain = [], secret_scan._trained
    monkeypatch.setattr(secret_scan, "SHARD", 500)
    monkeypatch.setattr(secret_scan, "_trained", lambda used: (seen.append(used.count()), plain(used))[1])
    kept, calibrated = [], secret_scan._calibrated
    monkeypatch.setattr(secret_scan, "_calibrated", lambda model, back: (kept.append(back.count()), calibrated(model, back))[1])
    model = secret_scan.learn(docs, given)
    assert seen[0] > 3 * 500 and seen[0] + kept[0] == sum(len(secret_scan.candidates(t)) for _, t in rows)
    fresh, known = planted(400, 6)
    hits = {(i, s["start"], s["end"]) for i, spans in enumerate(secret_scan.scan_texts(model, [t for _, t in fresh])) for s in spans}
    want = {(i, a, z) for i, _, a, z in known}
    assert len(hits & want) >= 0.95 * len(want) and len(hits - want) <= 0.05 * len(want)
