"""The corpus pipeline: every stage against brute force on its own input, odd rows, empty tables."""

import hashlib
import math
import os
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_basics import TOKENIZER, check_pieces
from test_llm_near import brute_force

from loglens.llm import labelled, toxicity
from loglens.llm.word_ids import WordIds

SF = "/root/testdata/sf0.01"
have_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def mixed_by_hand(rows):
    """{doc_id: how often} for (doc_id, source, text)."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, _, t in rows}
    per, total = {}, sum(size.values())
    for i, s, _ in rows:
        per[s] = per.get(s, 0) + size[i]
    names = sorted(per)
    w = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        left = 1.5 * total - sum(2.0 * per[s] for s in capped)
        target = {s: 2.0 * per[s] if s in capped else w[s] * (left / sum(w[x] for x in free)) for s in names}
        over = {s for s in free if target[s] > 2.0 * per[s]}
        if not over:
            break
        capped |= over
    times = {}
    for s in names:
        mine = []
        for i, src, t in rows:
            if src == s:
                u = (int(hashlib.md5(f"{i}:{hashlib.md5(t.encode()).hexdigest()}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                mine.append((-math.log(u) / (0.25 + 0.75 * (sum(c.isalpha() for c in t) / max(len(t), 1))), i))
        epochs, prefix = math.floor(target[s] / per[s]) if per[s] else 0, 0
        for _, i in sorted(mine):
            prefix += size[i]
            times[i] = epochs + (prefix - size[i] / 2 <= target[s] - epochs * per[s])
    return times


@have_data
def test_stages_by_brute_force(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs, source = spark.read.parquet(str(tmp_path / name)), docs
        kept[name] = after = docs.collect()
        if name != "packing":
            assert docs.columns == source.columns
            assert set(after) <= set(before)
        ids = sorted(r["doc_id"] for r in after)
        if name == "toxicity":
            model = toxicity.learn(source, spark.read.parquet(f"{SF}/labels.parquet"), ~labelled.held_out("doc_id", 4, 2))
            w = toxicity.Windows(model.ordinary, model.toxic)
            x = np.array([w.features(r["text"]) for r in before])
            score = labelled.sigmoid(x @ np.array(model.weights[:-1]) + model.weights[-1])
            assert ids == sorted(r["doc_id"] for r, s in zip(before, score) if s < 0.3)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best[r["text"]] = max(r["doc_id"], best.get(r["text"], -1))
            assert ids == sorted(best.values())
        elif name == "near_dedup":
            assert ids == sorted(i for i, (c, _) in brute_force([(r["doc_id"], r["text"]) for r in before]).items() if i == c)
        elif name == "mixing":
            times = mixed_by_hand([(r["doc_id"], r["source"], r["text"]) for r in before])
            assert ids == sorted(i for i, n in times.items() for _ in range(n))
    words = WordIds(open(TOKENIZER, encoding="utf-8").read())
    by_seq = check_pieces(kept["packing"], [(r["doc_id"], r["text"]) for r in kept["mixing"]], words)
    assert sum(sum(r["length"] for r in s) < 2048 for s in by_seq.values()) <= 1
    tokens = {r["doc_id"]: len(words.library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept["mixing"]}
    assert sum(r["length"] for r in kept["packing"]) == sum(tokens[r["doc_id"]] for r in kept["mixing"])


def folder(spark, path, docs, labels):
    spark.createDataFrame(docs, SCHEMA).withColumns({"body": F.lit("x"), "key": F.lit(None).cast("string"), "c0": F.lit(1)}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (None, "a b c d e f", None, None, None), (2, None, None, None, None),
            (3, "", "en", "t", 0), (4, "word " * 60_000, "en", "s", 1), (5, "one two", "de", None, 2)]
    where = folder(spark, tmp_path / "odd", docs, [(1, 1, 0), (None, 1, 1), (4, None, None)])
    rows = corpus_pipeline.run(spark, where).collect()
    assert {r["doc_id"] for r in rows} <= {None, 1, 2, 3, 4, 5} and 4 in {r["doc_id"] for r in rows}
    none = folder(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
