"""Quality, toxicity, chat formatting and archives."""

import base64
import gzip
import hashlib
import io
import json
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import chat_format, labelled, quality, queries, toxicity, warc

SF, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
have_data = pytest.mark.skipif(not os.path.isdir(SF1), reason="test data not present")


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def held_out_scores(spark, query, label):
    rows = query(spark, SF1).filter("held_out").join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows]), np.array([r["predicted"] for r in rows])


@have_data
def test_quality_on_held_out_labels(spark):
    score, y, predicted = held_out_scores(spark, queries.op2_quality, "quality")
    assert auc(score, y) > 0.97 and (predicted == y).mean() > 0.93


@have_data
def test_toxicity_on_held_out_labels(spark):
    score, y, predicted = held_out_scores(spark, queries.op5_toxicity, "toxic")
    # a few hundred toxic documents to learn from; with a few thousand the area is above 0.999
    assert auc(score, y) > 0.93
    assert predicted[y == 1].mean() > 0.8 and predicted[y == 0].mean() < 0.06


def test_scores_of_odd_rows(spark):
    rows = [(1, "x"), (1, "x"), (None, None), (2, ""), (3, "word " * 100_000), (4, "\x00é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "body": F.lit("b"), "score": F.lit(3), "k": F.lit(0), "t": F.lit("t")})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        for module in (quality, toxicity):
            model = module.learn(docs, given, F.lit(True))
            got = module.score(docs, model).collect()
            assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 1, 2, 3, 4]
            assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
            assert module.score(docs.limit(0), model).count() == 0
    model = toxicity.learn(docs, labels.limit(0), F.lit(True))
    kept = toxicity.not_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_held_out_is_crc32_of_the_id(spark):
    got = {r[0]: r[1] for r in spark.range(50).select(F.col("id"), labelled.held_out("id", 3, 1)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        starts = quality.chunk_starts(n)
        seen = np.zeros(max(n, 1), bool)
        for s in starts:
            seen[s:s + quality.CHUNK] = True
        assert seen[:n].all() and (n <= quality.CHUNK or starts[-1] + quality.CHUNK == n)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    params = [rng.standard_normal(s).astype(np.float64) * 0.3 for s in ((256, quality.VECTOR), (quality.WIDTH * quality.VECTOR, quality.FILTERS), (quality.FILTERS,), (quality.FILTERS,), (quality.FILTERS,), (1,))]
    x, y = rng.integers(97, 105, (3, 2, quality.CHUNK)).astype(np.uint8), np.array([1.0, 0.0, 1.0])
    weight = np.ones(3)

    def loss():
        m = quality.Model(*params[:5], float(params[5][0]))
        z = quality._places(x.reshape(6, -1), m.vectors)
        top = np.maximum((z.reshape(-1, z.shape[2]) @ m.filters).reshape(6, z.shape[1], -1).max(axis=1) + m.bias, 0).reshape(3, 2, -1)
        p = labelled.sigmoid(top.mean(axis=1) @ m.mean_weight + top.max(axis=1) @ m.max_weight + m.constant)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for p, g in zip(params, quality._gradients(params, x, y, weight)):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape) if p.shape[0] != 256 else (int(rng.integers(97, 105)), int(rng.integers(0, quality.VECTOR)))
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert (up - down) / 2e-5 == pytest.approx(float(g[at]), abs=2e-4)


def test_windows_cover_every_byte_and_find_a_word():
    rng = random.Random(8)
    noise = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    prose = lambda n: " ".join(noise() for _ in range(n))
    rows = [(prose(80) + (f" {noise()} scumbag {noise()} vileword {noise()}" if i % 2 else ""), i % 2) for i in range(240)]
    model = toxicity.fit(rows, {0: 120, 1: 120})
    w = toxicity.Windows(model.ordinary, model.toxic)
    assert b" scumbag " in model.toxic and b" vileword " in model.toxic
    plain = prose(70)
    clean = w.features(plain)
    for at in range(0, 400, 7):
        found = w.features(plain[:at] + " scumbag " + plain[at:])
        assert found[3] == 1 and found[4] > clean[4]


# ---------------------------------------------------------------- scores by plain loops
def plain_quality(model, data):
    """The network read straight from its description: every byte, place, filter and chunk in loops."""
    size, hop, width, stride = quality.CHUNK, quality.HOP, quality.WIDTH, quality.STRIDE
    data = data + b" " * (size - len(data))
    starts, at = [], 0
    while at + size < len(data):
        starts.append(at)
        at += hop
    starts.append(len(data) - size)
    pooled = []
    for s in sorted(set(starts)):
        tops = [-math.inf] * quality.FILTERS
        for place in range(s, s + size - width + 1, stride):
            for f in range(quality.FILTERS):
                z = sum(float(model.vectors[data[place + j]] @ model.filters[j * quality.VECTOR:(j + 1) * quality.VECTOR, f]) for j in range(width))
                tops[f] = max(tops[f], z)
        pooled.append([max(0.0, t + float(b)) for t, b in zip(tops, model.bias)])
    mean = [sum(c[f] for c in pooled) / len(pooled) for f in range(quality.FILTERS)]
    high = [max(c[f] for c in pooled) for f in range(quality.FILTERS)]
    z = sum(a * float(w) for a, w in zip(mean, model.mean_weight)) + sum(a * float(w) for a, w in zip(high, model.max_weight)) + model.constant
    return 1 / (1 + math.exp(-z))


def test_quality_scores_by_plain_loops(spark):
    rng = np.random.default_rng(4)
    f32 = lambda *shape: rng.standard_normal(shape).astype(np.float32) * 0.4
    model = quality.Model(f32(256, quality.VECTOR), f32(quality.WIDTH * quality.VECTOR, quality.FILTERS), f32(quality.FILTERS), f32(quality.FILTERS), f32(quality.FILTERS), 0.2)
    texts = [None, "", "short", "x" * 256, "é" * 130, "word and word " * 40, "\x00 odd \U0001f600" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score(docs, model).collect():
        want = plain_quality(model, (texts[r["doc_id"]] or "").encode())
        assert r["score"] == pytest.approx(want, abs=1e-5) and r["predicted"] == (want >= 0.5)


def plain_toxicity(model, text):
    """The features by plain loops, each compression by a compressor of its own."""
    import zstandard as zs

    end = b"\x00" + toxicity.PAD * 2

    def size(content, data):
        how = zs.ZstdCompressionParameters(window_log=max(17, (len(content) + toxicity.WINDOW).bit_length() + 1), chain_log=15, hash_log=15, search_log=4, min_match=4, target_length=32,
                                           strategy=zs.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0, write_checksum=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
        return len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how).compress(data))

    data = b" " + (text or "").lower().encode() + b" "
    windows, at = [], 0
    while True:
        windows.append(data[at:at + toxicity.WINDOW])
        at += toxicity.STEP
        if at >= len(data) - (toxicity.WINDOW - toxicity.STEP):
            break
    gains, words = [], set()
    for w in windows:
        gain = size(model.ordinary + end, w + toxicity.PAD) - size(model.toxic + model.ordinary + end, w + toxicity.PAD)
        if gain >= toxicity.GAIN:
            gains.append(gain)
            words |= set(re.findall(rb"[a-z\x80-\xff]+", w))
    least = min((size(model.ordinary + model.toxic + end, b" " + w + b" " + toxicity.PAD) for w in model.toxic.split()), default=0)
    found, whole = [0, 0, 0], 0
    for w in words:
        if len(w) < toxicity.WINDOW:
            alone = size(model.ordinary + end, b" " + w + b" " + toxicity.PAD)
            gain = alone - size(model.ordinary + model.toxic + end, b" " + w + b" " + toxicity.PAD)
            found.append(max(0, gain))
            whole += gain >= max(2, toxicity.WHOLE * (alone - least))
    found.sort(reverse=True)
    x = [max(gains, default=0), found[0], sum(found[:3]), whole > 0, math.log1p(whole), math.log1p(len(gains))]
    return 1 / (1 + math.exp(-sum(float(a) * b for a, b in zip(x, model.weights)) - model.weights[-1]))


def test_toxicity_scores_by_plain_loops(spark):
    rng = random.Random(8)
    noise = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = [(" ".join(noise() for _ in range(60)) + (f" scumbag {noise()} vileword" if i % 2 else ""), i % 2) for i in range(240)]
    model = toxicity.fit(rows, {0: 120, 1: 120})
    texts = [None, "", "scumbag", rows[0][0], rows[1][0] * 4, "VileWord, é " * 30, "x" * 500] + [t for t, _ in rows[40:52]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        assert r["score"] == pytest.approx(plain_toxicity(model, texts[r["doc_id"]]), abs=1e-9), texts[r["doc_id"]]


# ---------------------------------------------------------------- chat formatting
def by_hand(turns, speaker, opening=None):
    out, mask = "" if opening is None else f"<|im_start|>system\n{opening}<|im_end|>\n", []
    for _, who, text in sorted(turns):
        tag = "assistant" if who == speaker else "system" if who == "system" else "user name=" + (who or "unknown")
        head = f"<|im_start|>{tag}\n"
        if who == speaker:
            mask.append((len(out) + len(head), len(out) + len(head) + len(text) + len("<|im_end|>")))
        out += head + text + "<|im_end|>\n"
    return out, mask


def test_every_participant_gets_a_view(spark):
    rng = random.Random(2)
    turns = [(k, who, f"téxt 😀 {rng.random()}") for k, who in enumerate(["ann", "system", *rng.choices(["ann", "bob", "", "system"], k=398)])]
    rows = [(7, k, who or None, text) for k, who, text in turns] * 2  # repeated rows count once
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "perspective", "m", "piece", "r", "conv", "n", "pieces")})
    got = chat_format.perspectives(df).collect()
    assert {(r["perspective"], r["part"], r["piece"]) for r in got} == {(s, p, 0) for s in ("ann", "bob", "") for p in range(4)}
    for r in got:  # 400 turns: the rules stand at the head of every later part
        text, mask = by_hand([t for t in turns if t[0] // 128 == r["part"]], r["perspective"], turns[1][2] if r["part"] else None)
        assert r["rendered"] == text and [tuple(m) for m in r["mask"]] == mask
    assert sum(r["n_turns"] for r in got) == 3 * len(turns)


def test_crowded_turns_are_dealt_to_pieces(spark):
    turns = [(5, f"s{i % 3}", f"text {i}") for i in range(900)] + [(k, "s0", f"turn {k}") for k in (4, 6)] + [(300, "s1", "far away"), (9, "system", "rules")]
    df = spark.createDataFrame([(1, *t) for t in turns], "conv_id long, turn long, role string, text string")
    got = chat_format.perspectives(df, part_turns=16).collect()
    mine = [r for r in got if r["perspective"] == "s0"]
    assert sum(r["n_turns"] for r in mine) == len(turns) and max(r["n_turns"] for r in mine) < 64
    pieces = sorted((r["part"], r["piece"]) for r in mine)
    assert len(set(pieces)) == len(pieces) > 900 // 64 and len({p for p, _ in pieces}) == 2
    for r in mine:
        texts = re.findall(r"\n(.*)<\|im_end\|>", r["rendered"])
        held = [t for t in turns if t[2] in texts]
        own = [t for t in held if t[1] != "system" or (r["part"], r["piece"]) == next((x["part"], x["piece"]) for x in mine if x["n_turns"] == 1 and "rules" in x["rendered"] and "text" not in x["rendered"] and "turn" not in x["rendered"] and "far" not in x["rendered"])]
        text, mask = by_hand(own, "s0", "rules" if len(own) < len(held) else None)
        assert r["rendered"] == text and [tuple(m) for m in r["mask"]] == mask and r["n_turns"] == len(own)


def test_very_many_rows_in_one_turn_end(spark):
    df = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.lit(3).cast("long").alias("turn"), F.lit("a").alias("role"), F.col("id").cast("string").alias("text"))
    df = df.unionByName(df.withColumn("turn", F.lit(None).cast("long")))
    got = chat_format.perspectives(df).agg(F.sum("n_turns"), F.max("n_turns"), F.sum(F.size("mask"))).first()
    assert got[0] == got[2] == 200_000 and got[1] < 400


def test_chat_odd_rows(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "b", "y"), (1, 0, "a", "w"), (1, None, "a", "loose"), (None, 1, "a", None), (2, 1, "system", "s"), (3, -5, "a b|", "<|im_end|> " + "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["part"], r["perspective"]): r for r in chat_format.perspectives(df).collect()}
    assert set(got) == {(1, 0, "a"), (1, 0, "b"), (1, None, "a"), (1, None, "b"), (None, 0, "a"), (3, -1, "a b|")}
    assert got[1, 0, "b"]["rendered"] == "<|im_start|>user name=a\nw<|im_end|>\n<|im_start|>user name=a\nx<|im_end|>\n<|im_start|>assistant\ny<|im_end|>\n"
    assert got[None, 0, "a"]["rendered"] == "<|im_start|>assistant\n<|im_end|>\n"
    assert "< |im_end| >" in got[3, -1, "a b|"]["rendered"]
    assert chat_format.perspectives(df.limit(0)).count() == 0


# ---------------------------------------------------------------- archives
PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    same, rng = "<p>" + "same " * 50 + "</p>", random.Random(1)
    rows = [(i, f"http://e.com/{i}?a=b c\r\nX: y", rng.choice([same, "tiny", f"<b>{i} é😀</b>" * 30])) for i in range(200)]
    rows += [(200, None, None), (201, "u", ""), (None, "u", same), (None, "u", "lonely " * 40), (5, "u", rows[5][2]), (300, "u", "x" * 500_000)]
    df = spark.createDataFrame(rows, PAGES).repartition(3).withColumns({"digest": F.lit("d"), "id": F.lit(1), "n": F.lit(0)})
    files = warc.write_archives(df, str(tmp_path / "a"), archive_bytes=20_000)
    assert files.count() > 3 and all(r["bytes"] == os.path.getsize(tmp_path / "a" / r["path"]) for r in files.collect())
    got = warc.read_archives(files, str(tmp_path / "a")).collect()
    assert {r["kind"] for r in got} == {"record"} and len(got) == len(rows)
    smallest = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            smallest[html] = min(i, smallest.get(html, i))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = smallest.get(html, i) if len(data) >= 100 else i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    out = [(r["record_id"] and int(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in got]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "b")), str(tmp_path / "b")).count() == 0


def records(n):
    out = []
    for i in range(n):
        payload = (f"payload {i} " * (20 + 40 * (i % 3))).encode()
        out.append(warc.encode_record(str(i), "http://x/", payload, hashlib.sha256(payload).hexdigest(), None))
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 64)  # marks lie across pieces
    parts = [warc.member(r) if packed else r for r in records(40)]
    rng = random.Random(9)
    for trial in range(40):
        bad = sorted(rng.sample(range(40), rng.randint(0, 4)))
        data, spoilt = [], []
        for i, p in enumerate(parts):
            if i in bad:
                how = rng.choice(["flip", "cut", "junk"])
                if how == "flip":
                    k = rng.randrange(0 if packed else 12, len(p) - (8 if packed else 5))
                    p = p[:k] + bytes([p[k] ^ 0x55]) + p[k + 1:]
                elif how == "cut":
                    p = p[:rng.randrange(1, len(p) - 1)]
                else:
                    p = b"\x1f\x8b\x08WARC/1.1\r\njunk" * rng.randint(1, 5) + p
                    spoilt.append(("junk", i))
            data.append(p)
        whole = b"".join(data)
        rows = list(warc.salvage(Source(whole), "f"))
        found = [int(r[6]) for r in rows if r[3] == "record"]
        assert found == sorted(found)
        assert set(range(40)) - set(found) <= set(bad)  # all undamaged records are recovered
        spans = sorted((r[1], r[2]) for r in rows)
        assert not spans or spans[0][0] == 0 and spans[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(r[4] for r in rows if r[3] == "gap") and (bool(bad) or len(rows) == 40)


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_salvage_reports_what_failed():
    good = records(3)
    flipped = good[1].replace(b"payload 1", b"payl0ad 1", 1)
    rows = list(warc.salvage(Source(warc.member(good[0]) + warc.member(flipped) + gzip.compress(b"no record") + warc.member(good[2]) + b"tail"), "f"))
    assert [(r[3], r[4]) for r in rows] == [("record", None), ("gap", "block digest"), ("record", None), ("gap", "no member or version line")]
    assert json.dumps(rows[1][:5])
    assert list(warc.salvage(Source(b""), "f")) == []


@have_data
@pytest.mark.parametrize("name", ["op3_chat_format", "op4_warc"])
def test_scale_columns(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(f"SELECT count(*) FROM ({queries.ORACLE_SQL[name]})").fetchall()[0][0]
    assert queries.QUERIES[name](spark, SF).count() == want > 100


# ---------------------------------------------------------------- archives by other writers
def foreign(i, payload=None, block=None, payload_digest=None, kind="response", head=b"HTTP/1.1 200 OK\r\n\r\n", version=b"WARC/1.0"):
    payload = f"<p>page {i}</p>".encode() * 5 if payload is None else payload
    body = head + payload
    sha1 = lambda d: "sha1:" + base64.b32encode(hashlib.sha1(d).digest()).decode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{i}>", "WARC-Target-URI": f"http://x/{i}", "Content-Type": "application/http; msgtype=response",
              "WARC-Block-Digest": sha1(body) if block is None else block, "WARC-Payload-Digest": sha1(payload) if payload_digest is None else payload_digest, "Content-Length": len(body)}
    return version + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def read(data):
    return [(r[3], r[6], r[4], r[11]) for r in warc.salvage(Source(data), "f")]


def test_digests_of_other_writers():
    data, p = b"", b"payload"
    hexes = {a: f"{a}:{hashlib.new(a.replace('-', ''), p).hexdigest()}" for a in ("md5", "sha1", "sha-256", "sha512")}
    for i, stated in enumerate([None, *hexes.values(), "SHA1:" + base64.b32encode(hashlib.sha1(p).digest()).decode().lower()]):
        data += warc.member(foreign(i, p, payload_digest=stated))
    assert [(k, n) for k, _, n, _ in read(data)] == [("record", None)] * 6
    assert [(k, n) for k, _, n, _ in read(warc.member(foreign(1, p, payload_digest="crc32c:00"))) ] == [("record", "payload digest not checked: crc32c")]
    for wrong in ("sha1:" + "A" * 32, "sha1:xyz", "md5:" + "0" * 32):
        assert [(k, n) for k, _, n, _ in read(warc.member(foreign(1, p, payload_digest=wrong)))] == [("gap", "payload digest")]
        assert [(k, n) for k, _, n, _ in read(warc.member(foreign(1, p, block=wrong)))] == [("gap", "block digest")]


def test_chunked_bodies_with_either_digest():
    plain, chunked = b"hello world", b"5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    for d in (plain, chunked):
        got = read(warc.member(foreign(1, chunked, head=head, payload_digest="sha1:" + hashlib.sha1(d).hexdigest())))
        assert [k for k, *_ in got] == ["record"] and got[0][3] == chunked


@pytest.mark.parametrize("piece", [64, 1 << 18])
def test_members_with_several_records(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    records = [foreign(i) for i in range(30)]
    one = warc.member(b"".join(records[:20])) + warc.member(records[20]) + records[21] + warc.member(b"".join(records[22:]))
    got = list(warc.salvage(Source(one), "f"))
    assert [r[6] for r in got] == [f"urn:uuid:{i}" for i in range(30)] and {r[3] for r in got} == {"record"}
    assert sum(r[2] is not None for r in got) == 4 and got[-1][2] == len(one)
    # a member that breaks off: its proven records stay, the rest is a gap, the next member is found
    packed = warc.member(b"".join(records[:20]), 0)  # stored, so that the cut lies behind some records
    cut = packed[:len(packed) * 3 // 4]
    got = list(warc.salvage(Source(cut + warc.member(records[25])), "f"))
    kept = [r for r in got if r[3] == "record"]
    gaps = [r for r in got if r[3] == "gap"]
    assert [r[6] for r in kept[:-1]] == [f"urn:uuid:{i}" for i in range(len(kept) - 1)] and len(kept) > 10
    assert kept[-1][6] == "urn:uuid:25" and len(gaps) == 1 and f"after {len(kept) - 1} records" in gaps[0][4]
    assert (gaps[0][1], gaps[0][2]) == (0, len(cut))


def test_a_wrong_checksum_spoils_only_what_it_covers():
    records = [foreign(i) for i in range(3)]
    single = bytearray(warc.member(records[0]))
    single[-6] ^= 1
    assert [r[3] for r in warc.salvage(Source(bytes(single) + warc.member(records[1])), "f")] == ["gap", "record"]
