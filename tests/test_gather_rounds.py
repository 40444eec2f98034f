"""Ordered gathering in pieces, and the fold in rounds: against plain gathering and the per-thread fold; resuming."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loglens.operators import completion, gather, rounds, threads


def rows_with_a_hot_key(n=900):
    rng = random.Random(7)
    rows = [("hot", i, f"t{i}") for i in range(n // 3)] + [("same", 5, f"s{i % 40}") for i in range(n // 3)]
    rows += [(rng.choice(["a", "b", "c", None]), rng.randrange(50), f"x{rng.randrange(30)}") for _ in range(n // 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece_rows", [1, 7, 50, 10_000])
def test_pieces_are_the_items_in_order(spark, piece_rows):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame(rows, "k string, o int, t string").withColumns({"key": F.lit(1), "piece": F.lit(2), "item": F.lit(3), "h": F.lit(4)})
    pieces = gather.ordered_pieces(df, "k", ["o"], F.col("t"), piece_rows).collect()
    assert all(0 < len(p["items"]) <= max(piece_rows, 0) for p in pieces)
    for key in {k for k, _, _ in rows}:
        mine = sorted((p for p in pieces if p["k"] == key), key=lambda p: p["piece"])
        assert [p["piece"] for p in mine] == list(range(len(mine))) and {p["of"] for p in mine} == {len(mine)}
        items = [x for p in mine for x in p["items"]]
        order = {t: set() for _, _, t in rows}
        for k, o, t in rows:
            if k == key:
                order[t].add(o)
        assert sorted(items) == sorted(t for k, _, t in rows if k == key)
        if key == "hot":
            assert items == [f"t{i}" for i in range(len(items))]


def test_a_hot_key_is_gathered_by_several_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    pieces = gather.ordered_pieces(df, "k", ["o"], F.col("o"), 500)
    assert pieces.select("piece").distinct().count() >= 8
    whole = gather.gathered(pieces, "k", {"items": "list"}).collect()
    assert len(whole) == 1 and whole[0]["items"] == list(range(4000))


def test_empty_table_has_no_pieces(spark):
    df = spark.createDataFrame([], "k string, o int, t string")
    assert gather.ordered_pieces(df, "k", ["o"], F.col("t"), 3).count() == 0
    assert gather.gathered(gather.ordered_pieces(df, "k", ["o"], F.col("t"), 3), "k", {"items": "list"}).count() == 0


OUTPUTS = [("a", 1, '{"deadlines": ["d1"], "summary_update": "u1"}'), ("a", 2, "no"), ("a", 3, '{"deadlines": ["d3", "d4"]}'), ("b", 1, ""), (None, 2, '{"summary_update": "n"}')]


@pytest.mark.parametrize("piece_rows", [1, 2, 100])
def test_split_findings_equal_plain_ones(spark, piece_rows):
    df = spark.createDataFrame(OUTPUTS, "thread_id string, email_no int, out string")
    plain = sorted(map(str, threads.thread_findings(df).collect()))
    split = threads.joined_findings(threads.thread_finding_pieces(df, piece_rows=piece_rows))
    assert sorted(map(str, split.select(*threads.thread_findings(df).columns).collect())) == plain


def test_split_chat_equals_plain_one(spark):
    rows = [(c, t, r, x) for c in (1, 2) for t, r, x in [(3, "user", "c"), (1, "system", "a"), (2, "user", None), (4, "assistant", "d")]]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    plain = {r["conv_id"]: (r["messages"], r["p"]) for r in completion.chat_transcript(df).withColumn("p", completion.render_chat(F.col("messages"))).collect()}
    for n in (1, 2, 9):
        split = completion.joined_chat(completion.chat_pieces(df, piece_rows=n)).collect()
        assert {r["conv_id"]: (r["messages"], r["prompt"]) for r in split} == plain


# ---------------------------------------------------------------- rounds
def mails(spark):
    rng = random.Random(3)
    rows = [(t, i, f"mail {t} {i} " + "x" * rng.randrange(40)) for t, n in (("a", 23), ("b", 1), ("c", 9), (None, 4)) for i in range(1, n + 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "thread_id string, email_no int, body string").repartition(3)


@pytest.mark.parametrize("per_round, piece_rows, together", [(1, 100, 64), (4, 5, 2), (4, 6, 64), (50, 100, 1), (3, 2, 64)])
def test_rounds_equal_the_per_thread_fold(spark, tmp_path, per_round, piece_rows, together):
    df = mails(spark)
    for flavour, fn in (("summary", threads.prompt_length_completion), ("findings", rounds.digest_finding)):
        got = rounds.fold_in_rounds(df, f"{tmp_path}/{flavour}", fn=fn, flavour=flavour, per_round=per_round, piece_rows=piece_rows, together=together).collect()
        want = threads.fold_threads(df, fn=fn, flavour=flavour).collect()
        key = lambda r: (str(r["thread_id"]), r["email_no"])
        assert [(key(r), r["output"], r["ok"], r["error"]) for r in sorted(got, key=key)] == [(key(r), r["output"], r["ok"], r["error"]) for r in sorted(want, key=key)]
        last = {str(r["thread_id"]): r["summary"] for r in sorted(want, key=key)}
        assert {str(r["thread_id"]): r["summary"] for r in rounds.final_states(spark, f"{tmp_path}/{flavour}").collect()} == last


def test_reports_hold_all_findings(spark, tmp_path):
    df = mails(spark)
    steps = rounds.fold_in_rounds(df, str(tmp_path / "r"), fn=rounds.digest_finding, flavour="findings", per_round=4)
    got = {r["thread_id"]: r for r in rounds.fold_reports(spark, str(tmp_path / "r"), steps, piece_rows=3).collect()}
    want = {r["thread_id"]: r for r in threads.fold_reports(threads.fold_threads(df, fn=rounds.digest_finding, flavour="findings")).collect()}
    assert got.keys() == want.keys()
    for t in want:
        assert got[t]["summary"] == want[t]["summary"] and got[t]["conclusion"] == want[t]["conclusion"] and got[t]["report_prompt"] == want[t]["report_prompt"]


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    df, folder, calls, stop = mails(spark), str(tmp_path / "run"), str(tmp_path / "calls"), str(tmp_path / "stop")
    os.makedirs(calls)

    def batches():
        def answer(prompts):
            import uuid

            for p in prompts:
                if os.path.exists(stop) and "mail a 14" in p:
                    raise RuntimeError("killed")
                with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
                    f.write(p)
            return [threads.prompt_length_completion(p) for p in prompts]

        return answer

    open(stop, "w").close()
    with pytest.raises(Exception, match="killed"):
        rounds.fold_in_rounds(df, folder, batch_factory=batches, per_round=4)
    assert rounds.complete_folder(spark, f"{folder}/rounds/round=2") and not rounds.complete_folder(spark, f"{folder}/rounds/round=3")
    os.unlink(stop)
    before = len(os.listdir(calls))
    got = rounds.fold_in_rounds(df, folder, batch_factory=batches, per_round=4).collect()
    # the resumed run answers the mails of the rounds that were not finished, and no others
    left = sum(max(0, n - 12) for n in (23, 1, 9, 4))
    assert len(os.listdir(calls)) - before == left
    want = threads.fold_threads(df, fn=threads.prompt_length_completion).collect()
    assert sorted((str(r["thread_id"]), r["email_no"], r["output"]) for r in got) == sorted((str(r["thread_id"]), r["email_no"], r["output"]) for r in want)
    again = len(os.listdir(calls))
    assert rounds.fold_in_rounds(df, folder, batch_factory=batches, per_round=4).count() == 37 and len(os.listdir(calls)) == again


def test_rounds_of_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, None), (1, None, "x"), (2, 1, ""), (2, 1, "")], "thread_id int, email_no int, body string")
    got = rounds.fold_in_rounds(df, str(tmp_path / "odd"), per_round=1).collect()
    assert sorted((r["thread_id"], str(r["email_no"])) for r in got) == [(1, "1"), (1, "None"), (2, "1"), (2, "1")]
    assert rounds.fold_in_rounds(df.limit(0), str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        rounds.fold_in_rounds(df, str(tmp_path / "bad"), flavour="poem")
