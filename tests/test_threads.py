import json

from loglens.operators import threads

OUTS = [
    (1, 1, json.dumps({"new_commitments": ["pay"], "deadlines": ["d1"], "summary_update": "first"})),
    (1, 2, json.dumps({"monetary_mentions": ["100"], "legal_triggers": ["breach"]})),   # missing keys
    (1, 3, json.dumps({"deadlines": None, "summary_update": "third"})),                 # null list
    (1, 4, json.dumps({"deadlines": "not a list"})),                                    # wrong type
    (1, 5, "not json"),
    (1, 6, ""),
    (1, 7, None),
    (1, 8, json.dumps([1, 2])),
    (2, 1, "garbage"),
]


# outputs and what they mean (None: unusable), for all three paths
MEANINGS = [
    ('{"deadlines": ["x"]}', ["x"]), (' {"deadlines": ["x"]}\n', ["x"]), ('{"deadlines": []}', []), ('{}', []), ('{"deadlines": null}', []),
    ('{"deadlines": ["x", 1, 1.5, true, null, {"a": [1]}]}', ["x", "1", "1.5", "true", None, '{"a": [1]}']),
    ('{"deadlines": ["x"]} trailing words', None), ("{'deadlines':['x']}", None), ('{"deadlines": "x"}', None), ('{"deadlines": {"a": 1}}', None),
    ('{"deadlines": ["x"], "summary_update": 3}', None), ('[{"deadlines": ["x"]}]', None), ('"x"', None), ("", None), ("null", None), (None, None),
    ('{"deadlines": ["x"}', None), ('{"deadlines": ["x"]}{"deadlines": ["y"]}', None), ("[" * 100_000, None),
]


def test_one_meaning_in_batch_fold_and_stream(spark, tmp_path):
    import uuid

    from loglens.streaming import thread_state

    want = {k: v for k, (_, v) in enumerate(MEANINGS)}
    outs = spark.createDataFrame([(k, 1, t) for k, (t, _) in enumerate(MEANINGS)], "thread_id long, email_no int, out string")
    rejected = {r.thread_id for r in threads.finding_rejects(outs).collect()}
    batch = {r.thread_id: None if r.thread_id in rejected else list(r.deadlines) for r in threads.thread_findings(outs).collect()}
    assert batch == want
    answers = [t for t, _ in MEANINGS]
    mails = spark.createDataFrame([(k, 1, f"#{k}#") for k in range(len(MEANINGS))], "thread_id long, email_no int, body string")
    fold = threads.fold_threads(mails, fn=lambda p: answers[int(p.split("#")[-2])], flavour="findings").collect()
    assert {r.thread_id: json.loads(r.findings_json)["deadlines"] if r.ok else None for r in fold} == want
    outs.write.parquet(str(tmp_path / "src"))
    q = thread_state.start_thread_stream(spark, str(tmp_path / "src"), str(tmp_path / "out"), name=f"t_mean_{uuid.uuid4().hex}")
    q.awaitTermination(120)
    res = spark.read.parquet(str(tmp_path / "out"))
    late = {r.thread_id for r in res.where("kind = 'rejected'").collect()}
    assert {r.thread_id: None if r.thread_id in late else list(r.deadlines) for r in thread_state.gathered(res).collect()} == want


def test_review_threads_writes_steps_and_reports(spark, tmp_path):
    from loglens.plans import jobs

    mails = spark.createDataFrame([(1, 1, "a"), (1, 2, "bb"), (2, 5, "c")], "thread_id long, email_no int, body string")
    jobs.review_threads(mails, str(tmp_path))  # the default step
    steps = spark.read.parquet(str(tmp_path / "steps")).collect()
    reports = {r.thread_id: r for r in spark.read.parquet(str(tmp_path / "reports")).collect()}
    assert len(steps) == 3 and set(reports) == {1, 2}
    last = next(s for s in steps if (s.thread_id, s.email_no) == (1, 2))
    assert last.findings_json in reports[1].report_prompt and reports[1].conclusion.startswith("completion of ")
    jobs.review_threads(mails, str(tmp_path / "s"), flavour="summary")
    assert not (tmp_path / "s" / "reports").exists()


def test_findings_and_rejects(spark):
    df = spark.createDataFrame(OUTS, "thread_id long, email_no int, out string")
    f = {r.thread_id: r for r in threads.thread_findings(df).collect()}
    assert f[1].commitments == ["pay"] and f[1].monetary_mentions == ["100"]
    assert f[1].deadlines == ["d1"] and f[1].legal_triggers == ["breach"]
    assert f[1].summary == "\nfirst\n\nthird"
    assert f[2].commitments == [] and f[2].summary == ""
    rej = sorted((r.thread_id, r.email_no) for r in threads.finding_rejects(df).collect())
    assert rej == [(1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 1)]


def test_report_prompt_json_layout(spark):
    df = spark.createDataFrame(OUTS[:2], "thread_id long, email_no int, out string")
    p = threads.report_prompt(threads.thread_findings(df)).first().report_prompt
    expect = json.dumps({"commitments": ["pay"], "monetary_mentions": ["100"], "deadlines": ["d1"],
                         "legal_triggers": ["breach"], "escalation_flags": []}, indent=2)
    assert expect in p and p.startswith("<|system|>") and p.endswith("<|assistant|>")


def test_fold_findings_all_or_nothing(spark):
    answers = iter([])

    def model(prompt):
        if "mail-2" in prompt:
            return json.dumps({"deadlines": ["x"], "legal_triggers": "oops"})
        if "mail-3" in prompt:
            return "no json"
        return json.dumps({"deadlines": ["d"], "summary_update": "u"})

    del answers
    emails = spark.createDataFrame([(9, i, f"mail-{i}") for i in (3, 1, 2, 4)], "thread_id long, email_no int, body string")
    rows = sorted(threads.fold_threads(emails, fn=model, flavour="findings").collect(), key=lambda r: r.email_no)
    assert [r.ok for r in rows] == [True, False, False, True]
    assert json.loads(rows[-1].findings_json)["deadlines"] == ["d", "d"]
    assert rows[-1].summary == "\nu\nu"
    assert "Previous Investigation Summary:\n\nu\n" in rows[1].prompt


def test_fold_summary_state_flows(spark):
    emails = spark.createDataFrame([(1, 1, "a"), (1, 2, "bb"), (2, 1, "c")], "thread_id long, email_no int, body string")
    rows = {(r.thread_id, r.email_no): r for r in threads.fold_threads(emails, fn=threads.prompt_length_completion).collect()}
    assert "No prior summary." in rows[(1, 1)].prompt
    assert rows[(1, 1)].summary in rows[(1, 2)].prompt
    assert "No prior summary." in rows[(2, 1)].prompt
