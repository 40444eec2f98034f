import random

from pyspark.sql import functions as F

from loglens.functions.text import strip_chars
from loglens.operators import routing
from loglens.sources import taxonomy


def test_reason_strip_matches_python(spark):
    rnd = random.Random(1)
    vals = ["".join(rnd.choice(" |ab") for _ in range(rnd.randint(0, 8))) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(strip_chars(F.col("s"), " |")).collect()]
    assert got == [v.strip(" |") for v in vals]


def test_governance(spark):
    rows = [
        (1, "D01", "I03", "semantic", "nothing here"),
        (2, "D01", "I03", "llm_classify", "nothing"),
        (3, "D01", "I03", "semantic", "money LAUNDERING plan"),
        (4, "D09", "I09", "unclassified", "talk off the record"),
    ]
    df = spark.createDataFrame(rows, "session_id long, predicted_domain string, predicted_intent string, label_source string, combined_prompt string")
    m = spark.createDataFrame([("D01", "I03", "HIGH", "pair reason")], "domain string, intent string, level string, reason string")
    got = {r.session_id: (r.governance_flag, r.governance_reason) for r in routing.apply_governance(df, m).collect()}
    assert got[1] == ("HIGH", "pair reason")
    assert got[2] == ("NONE", "")
    assert got[3] == ("HIGH", "pair reason | suspicious keyword detected: 'launder'")
    assert got[4] == ("HIGH", "suspicious keyword detected: 'off the record'")


def test_route_thresholds_use_rounded_value(spark):
    df = spark.createDataFrame([(0.75,), (0.7499,), (0.5,), (0.4999,)], "combined_confidence double")
    got = [r.label_source for r in routing.route_confidence(df).collect()]
    assert got == ["semantic", "llm_classify", "llm_classify", "unclassified"]


def test_sinks_and_write(spark, tmp_path):
    rows = [(1, "HIGH", "llm_classify"), (2, "NONE", "semantic"), (3, "MEDIUM", "unclassified")]
    df = spark.createDataFrame(rows, "session_id long, governance_flag string, label_source string")
    got = sorted((r.sink, r.session_id) for r in routing.route_outputs(df).collect())
    assert got == [("classification_logs", 1), ("classification_logs", 2), ("classification_logs", 3),
                   ("governance_alerts", 1), ("governance_monitoring", 3), ("llm_classify_queue", 1), ("unclassified", 3)]
    target = routing.write_outputs(df, str(tmp_path), "20260101_000000", columns=["session_id", "governance_flag", "label_source"])
    back = spark.read.option("header", True).csv(target)
    assert back.count() == 7 and {r.sink for r in back.select("sink").distinct().collect()} == {x for x, _ in got}


def test_taxonomy_file_and_matrix(spark, tmp_path):
    import json

    doc = {
        "domains": [{"code": "D01", "name": "A", "definition": "def a", "keywords": ["k1", "k2"], "phrases": ["p1"]},
                    {"code": "D02", "name": "B", "definition": "def b", "keywords": ["k3"], "phrases": ["p2", "p3"]}],
        "intents": [{"code": "I01", "name": "C", "definition": "def c", "keywords": ["k4"], "phrases": ["p4"]}],
        "governance_flag_matrix": {
            "high_risk": [{"domain": "D01", "intent": "I01", "reason": "h1"}, {"domain": "D02", "intent": "I01", "reason": "h2"}],
            "medium_risk": [{"domain": "D01", "intent": "I01", "reason": "m1"}]},
    }
    path = tmp_path / "tax.json"
    path.write_text(json.dumps(doc, indent=2))
    tax = taxonomy.read_taxonomy(spark, str(path))
    protos = taxonomy.flatten_taxonomy(tax).collect()
    assert len(protos) == 3 + 3 + 3 + 2
    assert {(r.code, r.ord) for r in protos} == {("D01", 0), ("D02", 1), ("I01", 0)}
    m = {(r.domain, r.intent): (r.level, r.reason) for r in taxonomy.governance_matrix(tax).collect()}
    assert m == {("D01", "I01"): ("MEDIUM", "m1"), ("D02", "I01"): ("HIGH", "h2")}
