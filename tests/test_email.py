from pyspark.sql import functions as F

from loglens.operators import email

CHAIN = [
    "From: billing@firm.test\nTo: partner@other.test\nDate: 10 Jan 2026 09:15 AM\nSubject: Settlement\n\n"
    "We confirm the open amount.\nPayment follows by 15 Jan 2026.\n",
    "From: partner@other.test\nDate: 16 Jan 2026\nSubject: Late payment\n\nFunds have not arrived.\n",
]


def _rows(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "email_id long, body string")
    return email.extract_headers(df, **kw).orderBy("email_id", "block_no").collect()


def test_sample_chain(spark):
    r = _rows(spark, CHAIN)
    assert len(r) == 2
    assert r[0]["from"] == "billing@firm.test" and r[0]["sent"] is None
    assert r[0]["to"] == ["partner@other.test"] and r[0]["cc"] == [] and r[0]["subject"] == "Settlement"
    assert r[1]["to"] == []  # no To line


def test_quirks(spark):
    texts = [
        "From: a\nTo: b; c\nCc:\nSubject: hi\n\nbody",                 # empty Cc takes the next line
        "From: a\nReply-To: x@y\nSubject: s",                           # To: is not anchored
        "From: a &amp; b\r\nSent: now\r\nSubject: crlf\r\n\r\nbody",    # CRLF and entities
        "From: a\nSubject: one\nFrom: b\nSubject: two",                 # next From ends a block
    ]
    r = _rows(spark, texts)
    assert r[0]["to"] == ["b", " c"] and r[0]["cc"] == ["Subject: hi"]
    assert r[1]["to"] == ["x@y"]
    assert r[2]["from"] == "a & b" and r[2]["sent"] == "now" and r[2]["subject"] == "crlf"
    assert [x["subject"] for x in r[3:]] == ["one", "two"]
    fixed = _rows(spark, texts[:1], single_line=True, trim_items=True)
    assert fixed[0]["cc"] == [""] and fixed[0]["to"] == ["b", "c"]


def test_entities_full_table(spark):
    df = spark.createDataFrame([("&eacute;&copy;&#39;&lt;",)], "t string")
    assert df.select(email.html_unescape(F.col("t"))).first()[0] == "é©'<"
