import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeloom.functions import text as T
from noticeloom.functions.grouped import running_sum
from noticeloom.operators import dates, documents, rules, spans, summarize


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_clean_keeps_what_matters(spark):
    t = "GOVERNMENT\n\n\n\nDIN: 15-09-2026  mail a@b.in +91-9876543210 x​\nPage 1 of 3\n- 2 -\n"
    got = one(spark, T.clean(F.col("t")), t=t)
    assert got == "GOVERNMENT\n\nDIN: 15-09-2026 mail a@b.in +91-9876543210 x"
    assert one(spark, T.clean(F.col("t")), t="ﬁne ①") == "fine 1"
    assert one(spark, T.clean(F.col("t")), t=None) is None
    assert one(spark, T.clean(F.col("t")), t=" \n ") == ""


def test_title_case(spark):
    assert one(spark, T.title_case(F.col("t")), t="MINISTRY OF R&D, O'NEIL 3RD") == "Ministry Of R&D, O'Neil 3Rd"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n😀क", max_size=30), min_size=1, max_size=20))
def test_find_all_has_pythons_offsets(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    p = r"[^.!?\n]+[.!?\n]*"
    got = {r["i"]: [tuple(x) for x in r["x"]] for r in df.select("i", T.find_all("t", p).alias("x")).collect()}
    assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(p, t)] for i, t in enumerate(texts)}


def test_find_all_of_many_matches(spark):
    t = "ab, " * 5000
    got = one(spark, T.find_all("t", r"\w+"), t=t)
    assert [(x["start"], x["end"]) for x in got] == [(m.start(), m.end()) for m in re.finditer(r"\w+", t)]


def test_first_capture(spark):
    got = one(spark, T.first_capture("t", r"(?:DIN|NO\.)[:\s.-]+", r"[A-Z0-9/-]{5,}", "(?i)"), t="x😀 no. abc12/x and DIN: 99999")
    assert (got["start"], got["value"]) == (7, "abc12/x")
    assert one(spark, T.first_capture("t", "", "z+"), t="abc") is None


def test_running_sum_equals_a_plain_one(spark):
    rows = [("a", i, (i * 7) % 5) for i in range(0, 5000, 3)] + [("b", 1, None), ("b", 4, 2), (None, 0, 5), (None, 9, 1)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r["g"], r["o"]): r["s"] for r in running_sum(df, ["g"], "o", F.col("v"), "s", width=64).collect()}
    want, seen = {}, {}
    for g, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[g, o] = seen.get(g, 0)
        seen[g] = want[g, o] + (v or 0)
    assert got == want


def test_page_types(spark):
    rows = [(500, 0.9, True, False, False, "TEXT"), (500, 0.9, True, True, True, "MIXED"), (500, 0.9, False, False, False, "MIXED"), (500, 0.2, True, False, False, "SCANNED"), (5, 0.0, False, True, True, "SCANNED"), (0, 0.0, False, False, False, "SCANNED")]
    df = spark.createDataFrame(rows, "n int, q double, f boolean, i boolean, l boolean, want string")
    assert df.filter(documents.page_type(F.col("n"), F.col("q"), F.col("f"), F.col("i"), F.col("l")) != F.col("want")).count() == 0


def test_quality_of_texts(spark):
    q = lambda t: one(spark, documents.text_quality(F.col("t")), t=t)
    assert q(None) == 0.0 and q("") == 0.0 and q("short") == 0.0
    assert q("A plain and readable sentence.") == pytest.approx(0.9)
    assert q("☃☃☃☃☃☃ ☃☃☃☃☃☃☃ ☃☃☃☃☃☃") < 0.3


@pytest.mark.parametrize(
    "raw,base,want",
    [("within 15 days", "2026-09-01", "2026-09-16"), ("within 2 months", "2026-09-01", "2026-10-31"), ("before 20", "2026-09-01", "2026-09-15"), ("by 30/9/2026", "2026-09-01", "2026-09-30"),
     ("30th september 2026", "2026-09-01", "2026-09-30"), ("2026-10-15", "1 September 2026", "2026-10-15"), (None, "01-09-2026", "2026-09-15"), ("by 31/2/2026", "2026-09-01", "2026-09-15")],
)
def test_deadlines(spark, raw, base, want):
    df = spark.createDataFrame([(raw, base)], "r string, b string")
    got = df.select(rules.deadline(F.col("r"), rules.base_date(F.col("b"), F.lit("2026-01-01").cast("date"))).cast("string").alias("x")).first()["x"]
    assert got == want


def test_obligations(spark):
    t = "Notice\nYou must furnish the return within 15 days.\nPay a penalty of ₹ 50,000/- before 20-09-2026.\n\nNothing here"
    df = spark.createDataFrame([("d", t), ("e", None), ("f", "")], "document_id string, text string")
    got = {r["obligation_id"]: r for r in rules.obligations(df).collect()}
    assert list(sorted(got)) == ["OBL-01", "OBL-02"]
    assert got["OBL-01"]["priority"] == "HIGH" and got["OBL-01"]["raw_deadline"] == "within 15 days"
    assert got["OBL-02"]["penalty_amount"] == 50000.0 and got["OBL-02"]["raw_deadline"] == "before 20" and got["OBL-02"]["start"] == t.index("Pay")
    assert {r["document_id"] for r in rules.without_obligations(df, rules.obligations(df)).collect()} == {"e", "f"}


def test_metadata(spark):
    df = spark.createDataFrame([("a", "MINISTRY OF STEEL\nDATED: 01-09-2026 REF NO: ROC/12345 show cause"), ("b", "x" * 20)], "document_id string, text string")
    got = {r["document_id"]: r for r in rules.metadata(df, "2026-01-01").collect()}
    assert got["a"]["issuing_authority"].startswith("Registrar of Companies") and got["a"]["notice_date"] == "01-09-2026" and got["a"]["notice_type"] == "Show Cause Notice (SCN)"
    assert got["b"]["issuing_authority"] == rules.NO_AUTHORITY and got["b"]["notice_date"] == "2026-01-01" and got["b"]["act_rules_cited"] == [rules.NO_ACT]


def test_summary_picks_the_entities_sentences(spark):
    t = "First sentence is plain. Second one is dated 01-02-2026 here. Third has nothing. Fourth is the deadline for all. Fifth ends it."
    df = spark.createDataFrame([("d", t), ("e", ""), ("f", "Only one.")], "document_id string, text string")
    sc = summarize.score_sentences(summarize.sentences(df), dates.find_dates(df))
    got = {r["document_id"]: r for r in summarize.summary(sc, length="SHORT").collect()}
    assert "Second one is dated" in got["d"]["summary"] and got["d"]["picked"] == 2
    assert got["f"]["summary"] == "Only one." and got["f"]["confidence"] == 0.95 and "e" not in got


def test_sentences(spark):
    df = spark.createDataFrame([("d", "Hello world. This is a test! How are you?\nI am fine.")], "document_id string, text string")
    assert [r["sentence"] for r in summarize.sentences(df).orderBy("idx").collect()] == ["Hello world.", "This is a test!", "How are you?", "I am fine."]


def test_dates(spark):
    rows = [("a", "New Delhi, the 19th August, 2026"), ("b", "Last date for submission: 15th February, 2026."), ("c", "no date"), ("d", "दिनांक: 15 अगस्त, 2026"), ("e", "on 12/31/2026"), ("f", None)]
    df = spark.createDataFrame(rows, "document_id string, text string")
    got = {r["document_id"]: (r["type"], str(r["day"])) for r in dates.classify(dates.find_dates(df)).withColumn("day", dates.parse(F.col("value"))).collect()}
    assert got == {"a": ("ISSUE_DATE", "2026-08-19"), "b": ("DEADLINE", "2026-02-15"), "d": ("ISSUE_DATE", "2026-08-15"), "e": ("UNKNOWN_DATE", "2026-12-31")}


def test_evidence(spark):
    t = "Intro here. The Ministry of Steel issued it today. End."
    docs = spark.createDataFrame([("d", t)], "document_id string, text string")
    s = spark.createDataFrame([("d", "authority", 0.9, 16, 33, "x"), ("d", "bad", 0.9, 50, 900, "x"), ("d", "inv", 0.9, 5, 2, "x")], "document_id string, field string, score double, start int, end int, value string")
    got = {r["field"]: r for r in spans.evidence(s, docs).collect()}
    assert got["authority"]["value"] == "Ministry of Steel" and got["authority"]["evidence"] == "The Ministry of Steel issued it today."
    assert got["bad"]["span_status"] == got["inv"]["span_status"] == "LOW_CONFIDENCE" and got["bad"]["value"] is None and got["bad"]["score"] == 0.0


def test_confidence_and_decisions(spark):
    rows = [("title", 0.90, True, 0.95), ("title", 0.75, True, 0.875), ("authority", 0.88, True, 0.946), ("date", 0.92, True, 0.968), ("contact", 0.90, True, 0.965), ("notice_number", 0.90, False, 0.895)]
    df = spark.createDataFrame(rows, "f string, m double, ok boolean, want double")
    for r in df.withColumn("got", spans.confidence(F.col("f"), F.col("m"), F.lit(1.0), F.lit(True), F.lit(True), F.col("ok"))).collect():
        assert r["got"] == pytest.approx(r["want"])
    f = spark.createDataFrame([("title", "T", 0.9), ("title", "T", 0.6), ("title", None, 0.9)], "field string, value string, confidence double")
    assert sorted((r["decision"], r["value"]) for r in spans.abstain(f).collect() if r["value"]) == [("ACCEPT", "T")]
    assert sorted(r["decision"] for r in spans.abstain(f).collect()) == ["ABSTAIN", "ACCEPT", "NOT_FOUND"]


def test_consistency(spark):
    t = "Copy to: Ministry of Steel"
    rows = [("contact", "nobody", 0.15), ("contact", "a@b.in", 0.0), ("document", "x", 0.10), ("authority", "Acme", 0.10), ("authority", "Ministry of Steel", 0.15), ("title", None, 0.0)]
    df = spark.createDataFrame([(f, v, w, t) for f, v, w in rows], "f string, v string, want double, t string")
    for r in df.withColumn("got", spans.field_penalty(F.col("f"), F.col("v"), F.col("t"), F.lit(None).cast("int"), 2026)).collect():
        assert r["got"] == pytest.approx(r["want"]), r
    pen = spark.createDataFrame([("d", 0.2), ("d", 0.15)], "document_id string, penalty double")
    day = spark.createDataFrame([("d", "START_DATE", "2026-02-01"), ("d", "DEADLINE", "2026-01-01")], "document_id string, type string, day string")
    r = spans.document_consistency(pen, day).first()
    assert (r["conflicts"], r["inversions"], r["consistency"], r["consistent"]) == (0, 1, 0.45, False)
    twice = spark.createDataFrame([("d", "START_DATE", "2026-02-01"), ("d", "DEADLINE", "2026-01-01"), ("d", "END_DATE", "2026-01-01"), ("e", "ISSUE_DATE", "2026-01-01"), ("e", "DEADLINE", "2026-02-01"), ("f", "DEADLINE", "2026-02-01")], "document_id string, type string, day string")
    none = spark.createDataFrame([(k, 0.0) for k in "defg"], "document_id string, penalty double")
    got = {r["document_id"]: (r["conflicts"], r["inversions"], r["consistency"]) for r in spans.document_consistency(none, twice).collect()}
    assert got == {"d": (0, 2, 0.6), "e": (1, 0, 0.9), "f": (0, 0, 1.0), "g": (0, 0, 1.0)}


def test_merge_and_dates(spark):
    schema = "document_id string, field string, score double, start int, end int, value string"
    model = spark.createDataFrame([("d", "title", 0.5, 0, 5, "Short"), ("d", "contact", 0.9, 3, 20, "long enough value")], schema)
    found = spark.createDataFrame([("d", "title", 0.9, 0, 22, "A much longer title it"), ("d", "audience", 0.8, 1, 9, "everyone")], schema)
    got = {r["field"]: r["value"] for r in spans.merge(model, found).collect()}
    assert got == {"title": "A much longer title it", "contact": "long enough value", "audience": "everyone"}
    m = spark.createDataFrame([("d", 10, 20, 0.9, "a")], "document_id string, start int, end int, score double, value string")
    h = spark.createDataFrame([("d", 12, 22, 0.9, "b"), ("d", 40, 50, 0.9, "c"), ("d", 43, 53, 0.9, "e")], m.schema)
    assert sorted(r["start"] for r in spans.add_dates(m, h).collect()) == [10, 40]
