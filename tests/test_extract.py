import json

import pytest
from pyspark.sql import functions as F

from noticeloom import cli
from noticeloom.functions import text as T
from noticeloom.operators import annotate, dates, extract, ocr, spans, summarize
from noticeloom.sources import files

NOTICE = "NOTIFICATION on fees\nMinistry of Steel\nDated: 01-02-2031\nEligibility: all registered units. Contact help@steel.in now."


def test_every_replaced_code_point(spark):
    want = {"\u00a0": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\u00ad": "", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2010": "-", "\u2212": "\u2212"}
    df = spark.createDataFrame([(f"a{c}b", f"a{w}b") for c, w in want.items()], "t string, w string")
    assert df.filter(T.clean(F.col("t")) != F.col("w")).count() == 0


def test_lines_end_at_line_feeds(spark):
    rows = [("a\rb", "a\rb"), ("a \r\n b", "a\nb"), ("a\n\x0c\x0b\n\n b\t c ", "a\n\nb c"), (" \n", ""), ("x\n\u2003\ny", "x\n\ny")]
    df = spark.createDataFrame(rows, "t string, w string")
    assert [(r["t"], r["g"]) for r in df.select("t", T.normalise_whitespace(F.col("t")).alias("g")).collect()] == rows


def test_signature_order_and_quality(spark):
    z = spark.createDataFrame([("d", 1, 1, "Officer A", "body"), ("d", 1, 2, "seal", "footer"), ("d", 2, 1, "text", "body")], "document_id string, page_number int, line_no int, text string, zone string")
    got = {r["page_number"]: (r["detected"], r["signature"]) for r in ocr.signature(z).collect()}
    assert got == {1: (True, "seal\nOfficer A"), 2: (False, "")}
    pages = spark.createDataFrame([("d", 1, 0.9, 100, "GOOD", "en"), ("d", 2, 0.7, 50, "MODERATE", "hi"), ("d", 3, 0.3, 5, "POOR", "unknown")], "document_id string, page_number int, ocr_quality_score double, word_count int, quality_label string, language_detected string")
    r = ocr.document_quality(pages).first()
    assert (r["good_pages"], r["poor_pages"], r["languages"], r["bilingual"]) == (2, 1, ["en", "hi"], True)


def test_words_of_engines(spark):
    raw = [("d", 1, 0, 1, "one", 90.0), ("d", 1, 1, 1, "two", 120.0), ("d", 1, 2, 1, " ", 50.0), ("d", 1, 3, 1, "three", 40.0), ("d", 1, 4, 2, "four", 30.0), ("d", 1, 5, 2, "bad", -1.0)]
    df = spark.createDataFrame(raw, "document_id string, page_number int, ord int, line_num int, text string, confidence double").withColumns({"left": F.lit(1), "top": F.lit(2), "width": F.lit(3), "height": F.lit(4)})
    w = ocr.words_of_percent(df)
    r = ocr.text_of_lines(w).first()
    assert (r["text"], r["confidence"], r["word_count"]) == ("one two\nthree\nfour", 0.65, 4)
    first = w.orderBy("ord").first()
    assert [first[c] for c in ("x1", "y1", "x2", "y2")] == [1, 2, 4, 6]
    q = spark.createDataFrame([("d", 1, 0, "w", 0.98765, [[1.5, 2.0], [9.0, 1.0], [8.0, 7.9], [0.5, 6.0]])], "document_id string, page_number int, ord int, text string, confidence double, quad array<array<double>>")
    r = ocr.words_of_polygons(q).first()
    assert (r["confidence"], r["x1"], r["y1"], r["x2"], r["y2"]) == (0.9877, 0, 1, 9, 7)
    p = spark.createDataFrame([("a " * 30,), (None,)], "t string").select(ocr.text_page_quality(F.col("t")).alias("q")).collect()
    assert p[0]["q"]["word_count"] == 30 and p[0]["q"]["text_density"] == pytest.approx(0.02) and p[1]["q"]["word_count"] == 0 and p[0]["q"]["ocr_quality_score"] == 0.95


def test_dates_of_a_model(spark):
    df = spark.createDataFrame([("d", "Last date: 01-02-2031. Held on the first of May.")], "document_id string, text string")
    model = spark.createDataFrame([("d", 12, 22, 0.9), ("d", 31, 47, 0.8), ("d", 32, 47, 0.7)], "document_id string, start int, end int, score double")
    got = sorted((r["source"], r["start"], r["ner_score"], r["type"]) for r in dates.classify(dates.with_model(dates.find_dates(df), model, df)).collect())
    assert got == [("ner", 31, 0.8, "EVENT_DATE"), ("regex", 11, 0.0, "ISSUE_DATE")]


def test_summary_branches(spark):
    df = spark.createDataFrame([("d", "First one. The fee is Rs 5. More text. And more. Then it ends. Fin.", [(None, None, "fee", 3)])], "document_id string, text string, s array<struct<start:int,end:int,value:string,page_number:int>>")
    rows = {r["sentence_index"]: r for r in summarize.summaries(df, "s", length="SHORT", detail=True).collect()}
    assert rows[1]["page_number"] == 3 and rows[1]["entity_score"] == 2.0 + 3.0 + 1.0 and rows[0]["page_number"] == 1


def test_extraction(spark):
    docs = spark.createDataFrame([("d", NOTICE), ("n", None), ("b", " ")], "document_id string, text string")
    e = extract.extract(docs)
    f = {r["field"]: r for r in e.fields.collect()}
    assert f["title"]["value"] == "NOTIFICATION on fees" and f["title"]["decision"] == "ACCEPT" and f["authority"]["penalty"] == 0.0 and f["date"]["value"] == "01-02-2031"
    assert [(r["type"], str(r["day"])) for r in e.dates.collect()] == [("ISSUE_DATE", "2031-02-01")]
    d = e.documents.collect()
    assert [r["document_id"] for r in d] == ["d"] and d[0]["consistency_score"] == 1.0 and d[0]["warnings"] == []
    n = len(NOTICE)
    pages = spark.createDataFrame([("d", 1, 0, 20, 0.3), ("d", 2, 21, n, 0.4)], "document_id string, page_number int, start_offset int, end_offset int, ocr_quality_score double")
    words = spark.createDataFrame([("d", 1, 0, "NOTIFICATION", 0.5, 0, 0, 9, 9), ("d", 1, 1, "on", 0.7, 10, 0, 12, 9), ("d", 1, 2, "fees", 0.9, 13, 0, 20, 9)], "document_id string, page_number int, ord int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    e = extract.extract(docs, pages, words)
    f = {r["field"]: r for r in e.fields.collect()}
    assert f["title"]["page_number"] == 1 and f["title"]["c_ocr"] == pytest.approx(0.7) and (f["title"]["x1"], f["title"]["x2"]) == (0, 20) and f["authority"]["c_ocr"] == 0.4 and f["authority"]["page_number"] == 2
    assert e.documents.first()["warnings"][0].startswith("OCR_QUALITY_WARNING")
    model = spark.createDataFrame([("d", "authority", 0.5, 21, 29, "Ministry"), ("d", "date", 0.99, 46, 56, "01-02-2031")], "document_id string, field string, score double, start int, end int, value string")
    f = {r["field"]: r for r in extract.extract(docs, model=model).fields.collect()}
    assert f["authority"]["end"] > 29 and f["date"]["score"] == 0.99  # a short value of the model gives way


def test_best_within_the_row(spark):
    docs = spark.createDataFrame([("d", NOTICE + " 3 May 2030"), ("e", "x")], "document_id string, text string")
    cols = ["document_id", "field", "start", "end", "value"]
    two = [sorted(tuple(r) for r in df.select(cols).collect()) for df in (spans.best_spans(spans.drop_noise(spans.find_spans(docs))), spans.find_best(docs, noise=False))]
    assert two[0] == two[1]


def test_analysis(spark):
    docs = spark.createDataFrame([("d", "DATED 01-02-2031. You must submit a reply\nPay the fine of 1,000 within 10 days"), ("e", "nothing to do here"), ("s", "short")], "document_id string, text string")
    got = {r["document_id"]: r for r in extract.analyse(docs, "2031-01-01").collect()}
    assert set(got) == {"d", "e"} and len(got["d"]["obligations"]) == 2 and got["e"]["obligations"][0]["fallback"] and got["e"]["obligations"][0]["penalty_amount"] == 5000.0
    assert str(got["d"]["obligations"][1]["deadline"]) == "2031-02-11" and got["d"]["notice_id"].startswith("N2A-")


def test_exact_splits_and_store(spark):
    d = spark.range(101).select(F.col("id").cast("string").alias("document_id"))
    n = {r["split"]: r["count"] for r in annotate.exact_splits(d).groupBy("split").count().collect()}
    assert n == {"test": 15, "validation": 15, "train": 71}
    two = {r["split"]: r["count"] for r in annotate.exact_splits(d.limit(3)).groupBy("split").count().collect()}
    assert two == {"test": 1, "validation": 1, "train": 1}
    e = spark.createDataFrame([("abcdef", None)], "text string, entities array<struct<label:string,start:int,end:int,text:string>>")
    e = e.withColumn("entities", annotate.add_entity(F.col("entities"), F.lit("DATE"), F.lit(3), F.lit(5), F.col("text"))).withColumn("entities", annotate.add_entity(F.col("entities"), F.lit("TITLE"), F.lit(0), F.lit(2), F.col("text")))
    assert [(x["label"], x["text"]) for x in e.first()["entities"]] == [("TITLE", "ab"), ("DATE", "de")]
    assert [x["label"] for x in e.select(annotate.delete_entity(F.col("entities"), F.lit(0)).alias("e")).first()["e"]] == ["DATE"]


def test_commands(spark, tmp_path):
    rec = [{"document_id": f"d{i}", "text": "Ministry of Steel notice", "entities": [{"label": "AUTHORITY", "start": 0, "end": 17}]} for i in range(10)]
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text("\n".join(json.dumps(r) for r in rec))
    bad.write_text(json.dumps(rec[0] | {"entities": [{"label": "X", "start": 0, "end": 99}]}) + "\n{not json\n")
    assert cli.main(["validate", "--input", str(good)], spark) == 0 and cli.main(["validate", "--verbose", "--input", str(bad)], spark) == 1
    assert cli.main(["convert", "--input", str(good), "--outdir", str(tmp_path / "out")], spark) == 0
    got = spark.read.json(str(tmp_path / "out/chunks"))
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"test": 2, "validation": 2, "train": 6}
    assert got.first()["label_ids"] == [-100, 3, 3, 3, 0, -100]


def test_one_row_files(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "n int, t string")
    files.write_one(one, str(tmp_path / "one"))
    assert files.read_one(spark, str(tmp_path / "one")) == {"n": 1, "t": "a"}
    with pytest.raises(ValueError):
        files.write_one(one.union(one), str(tmp_path / "two"))
