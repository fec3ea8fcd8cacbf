import json

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import annotate, corpus, ocr, stats
from noticeloom.sources import files
from noticeloom.streaming import inbox


def test_validation(spark):
    t = "Ministry of Finance notification"
    e = [("AUTHORITY", 0, 8, "Ministry"), ("FOO", 9, 11, None), ("DATE", 5, 5, None), ("DATE", -1, 4, None), ("DATE", 8, 9, None), ("TITLE", 12, 19, "x"), (None, 20, 22, None), ("TITLE", 18, 25, None)]
    df = spark.createDataFrame([("d", t, e), ("n", None, None), ("ok", t, [("TITLE", 0, 8, None), ("DATE", 8 + 1, 11, None)])], "document_id string, text string, entities array<struct<label:string,start:int,end:int,text:string>>")
    got = sorted((r["document_id"], r["entity_index"], r["error_type"]) for r in annotate.validate(df).collect())
    assert ("d", 1, "UNKNOWN_LABEL") in got and ("d", 2, "EMPTY_SPAN") in got and ("d", 3, "INVALID_OFFSET") in got and ("d", 4, "EMPTY_SPAN") in got
    assert ("d", 5, "TEXT_MISMATCH") in got and ("d", 6, "MISSING_FIELD") in got and ("d", 5, "OVERLAPPING") in got and ("d", 7, "OVERLAPPING") not in got
    assert got.count(("n", -1, "MISSING_FIELD")) == 2
    assert not [x for x in got if x[0] == "ok"]
    r = annotate.validation_report(df, annotate.validate(df)).first()
    assert (r["documents"], r["invalid"], r["valid"]) == (3, 2, 1)


def test_disjoint_spans(spark):
    df = spark.createDataFrame([([(5, 11, "B"), (0, 8, "A"), (11, 12, "C")],)], "spans array<struct<start:int,end:int,label:string>>")
    assert [tuple(x) for x in df.select(annotate.keep_disjoint(F.col("spans")).alias("x")).first()["x"]] == [(0, 8, "A"), (11, 12, "C")]


def test_bio(spark):
    t = "of Ministry of Finance notice x"
    df = spark.createDataFrame([("d", t)], "document_id string, text string")
    toks = annotate.words(df).withColumn("word_id", F.col("ord"))
    s = spark.createDataFrame([("d", 3, 22, "AUTHORITY")], "document_id string, start int, end int, label string")
    assert [r["label"] for r in annotate.bio_labels(toks, s).orderBy("ord").collect()] == ["O", "B-AUTHORITY", "B-AUTHORITY", "B-AUTHORITY", "O", "O"]


@pytest.mark.parametrize("n,want", [(0, 1), (510, 1), (511, 2), (892, 2), (893, 3)])
def test_windows(spark, n, want):
    w = spark.range(1).select(annotate.windows(F.lit(n)).alias("w")).first()["w"]
    assert len(w) == want and w[-1]["window_end"] == n and all(a["window_end"] - b["window_start"] == 128 for a, b in zip(w, w[1:]))


def test_decode(spark):
    df = spark.createDataFrame([("d", ["O", "B-A", "I-A", "B-A", "I-B", "I-B", "O", "I-A"], [1.0, 0.9, 0.5, 0.8, 0.7, 0.6, 1.0, 0.4]), ("e", [], [])], "k string, labels array<string>, p array<double>")
    got = [tuple(r)[1:] for r in annotate.decode(df, ["k"], scores="p").collect()]
    assert got == [(1, 2, "A", 0.5), (3, 3, "A", 0.8), (4, 5, "B", 0.6), (7, 7, "A", 0.4)]


def test_split_is_stable(spark):
    df = spark.createDataFrame([(f"d{i}",) for i in range(2000)], "document_id string")
    a = {r["document_id"]: r["split"] for r in annotate.split_documents(df).collect()}
    b = {r["document_id"]: r["split"] for r in annotate.split_documents(df.limit(100)).collect()}
    assert all(a[k] == v for k, v in b.items())
    assert 0.65 < sum(v == "train" for v in a.values()) / 2000 < 0.75


def words(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_number int, ord int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")


def test_layout(spark):
    w = words(spark, [("d", 1, 1, "world", 0.8, 60, 12, 100, 30), ("d", 1, 0, "hello", 0.9, 0, 10, 50, 28), ("d", 1, 2, "Sd/-", 0.9, 0, 150, 50, 170), ("d", 1, 3, "foot", 0.9, 0, 390, 50, 400)])
    ln = ocr.lines(w)
    assert [r["text"] for r in ln.orderBy("line_no").collect()] == ["hello world", "Sd/-", "foot"]
    z = ocr.zones(ln, F.lit(400))
    assert [r["zone"] for r in z.orderBy("line_no").collect()] == ["header", "body", "footer"]
    assert [r["line_count"] for r in ocr.paragraphs(ln).orderBy("paragraph_no").collect()] == [1, 1, 1]
    assert ocr.signature(z).first()["signature"] == "Sd/-"
    assert ocr.zone_text(z).first()["body"] == "Sd/-"


def test_page_quality(spark):
    good = ocr.page_quality(words(spark, [("d", 1, i, w, 0.95, 0, 0, 1, 1) for i, w in enumerate("The Ministry of Health issued orders".split())]))
    assert good.first()["quality_label"] in ("GOOD", "MODERATE") and good.first()["language_detected"] == "en"
    bad = ocr.page_quality(words(spark, [("d", 1, i, w, 0.1, 0, 0, 1, 1) for i, w in enumerate(["~~", "☃☃", "^|"])]))
    assert bad.first()["quality_label"] == "VERY_POOR"
    assert ocr.page_quality(words(spark, [])).count() == 0
    pages = spark.createDataFrame([("d", 1, 0.9, 100, "GOOD", "en"), ("d", 2, 0.5, 50, "POOR", "en")], "document_id string, page_number int, ocr_quality_score double, word_count int, quality_label string, language_detected string")
    r = ocr.document_quality(pages).first()
    assert (r["quality"], r["label"], r["language"], r["good_pages"], r["poor_pages"], r["bilingual"]) == (0.7667, "MODERATE", "en", 1, 1, False)


def test_quota(spark):
    rows = [(f"d{i:03}", "Office Order" if i % 2 else "Notification", "x" * (300 if i % 3 else 50)) for i in range(90)] + [("z", None, None)]
    s = corpus.quota_sample(spark.createDataFrame(rows, "document_id string, document_type string, text string"), [F.col("document_id")])
    assert {r["canonical_type"]: r["count"] for r in s.groupBy("canonical_type").count().collect()} == {"Notification": 10, "Order": 5}
    assert {r["canonical_type"]: r["collected"] for r in corpus.quota_manifest(s).collect()}["Scheme"] == 0


def test_backfill(spark):
    s = spark.createDataFrame([("Scheme",)] * 8, "canonical_type string")
    second = spark.createDataFrame([(f"{i}", "y" * 250 if i else "short", None if i % 2 else f"T{i}") for i in range(6)], "k string, body string, name string")
    got = corpus.backfill(s, second, [F.col("k")], "Scheme", ["body"], ["name"]).collect()
    assert sorted(r["document_title"] for r in got) == ["T2", "Untitled"]


def predictions(spark, rows):
    return spark.createDataFrame(rows, "confidence double, is_correct boolean, is_missing_in_ground_truth boolean")


def test_selective(spark):
    p = predictions(spark, [(0.95, False, True), (0.95, True, False), (0.2, False, True)])
    r = stats.selective(p, 0.9).first()
    assert (round(r["coverage"], 4), r["selective_precision"], r["false_answer_rate_missing"]) == (0.6667, 0.5, 0.5)
    assert stats.selective(predictions(spark, []), 0.5).first()["selective_precision"] == 1.0


def test_sweep_equals_brute_force(spark):
    rows = [(i / 40, i % 3 != 0, False) for i in range(41)] + [(0.95, False, False), (0.85, True, False)]
    got = {r["step"]: (r["coverage"], r["precision"]) for r in stats.threshold_sweep(predictions(spark, rows)).collect()}
    for k in range(101):
        ok = [c for v, c, _ in rows if round(v * 100, 9) >= k]
        assert got[k] == pytest.approx((len(ok) / len(rows), sum(ok) / len(ok) if ok else 1.0))


def test_calibration(spark):
    rows = [((i % 11) / 10, i % 4 != 0, False) for i in range(200)]
    p = predictions(spark, rows)
    got = stats.ece(p).first()["ece"]
    want = 0.0
    for b in range(1, 11):
        inside = [(v, c) for v, c, _ in rows if (b - 1) / 10 < v <= b / 10 + 1e-12]
        if inside:
            want += abs(sum(c for _, c in inside) / len(inside) - sum(v for v, _ in inside) / len(inside)) * len(inside) / len(rows)
    assert got == pytest.approx(want)


def test_probabilities(spark):
    df = spark.createDataFrame([([2.0, 1.0, 0.0], 0), ([0.0, 3.0, 0.0], 1), ([1.0, 1.0, 1.0], 2)], "z array<double>, label int").withColumn("p", stats.softmax(F.col("z")))
    assert all(sum(r["p"]) == pytest.approx(1) for r in df.collect())
    assert 0 < stats.brier(df, "p", "label").first()["brier"] < 2
    assert 0.04 < stats.fit_temperature(df, "z", "label") < 21
    q = stats.conformal_quantile(df, "p", "label", 0.1).first()
    assert q["n"] == 3 and q["q_hat"] == pytest.approx(max(1 - r["p"][r["label"]] for r in df.collect()))
    assert df.select(stats.prediction_set(F.col("p"), F.lit(None).cast("double")).alias("s")).collect()[1]["s"] == [1]


def test_duplicates_and_missing(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "x"), (None, "y")], "t string, u string")
    assert tuple(stats.duplicates(df, ["t"]).first()) == (4, 2)
    assert {r["column"]: r["percent"] for r in stats.missing_values(df, ["t", "u"]).collect()} == {"t": 50.0, "u": 50.0}


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"document_id": "a", "text": "हिन्दी"}\n\n{broken\n{"document_id": "b", "text": "x"}\n', encoding="utf-8")
    rows, lack = files.read_jsonl(spark, [str(p), str(tmp_path / "none.jsonl")], files.ANNOTATIONS)
    assert sorted(r["document_id"] for r in rows.collect()) == ["a", "b"] and lack == [str(tmp_path / "none.jsonl")]
    num = files.read_jsonl_numbered(spark, [str(p)], files.ANNOTATIONS)
    assert [(r["line_no"], r["error"]) for r in num.orderBy("line_no").collect()] == [(1, None), (3, "PARSE_ERROR"), (4, None)]
    files.write_jsonl(rows.select("document_id", "text"), [str(tmp_path / "o1"), str(tmp_path / "o2")])
    assert "हिन्दी" in "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "o2").glob("part*"))
    files.rewrite(spark, str(tmp_path / "o1"), "document_id string, text string", F.col("document_id") == "a")
    assert spark.read.json(str(tmp_path / "o1")).count() == 1
    files.write_splits(rows.select("document_id").withColumn("split", F.lit("train")), str(tmp_path / "s"), {"O": 0})
    assert (tmp_path / "s/chunks/split=train").exists()
    d = files.with_defaults(spark.createDataFrame([(None, None, "t")], "document_id string, document_title string, text string")).first()
    assert d["document_id"].startswith("DOC-") and d["document_title"] == "Untitled"


def test_stream_equals_batch(spark, tmp_path):
    from noticeloom.operators import rules

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [{"document_id": f"d{i}", "text": f"You must submit form {i} within {i} days.", "received_at": "2026-01-01T00:00:00Z"} for i in range(6)] + [{"document_id": "short", "text": "x", "received_at": None}]
    for k in (0, 1):
        (src / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k::2]))
    analyse = lambda df: rules.obligations(df)
    q = inbox.run(inbox.drop_folder(spark, str(src), files_per_batch=1), analyse, str(out), str(tmp_path / "c"), str(tmp_path / "q"))
    q.awaitTermination(60)
    batch = rules.obligations(spark.createDataFrame(rows[:6], "document_id string, text string, received_at string"))
    assert sorted(r["line"] for r in spark.read.json(str(out)).collect()) == sorted(r["line"] for r in batch.collect())
    assert spark.read.json(str(tmp_path / "q")).count() == 1


def test_corrections(spark):
    c = spark.createDataFrame([("a", "1"), ("b", "2")], "document_id string, text string")
    assert sorted(map(tuple, inbox.merge_corrections(c, spark.createDataFrame([("b", "3")], c.schema)).collect())) == [("a", "1"), ("b", "3")]


def test_plans_have_no_nested_loops(spark, tmp_path):
    from noticeloom.plans import registry

    spark.createDataFrame([(1, "You must submit it within 15 days. Dated 01-02-2026.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("obligations_by_priority", "field_decision", "date_context_type", "summary_topk"):
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_entry_without_the_optional_part():
    import __spark_entry__ as e
    from noticeloom.plans import registry

    assert set(registry.queries()) <= set(e.queries()) and set(registry.oracle_sql()) <= set(e.oracle_sql())
