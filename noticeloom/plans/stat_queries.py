"""Queries over corpora and predictions: OCR layout, curation, profiles, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grouped import first_by
from ..functions.text import word_count
from ..operators import corpus, ocr, stats
from ..session import read
from .sqltext import any_of, q, strip

PAGE_HEIGHT = 400


def _words(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of every chunk laid out as words of a page, twelve to a line, with made-up boxes and confidences."""
    t = read(spark, d, "train").select("document_id", F.col("chunk_index").alias("page_number"), "tokens").distinct()
    w = t.select("document_id", "page_number", F.posexplode("tokens").alias("ord", "text"))
    row, col = F.floor(F.col("ord") / 12), F.col("ord") % 12
    gap = F.when(row >= 3, 60).otherwise(0)
    y = (row * 40 + gap + F.col("ord") % 3).cast("int")
    conf = ((F.col("ord") * 37 + F.col("page_number") * 11) % 50 + 50) / 100.0
    return w.select("document_id", "page_number", "ord", "text", conf.alias("confidence"), (col * 60).cast("int").alias("x1"), y.alias("y1"), (col * 60 + 50).cast("int").alias("x2"), (y + 20).alias("y2"))


WORDS = """(SELECT document_id, page_number, ord, text, ((ord * 37 + page_number * 11) % 50 + 50) / 100.0 AS confidence, (ord % 12) * 60 AS x1, y AS y1, (ord % 12) * 60 + 50 AS x2, y + 20 AS y2 FROM (
    SELECT *, (ord // 12) * 40 + CASE WHEN ord // 12 >= 3 THEN 60 ELSE 0 END + ord % 3 AS y FROM (
        SELECT document_id, page_number, i - 1 AS ord, tokens[i] AS text FROM (SELECT DISTINCT document_id, chunk_index AS page_number, tokens FROM train) a, unnest(range(1, len(tokens) + 1)) AS u(i)) b) c)"""


def ocr_page_quality(spark: SparkSession, d: str) -> DataFrame:
    return ocr.page_quality(_words(spark, d))


def ocr_doc_quality(spark: SparkSession, d: str) -> DataFrame:
    return ocr.document_quality(ocr.page_quality(_words(spark, d)))


def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    return ocr.lines(_words(spark, d)).select("document_id", "page_number", "line_no", F.md5("text").alias("digest"), "confidence", "x1", "y1", "x2", "y2", "word_count")


def _zoned(spark: SparkSession, d: str) -> DataFrame:
    return ocr.zones(ocr.lines(_words(spark, d)), F.lit(PAGE_HEIGHT))


def layout_zones(spark: SparkSession, d: str) -> DataFrame:
    return _zoned(spark, d).groupBy("zone").agg(F.count("*").alias("lines"), F.sum("word_count").alias("words"))


def paragraph_islands(spark: SparkSession, d: str) -> DataFrame:
    return ocr.paragraphs(ocr.lines(_words(spark, d))).select("document_id", "page_number", "paragraph_no", "line_count", "y1", "y2")


def layout_signature(spark: SparkSession, d: str) -> DataFrame:
    return ocr.signature(_zoned(spark, d)).select("document_id", "page_number", "detected", F.md5("signature").alias("digest"))


def layout_zone_text(spark: SparkSession, d: str) -> DataFrame:
    return ocr.zone_text(_zoned(spark, d))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "annotation_corpus")


def canonical_types(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d).select("document_id", "document_type").distinct()
    return c.groupBy(corpus.canonical_type(F.col("document_type")).alias("canonical_type")).agg(F.count("*").alias("documents"))


def _sample(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d).select("document_id", "document_type", "text").distinct()
    return corpus.quota_sample(c, [F.col("document_id")])


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the limit per type is its purpose."""
    return _sample(spark, d).select("canonical_type", "document_id", "pick")


def quota_manifest(spark: SparkSession, d: str) -> DataFrame:
    return corpus.quota_manifest(_sample(spark, d))


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d).filter("text is not null").select("document_id", "document_title", "text").distinct()
    return c.select("document_id", corpus.content_id(F.col("document_title"), F.col("text")).alias("content_id"))


def target_rows(spark: SparkSession, d: str) -> DataFrame:
    return corpus.target_rows(_corpus(spark, d)).groupBy("source").agg(F.count("*").alias("rows"))


COLUMNS = ["document_title", "document_type", "document_jurisdiction", "issuing_authority", "issue_date", "text", "lang", "collected_at"]


def ingest_manifest(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ingest_manifest(_corpus(spark, d), COLUMNS)


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    u = corpus.union_sources({"corpus": _corpus(spark, d), "documents": read(spark, d, "documents").withColumn("collected_at", F.col("fetched_at"))})
    return u.groupBy("source_dataset", "lang").agg(F.count("*").alias("rows"), F.count("doc_id").alias("numbered"), F.count("document_title").alias("titled"))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(_corpus(spark, d), "document_type")


def top_authorities(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return stats.value_counts(_corpus(spark, d), "issuing_authority", top=10)


def missing_values(spark: SparkSession, d: str) -> DataFrame:
    return stats.missing_values(_corpus(spark, d), COLUMNS)


def length_describe(spark: SparkSession, d: str) -> DataFrame:
    r = stats.describe(read(spark, d, "documents"), F.length("text"), ["lang"])
    return r.select("lang", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def word_describe(spark: SparkSession, d: str) -> DataFrame:
    r = stats.describe(_corpus(spark, d), word_count(F.col("text")))
    return r.select("count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def duplicate_counts(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return stats.duplicates(c, ["text"]).withColumn("subset", F.lit("text")).union(stats.duplicates(c, ["document_title"]).withColumn("subset", F.lit("title")))


def first_of_each_type(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d).filter("document_type is not null").select("document_type", "document_id").distinct()
    return first_by(c, ["document_type"], [F.col("document_id")])


def longest_texts(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return read(spark, d, "documents").select("doc_id", F.length("text").alias("n")).orderBy(F.desc_nulls_last("n"), "doc_id").limit(3)


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.select(F.round(F.col("l_discount") * 10, 2).alias("confidence"), (F.col("l_returnflag") != "R").alias("is_correct"), (F.col("l_linestatus") == "O").alias("is_missing_in_ground_truth"))


PRED = "(SELECT round(l_discount * 10, 2) AS confidence, l_returnflag <> 'R' AS is_correct, l_linestatus = 'O' AS is_missing FROM lineitem)"


def selective_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.selective(_predictions(spark, d), 0.6).select(*[F.round(c, 6).alias(c) for c in ("coverage", "selective_precision", "abstention_rate", "false_answer_rate_missing")])


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return stats.threshold_sweep(_predictions(spark, d)).select("step", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return stats.best_threshold(stats.threshold_sweep(_predictions(spark, d)), 0.5).select("step", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


def ece_bins(spark: SparkSession, d: str) -> DataFrame:
    b = stats.calibration_bins(_predictions(spark, d))
    return b.select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"))


def ece(spark: SparkSession, d: str) -> DataFrame:
    return stats.ece(_predictions(spark, d)).select(F.round("ece", 6).alias("ece"))


def _logits(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return e.select("vec_id", z.alias("logits"), F.col("label").cast("int").alias("label")).withColumn("probs", stats.softmax(F.col("logits")))


_LOGITS = "(SELECT vec_id, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS logits, label FROM embeddings)"
_PROBS = f"(SELECT vec_id, label, logits, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM {_LOGITS}))"


def brier(spark: SparkSession, d: str) -> DataFrame:
    return stats.brier(_logits(spark, d), "probs", "label").select(F.round("brier", 6).alias("brier"))


TEMPERATURES = [0.5, 1.0, 1.5, 2.0, 4.0]


def temperature_nll(spark: SparkSession, d: str) -> DataFrame:
    return stats.nll(_logits(spark, d), "logits", "label", TEMPERATURES).select("temperature", F.round("nll", 6).alias("nll"))


def conformal_qhat(spark: SparkSession, d: str) -> DataFrame:
    return stats.conformal_quantile(_logits(spark, d), "probs", "label").select("n", F.round("q_hat", 6).alias("q_hat"))


def prediction_sets(spark: SparkSession, d: str) -> DataFrame:
    p = _logits(spark, d)
    sets = p.select(F.size(stats.prediction_set(F.col("probs"), F.lit(0.95))).alias("size"), F.array_contains(stats.prediction_set(F.col("probs"), F.lit(0.95)), F.col("label")).alias("covers"))
    return sets.groupBy("size").agg(F.count("*").alias("rows"), F.count_if("covers").alias("covered"))


def argmax_types(spark: SparkSession, d: str) -> DataFrame:
    p = _logits(spark, d)
    return p.select((F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("class"), "label").groupBy("class").agg(F.count("*").alias("rows"), F.count_if(F.col("class") == F.col("label")).alias("right"))


def model_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Scores by field and model; reports are made of the line items' flags."""
    li = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model_name"), F.col("l_linestatus").alias("field")).agg(F.round(F.avg("l_discount"), 6).alias("precision"), F.round(F.avg("l_tax"), 6).alias("recall"))
    reports = li.groupBy("model_name").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("precision", "recall")))).alias("per_field"))
    return stats.model_pivot(reports, "precision", ["A", "N", "R"])


def confidence_badges(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    return p.groupBy(stats.badge(F.col("confidence"), F.when(F.col("is_missing_in_ground_truth"), "LOW_CONFIDENCE").otherwise("NOT_FOUND")).alias("badge")).agg(F.count("*").alias("rows"))


_VALID = r"length(w) >= 2 AND (regexp_matches(w, '^\p{Nd}+$') OR regexp_matches(w, '[\x{0900}-\x{097F}]') OR (length(w) - length(regexp_replace(w, '\p{L}', '', 'g')))::DOUBLE / length(w) >= 0.5 OR regexp_matches(w, '^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}'))"
_LABEL = "CASE WHEN {0} >= 0.80 THEN 'GOOD' WHEN {0} >= 0.60 THEN 'MODERATE' WHEN {0} >= 0.40 THEN 'POOR' ELSE 'VERY_POOR' END"
_PAGEQ = rf"""(SELECT *, CASE WHEN deva > latin THEN 'hi' WHEN latin > 0 THEN 'en' ELSE 'unknown' END AS lang,
      greatest(0.0, least(1.0, 0.40 * conf + 0.25 * valid + 0.15 * least(1.0, chars / 3000.0) + 0.10 * (1.0 - odd::DOUBLE / greatest(1, chars)) + 0.10 * CASE WHEN deva > latin OR latin > 0 THEN 0.7 ELSE 0.0 END)) AS score FROM (
    SELECT document_id, page_number, avg(confidence::DOUBLE) AS conf, avg(CASE WHEN {_VALID} THEN 1.0 ELSE 0.0 END) AS valid, sum(length(s)) AS chars, sum(length(regexp_replace(s, '[a-zA-Z0-9\s.,;:!?@#$%&*()\-/''"\x{{0900}}-\x{{097F}}]', '', 'g'))) AS odd,
           count(*) AS n, sum(length(text) - length(regexp_replace(text, '[\x{{0900}}-\x{{097F}}]', '', 'g'))) AS deva, sum(length(text) - length(regexp_replace(text, '[a-zA-Z]', '', 'g'))) AS latin
    FROM (SELECT *, trim(text) AS w, replace(text, ' ', '') AS s FROM {WORDS}) GROUP BY 1, 2))"""
_LINES = f"""(SELECT document_id, page_number, ord // 12 AS line_no, string_agg(text, ' ' ORDER BY x1, ord) AS text, round(avg(confidence::DOUBLE), 4) AS confidence, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS word_count FROM {WORDS} GROUP BY 1, 2, 3)"""
_ZONED = f"(SELECT *, CASE WHEN (y1 + y2) / 2.0 < {PAGE_HEIGHT} * 0.12 THEN 'header' WHEN (y1 + y2) / 2.0 > {PAGE_HEIGHT} * 0.9 THEN 'footer' ELSE 'body' END AS zone FROM {_LINES})"
_CANON = "CASE " + " ".join(f"WHEN {any_of('lower(' + strip('document_type') + ')', marks)} THEN {q(n)}" for n, (_, marks) in corpus.QUOTAS.items()) + " END"
_QUOTA = "CASE canonical_type " + " ".join(f"WHEN {q(n)} THEN {k}" for n, (k, _) in corpus.QUOTAS.items()) + " END"
_SAMPLE = f"""(SELECT canonical_type, document_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY canonical_type ORDER BY document_id) AS pick FROM (
    SELECT *, {_CANON} AS canonical_type FROM (SELECT DISTINCT document_id, document_type, text FROM annotation_corpus)) WHERE canonical_type IS NOT NULL AND length(text) BETWEEN 200 AND 8000) WHERE pick <= {_QUOTA})"""
_DESC = "count(v) AS count, round(avg(v), 4) AS mean, round(stddev(v), 4) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, max(v) AS max"
_WC = rf"CASE WHEN text IS NULL THEN 0 WHEN length({strip('text')}) > 0 THEN len(string_split_regex({strip('text')}, '\s+')) ELSE 0 END"
_SWEEP = f"SELECT s AS step, coalesce(count(*) FILTER (round(confidence * 100, 9) >= s) / nullif(count(*), 0), 0.0) AS coverage, coalesce(count(*) FILTER (round(confidence * 100, 9) >= s AND is_correct) / nullif(count(*) FILTER (round(confidence * 100, 9) >= s), 0), 1.0) AS precision FROM {PRED}, unnest(range(0, 101)) AS u(s) GROUP BY 1"
_BINS = f"SELECT least(10, ceil(round(confidence * 10, 9)))::INT AS bin, count(*) AS n, avg(is_correct::INT) AS accuracy, avg(confidence) AS mean_confidence FROM {PRED} WHERE confidence > 0 GROUP BY 1"


def _nll(t: float) -> str:
    return f"SELECT {t} AS temperature, round(avg(ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / {t})))) - (logits[label + 1] - list_max(logits)) / {t}), 6) AS nll FROM {_LOGITS}"


QUERIES = {
    "ocr_page_quality": (ocr_page_quality, f"SELECT document_id, page_number, round(conf + 1e-9, 4) AS avg_confidence, round(valid + 1e-9, 4) AS token_validity_ratio, round(least(1.0, chars / 3000.0) + 1e-9, 4) AS text_density, round(odd::DOUBLE / greatest(1, chars) + 1e-9, 4) AS abnormal_char_ratio, lang AS language_detected, n AS word_count, round(score + 1e-9, 4) AS ocr_quality_score, {_LABEL.format('score')} AS quality_label FROM {_PAGEQ}"),
    "ocr_doc_quality": (ocr_doc_quality, f"""
        WITH p AS (SELECT document_id, lang, n, round(score + 1e-9, 4) AS s, {_LABEL.format('score')} AS label FROM {_PAGEQ}),
        l AS (SELECT document_id, lang, sum(n) AS w, sum(s * n) AS sq, count(*) AS pages, count(*) FILTER (label IN ('GOOD', 'MODERATE')) AS good, count(*) FILTER (label IN ('POOR', 'VERY_POOR')) AS poor, bool_or(n > 10) AS big FROM p GROUP BY 1, 2),
        g AS (SELECT document_id, round(sum(sq) / sum(w) + 1e-9, 4) AS quality, arg_max(lang, (w, lang)) AS language, count(*) FILTER (big AND lang <> 'unknown') > 1 AS bilingual, coalesce(list_sort(list(lang) FILTER (big AND lang <> 'unknown')), [arg_max(lang, (w, lang))]) AS languages, sum(pages) AS pages, sum(good) AS good_pages, sum(poor) AS poor_pages, sum(w) AS words FROM l GROUP BY 1)
        SELECT document_id, quality, {_LABEL.format('quality')} AS label, language, bilingual, languages, pages, good_pages, poor_pages, words FROM g"""),
    "layout_lines": (layout_lines, f"SELECT document_id, page_number, line_no, md5(text) AS digest, confidence, x1, y1, x2, y2, word_count FROM {_LINES}"),
    "layout_zones": (layout_zones, f"SELECT zone, count(*) AS lines, sum(word_count) AS words FROM {_ZONED} GROUP BY 1"),
    "paragraph_islands": (paragraph_islands, f"""
        WITH a AS (SELECT *, avg(CASE WHEN y2 > y1 THEN y2 - y1 END) OVER (PARTITION BY document_id, page_number) AS h, lag(y2) OVER (PARTITION BY document_id, page_number ORDER BY line_no) AS p FROM {_LINES}),
        b AS (SELECT *, sum(CASE WHEN y1 - p > coalesce(h, 20) * 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY line_no) AS paragraph_no FROM a)
        SELECT document_id, page_number, paragraph_no, count(*) AS line_count, min(y1) AS y1, max(y2) AS y2 FROM b GROUP BY 1, 2, 3"""),
    "layout_signature": (layout_signature, f"""SELECT document_id, page_number, count(*) FILTER (sign) > 0 AS detected, md5(coalesce(string_agg(text, chr(10) ORDER BY zone <> 'footer', line_no) FILTER (sign), '')) AS digest
        FROM (SELECT *, (zone = 'footer' OR (zone = 'body' AND r <= 3)) AND {any_of('lower(text)', ocr.SIGNATURE)} AS sign FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number, zone ORDER BY line_no DESC) AS r FROM {_ZONED})) GROUP BY 1, 2"""),
    "layout_zone_text": (layout_zone_text, "SELECT document_id, page_number, " + ", ".join(f"coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (zone = {q(z)}), '') AS {z}" for z in ("header", "body", "footer")) + f" FROM {_ZONED} GROUP BY 1, 2"),
    "canonical_types": (canonical_types, f"SELECT {_CANON} AS canonical_type, count(*) AS documents FROM (SELECT DISTINCT document_id, document_type FROM annotation_corpus) GROUP BY 1"),
    "quota_sample": (quota_sample, f"SELECT * FROM {_SAMPLE}"),
    "quota_manifest": (quota_manifest, "SELECT canonical_type, target, count(document_id) AS collected FROM (VALUES " + ", ".join(f"({q(n)}, {k})" for n, (k, _) in corpus.QUOTAS.items()) + f") AS v(canonical_type, target) LEFT JOIN {_SAMPLE} s USING (canonical_type) GROUP BY 1, 2"),
    "content_ids": (content_ids, "SELECT document_id, 'NOTGOLD-' || upper(substr(md5(coalesce(document_title, '') || substr(text, 1, 200)), 1, 8)) AS content_id FROM (SELECT DISTINCT document_id, document_title, text FROM annotation_corpus WHERE text IS NOT NULL)"),
    "target_rows": (target_rows, f"SELECT source, count(*) AS rows FROM annotation_corpus WHERE text <> '' AND {any_of('lower(concat_ws(chr(32), document_type, document_title))', corpus.TARGETS)} GROUP BY 1"),
    "ingest_manifest": (ingest_manifest, " UNION ALL ".join(f"SELECT {q(c)} AS \"column\", count(*) FILTER ({c} IS NULL OR {c}::VARCHAR = '') AS missing, count(*) AS rows FROM annotation_corpus" for c in COLUMNS)),
    "union_sources": (union_sources, "SELECT source_dataset, lang, count(*) AS rows, count(doc_id) AS numbered, count(document_title) AS titled FROM (SELECT 'corpus' AS source_dataset, lang, NULL AS doc_id, document_title FROM annotation_corpus UNION ALL SELECT 'documents', lang, doc_id, NULL FROM documents) GROUP BY 1, 2"),
    "value_counts": (value_counts, "SELECT document_type AS value, count(*) AS count FROM annotation_corpus GROUP BY 1"),
    "top_authorities": (top_authorities, "SELECT issuing_authority AS value, count(*) AS count FROM annotation_corpus GROUP BY 1 ORDER BY count DESC, value NULLS FIRST LIMIT 10"),
    "missing_values": (missing_values, " UNION ALL ".join(f"SELECT {q(c)} AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS percent FROM annotation_corpus" for c in COLUMNS)),
    "length_describe": (length_describe, f"SELECT lang, {_DESC} FROM (SELECT lang, length(text)::DOUBLE AS v FROM documents) WHERE v IS NOT NULL GROUP BY 1"),
    "word_describe": (word_describe, f"SELECT {_DESC} FROM (SELECT ({_WC})::DOUBLE AS v FROM annotation_corpus)"),
    "duplicate_counts": (duplicate_counts, " UNION ALL ".join(f"SELECT sum(n) AS rows, sum(n - 1) AS duplicates, {q(name)} AS subset FROM (SELECT count(*) AS n FROM annotation_corpus GROUP BY {c})" for c, name in (("text", "text"), ("document_title", "title")))),
    "first_of_each_type": (first_of_each_type, "SELECT document_type, min(document_id) AS document_id FROM annotation_corpus WHERE document_type IS NOT NULL GROUP BY 1"),
    "longest_texts": (longest_texts, "SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC NULLS LAST, doc_id LIMIT 3"),
    "selective_metrics": (selective_metrics, f"SELECT round(a / n, 6) AS coverage, round(coalesce(c / nullif(a, 0), 1.0), 6) AS selective_precision, round(1.0 - a / n, 6) AS abstention_rate, round(coalesce(f / nullif(m, 0), 0.0), 6) AS false_answer_rate_missing FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (confidence >= 0.6)::DOUBLE AS a, count(*) FILTER (confidence >= 0.6 AND is_correct)::DOUBLE AS c, count(*) FILTER (is_missing)::DOUBLE AS m, count(*) FILTER (confidence >= 0.6 AND is_missing)::DOUBLE AS f FROM {PRED})"),
    "threshold_sweep": (threshold_sweep, f"SELECT step, round(coverage, 6) AS coverage, round(precision, 6) AS precision FROM ({_SWEEP})"),
    "best_threshold": (best_threshold, f"SELECT step, round(coverage, 6) AS coverage, round(precision, 6) AS precision FROM ({_SWEEP}) WHERE precision >= 0.5 ORDER BY coverage DESC, step LIMIT 1"),
    "ece_bins": (ece_bins, f"SELECT bin, n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence FROM ({_BINS})"),
    "ece": (ece, f"SELECT round(sum(abs(accuracy - mean_confidence) * n) / (SELECT count(*) FROM lineitem), 6) AS ece FROM ({_BINS})"),
    "brier": (brier, f"SELECT round(avg(list_sum(list_transform(range(0, 10), lambda i: pow(probs[i + 1] - (i = label)::INT, 2)))), 6) AS brier FROM {_PROBS}"),
    "temperature_nll": (temperature_nll, " UNION ALL ".join(_nll(t) for t in TEMPERATURES)),
    "conformal_qhat": (conformal_qhat, f"SELECT n, round(l[k + 1] + (l[least(k + 2, n)] - l[k + 1]) * (p * (n - 1) - k), 6) AS q_hat FROM (SELECT *, floor(p * (n - 1))::BIGINT AS k FROM (SELECT count(*) AS n, least(1.0::DOUBLE, ceil((count(*) + 1) * 0.9) / count(*)) AS p, list_sort(list(s)) AS l FROM (SELECT 1.0 - probs[label + 1] AS s FROM {_PROBS})))"),
    "prediction_sets": (prediction_sets, f"SELECT len(z) AS size, count(*) AS rows, count(*) FILTER (list_contains(z, label)) AS covered FROM (SELECT label, list_filter(range(0, 10), lambda i: probs[i + 1] >= 1.0::DOUBLE - 0.95::DOUBLE) AS z FROM {_PROBS}) GROUP BY 1"),
    "argmax_types": (argmax_types, f"SELECT class, count(*) AS rows, count(*) FILTER (class = label) AS \"right\" FROM (SELECT list_position(probs, list_max(probs)) - 1 AS class, label FROM {_PROBS}) GROUP BY 1"),
    "model_pivot": (model_pivot, "SELECT l_linestatus AS field, " + ", ".join(f"round(avg(l_discount) FILTER (l_returnflag = {q(m)}), 6) AS \"{m}\"" for m in "ANR") + " FROM lineitem GROUP BY 1"),
    "confidence_badges": (confidence_badges, f"SELECT CASE WHEN confidence >= 0.80 THEN 'HIGH' WHEN is_missing OR confidence >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS badge, count(*) AS rows FROM {PRED} GROUP BY 1"),
}
