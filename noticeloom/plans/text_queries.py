"""Queries over texts: cleaning, pages, sentences, summaries, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dates, documents, summarize
from ..session import read
from .sqltext import any_of, find_all, q, strip


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "annotation_corpus").select("document_id", "text")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d).filter("text is not null")
    return c.select("document_id", T.clean(F.col("text")).alias("clean"))


def clean_text_rules(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d).filter("text is not null").select("document_id", T.clean_rules(F.col("text")).alias("clean"))
    return c.select("document_id", F.length("clean").alias("n"), F.md5("clean").alias("digest"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "train").select("document_id", F.col("chunk_index").alias("page_number"), F.array_join("tokens", " ").alias("text")).distinct()


PAGES = "(SELECT DISTINCT document_id, chunk_index AS page_number, array_to_string(tokens, ' ') AS text FROM train)"


def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return documents.page_offsets(_pages(spark, d)).select("document_id", "page_number", "start_offset", "end_offset")


def full_texts(spark: SparkSession, d: str) -> DataFrame:
    return documents.full_text(_pages(spark, d)).select("document_id", F.length("full_text").alias("n"), F.md5("full_text").alias("digest"))


def page_quality(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.round(documents.text_quality(F.col("text")), 4).alias("quality"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    n = F.coalesce(F.length("text"), F.lit(0))
    kind = documents.page_type(n, documents.text_quality(F.col("text")), F.lit(True), F.col("doc_id") % 7 == 0, F.col("doc_id") % 14 == 0)
    return docs.select(F.col("source").alias("document_id"), "doc_id", kind.alias("page_type"))


def page_types(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).groupBy("page_type").agg(F.count("*").alias("pages"))


def document_types(spark: SparkSession, d: str) -> DataFrame:
    return documents.document_type(_typed(spark, d))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = summarize.sentences(read(spark, d, "documents"), key="doc_id")
    return s.select("doc_id", "idx", "start", "end", F.md5("sentence").alias("digest"))


def _distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    s = summarize.score_sentences(summarize.sentences(_distinct_texts(spark, d), key="doc_id"), key="doc_id")
    return s.select("doc_id", "idx", "n", "score")


def _with_dates(spark: SparkSession, d: str) -> DataFrame:
    each = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit(None).cast("int").alias("page_number"))
    return _distinct_texts(spark, d).withColumn("dates", F.transform(dates.date_array("text"), each))


def summary_topk(spark: SparkSession, d: str) -> DataFrame:
    s = summarize.summaries(_with_dates(spark, d), "dates", key="doc_id")
    return s.select("doc_id", "picked", F.md5("summary").alias("digest"), "confidence")


def summary_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The picked sentences, dates given by their values only: points for sentences that hold them."""
    bare = F.transform("dates", lambda x: F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), x["value"].alias("value"), x["page_number"].alias("page_number")))
    return summarize.summaries(_with_dates(spark, d).withColumn("dates", bare), "dates", key="doc_id", detail=True).select("doc_id", "sentence_index", "start", "end", "entity_score")


def date_finditer(spark: SparkSession, d: str) -> DataFrame:
    return dates.find_dates(_distinct_texts(spark, d), key="doc_id").select("doc_id", "start", "end", "value", "pattern")


def date_context_type(spark: SparkSession, d: str) -> DataFrame:
    return dates.classify(dates.find_dates(_distinct_texts(spark, d), key="doc_id")).select("doc_id", "start", "end", "type", "type_confidence")


def date_parse(spark: SparkSession, d: str) -> DataFrame:
    found = dates.find_dates(_distinct_texts(spark, d), key="doc_id")
    return found.select("doc_id", "start", F.date_format(dates.parse(F.col("value")), "yyyy-MM-dd").alias("day"))


def last_date(spark: SparkSession, d: str) -> DataFrame:
    return dates.last_date(dates.classify(dates.find_dates(_distinct_texts(spark, d), key="doc_id")), key="doc_id")


def issue_dates(spark: SparkSession, d: str) -> DataFrame:
    """The notations of annotation_corpus.issue_date read as days; impossible ones stay null."""
    c = read(spark, d, "annotation_corpus").select("issue_date").distinct().filter("issue_date is not null")
    return c.select("issue_date", F.date_format(F.coalesce(F.try_to_timestamp("issue_date", F.lit("yyyy-MM-dd")).cast("date"), dates.parse(F.col("issue_date"))), "yyyy-MM-dd").alias("day"))


# ---- SQL
_DOC = "(SELECT doc_id, text FROM documents)"


def _clean_sql(x: str) -> str:
    c = f"translate({x}, {q(T.REPLACED + T.REMOVED)}, {q(T.REPLACING)})"
    c = rf"regexp_replace({c}, '(?i)\bPage\s+\d+(\s+of\s+\d+)?\b', '', 'g')"
    c = rf"regexp_replace({c}, '(?m)^[ \t]*[-—][ \t]*\d+[ \t]*[-—][ \t]*$', '', 'g')"
    blank = T.INNER_BLANKS
    for a, b in ((rf"{blank}*\n{blank}*", "\n"), (rf"^{T.ALL_BLANKS}+|{T.ALL_BLANKS}+$", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        c = f"regexp_replace({c}, {q(a)}, {q(b)}, 'g')"
    return c


_QUALITY = r"""CASE WHEN text IS NULL OR length(text) < 10 OR len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) = 0 THEN 0.0 ELSE
    greatest(0.0, least(1.0, (0.6 * (length(text) - length(regexp_replace(text, '[\p{L}\p{N}\s.,;:!?@#$%&*()\-/''"\x{0900}-\x{097F}]', '', 'g')))::DOUBLE / length(text)
      + 0.3 * CASE WHEN length(regexp_replace(text, '\s+', '', 'g'))::DOUBLE / len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) BETWEEN 2 AND 15 THEN 1.0 ELSE 0.5 END)
      * (1.0 - least(1.0, len(regexp_extract_all(text, '[^\x{00}-\x{7F}\x{0900}-\x{097F}]{5,}')) * 0.15)))) END"""
_TYPED = f"""(SELECT source AS document_id, doc_id, CASE WHEN coalesce(length(text), 0) >= 100 AND ({_QUALITY}) >= 0.5
    THEN CASE WHEN doc_id % 14 = 0 THEN 'MIXED' ELSE 'TEXT' END ELSE 'SCANNED' END AS page_type FROM documents)"""
_SENT = f"""SELECT doc_id, i - 1 AS idx, "start", "end", {strip('value')} AS sentence FROM ({find_all('documents', 'doc_id', 'text', summarize.SENTENCE)}) z"""
_SENTENCES = f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx, "start", "end", sentence FROM ({_SENT}) y WHERE sentence <> '')"""
_DATES = "(SELECT doc_id, \"start\", \"end\", min_by(value, pattern) AS value, min(pattern) AS pattern, any_value(t) AS t FROM (" + " UNION ALL ".join(f"SELECT doc_id, \"start\", \"end\", value, {n} AS pattern, t FROM ({find_all('documents', 'doc_id', 'text', p)}) d{n}" for n, p in enumerate(dates.DATE_PATTERNS)) + ") z GROUP BY doc_id, \"start\", \"end\")"


def _score_sql(entity: str) -> str:
    kw = " + ".join(f"contains(lower(sentence), {q(k)})::INT" for k in summarize.KEYWORDS)
    dull = " OR ".join(f"regexp_matches(lower(sentence), {q(p)})" for p in summarize.BOILERPLATE)
    return f"{entity} + ({kw}) + CASE WHEN idx < 3 THEN 1.5 * (3 - idx) WHEN idx >= n - 2 THEN 1.0 ELSE 0.0 END - CASE WHEN {dull} THEN 5.0 ELSE 0.0 END"


_SCORED = f"SELECT doc_id, idx, n, sentence, entity, ({_score_sql('entity')})::DOUBLE AS score FROM"


def _types_sql() -> str:
    items, order = [], 0
    for kind, patterns in dates.CONTEXT.items():
        for p in patterns:
            far = f"(length(b) - length(regexp_extract(b, {q('^((?s:.*?)' + p + ')')}, 1)))"
            s = f"CASE WHEN regexp_matches(b, {q(p)}) THEN 0.85 - least(0.20, 0.005 * {far}) WHEN regexp_matches(a, {q(p)}) THEN 0.70 ELSE 0.0 END"
            items.append(f"{{'s': round(({s})::DOUBLE, 6), 'o': {-order}, 'k': {q(kind)}}}")
            order += 1
    w = dates.WINDOW
    return f"""SELECT doc_id, "start", "end", value, pattern,
        CASE WHEN best.s > 0 THEN best.k WHEN "start" < 500 AND {any_of('head', dates.HEADER_SIGNS)} THEN 'ISSUE_DATE' ELSE 'UNKNOWN_DATE' END AS type,
        round(greatest(0.30, least(0.99, CASE WHEN best.s > 0 THEN best.s WHEN "start" < 500 AND {any_of('head', dates.HEADER_SIGNS)} THEN 0.65 ELSE 0.0 END)), 4) AS type_confidence
        FROM (SELECT *, list_reverse_sort([{', '.join(items)}])[1] AS best FROM (
            SELECT *, b || ' ' || c AS a FROM (
                SELECT doc_id, "start", "end", value, pattern, lower(substr(t, (greatest("start" - {w}, 0) + 1)::BIGINT, least("start", {w})::BIGINT)) AS b, lower(substr(t, ("end" + 1)::BIGINT, {w})) AS c,
                       lower(substr(t, 1, "start"::BIGINT)) AS head FROM {_DATES} x) y) z) v"""


_DAY = """coalesce(try_strptime(v, '%d-%m-%Y'), try_strptime(v, '%m-%d-%Y'), try_strptime(v, '%d %B %Y'), try_strptime(v, '%B %d %Y'))"""


def _fold_date(x: str) -> str:
    v = rf"regexp_replace(regexp_replace({x}, '(?i)(\d)(st|nd|rd|th)\b', '\1', 'g'), '(?i)\bof\s+', '', 'g')"
    for i, m in enumerate(dates.HINDI_MONTHS.split("|")):
        v = f"replace({v}, {q(m)}, {q(dates.MONTHS.split('|')[i])})"
    return rf"regexp_replace(regexp_replace({v}, '[,\s]+', ' ', 'g'), '[/.]', '-', 'g')"


QUERIES = {
    "clean_text": (clean_text, None),
    "clean_text_rules": (clean_text_rules, f"SELECT document_id, length(c) AS n, md5(c) AS digest FROM (SELECT document_id, {_clean_sql('text')} AS c FROM annotation_corpus WHERE text IS NOT NULL)"),
    "page_offsets": (page_offsets, f"""SELECT document_id, page_number, b AS start_offset, b + length(text) AS end_offset FROM (
        SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {PAGES})"""),
    "full_texts": (full_texts, f"SELECT document_id, length(t) AS n, md5(t) AS digest FROM (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS t FROM {PAGES} GROUP BY 1)"),
    "page_quality": (page_quality, f"SELECT doc_id, round({_QUALITY}, 4) AS quality FROM documents"),
    "page_types": (page_types, f"SELECT page_type, count(*) AS pages FROM {_TYPED} GROUP BY 1"),
    "document_types": (document_types, f"SELECT document_id, count(*) AS pages, CASE WHEN min(page_type) = max(page_type) AND min(page_type) <> 'MIXED' THEN min(page_type) ELSE 'MIXED' END AS document_type FROM {_TYPED} GROUP BY 1"),
    "sentence_split": (sentence_split, f"""SELECT doc_id, idx, "start", "end", md5(sentence) AS digest FROM {_SENTENCES}"""),
    "sentence_scores": (sentence_scores, f"SELECT doc_id, idx, n, score FROM ({_SCORED} (SELECT *, 0.0 AS entity, count(*) OVER (PARTITION BY doc_id) AS n FROM {_SENTENCES}))"),
    "summary_topk": (summary_topk, f"""
        WITH s AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {_SENTENCES}), d AS (SELECT * FROM {_DATES}),
        h AS (SELECT s.doc_id, s.idx, 3.0 * count(*) AS e FROM s JOIN d ON s.doc_id = d.doc_id AND d."start" < s."end" AND d."end" > s."start" GROUP BY ALL),
        c AS ({_SCORED} (SELECT s.*, coalesce(h.e, 0.0) AS entity FROM s LEFT JOIN h USING (doc_id, idx))),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r, max(entity) OVER (PARTITION BY doc_id) > 0 AS has FROM c),
        p AS (SELECT * FROM r WHERE r <= CASE WHEN n > 3 AND has THEN 5 ELSE 3 END)
        SELECT doc_id, count(*) AS picked, md5(string_agg(sentence, ' ' ORDER BY idx)) AS digest,
               CASE WHEN any_value(n) <= 3 THEN 0.95 ELSE least(0.98, greatest(0.60, round(round((0.60 + least(0.38, sum(score) / count(*) * 0.05))::DOUBLE, 6), 2))) END AS confidence FROM p GROUP BY 1"""),
    "summary_sentences": (summary_sentences, f"""
        WITH s AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {_SENTENCES}), d AS (SELECT * FROM {_DATES}),
        h AS (SELECT s.doc_id, s.idx, 2.0 * count(*) AS e FROM s JOIN d ON s.doc_id = d.doc_id AND contains(lower(s.sentence), lower(d.value)) WHERE length(d.value) > 2 GROUP BY ALL),
        c AS (SELECT *, ({_score_sql('entity')})::DOUBLE AS score FROM (SELECT s.*, coalesce(h.e, 0.0) AS entity FROM s LEFT JOIN h USING (doc_id, idx))),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r, max(entity) OVER (PARTITION BY doc_id) > 0 AS has FROM c)
        SELECT doc_id, idx AS sentence_index, "start", "end", round(greatest(0.0, score), 2) AS entity_score FROM r WHERE r <= CASE WHEN n > 3 AND has THEN 5 ELSE 3 END"""),
    "date_finditer": (date_finditer, f"""SELECT doc_id, "start", "end", value, pattern FROM {_DATES}"""),
    "date_context_type": (date_context_type, f"""SELECT doc_id, "start", "end", type, type_confidence FROM ({_types_sql()})"""),
    "date_parse": (date_parse, f"""SELECT doc_id, "start", strftime({_DAY}, '%Y-%m-%d') AS day FROM (SELECT doc_id, "start", {_fold_date('value')} AS v FROM {_DATES})"""),
    "last_date": (last_date, f"""SELECT doc_id, value, type, "start" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", pattern) AS r FROM ({_types_sql()})
        WHERE type IN ({', '.join(q(t) for t in dates.DEADLINES)})) WHERE r = 1"""),
    "issue_dates": (issue_dates, f"""SELECT issue_date, strftime(coalesce(try_strptime(issue_date, '%Y-%m-%d'), {_DAY}), '%Y-%m-%d') AS day FROM (SELECT DISTINCT issue_date, {_fold_date('issue_date')} AS v FROM annotation_corpus WHERE issue_date IS NOT NULL)"""),
}
