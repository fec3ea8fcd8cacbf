"""Queries over fields: spans, decisions, evidence, metadata, obligations, annotations, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, dates, extract, rules, spans
from ..session import read
from .sqltext import any_of, cascade, find_all, lines, q, strip
from .text_queries import _DAY, _fold_date, _types_sql

AS_OF = "2032-01-01"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.find_spans(_docs(spark, d), key="doc_id")


def heuristic_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "field", "score", "start", "end", "value")


def best_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.find_best(_docs(spark, d), key="doc_id", noise=False).select("doc_id", "field", "start", "end", "value")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    best = spans.find_best(_docs(spark, d), key="doc_id", noise=False)
    conf = spans.confidence(F.col("field"), F.col("score"), F.lit(1.0), F.lit(True), F.lit(True), F.length("value") % 4 != 0)
    return spans.abstain(best.withColumn("confidence", conf))


def field_decision(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("doc_id", "field", "confidence", "decision", "status")


def field_pivot(spark: SparkSession, d: str) -> DataFrame:
    return spans.wide(_fields(spark, d), key="doc_id")


def inbox_items(spark: SparkSession, d: str) -> DataFrame:
    return spans.inbox_items(_fields(spark, d), _docs(spark, d), key="doc_id")


def evidence_sentence(spark: SparkSession, d: str) -> DataFrame:
    best = spans.find_best(_docs(spark, d), key="doc_id", evidence=True)
    return best.select("doc_id", "field", "sentence_start", "sentence_end", F.md5("evidence").alias("digest"), F.lit("VALID_SPAN").alias("span_status"))


def consistency_score(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    best = spans.find_best(docs.withColumn("_full", F.col("text")), key="doc_id", keep=["_full"])
    year = F.when(F.col("field") == "date", F.year(dates.parse(F.col("value"))))
    pen = best.select("doc_id", spans.field_penalty(F.col("field"), F.col("value"), F.col("_full"), year, 2032).alias("penalty"))
    typed = dates.classify(dates.find_dates(docs, key="doc_id")).select("doc_id", "type", dates.parse(F.col("value")).alias("day"))
    return spans.document_consistency(pen, typed, key="doc_id")


def extract_fields(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(_docs(spark, d), key="doc_id").fields.select("doc_id", "field", "penalty", "confidence", "decision", "status")


def analyse(spark: SparkSession, d: str) -> DataFrame:
    """Notices by priority of their first obligation, with those that have only the one that stands for the whole."""
    a = extract.analyse(_docs(spark, d), AS_OF, key="doc_id")
    first = F.get("obligations", F.lit(0))
    return a.groupBy(first["priority"].alias("priority"), first["fallback"].alias("fallback")).agg(F.count("*").alias("notices"), F.sum(F.size("obligations")).alias("obligations"))


def metadata_cascade(spark: SparkSession, d: str) -> DataFrame:
    m = rules.metadata(_docs(spark, d), AS_OF, key="doc_id")
    return m.select("doc_id", "issuing_authority", "notice_type", "notice_title", "notice_ref_no", "notice_date", F.array_join("act_rules_cited", "; ").alias("acts"), "jurisdiction")


def _obligations(spark: SparkSession, d: str) -> DataFrame:
    """One projection: the notice's own date goes along with its lines."""
    docs = _docs(spark, d).withColumn("notice_date", rules.notice_date(F.col("text"), AS_OF))
    o = rules.obligations(docs, key="doc_id", keep=["notice_date"])
    as_of = F.to_date(F.lit(AS_OF))
    return o.withColumn("deadline", rules.deadline(F.col("raw_deadline"), rules.base_date(F.col("notice_date"), as_of))).withColumn("days_left", rules.days_left(F.col("deadline"), as_of))


def obligations(spark: SparkSession, d: str) -> DataFrame:
    return rules.obligations(_docs(spark, d), key="doc_id").select("doc_id", "obligation_id", F.md5("line").alias("digest"), "priority", "title_word", "raw_deadline", "penalty_clause", "penalty_amount", "start", "end")


def deadline_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _obligations(spark, d).select("doc_id", "obligation_id", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), "days_left")


def obligations_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: open obligations by priority, with their penalties and the earliest deadline."""
    return _obligations(spark, d).groupBy("priority").agg(F.count("*").alias("obligations"), F.countDistinct("doc_id").alias("notices"), F.round(F.sum("penalty_amount"), 2).alias("penalties"), F.date_format(F.min("deadline"), "yyyy-MM-dd").alias("earliest"))


def notices_without_obligations(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return rules.without_obligations(docs, rules.obligations(docs, key="doc_id"), key="doc_id").select("doc_id")


def obligations_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return rules.with_fallback(rules.obligations(docs, key="doc_id"), docs, key="doc_id").select("doc_id", "obligation_id", F.md5("line").alias("digest"), "priority", "penalty_amount", "start", "end", "fallback")


def obligation_evidence(spark: SparkSession, d: str) -> DataFrame:
    return rules.evidence_rows(rules.obligations(_docs(spark, d), key="doc_id"), key="doc_id").select("doc_id", "evidence_id", "obligation_id", F.md5("text").alias("digest"), "start", "end")


def input_check(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy(rules.valid_input(F.col("text")).alias("valid")).agg(F.count("*").alias("documents"))


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotation records made of every notice: sound and faulty spans, by the text's length."""
    n = F.length("text") % 5
    e = lambda label, a, b, t: F.struct(label.cast("string").alias("label"), a.cast("int").alias("start"), b.cast("int").alias("end"), t.cast("string").alias("text"))
    none = F.lit(None)
    made = F.array(
        e(F.lit("TITLE"), F.lit(0), F.lit(10), F.substring("text", 1, 10)),
        e(F.when(n == 0, F.lit("FOO")).otherwise(F.lit("DATE")), 12 - n, F.lit(20), none),
        e(F.lit("CONTACT"), F.lit(30), F.when(n == 1, F.lit(30)).when(n == 2, F.lit(10_000_000)).otherwise(F.lit(40)), F.when(n == 3, F.lit("x"))),
        e(F.when(n == 4, none).otherwise(F.lit("DOCUMENT")), F.lit(50), F.lit(60), none),
    )
    return read(spark, d, "annotation_corpus").select("document_id", "text").distinct().withColumn("entities", F.when(F.col("text").isNotNull(), made))


ANNOTATIONS = """(SELECT document_id, text, unnest([0, 1, 2, 3]) AS i, length(text) % 5 AS n FROM (SELECT DISTINCT document_id, text FROM annotation_corpus) WHERE text IS NOT NULL)"""
ENTITIES = f"""(SELECT document_id, i, text, n,
    CASE i WHEN 0 THEN 'TITLE' WHEN 1 THEN CASE WHEN n = 0 THEN 'FOO' ELSE 'DATE' END WHEN 2 THEN 'CONTACT' ELSE CASE WHEN n = 4 THEN NULL ELSE 'DOCUMENT' END END AS label,
    CASE i WHEN 0 THEN 0 WHEN 1 THEN 12 - n WHEN 2 THEN 30 ELSE 50 END AS s,
    CASE i WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN CASE n WHEN 1 THEN 30 WHEN 2 THEN 10000000 ELSE 40 END ELSE 60 END AS e,
    CASE i WHEN 0 THEN substr(text, 1, 10) WHEN 2 THEN CASE WHEN n = 3 THEN 'x' END END AS own FROM {ANNOTATIONS})"""


def span_validate(spark: SparkSession, d: str) -> DataFrame:
    return annotate.validate(_annotations(spark, d))


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of error the number of them and of documents that have it."""
    return annotate.validate(_annotations(spark, d)).groupBy("error_type").agg(F.count("*").alias("errors"), F.countDistinct("document_id").alias("documents"))


def span_report(spark: SparkSession, d: str) -> DataFrame:
    a = _annotations(spark, d)
    return annotate.validation_report(a, annotate.validate(a))


def bio_labels(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by label, of all fields but the number, which is none of the labels. Within the row up to the count."""
    span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["field"]).alias("label"))
    found = spans.spans_of(_docs(spark, d), key="doc_id").select("text", F.transform(F.filter("spans", lambda x: x["field"] != "notice_number"), span).alias("spans"))
    every = read(spark, d, "documents").select("text").filter("text is not null")
    blank = every.filter(F.length(F.btrim("text", F.lit(" \n\r\t\f\x0b"))) == 0).select("text", F.array().cast("array<struct<start:int,end:int,label:string>>").alias("spans"))
    tokens = F.transform(annotate.find_all("text", r"\S+"), lambda w, i: F.struct(w["start"].alias("start"), w["end"].alias("end"), i.alias("word_id")))
    labelled = found.unionByName(blank).withColumn("_t", tokens)
    return annotate.each(labelled, [], annotate.bio_array(F.col("_t"), F.col("spans")), "label").groupBy("label").agg(F.count("*").alias("tokens"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Annotation records: the corpus with its string labels, and for some types of documents spans of its own."""
    c = read(spark, d, "annotation_corpus").groupBy("document_id").agg(F.max(F.struct("text", "document_title", "issuing_authority", "issue_date", "document_type")).alias("_x")).select("document_id", "_x.*")
    own = F.array(F.struct(F.lit("TITLE").alias("label"), F.lit(0).alias("start"), F.lit(30).alias("end"), F.lit(None).cast("string").alias("text")))
    return c.withColumn("entities", F.when((F.length("text") % 3 == 0) & (F.length("text") > 30), own).otherwise(F.array().cast(own_type)))


own_type = "array<struct<label:string,start:int,end:int,text:string>>"


def training_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = annotate.training_chunks(_records(spark, d))
    return c.select("document_id", "chunk_index", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"), F.array_join(F.transform("label_ids", lambda x: x.cast("string")), ",").alias("labels"), "doc_label_id")


def chunk_splits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by split; the documents are counted off in a hash's order."""
    c = annotate.training_chunks(_records(spark, d)).select("document_id", "chunk_index")
    s = annotate.exact_splits(c)
    return annotate.chunk_splits(c, s).groupBy("split").agg(F.countDistinct("document_id").alias("documents"))


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), F.lit(0)))
    w = _docs(spark, d).filter("text is not null").select("doc_id", F.explode(annotate.windows(n)).alias("_w"))
    return w.select("doc_id", "_w.*")


def doc_split(spark: SparkSession, d: str) -> DataFrame:
    return annotate.split_documents(read(spark, d, "train"))


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    return annotate.decode(read(spark, d, "train").select("document_id", "chunk_index", "labels").distinct(), ["document_id", "chunk_index"])


def decode_entities(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d).select("document_id", "chunk_index", "first_token", "last_token", "label")


def entity_f1(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import stats

    gold = _decoded(spark, d)
    found = gold.filter(F.col("first_token") % 5 != 0).withColumn("last_token", F.when(F.col("first_token") % 7 == 0, F.col("last_token") + 1).otherwise(F.col("last_token")))
    s = stats.entity_scores(gold, found, ["document_id", "chunk_index"])
    return s.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "annotation_corpus").select("document_id", "collected_at", "text")
    return annotate.latest(c, "document_id", "collected_at", ["text"]).select("document_id", F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss").alias("collected"), F.md5("text").alias("digest"))


def align_labels(spark: SparkSession, d: str) -> DataFrame:
    """Titles, contacts and numbers given as strings, found again in the texts; of overlapping ones the first is kept."""
    docs = _docs(spark, d)
    w = field_pivot(spark, d).select(F.col("doc_id").alias("_k"), "title", "contact", "notice_number")
    j = docs.join(w, F.col("doc_id") == F.col("_k")).withColumn("spans", annotate.align_values(None, {"title": "TITLE", "contact": "CONTACT", "notice_number": "DOCUMENT"}))
    kept = j.withColumn("spans", annotate.keep_disjoint(F.col("spans")))
    return kept.select("doc_id", F.explode("spans").alias("_s")).select("doc_id", "_s.*")


# ---- SQL
_D = "documents"


def _capture(x: str, before: str, group: str, flags: str = "") -> tuple[str, str, str]:
    p = q(f"{flags}^((?s:.*?)(?:{before}))({group})")
    hit = f"regexp_matches({x}, {q(flags + '(?:' + before + ')(?:' + group + ')')})"
    return hit, f"length(regexp_extract({x}, {p}, 1))", f"length(regexp_extract({x}, {p}, 2))"


def _spans_sql() -> str:
    base = f"(SELECT doc_id, text AS t, upper(text) AS up, {lines('text')} AS ls FROM documents WHERE length({strip('text')}) > 0)"
    marked = f"list_filter(ls, lambda l: {any_of('upper(l)', spans.TITLE_WORDS)})[1]"
    title = f"SELECT doc_id, 'title' AS field, CASE WHEN m IS NOT NULL THEN 0.90 ELSE 0.75 END AS score, instr(t, v) - 1 AS s, instr(t, v) - 1 + length(v) AS e, t FROM (SELECT doc_id, t, {marked} AS m, coalesce({marked}, CASE WHEN len(ls) > 1 AND length(ls[1]) <= 10 THEN ls[2] ELSE ls[1] END) AS v FROM {base}) x"
    whens = []
    for p in spans.AUTHORITIES:
        hit, a, n = _capture("up", "", p)
        whens.append((hit, f"{{'a': {a}, 'n': {n}}}"))
    pick = "CASE " + " ".join(f"WHEN {h} THEN {v}" for h, v in whens) + " END"
    auth = f"SELECT doc_id, 'authority' AS field, 0.88 AS score, x.a AS s, x.a + length({strip('substr(t, (x.a + 1)::BIGINT, x.n::BIGINT)')}) AS e, t FROM (SELECT doc_id, t, {pick} AS x FROM {base}) y WHERE x IS NOT NULL"
    parts = [title, auth, f"""SELECT doc_id, 'date' AS field, 0.92 AS score, "start" AS s, "end" AS e, t FROM ({find_all(base + ' bb', 'doc_id', 't', spans.DATE)}) z"""]
    hit, a, n = _capture("t", "", spans.CONTACT)
    parts.append(f"SELECT doc_id, 'contact' AS field, 0.90 AS score, {a} AS s, {a} + {n} AS e, t FROM {base} WHERE {hit}")
    for f, (before, group) in spans.CAPTURES.items():
        hit, a, n = _capture("t", before, group, "(?i)")
        parts.append(f"SELECT doc_id, {q(f)} AS field, {spans.SCORES[f]} AS score, {a} AS s, {a} + {n} AS e, t FROM {base} WHERE {hit}")
    return "SELECT doc_id, field, score::DOUBLE AS score, s, e, substr(t, (s + 1)::BIGINT, (e - s)::BIGINT) AS value, t FROM (" + " UNION ALL ".join(f"({p})" for p in parts) + ") zz"


_SPANS = f"({_spans_sql()})"
_QUIET = f"(SELECT * FROM {_SPANS} WHERE length({strip('value')}) >= 3 AND {strip('value')} NOT IN ({', '.join(q(x) for x in spans.NOISE)}))"


def _best(src: str) -> str:
    return f"(SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, s, e) AS r FROM {src}) WHERE r = 1)"


def _w(n: int) -> str:
    return "CASE field " + " ".join(f"WHEN {q(f)} THEN {w[n]}" for f, w in spans.WEIGHTS.items()) + f" ELSE {spans.DEFAULT_WEIGHTS[n]} END"


_CONF = f"round(greatest(0.0, least(1.0, (({_w(0)}) * score + ({_w(1)}) + ({_w(2)}) + ({_w(3)}) * CASE WHEN length(value) % 4 <> 0 THEN 1.0 ELSE 0.4 END)::DOUBLE)), 4)"
_T = "CASE field " + " ".join(f"WHEN {q(f)} THEN {t}" for f, t in spans.THRESHOLDS.items()) + " ELSE 0.85 END"
_DECIDED = f"(SELECT *, CASE WHEN value IS NOT NULL AND value <> '' AND confidence >= {_T} THEN 'ACCEPT' WHEN value IS NOT NULL AND value <> '' THEN 'ABSTAIN' ELSE 'NOT_FOUND' END AS decision FROM (SELECT *, {_CONF} AS confidence FROM {_best(_QUIET)}))"
_VALID = f"s >= 0 AND s < e AND e <= length(t) AND length({strip('substr(t, (s + 1)::BIGINT, (e - s)::BIGINT)')}) > 0"
_A = r"length(regexp_extract(substr(t, 1, s::BIGINT), '(?s)^(.*[.\n?!]\s+)', 1))"
_B = r"e + length(regexp_extract(substr(t, (e + 1)::BIGINT), '(?s)^([^.\n?!]*[.\n?!]?)', 1))"
_TITLE_CASE = r"array_to_string(list_transform(regexp_extract_all(x, '\p{L}+|\P{L}+'), lambda p: upper(p[1]) || lower(p[2:])), '')"
_U = "upper(text)"
_META = f"""(SELECT doc_id, text, coalesce({cascade(_U, rules.AUTHORITY_SIGNS, 1, None)}, {_TITLE_CASE.replace('(x,', f"(nullif(regexp_extract({_U}, {q(rules.AUTHORITY)}, 1), ''),")}, {q(rules.NO_AUTHORITY)}) AS issuing_authority,
    {cascade(_U, rules.TYPE_SIGNS, 1, rules.NO_TYPE)} AS notice_type, {cascade(_U, rules.TYPE_SIGNS, 2, rules.NO_TITLE)} AS notice_title,
    coalesce(nullif(regexp_extract({_U}, {q(rules.REF)}, 1), ''), {q(rules.NO_REF)}) AS notice_ref_no, coalesce(nullif(regexp_extract(text, {q(rules.DATED)}, 1), ''), '{AS_OF}') AS notice_date,
    coalesce(nullif(concat_ws('; ', {', '.join(f"CASE WHEN {any_of(_U, s)} THEN {q(a)} END" for s, a in rules.ACTS)}), ''), {q(rules.NO_ACT)}) AS acts, {cascade(_U, rules.PLACES, 1, rules.NO_PLACE)} AS jurisdiction
    FROM documents WHERE text IS NOT NULL)"""
_TRIGGER = [([*w], p, w[0]) for w, p in rules.TRIGGERS]
_OBL = f"""(SELECT doc_id, printf('OBL-%02d', i) AS obligation_id, line, {cascade('low', _TRIGGER, 1, None)} AS priority, {cascade('low', _TRIGGER, 2, None)} AS title_word,
    coalesce(nullif(regexp_extract(low, {q(rules.DEADLINE)}, 1), ''), {q(rules.NO_DEADLINE)}) AS raw_deadline, nullif(regexp_extract(low, {q(rules.PENALTY)}, 1), '') AS penalty_clause,
    try_cast(replace(nullif(regexp_extract(low, {q(rules.PENALTY)}, 2), ''), ',', '') AS DOUBLE) AS penalty_amount, greatest(instr(t, substr(line, 1, 25)) - 1, 0) AS s
    FROM (SELECT doc_id, t, i, ls[i] AS line, lower(ls[i]) AS low FROM (SELECT doc_id, text AS t, list_filter({lines('text')}, lambda l: {' OR '.join(any_of('lower(l)', w) for w, _, _ in _TRIGGER)}) AS ls FROM documents WHERE text IS NOT NULL) a,
          unnest(range(1, len(ls) + 1)) AS u(i)) b)"""
_BASE = f"coalesce(try_strptime(nd, '%Y-%m-%d')::DATE, try_strptime(nd, '%d/%m/%Y')::DATE, try_strptime(nd, '%d-%m-%Y')::DATE, try_strptime(nd, '%B %d, %Y')::DATE, try_strptime(nd, '%d %B %Y')::DATE, DATE '{AS_OF}')"
_NAMED = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({rules._MONTH})\s+(\d{{4}})"
_DEADLINE = rf"""coalesce(base + try_cast(nullif(regexp_extract(r, '(?:within|in|by|before)\s+(\d+)\s+days', 1), '') AS INT), base + 30 * try_cast(nullif(regexp_extract(r, '(?:within|in|by|before)\s+(\d+)\s+months', 1), '') AS INT),
    CASE WHEN regexp_matches(r, '(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})') THEN try_strptime(replace(regexp_extract(r, '(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})', 0), '/', '-'), '%d-%m-%Y')::DATE
         ELSE try_strptime(replace(regexp_extract(r, '(\d{{4}})[/-](\d{{1,2}})[/-](\d{{1,2}})', 0), '/', '-'), '%Y-%m-%d')::DATE END,
    try_strptime(regexp_extract(r, {q(_NAMED)}, 1) || ' ' || regexp_extract(r, {q(_NAMED)}, 2) || ' ' || regexp_extract(r, {q(_NAMED)}, 3), '%d %B %Y')::DATE, base + 14)"""
_DUE = f"""(SELECT *, {_DEADLINE} AS deadline FROM (SELECT o.*, {strip('lower(raw_deadline)')} AS r, {_BASE} AS base FROM {_OBL} o JOIN (SELECT doc_id, {strip('notice_date')} AS nd FROM {_META}) m USING (doc_id)) x)"""
_WORDS = f"""({find_all('documents', 'doc_id', 'text', r'[^ \t\n\x0B\f\r]+')})"""
_LABELS = "(SELECT DISTINCT document_id, chunk_index, labels FROM train)"
_DECODED = f"""(SELECT document_id, chunk_index, min(k) AS first_token, max(k) AS last_token, any_value(kind) AS label FROM (
    SELECT *, sum(opens) OVER (PARTITION BY document_id, chunk_index, labels ORDER BY k) AS no FROM (
        SELECT *, CASE WHEN kind IS NOT NULL AND (l LIKE 'B-%' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY document_id, chunk_index, labels ORDER BY k)) THEN 1 ELSE 0 END AS opens FROM (
            SELECT document_id, chunk_index, labels, k - 1 AS k, labels[k] AS l, CASE WHEN labels[k] <> 'O' THEN labels[k][3:] END AS kind FROM {_LABELS} a, unnest(range(1, len(labels) + 1)) AS u(k)) b) c) d
    WHERE kind IS NOT NULL GROUP BY document_id, chunk_index, labels, no)"""

# written from the rules themselves: of the entities that have all fields, those inside the text reach into the next one by start
_ERRORS = f"""(
    WITH x AS (SELECT *, substr(text, (s + 1)::BIGINT, greatest(e - s, 0)::BIGINT) AS body FROM {ENTITIES} WHERE label IS NOT NULL),
    k AS (SELECT *, CASE WHEN e <= s THEN 'EMPTY_SPAN' WHEN s < 0 OR e > length(text) THEN 'INVALID_OFFSET' WHEN {strip('body')} = '' THEN 'EMPTY_SPAN' WHEN own <> body THEN 'TEXT_MISMATCH' END AS error FROM x),
    v AS (SELECT document_id, i, e, lead(s) OVER (PARTITION BY document_id ORDER BY s, i) AS nxt FROM k WHERE coalesce(error, 'TEXT_MISMATCH') = 'TEXT_MISMATCH')
    SELECT document_id, i AS entity_index, error AS error_type FROM k WHERE error IS NOT NULL
    UNION ALL SELECT document_id, i, 'MISSING_FIELD' FROM {ENTITIES} WHERE label IS NULL
    UNION ALL SELECT document_id, i, 'UNKNOWN_LABEL' FROM x WHERE label = 'FOO'
    UNION ALL SELECT document_id, i, 'OVERLAPPING' FROM v WHERE nxt < e
    UNION ALL SELECT document_id, -1, 'MISSING_FIELD' FROM (SELECT DISTINCT document_id, text FROM annotation_corpus), (VALUES (1), (2)) WHERE text IS NULL)"""
_V = strip("value")
_LEAD = f"substr(lower(t), 1, greatest(instr(lower(t), lower({_V})) - 1, 0)::BIGINT)"
_PENALTY = f"""CASE field
    WHEN 'contact' THEN CASE WHEN NOT regexp_matches({_V}, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+[.][a-zA-Z0-9-.]+$') AND NOT regexp_matches({_V}, '^[+]?[0-9\\s()-]{{7,15}}$') AND length({_V}) < 20 AND NOT regexp_matches({_V}, '[0-9]') THEN 0.15 ELSE 0.0 END
    WHEN 'authority' THEN CASE WHEN {' OR '.join(f"contains(right({_LEAD}, 199), {q(k)})" for k in spans.COPY_TO)} THEN 0.15 WHEN NOT {any_of(f'lower({_V})', spans.AUTHORITY_WORDS)} THEN 0.10 ELSE 0.0 END
    WHEN 'date' THEN CASE WHEN y IS NULL THEN 0.15 WHEN y < 1900 OR y > 2042 THEN 0.20 ELSE 0.0 END
    WHEN 'notice_number' THEN 0.0 ELSE CASE WHEN length({_V}) < 2 THEN 0.10 ELSE 0.0 END END"""
_CONSISTENCY = f"""
    WITH f AS (SELECT doc_id, field, value, t, year({_DAY}) AS y FROM (SELECT *, {_fold_date('value')} AS v FROM {_best(_SPANS)})),
    p AS (SELECT doc_id, sum({_PENALTY})::DOUBLE AS penalties FROM f GROUP BY 1),
    d AS (SELECT doc_id, type, {_DAY}::DATE AS day FROM (SELECT doc_id, type, {_fold_date('value')} AS v FROM ({_types_sql()})) WHERE {_DAY} IS NOT NULL),
    n AS (SELECT doc_id, count(DISTINCT day) AS days, count(*) FILTER (type = 'START_DATE') AS starts, count(*) FILTER (type IN ('END_DATE', 'DEADLINE')) AS ends FROM d GROUP BY 1),
    i AS (SELECT a.doc_id, count(*) AS inv FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.type = 'START_DATE' AND b.type IN ('END_DATE', 'DEADLINE') AND a.day > b.day GROUP BY 1),
    j AS (SELECT doc_id, round(penalties, 4) AS penalties, CASE WHEN days > 1 AND NOT (starts > 0 AND ends > 0) THEN 1 ELSE 0 END AS conflicts, CASE WHEN days > 1 THEN coalesce(inv, 0) ELSE 0 END AS inversions FROM p LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id))
    SELECT *, greatest(0.0, round(round((1.0 - penalties - 0.1 * conflicts - 0.2 * inversions)::DOUBLE, 6), 2)) AS consistency, greatest(0.0, round(round((1.0 - penalties - 0.1 * conflicts - 0.2 * inversions)::DOUBLE, 6), 2)) >= 0.6 AS consistent FROM j"""
_BIO = "[" + ", ".join(q(x) for x in annotate.BIO) + "]"
_REC = """(SELECT document_id, x.text AS text, x.document_title AS a, x.issuing_authority AS b, x.issue_date AS c, x.document_type AS kind FROM (
    SELECT document_id, max({'text': text, 'document_title': document_title, 'issuing_authority': issuing_authority, 'issue_date': issue_date, 'document_type': document_type}) AS x FROM annotation_corpus WHERE text IS NOT NULL GROUP BY 1))"""
_CHUNKS = rf"""(
    WITH r AS (SELECT *, length(text) % 3 = 0 AND length(text) > 30 AS own FROM {_REC} WHERE text <> ''),
    l AS (SELECT * FROM r WHERE own OR a <> '' OR b <> '' OR c <> ''),
    f AS (SELECT document_id, 0 AS s, 30 AS e, 'TITLE' AS lab FROM l WHERE own
          UNION ALL SELECT document_id, instr(text, v) - 1, instr(text, v) - 1 + length(v), lab FROM (SELECT document_id, text, own, a AS v, 'TITLE' AS lab FROM l UNION ALL SELECT document_id, text, own, b, 'AUTHORITY' FROM l UNION ALL SELECT document_id, text, own, c, 'DATE' FROM l) WHERE NOT own AND v <> '' AND contains(text, v)),
    o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s, e, lab) AS k FROM f),
    g AS (SELECT document_id, max(CASE WHEN k = 1 THEN e END) AS e1, max(CASE WHEN k = 2 THEN s END) AS s2, max(CASE WHEN k = 2 THEN e END) AS e2 FROM o GROUP BY 1),
    p AS (SELECT document_id, s, e, lab FROM o JOIN g USING (document_id) WHERE k = 1 OR (k = 2 AND s >= e1) OR (k = 3 AND s >= CASE WHEN s2 >= e1 THEN e2 ELSE e1 END)),
    w AS ({find_all('l', 'document_id', 'text', r'[^ \t\n\x0B\f\r]+')}),
    t AS (SELECT w.document_id, w.i, w.value, coalesce('B-' || p.lab, 'O') AS lab FROM w LEFT JOIN p ON w.document_id = p.document_id AND w."start" >= p.s AND w."start" < p.e),
    n AS (SELECT document_id, kind, coalesce(m, 0) AS m FROM l LEFT JOIN (SELECT document_id, count(*) AS m FROM t GROUP BY 1) USING (document_id)),
    c AS (SELECT document_id, kind, m, c AS chunk_index, c * 382 AS a, least(m, c * 382 + 510) AS b FROM n, unnest(range(0, CASE WHEN m <= 510 THEN 1 ELSE 1 + ceil((m - 510) / 382.0)::INT END)) AS u(c))
    SELECT c.document_id, chunk_index, count(t.i) + 2 AS n, md5(concat_ws(' ', '[CLS]', string_agg(t.value, ' ' ORDER BY t.i), '[SEP]')) AS digest,
           concat_ws(',', '-100', string_agg((list_position({_BIO}, t.lab) - 1)::VARCHAR, ',' ORDER BY t.i), '-100') AS labels,
           CASE any_value(kind) WHEN 'Notification' THEN 1 WHEN 'Ordinance' THEN 2 WHEN 'Draft Rule' THEN 3 ELSE 0 END AS doc_label_id
    FROM c LEFT JOIN t ON t.document_id = c.document_id AND t.i > a AND t.i <= b GROUP BY 1, 2)"""

QUERIES = {
    "heuristic_spans": (heuristic_spans, f"""SELECT doc_id, field, score, s AS "start", e AS "end", value FROM {_SPANS}"""),
    "best_spans": (best_spans, f"""SELECT doc_id, field, s AS "start", e AS "end", value FROM {_best(_QUIET)}"""),
    "field_decision": (field_decision, f"SELECT doc_id, field, confidence, decision, CASE decision WHEN 'ACCEPT' THEN 'HIGH_CONFIDENCE' WHEN 'ABSTAIN' THEN 'LOW_CONFIDENCE' ELSE 'NOT_FOUND' END AS status FROM {_DECIDED}"),
    "field_pivot": (field_pivot, "SELECT doc_id, " + ", ".join(f"max(CASE WHEN field = {q(f)} AND decision = 'ACCEPT' THEN value END) AS {f}" for f in spans.FIELDS) + f" FROM {_DECIDED} GROUP BY 1"),
    "inbox_items": (inbox_items, f"""SELECT doc_id, list_sort(list_filter([{', '.join(q(f) for f in spans.FIELDS)}], lambda f: NOT list_contains(coalesce(have, []), f))) AS missing
        FROM documents LEFT JOIN (SELECT doc_id, list(DISTINCT field) AS have FROM {_DECIDED} WHERE decision = 'ACCEPT' GROUP BY 1) h USING (doc_id) WHERE len(list_filter([{', '.join(q(f) for f in spans.FIELDS)}], lambda f: NOT list_contains(coalesce(have, []), f))) > 0"""),
    "evidence_sentence": (evidence_sentence, f"""SELECT doc_id, field, CASE WHEN ok THEN a END AS sentence_start, CASE WHEN ok THEN b END AS sentence_end, CASE WHEN ok THEN md5({strip('substr(t, (a + 1)::BIGINT, (b - a)::BIGINT)')}) END AS digest, CASE WHEN ok THEN 'VALID_SPAN' ELSE 'LOW_CONFIDENCE' END AS span_status
        FROM (SELECT *, {_VALID} AS ok, {_A} AS a, {_B} AS b FROM {_best(_SPANS)})"""),
    "consistency_score": (consistency_score, _CONSISTENCY),
    "extract_fields": (extract_fields, f"""SELECT doc_id, field, penalty, confidence, CASE WHEN confidence >= {_T} THEN 'ACCEPT' ELSE 'ABSTAIN' END AS decision, CASE WHEN confidence >= {_T} THEN 'HIGH_CONFIDENCE' ELSE 'LOW_CONFIDENCE' END AS status
        FROM (SELECT *, round(greatest(0.0, least(1.0, (({_w(0)}) * score + ({_w(1)}) + ({_w(2)}) + ({_w(3)}) * CASE WHEN penalty = 0 THEN 1.0 ELSE 0.4 END)::DOUBLE)), 4) AS confidence
        FROM (SELECT *, ({_PENALTY})::DOUBLE AS penalty FROM (SELECT *, year({_DAY}) AS y FROM (SELECT *, {_fold_date('value')} AS v FROM {_best(_QUIET)}))))"""),
    "analyse": (analyse, f"""WITH o AS (SELECT doc_id, priority, row_number() OVER (PARTITION BY doc_id ORDER BY obligation_id) AS r, count(*) OVER (PARTITION BY doc_id) AS n, false AS fallback FROM {_OBL}),
        x AS (SELECT doc_id, priority, fallback, n FROM o WHERE r = 1 UNION ALL SELECT doc_id, 'HIGH', true, 1 FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM o))
        SELECT priority, fallback, count(*) AS notices, sum(n) AS obligations FROM x WHERE doc_id IN (SELECT doc_id FROM documents WHERE length({strip('text')}) >= 10) GROUP BY 1, 2"""),
    "metadata_cascade": (metadata_cascade, f"SELECT doc_id, issuing_authority, notice_type, notice_title, notice_ref_no, notice_date, acts, jurisdiction FROM {_META}"),
    "obligations": (obligations, f"""SELECT doc_id, obligation_id, md5(line) AS digest, priority, title_word, raw_deadline, penalty_clause, penalty_amount, s AS "start", s + length(line) AS "end" FROM {_OBL}"""),
    "deadline_resolution": (deadline_resolution, f"SELECT doc_id, obligation_id, strftime(deadline, '%Y-%m-%d') AS deadline, greatest(0, deadline - DATE '{AS_OF}') AS days_left FROM {_DUE}"),
    "obligations_by_priority": (obligations_by_priority, f"SELECT priority, count(*) AS obligations, count(DISTINCT doc_id) AS notices, round(sum(penalty_amount), 2) AS penalties, strftime(min(deadline), '%Y-%m-%d') AS earliest FROM {_DUE} GROUP BY 1"),
    "obligations_or_fallback": (obligations_or_fallback, f"""SELECT doc_id, obligation_id, md5(line) AS digest, priority, penalty_amount, s AS "start", s + length(line) AS "end", false AS fallback FROM {_OBL}
        UNION ALL SELECT doc_id, 'OBL-01', md5(substr(text, 1, 150)), 'HIGH', 5000.0, 0, least(150, length(text)), true FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM {_OBL})"""),
    "obligation_evidence": (obligation_evidence, f"""SELECT doc_id, replace(obligation_id, 'OBL', 'EVD') AS evidence_id, obligation_id, md5(line) AS digest, s AS "start", s + length(line) AS "end" FROM {_OBL}"""),
    "notices_without_obligations": (notices_without_obligations, f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {_OBL})"),
    "input_check": (input_check, f"SELECT coalesce(length({strip('text')}) >= 10, false) AS valid, count(*) AS documents FROM documents GROUP BY 1"),
    "span_validate": (span_validate, f"SELECT document_id, entity_index, error_type FROM {_ERRORS}"),
    "validation_report": (validation_report, f"SELECT error_type, count(*) AS errors, count(DISTINCT document_id) AS documents FROM {_ERRORS} GROUP BY 1"),
    "span_report": (span_report, f"""SELECT count(*) AS documents, count(e) AS invalid, count(*) - count(e) AS valid, coalesce(sum(e), 0) AS errors, 0 AS warnings, 0 AS parse_errors, coalesce(sum(e), 0) = 0 AS is_clean
        FROM (SELECT DISTINCT document_id, text FROM annotation_corpus) LEFT JOIN (SELECT document_id, count(*) AS e FROM {_ERRORS} GROUP BY 1) USING (document_id)"""),
    "bio_labels": (bio_labels, f"""SELECT coalesce('B-' || upper(f), 'O') AS label, count(*) AS tokens FROM (SELECT w.doc_id, w.i, arg_min(field, (p.s, p.e, upper(field))) AS f FROM {_WORDS} w
        LEFT JOIN (SELECT * FROM {_best(_SPANS)} WHERE field <> 'notice_number') p ON w.doc_id = p.doc_id AND w."start" >= p.s AND w."start" < p.e GROUP BY 1, 2) GROUP BY 1"""),
    "training_chunks": (training_chunks, f"SELECT document_id, chunk_index, n, digest, labels, doc_label_id FROM {_CHUNKS}"),
    "chunk_splits": (chunk_splits, f"""WITH n AS (SELECT count(DISTINCT document_id) AS n FROM {_CHUNKS}), s AS (SELECT n, greatest(1, round_even(n * 0.15, 0)::BIGINT) AS k FROM n)
        SELECT 'test' AS split, k AS documents FROM s UNION ALL SELECT 'validation', k FROM s UNION ALL SELECT 'train', n - 2 * k FROM s"""),
    "token_windows": (token_windows, r"""SELECT doc_id, c AS chunk_index, c * 382 AS window_start, least(n, c * 382 + 510) AS window_end FROM (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents WHERE text IS NOT NULL) a,
        unnest(range(0, CASE WHEN n <= 510 THEN 1 ELSE 1 + ceil((n - 510) / 382.0)::INT END)) AS u(c)"""),
    "doc_split": (doc_split, """SELECT document_id, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.30 THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT DISTINCT document_id, ('0x' || substr(md5('42:' || document_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM train)"""),
    "decode_entities": (decode_entities, f"SELECT * FROM {_DECODED}"),
    "entity_f1": (entity_f1, f"""
        WITH g AS (SELECT DISTINCT * FROM {_DECODED}), f AS (SELECT DISTINCT document_id, chunk_index, first_token, CASE WHEN first_token % 7 = 0 THEN last_token + 1 ELSE last_token END AS last_token, label FROM {_DECODED} WHERE first_token % 5 <> 0),
        j AS (SELECT coalesce(g.label, f.label) AS label, g.label AS a, f.label AS b FROM g FULL JOIN f ON g.document_id = f.document_id AND g.chunk_index = f.chunk_index AND g.first_token = f.first_token AND g.last_token = f.last_token AND g.label = f.label),
        c AS (SELECT label, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS fn FROM j GROUP BY 1),
        p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c)
        SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM p"""),
    "latest_version": (latest_version, "SELECT document_id, strftime(collected_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS collected, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY collected_at DESC NULLS LAST, text DESC NULLS LAST) AS r FROM annotation_corpus) WHERE r = 1"),
    "align_labels": (align_labels, f"""
        WITH w AS (SELECT doc_id, max(CASE WHEN field = 'title' THEN value END) AS title, max(CASE WHEN field = 'contact' THEN value END) AS contact, max(CASE WHEN field = 'notice_number' THEN value END) AS num FROM {_DECIDED} WHERE decision = 'ACCEPT' GROUP BY 1),
        f AS (SELECT doc_id, v, lab, instr(text, v) - 1 AS s, instr(text, v) - 1 + length(v) AS e FROM documents JOIN (SELECT doc_id, title AS v, 'TITLE' AS lab FROM w UNION ALL SELECT doc_id, contact, 'CONTACT' FROM w UNION ALL SELECT doc_id, num, 'DOCUMENT' FROM w) x USING (doc_id) WHERE v <> '' AND contains(text, v)),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, lab) AS r FROM f),
        a AS (SELECT doc_id, max(CASE WHEN r = 1 THEN e END) AS e1, max(CASE WHEN r = 2 THEN s END) AS s2, max(CASE WHEN r = 2 THEN e END) AS e2 FROM o GROUP BY 1)
        SELECT doc_id, s AS "start", e AS "end", lab AS label FROM o JOIN a USING (doc_id) WHERE r = 1 OR (r = 2 AND s >= e1) OR (r = 3 AND s >= CASE WHEN s2 >= e1 THEN e2 ELSE e1 END)"""),
}

