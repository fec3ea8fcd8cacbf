"""Fields of a notice as spans with offsets: found by rules, merged with a model's, resolved, scored and decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouped import first_by
from ..functions.text import contains_any, each, find_all, first_capture, lines, rfind, strip

FIELDS = ["title", "authority", "date", "contact", "audience", "eligibility", "document", "notice_number"]
# fixed values: words of titles; patterns of authorities, in order of precedence, and what each must hold
TITLE_WORDS = ["NOTIFICATION", "CIRCULAR", "SHOW CAUSE", "PUBLIC NOTICE", "ORDINANCE", "DRAFT", "ADVISORY", "MEMORANDUM"]
AUTHORITIES = [
    r"MINISTRY OF [A-Z\s&]+(?:AND\s+[A-Z\s&]+)?", r"DEPARTMENT OF [A-Z\s&]+(?:AND\s+[A-Z\s&]+)?", r"GOVERNMENT OF [A-Z\s&]+", r"[A-Z\s&]+UNIVERSITY",
    r"FOOD SAFETY AND STANDARDS AUTHORITY[A-Z\s&]*", r"EMPLOYEES['\s]*PROVIDENT FUND ORGANISATION", r"CENTRAL BOARD OF [A-Z\s&]+", r"DIRECTORATE GENERAL OF [A-Z\s&]+",
    r"REGISTRAR OF [A-Z\s&]+", r"[A-Z\s&]+COMMISSION", r"[A-Z\s&]+BOARD", r"[A-Z\s&]+CORPORATION", r"[A-Z\s&]+AUTHORITY",
]
AUTHORITY_NEEDS = ["MINISTRY OF", "DEPARTMENT OF", "GOVERNMENT OF", "UNIVERSITY", "FOOD SAFETY", "PROVIDENT FUND", "CENTRAL BOARD OF", "DIRECTORATE GENERAL OF", "REGISTRAR OF", "COMMISSION", "BOARD", "CORPORATION", "AUTHORITY"]
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE = rf"(?i)\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTH})[,\s]+\d{{4}}|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}"
CONTACT = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+|\+?\d[\d\s-]{9,14}"
# fixed values: phrases before a field's value, and what the value is made of
CAPTURES = {
    "audience": (r"(?:Eligible persons|Intended Audience|Applies to|To all|All registered|Target Audience|For the attention of)[:\s]+", r"[^\n.]+"),
    "eligibility": (r"(?:Eligibility|Eligible|Qualification|Who can apply|Prerequisites)[:\s]+", r"[^\n.]+"),
    "document": (r"(?:Required documents|Documents required|Enclosures|Attachments|Proof required)[:\s]+", r"[^\n.;]+"),
    "notice_number": (r"(?:DIN|REF|NOTICE\s*NO|MEMO\s*NO|F\.?\s*NO|NO\.)[:\s.-]+", r"[A-Z0-9/-]{5,}"),
}
# strings of which every match holds one, in small letters; texts without them are not searched
CAPTURE_NEEDS = {
    "audience": ["eligible persons", "intended audience", "applies to", "to all", "all registered", "target audience", "for the attention of"],
    "eligibility": ["eligib", "qualification", "who can apply", "prerequisites"],
    "document": ["required documents", "documents required", "enclosures", "attachments", "proof required"],
    "notice_number": ["din", "ref", "notice", "memo", "f", "no."],
}
SCORES = {"audience": 0.85, "eligibility": 0.85, "document": 0.85, "notice_number": 0.90}
# fixed values: spans that are noise; least confidences by field
NOISE = [")", "(", "OF", "AND", "TO", "A", "THE", "IN", "IS"]
THRESHOLDS = {"title": 0.75, "authority": 0.80, "date": 0.80, "contact": 0.70, "audience": 0.70, "eligibility": 0.75, "document": 0.75, "notice_number": 0.75}
# fixed values: weights of the signals (model, ocr, evidence, consistency) by field
WEIGHTS = {
    "title": (0.50, 0.20, 0.20, 0.10), "authority": (0.45, 0.20, 0.25, 0.10), "date": (0.40, 0.30, 0.20, 0.10), "contact": (0.35, 0.30, 0.25, 0.10),
    "eligibility": (0.50, 0.20, 0.20, 0.10), "audience": (0.50, 0.20, 0.20, 0.10), "document": (0.50, 0.20, 0.20, 0.10),
}
DEFAULT_WEIGHTS = (0.45, 0.25, 0.20, 0.10)
# fixed values: words of authorities, and what stands before those who get copies
AUTHORITY_WORDS = ["ministry", "department", "board", "commission", "authority", "council", "office", "directorate", "government", "bureau", "cbic", "cbdt", "fssai", "mca", "epfo", "roc", "university", "institute", "controller", "registrar", "मंत्रालय", "विभाग", "कार्यालय", "सरकार"]
COPY_TO = ["copy to", "copies to", "copy forwarded to", "endorsed to", "for information", "प्रतिलिपि", "की प्रति"]


def _span(field: str, score: Column, start: Column, end: Column, text: str = "_t") -> Column:
    return F.struct(F.lit(field).alias("field"), score.cast("double").alias("score"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.col(text).substr(start + 1, end - start).alias("value"))


def _fast(pattern: str) -> str:
    """A run of capitals can only begin where none ends before it: so each run is tried once, not from each of its letters."""
    return r"(?<![A-Z\s&])" + pattern if pattern.startswith("[A-Z") else pattern


def _grounded(span: Column, text: Column) -> Column:
    """The span with the bounds of the sentence round it."""
    a, b = sentence_before(text, span["start"]), span["end"] + sentence_rest(text, span["end"])
    return F.struct(*[span[c].alias(c) for c in ("field", "score", "start", "end", "value")], a.cast("int").alias("sentence_start"), b.cast("int").alias("sentence_end"), strip(text.substr(a + 1, b - a)).alias("evidence"))


def _found(df: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """(_key, kept columns, _t, _every): all spans of a text as one array."""
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_t"), *keep).filter(F.length(strip(F.col(text))) > 0)
    base = base.withColumns({"_lines": lines(F.col("_t")), "_up": F.upper("_t"), "_low": F.lower("_t")})
    marked = F.filter(F.transform("_lines", lambda x: F.struct(x.alias("l"), F.upper(x).alias("u"))), lambda x: contains_any(x["u"], TITLE_WORDS))
    first, second = F.try_element_at("_lines", F.lit(1)), F.try_element_at("_lines", F.lit(2))
    fallback = F.when((F.size("_lines") > 1) & (F.length(first) <= 10), second).otherwise(first)
    base = base.withColumns({"_marked": F.when(contains_any(F.col("_up"), TITLE_WORDS), F.try_element_at(marked, F.lit(1))["l"])})
    base = base.withColumns({"_title": F.coalesce("_marked", fallback)})
    at = F.expr("locate(_title, _t)") - 1
    title = _span("title", F.when(F.col("_marked").isNotNull(), 0.90).otherwise(0.75), at, at + F.length("_title"))
    auth = None
    for p, needed in zip(AUTHORITIES, AUTHORITY_NEEDS):
        hit = first_capture("_up", "", _fast(p), needs=[needed])
        auth = hit if auth is None else F.coalesce(auth, hit)
    captures = {f"_{f}": first_capture("_t", *p, flags="(?i)", needs=CAPTURE_NEEDS[f], needs_in="_low") for f, p in CAPTURES.items()}
    base = base.withColumns({"_auth": auth, "_dates": find_all("_t", DATE), "_contact": first_capture("_t", "", CONTACT), **captures})
    a0 = F.col("_auth.start")
    authority = F.when(F.col("_auth").isNotNull(), _span("authority", F.lit(0.88), a0, a0 + F.length(strip(F.col("_t").substr(a0 + 1, F.col("_auth.end") - a0)))))
    parts = [F.when(at >= 0, title), authority]
    parts.append(F.when(F.col("_contact").isNotNull(), _span("contact", F.lit(0.90), F.col("_contact.start"), F.col("_contact.end"))))
    for f in CAPTURES:
        parts.append(F.when(F.col(f"_{f}").isNotNull(), _span(f, F.lit(SCORES[f]), F.col(f"_{f}.start"), F.col(f"_{f}.end"))))
    every = F.concat(F.array_compact(F.array(*parts)), F.transform("_dates", lambda d: _span("date", F.lit(0.92), d["start"], d["end"])))
    return base.select("_key", *keep, "_t", every.alias("_every"))


def find_spans(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, field, score, start, end, value): one row per span; dates may be several. Row-wise, no shuffle."""
    return each(_found(df, key, text, []), ["_key"], F.col("_every"), "_s").select(F.col("_key").alias(key), "_s.*")


def _quiet(x: Column) -> Column:
    return (F.length(strip(x["value"])) >= 3) & ~strip(x["value"]).isin(NOISE)


def best_array(every: Column) -> Column:
    """Of an array of spans one per field: the highest score, of equal ones the first in text order."""
    ranked = lambda f: F.array_min(F.transform(F.filter(every, lambda x: x["field"] == f), lambda x: F.struct((-x["score"]).alias("r"), x["start"].alias("start"), x["end"].alias("end"), x.alias("x"))))["x"]
    return F.array_compact(F.array(*[ranked(f) for f in FIELDS]))


def spans_of(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, text, spans): the best span per field as one array of a row."""
    return _found(df, key, text, []).select(F.col("_key").alias(key), F.col("_t").alias(text), best_array(F.col("_every")).alias("spans"))


def find_best(df: DataFrame, key: str = "document_id", text: str = "text", noise: bool = True, evidence: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(key, kept columns, field, score, start, end, value and with ``evidence`` sentence_start, sentence_end, evidence): the best
    span per field, with ``noise`` False after drop_noise. As best_spans of find_spans, but within the row: no shuffle."""
    found = _found(df, key, text, keep or [])
    best = best_array(F.col("_every") if noise else F.filter("_every", _quiet))
    if evidence:
        best = F.transform(best, lambda x: _grounded(x, F.col("_t")))
    return each(found, ["_key", *(keep or [])], best, "_s").select(F.col("_key").alias(key), *(keep or []), "_s.*")


def drop_noise(spans: DataFrame) -> DataFrame:
    return spans.filter((F.length(strip(F.col("value"))) >= 3) & ~strip(F.col("value")).isin(NOISE))


def best_spans(spans: DataFrame, key: str = "document_id") -> DataFrame:
    """One span per field: the highest score, of equal ones the first in text order."""
    return first_by(spans, [key, "field"], [F.desc("score"), F.asc("start"), F.asc("end")])


def merge(model: DataFrame, rules: DataFrame, key: str = "document_id") -> DataFrame:
    """Per field the model's span; the rules' where it is missing, or shorter than ten characters and shorter than theirs."""
    m = best_spans(drop_noise(model), key).select(F.col(key).alias("_k"), F.col("field").alias("_f"), F.struct("score", "start", "end", "value").alias("_m"))
    r = best_spans(rules, key).select(key, "field", F.struct("score", "start", "end", "value").alias("_r"))
    both = r.join(m, (F.col(key) == F.col("_k")) & (F.col("field") == F.col("_f")), "full_outer")
    pick = F.when(F.col("_m").isNull() | ((F.length("_m.value") < 10) & (F.length("_r.value") > F.length("_m.value"))), F.coalesce("_r", "_m")).otherwise(F.col("_m"))
    return both.select(F.coalesce(key, "_k").alias(key), F.coalesce("field", "_f").alias("field"), pick.alias("_p")).select(key, "field", "_p.*")


def add_dates(model: DataFrame, rules: DataFrame, key: str = "document_id", near: int = 5) -> DataFrame:
    """The model's dates and those of the rules that start nowhere near one of them, or near an earlier one of the rules."""
    m = model.select(F.col(key).alias("_k"), F.col("start").alias("_s"))
    fresh = rules.join(m, (F.col(key) == F.col("_k")) & (F.abs(F.col("start") - F.col("_s")) < near), "left_anti")
    held = F.sort_array(F.collect_list(F.struct("start", "end", "score", "value")))
    kind = "array<struct<start:int,end:int,score:double,value:string>>"
    keep = F.expr(f"aggregate(_h, cast(array() as {kind}), (a, x) -> if(exists(a, y -> abs(y.start - x.start) < {near}), a, concat(a, array(x))))")
    own = fresh.groupBy(key).agg(held.cast(kind).alias("_h")).select(key, F.explode(keep).alias("_d")).select(key, "_d.*")
    return model.select(key, "start", "end", "score", "value").unionByName(own.select(key, "start", "end", "score", "value"))


def sentence_before(text: Column, start: Column) -> Column:
    """Where the sentence around ``start`` begins."""
    return F.length(F.regexp_extract(text.substr(F.lit(1), start), r"(?s)^(.*[.\n?!]\s+)", 1))


def sentence_rest(text: Column, end: Column) -> Column:
    """How much of the sentence stands behind ``end``, its stop included."""
    return F.length(F.regexp_extract(text.substr(end + 1, F.length(text)), r"(?s)^([^.\n?!]*[.\n?!]?)", 1))


def evidence(spans: DataFrame, docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """Adds evidence (the sentence around the span), sentence_start, sentence_end and span_status (VALID_SPAN or
    LOW_CONFIDENCE for offsets outside the text, inverted, or over blanks; those lose their value and confidence)."""
    t = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    j = spans.join(t, F.col(key) == F.col("_k")).drop("_k")
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("_t"))
    body = F.col("_t").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    ok = F.coalesce(ok & (F.length(strip(body)) > 0), F.lit(False))
    a, b = sentence_before(F.col("_t"), F.col("start")), F.col("end") + sentence_rest(F.col("_t"), F.col("end"))
    return j.select(
        *[F.col(c) for c in spans.columns if c not in ("value", "score")],
        F.when(ok, body).alias("value"), F.when(ok, F.col("score")).otherwise(0.0).alias("score"),
        F.when(ok, a).alias("sentence_start"), F.when(ok, b).alias("sentence_end"),
        F.when(ok, strip(F.col("_t").substr(a + 1, b - a))).alias("evidence"),
        F.when(ok, "VALID_SPAN").otherwise("LOW_CONFIDENCE").alias("span_status"),
    )


def locate_original(found: str, original: str) -> Column:
    """1-based place of the column ``found`` in the column ``original``: as it is, in any case, or with blanks folded (then
    in the folded original); 0 if nowhere."""
    flat = lambda c: f"lower(regexp_replace({c}, r'\\s+', ' '))"
    ways = [f"locate({found}, {original})", f"locate(lower({found}), lower({original}))", f"locate({flat(found)}, {flat(original)})"]
    return F.coalesce(*[F.nullif(F.expr(w), F.lit(0)) for w in ways], F.lit(0))


def word_spans(words: DataFrame, key: list[str]) -> DataFrame:
    """Adds start and end of every word in the text of a page joined with single blanks. Words of a page are one window."""
    from ..functions.grouped import running_sum

    out = running_sum(words, key, "ord", F.length("text") + 1, "start")
    return out.withColumn("end", F.col("start") + F.length("text"))


def ocr_overlap(spans: DataFrame, words: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds c_ocr, the mean confidence of the words that overlap the span, and the union of their boxes."""
    w = words.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), "confidence", "x1", "y1", "x2", "y2")
    hit = spans.join(w, (F.col(key) == F.col("_k")) & (F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start")))
    return hit.groupBy(*[F.col(c) for c in spans.columns]).agg(F.avg("confidence").alias("c_ocr"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("words"))


def evidence_box(spans: DataFrame, words: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, field, x1, y1, x2, y2): the box round all words of the span's page whose text stands somewhere in the evidence, in any
    case; short words match often, so the box may be wide. spans: (key, field, page_number, evidence)."""
    w = words.select(F.col(key).alias("_k"), F.col("page_number").alias("_p"), F.lower(strip(F.col("text"))).alias("_w"), "x1", "y1", "x2", "y2").filter("_w <> ''")
    s = spans.select(key, "field", "page_number", F.lower(strip(F.col("evidence"))).alias("_e"))
    hit = s.join(w, (F.col(key) == F.col("_k")) & (F.col("page_number") == F.col("_p")) & F.contains("_e", "_w"))
    return hit.groupBy(key, "field").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def quality_word(score: Column) -> Column:
    return F.when(score >= 0.80, "GOOD").when(score >= 0.60, "MODERATE").when(score >= 0.40, "POOR").otherwise("VERY_POOR")


def page_of(spans: DataFrame, pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds page_number of the page that holds the span's start."""
    p = pages.select(F.col(key).alias("_k"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b"), "page_number")
    return spans.join(p, (F.col(key) == F.col("_k")) & (F.col("start") >= F.col("_a")) & (F.col("start") < F.col("_b")), "left").drop("_k", "_a", "_b")


def weight(field: Column, n: int) -> Column:
    out = None
    for f, w in WEIGHTS.items():
        out = F.when(field == f, w[n]) if out is None else out.when(field == f, w[n])
    return out.otherwise(DEFAULT_WEIGHTS[n])


def confidence(field: Column, model: Column, ocr: Column, available: Column, complete: Column, consistent: Column) -> Column:
    """The weighted signals, between 0 and 1, to four places."""
    ev = F.when(available, F.when(complete, 1.0).otherwise(0.8)).otherwise(0.0)
    s = weight(field, 0) * model + weight(field, 1) * ocr + weight(field, 2) * ev + weight(field, 3) * F.when(consistent, 1.0).otherwise(0.4)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 4)


def threshold(field: Column, default: float = 0.85) -> Column:
    out = None
    for f, t in THRESHOLDS.items():
        out = F.when(field == f, t) if out is None else out.when(field == f, t)
    return out.otherwise(default)


def decide(value: Column, conf: Column, least: Column) -> Column:
    return F.when(value.isNotNull() & (value != "") & (conf >= least), "ACCEPT").when(value.isNotNull() & (value != ""), "ABSTAIN").otherwise("NOT_FOUND")


def abstain(fields: DataFrame) -> DataFrame:
    """Adds decision and status; a value below its field's threshold is withheld with its evidence."""
    d = decide(F.col("value"), F.col("confidence"), threshold(F.col("field")))
    out = fields.withColumn("decision", d)
    keep = F.col("decision") == "ACCEPT"
    hidden = {c: F.when(keep, F.col(c)) for c in ("value", "evidence") if c in fields.columns}
    return out.withColumns(hidden | {"status": F.when(keep, "HIGH_CONFIDENCE").when(F.col("decision") == "ABSTAIN", "LOW_CONFIDENCE").otherwise("NOT_FOUND")})


def field_penalty(field: Column, value: Column, text: Column, parsed_year: Column, year_now: int) -> Column:
    """What a field's value costs the document's consistency; 0 if it looks right."""
    value = strip(value)
    low = F.lower(value)
    odd_contact = ~value.rlike(r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$") & ~value.rlike(r"^\+?[\d\s\-()]{7,15}$") & (F.length(value) < 20) & ~value.rlike(r"\d")
    lead = F.lower(text).substr(F.lit(1), F.greatest(F.position(low, F.lower(text)) - 1, F.lit(0)))
    near_copy = F.lit(False)
    for k in COPY_TO:
        at = rfind(lead, k)
        near_copy = near_copy | ((at >= 0) & (F.length(lead) - at < 200))
    authority = F.when(near_copy, 0.15).when(~contains_any(low, AUTHORITY_WORDS), 0.10).otherwise(0.0)
    date = F.when(parsed_year.isNull(), 0.15).when((parsed_year < 1900) | (parsed_year > year_now + 10), 0.20).otherwise(0.0)
    return (
        F.when(value.isNull() | (value == ""), 0.0)
        .when(field == "contact", F.when(odd_contact, 0.15).otherwise(0.0))
        .when(field == "authority", authority)
        .when(field == "date", date)
        .when(field.isin("title", "audience", "eligibility", "document"), F.when(F.length(value) < 2, 0.10).otherwise(0.0))
        .otherwise(0.0)
    )


def document_consistency(fields: DataFrame, dates: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, penalties, conflicts, inversions, consistency, consistent): 1 less the fields' penalties, and, if the date fields
    name several days: less 0.2 for each pair of a start and an earlier end or deadline, or less 0.1 if there are not both;
    to two places, not below 0, flagged under 0.6. A date that is given twice counts twice in pairs.

    fields: (key, penalty); dates: (key, type, day). Both are aggregated before they meet; a document's days are one row.
    """
    pen = fields.groupBy(F.col(key).alias("_a")).agg(F.sum("penalty").alias("penalties"))
    of = lambda *kinds: F.collect_list(F.when(F.col("type").isin(*kinds), F.col("day")))
    days = dates.filter(F.col("day").isNotNull()).groupBy(F.col(key).alias("_b")).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"), of("START_DATE").alias("_s"), of("DEADLINE", "END_DATE").alias("_e"))
    late = F.expr("aggregate(_s, 0, (n, x) -> n + size(filter(_e, y -> x > y)))")
    both = (F.size("_s") > 0) & (F.size("_e") > 0)
    several = F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(False))
    j = pen.join(days, F.col("_a") == F.col("_b"), "left")
    j = j.select(F.col("_a").alias(key), F.round("penalties", 4).alias("penalties"), F.when(several & ~both, 1).otherwise(0).alias("conflicts"), F.when(several & both, late).otherwise(0).alias("inversions"))
    score = F.greatest(F.lit(0.0), F.round(F.round(1.0 - F.col("penalties") - 0.1 * F.col("conflicts") - 0.2 * F.col("inversions"), 6), 2))
    return j.withColumn("consistency", score).withColumn("consistent", F.col("consistency") >= 0.6)


def ocr_warning(quality: Column, label: Column) -> Column:
    """The warning about a document whose words were recognised badly; null if they were not."""
    text = F.concat(F.lit("OCR_QUALITY_WARNING: Document OCR quality is "), F.coalesce(label, F.lit("POOR")), F.lit(" (confidence: "), F.format_number(quality, 2), F.lit("). Extraction reliability may be reduced."))
    return F.when(quality < 0.6, text)


def wide(fields: DataFrame, key: str = "document_id") -> DataFrame:
    """One row per document, one column per field."""
    return fields.groupBy(key).pivot("field", FIELDS).agg(F.first("value"))


def accepted_mean(fields: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, confidence): the mean confidence of the fields that have a value and are accepted; 0 if none is."""
    return fields.groupBy(key).agg(F.coalesce(F.round(F.avg(F.when(F.col("decision") == "ACCEPT", F.col("confidence"))), 4), F.lit(0.0)).alias("confidence"))


def document_id(text: Column, prefix: str = "TXT-") -> Column:
    """A repeatable id of a text given without one."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(text), 1, 12)))


def inbox_items(fields: DataFrame, docs: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, missing): documents in which a field was not found or withheld, with the fields' names in order."""
    have = fields.filter(F.col("decision") == "ACCEPT").groupBy(F.col(key).alias("_k")).agg(F.collect_set("field").alias("_have"))  # at most eight names
    missing = F.array_sort(F.array_except(F.array(*[F.lit(f) for f in FIELDS]), F.coalesce("_have", F.array().cast("array<string>"))))
    return docs.select(key).distinct().join(have, F.col(key) == F.col("_k"), "left").select(key, missing.alias("missing")).filter(F.size("missing") > 0)
