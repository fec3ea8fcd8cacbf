"""Metadata and obligations of a notice by rules; deadlines against a given day, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, contains_any, each, strip, title_case

# fixed values: signs of authorities in order of precedence, and the authority they stand for
AUTHORITY_SIGNS = [
    (["HEALTH"], "Ministry of Health & Family Welfare, Government of India"), (["HOME AFFAIRS"], "Ministry of Home Affairs, Government of India"),
    (["INCOME TAX", "CBDT"], "Income Tax Department, Ministry of Finance"), (["CORPORATE AFFAIRS", "ROC", "MCA"], "Registrar of Companies (ROC), Ministry of Corporate Affairs"),
    (["EPFO", "PROVIDENT FUND"], "Employees' Provident Fund Organisation (EPFO)"), (["CERT-IN", "CYBER"], "Indian Computer Emergency Response Team (CERT-In)"),
    (["MUNICIPAL", "TOWN PLANNING"], "Municipal Corporation & Urban Development Authority"), (["CUSTOMS", "DGFT"], "Directorate General of Foreign Trade (DGFT)"),
    (["TEZPUR", "UNIVERSITY"], "Tezpur University / Central University"), (["CBIC", "GST"], "Central Board of Indirect Taxes & Customs (CBIC)"),
]
# fixed values: what stands for nothing found, and the patterns of metadata
NO_AUTHORITY = "Government Authority / Department"
AUTHORITY = r"(MINISTRY OF [A-Z\s&]+|DEPARTMENT OF [A-Z\s&]+|GOVERNMENT OF [A-Z\s&]+|[A-Z\s&]+UNIVERSITY|[A-Z\s&]+BOARD|[A-Z\s&]+COMMISSION)"
AUTHORITY_NEEDS = ["MINISTRY OF", "DEPARTMENT OF", "GOVERNMENT OF", "UNIVERSITY", "BOARD", "COMMISSION"]
TYPE_SIGNS = [
    (["SHOW CAUSE"], "Show Cause Notice (SCN)", "Show Cause Notice under Statutory Act"), (["AUDIT", "SCRUTINY"], "Audit & Scrutiny Notice", "Notice for Statutory Audit & Scrutiny"),
    (["DEMAND"], "Tax & Fine Demand Notice", "Demand Notice for Unpaid Duties / Fines"), (["ADVISORY", "DIRECTIVE"], "Compliance Advisory & Directive", "Statutory Compliance Directive"),
]
NO_TYPE, NO_TITLE, NO_REF = "Show Cause Notice", "Statutory Notice & Obligation Demand", "DIN-2026-884920-CBIC"
REF = r"(?:DIN|REF|NOTICE\s*NO|MEMO\s*NO|F\.?\s*NO)[:\s.-]+([A-Z0-9/-]{6,})"
DATED = r"DATED?\s*[:-]?\s*(\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4})"
# fixed values: signs of acts and of places, and what they stand for
ACTS = [
    (["CGST", "GST"], "Central Goods and Services Tax Act, 2017 (Section 73/74)"), (["INCOME TAX"], "Income Tax Act, 1961 (Section 142(1) / 148)"), (["COMPANIES ACT"], "Companies Act, 2013 (Section 92 / 137)"),
    (["EPF", "PROVIDENT"], "Employees' Provident Funds and Misc Provisions Act, 1952"), (["INFORMATION TECHNOLOGY", "CERT-IN"], "Information Technology Act, 2000 (Section 70B)"),
]
NO_ACT = "Relevant Statutory & Regulatory Provisions"
PLACES = [(["BANGALORE", "KARNATAKA"], "Bengaluru GST & IT Commissionerate, Zone 1"), (["MUMBAI", "MAHARASHTRA"], "Mumbai Corporate Range 4"), (["DELHI"], "Delhi Central Taxes Division")]
NO_PLACE = "Jurisdictional Officer / State Commissionerate"
# fixed values: words that make a line an obligation, by group in order of precedence, with the group's priority
TRIGGERS = [
    (["furnish", "submit", "file", "provide", "deposit"], "HIGH"), (["show cause", "explain", "reply", "written submission"], "CRITICAL"),
    (["pay", "remit", "penalty", "interest", "tax amount"], "CRITICAL"), (["attend", "appear", "produce documents", "books of account"], "HIGH"), (["audit", "rectify", "compliance", "report"], "MEDIUM"),
]
# fixed values: patterns of deadlines and penalties
DEADLINE = r"(within\s+\d+\s+days|by\s+\d{1,2}[/-]\d{1,2}[/-]\d{4}|before\s+[a-z0-9\s,]+)"
NO_DEADLINE = "within 15 days of notice date"
NO_PENALTY = "Statutory interest/fine as applicable under relevant Act"
PENALTY = r"((?:penalty|fine|interest)\s+of\s+₹?\s*(\d+(?:,\d+)*(?:\.\d+)?))"
# a run of capitals can only begin where one ends before it: so each run is tried once, not from each of its letters
AUTHORITY_FAST = AUTHORITY.replace("|[A-Z", r"|(?<![A-Z\s&])[A-Z")
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december"


def _cascade(c: Column, table, value: int, default: str | None) -> Column:
    out = None
    for row in table:
        hit = contains_any(c, row[0])
        out = F.when(hit, row[value]) if out is None else out.when(hit, row[value])
    return out.otherwise(default) if default is not None else out


def notice_date(text: Column, as_of: str, given: Column | None = None) -> Column:
    """The date the text gives for itself, else the given one, else the day of the analysis."""
    own = F.nullif(F.regexp_extract(text, DATED, 1), F.lit(""))
    return F.coalesce(own, F.nullif(given, F.lit("")), F.lit(as_of)) if given is not None else F.coalesce(own, F.lit(as_of))


def metadata(df: DataFrame, as_of: str, key: str = "document_id", text: str = "text", title: str | None = None, date: str | None = None) -> DataFrame:
    """(key, issuing_authority, notice_type, notice_title, notice_ref_no, notice_date, act_rules_cited, jurisdiction). A narrow projection."""
    u = F.upper(F.col("_t"))
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_t"), (F.col(title) if title else F.lit(None).cast("string")).alias("_title"), (F.col(date) if date else F.lit(None).cast("string")).alias("_date")).filter("_t is not null")
    # the search is dear and seldom needed: only texts that hold one of its words are searched
    dynamic = F.when(contains_any(u, AUTHORITY_NEEDS), F.nullif(F.regexp_extract(u, AUTHORITY_FAST, 1), F.lit("")))
    acts = F.array_compact(F.array(*[F.when(contains_any(u, signs), act) for signs, act in ACTS]))
    return base.select(
        F.col("_key").alias(key),
        F.coalesce(_cascade(u, AUTHORITY_SIGNS, 1, None), title_case(dynamic), F.lit(NO_AUTHORITY)).alias("issuing_authority"),
        _cascade(u, TYPE_SIGNS, 1, NO_TYPE).alias("notice_type"),
        F.coalesce(F.nullif(F.col("_title"), F.lit("")), _cascade(u, TYPE_SIGNS, 2, NO_TITLE)).alias("notice_title"),
        F.coalesce(F.nullif(F.regexp_extract(u, REF, 1), F.lit("")), F.lit(NO_REF)).alias("notice_ref_no"),
        notice_date(F.col("_t"), as_of, F.col("_date")).alias("notice_date"),
        F.when(F.size(acts) > 0, acts).otherwise(F.array(F.lit(NO_ACT))).alias("act_rules_cited"),
        _cascade(u, PLACES, 1, NO_PLACE).alias("jurisdiction"),
    )


def trigger(line: Column, column: str = "priority") -> Column:
    low = F.lower(line)
    out = None
    for words, priority in TRIGGERS:
        v = priority if column == "priority" else words[0]
        hit = contains_any(low, words)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


def obligations(df: DataFrame, key: str = "document_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, kept columns, obligation_id, line, priority, title_word, raw_deadline, penalty_clause, penalty_amount, start, end): one
    per line with a trigger word, numbered in text order. ``start`` is the first place of the line's first 25 characters. Row-wise."""
    every = [w for words, _ in TRIGGERS for w in words]
    both = F.transform(F.filter(F.transform(F.split(F.col("_t"), "\n"), strip), lambda x: x != ""), lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    placed = F.transform(F.filter(both, lambda x: contains_any(x["low"], every)), lambda x: F.struct(x["line"].alias("line"), x["low"].alias("low"), F.position(F.substring(x["line"], 1, 25), F.col("_t")).alias("at")))
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep or []]
    out = each(df.select(F.col(key).alias("_key"), F.col(text).alias("_t"), *kept), ["_key", *[f"_keep_{c}" for c in keep or []]], placed, "_l", "_i")
    low, start = F.col("_l.low"), F.greatest(F.col("_l.at") - 1, F.lit(0))
    return out.select(
        F.col("_key").alias(key), *[F.col(f"_keep_{c}").alias(c) for c in keep or []],
        F.format_string("OBL-%02d", F.col("_i") + 1).alias("obligation_id"), F.col("_l.line").alias("line"), trigger(low).alias("priority"), trigger(low, "word").alias("title_word"),
        F.coalesce(F.nullif(F.regexp_extract(low, DEADLINE, 1), F.lit("")), F.lit(NO_DEADLINE)).alias("raw_deadline"),
        F.nullif(F.regexp_extract(low, PENALTY, 1), F.lit("")).alias("penalty_clause"),
        F.replace(F.nullif(F.regexp_extract(low, PENALTY, 2), F.lit("")), F.lit(","), F.lit("")).try_cast("double").alias("penalty_amount"),
        start.alias("start"), (start + F.length("_l.line")).alias("end"),
    )


def evidence_rows(found: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, evidence_id, obligation_id, text, start, end): the line of every obligation as its evidence, numbered alike."""
    number = F.regexp_extract("obligation_id", r"(\d+)$", 1).cast("int")
    return found.select(key, F.format_string("EVD-%02d", number).alias("evidence_id"), "obligation_id", F.col("line").alias("text"), "start", "end")


def with_fallback(found: DataFrame, docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """The obligations, and for every text without any the one that stands for the notice as a whole: its first 150 characters."""
    rest = without_obligations(docs.filter(F.col(text).isNotNull()), found, key)
    made = rest.select(
        F.col(key), F.lit("OBL-01").alias("obligation_id"), F.substring(F.col(text), 1, 150).alias("line"), F.lit("HIGH").alias("priority"), F.lit(None).cast("string").alias("title_word"),
        F.lit(NO_DEADLINE).alias("raw_deadline"), F.lit(NO_PENALTY).alias("penalty_clause"), F.lit(5000.0).alias("penalty_amount"), F.lit(0).alias("start"), F.least(F.lit(150), F.length(text)).alias("end"),
    )
    return found.withColumn("fallback", F.lit(False)).unionByName(made.withColumn("fallback", F.lit(True)), allowMissingColumns=True)


def notice_id(text: Column, prefix: str = "N2A-") -> Column:
    """An id of the text's own: the same text has the same."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(text), 1, 8)))


def base_date(notice_date: Column, as_of: Column) -> Column:
    d = F.btrim(notice_date, F.lit(BLANKS))
    ways = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "MMMM d, yyyy", "d MMMM yyyy"]
    return F.coalesce(*[F.try_to_timestamp(d, F.lit(w)).cast("date") for w in ways], as_of)


def deadline(raw: Column, base: Column) -> Column:
    """The day a deadline ends on: so many days or months of 30 days after the base, a day named, else 14 days after the base."""
    t = F.btrim(F.lower(F.coalesce(raw, F.lit(""))), F.lit(BLANKS))
    number = lambda p, g=1: F.nullif(F.regexp_extract(t, p, g), F.lit("")).try_cast("int")
    days, months = number(r"(?:within|in|by|before)\s+(\d+)\s+days"), number(r"(?:within|in|by|before)\s+(\d+)\s+months")
    dmy, ymd = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    day = lambda p, w: F.try_to_timestamp(F.nullif(F.regexp_replace(F.regexp_extract(t, p, 0), "/", "-"), F.lit("")), F.lit(w)).cast("date")
    named = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\s+(\d{{4}})"
    name = F.try_to_timestamp(F.nullif(F.initcap(F.concat_ws(" ", F.regexp_extract(t, named, 1), F.regexp_extract(t, named, 2), F.regexp_extract(t, named, 3))), F.lit("  ")), F.lit("d MMMM yyyy")).cast("date")
    return F.coalesce(F.date_add(base, days), F.date_add(base, months * 30), F.when(t.rlike(dmy), day(dmy, "d-M-yyyy")).otherwise(day(ymd, "yyyy-M-d")), name, F.date_add(base, 14))


def days_left(day: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(day, as_of))


def valid_input(text: Column) -> Column:
    """Texts worth analysing have ten characters or more between their outer blanks."""
    return F.coalesce(F.length(strip(text)) >= 10, F.lit(False))


def without_obligations(df: DataFrame, found: DataFrame, key: str = "document_id") -> DataFrame:
    """The rows in whose text no obligation was found."""
    return df.join(found.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
