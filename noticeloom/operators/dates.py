"""Dates in running text: where they stand, what they are, what they mean by their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouped import first_by
from ..functions.text import contains_any, each, find_all

# fixed values: names of months
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
HINDI_MONTHS = "जनवरी|फरवरी|मार्च|अप्रैल|मई|जून|जुलाई|अगस्त|सितंबर|अक्टूबर|नवंबर|दिसंबर"
# fixed values: notations of dates, in order of precedence
DATE_PATTERNS = [
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}\b",
    rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s*(?:of\s+)?(?:{MONTHS})\s*,?\s*\d{{4}}\b",
    rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?\s*,?\s*\d{{4}}\b",
    rf"\b\d{{1,2}}\s+(?:{HINDI_MONTHS})\s*,?\s*\d{{4}}\b",
]
# fixed values: what stands before or near a date of each type, in order of precedence
CONTEXT = {
    "ISSUE_DATE": [
        r"dated?\s*[:\-]?\s*$", r"date\s+of\s+issue", r"date\s+of\s+notification", r"date\s+of\s+order", r"date\s+of\s+circular", r"new\s+delhi\s*,?\s*(?:the\s+)?$",
        r"issued?\s+(?:on|dated?)\s*[:\-]?\s*$", r"published\s+(?:on|dated?)\s*[:\-]?\s*$", r"तिथि\s*[:\-]?\s*$", r"दिनांक\s*[:\-]?\s*$",
    ],
    "EFFECTIVE_DATE": [
        r"effective\s+(?:from|date)", r"w\.?\s*e\.?\s*f\.?\s*[:\-]?\s*$", r"with\s+effect\s+from", r"shall\s+come\s+into\s+(?:force|effect)", r"enforced?\s+(?:from|on)",
        r"applicable\s+(?:from|on|w\.e\.f)", r"प्रभावी\s+(?:तिथि|दिनांक)",
    ],
    "START_DATE": [
        r"(?:start|commence|begin|open)\s*(?:ing|s)?\s*(?:from|on|date)?\s*[:\-]?\s*$", r"from\s*[:\-]?\s*$", r"admission\s+(?:start|open|begin)", r"registration\s+(?:start|open|begin)",
        r"apply\s+from", r"आरम्भ\s+(?:तिथि|दिनांक)",
    ],
    "END_DATE": [
        r"(?:end|expir|clos|conclud)\s*(?:ing|e|es|ed)?\s*(?:on|date)?\s*[:\-]?\s*$", r"up\s*to\s*[:\-]?\s*$", r"until\s*[:\-]?\s*$", r"valid\s+(?:till|until|up\s+to)", r"समाप्ति\s+(?:तिथि|दिनांक)",
    ],
    "DEADLINE": [
        r"last\s+date", r"deadline\s*[:\-]?\s*$", r"before\s*[:\-]?\s*$", r"within\s+\d+\s+days\s+(?:of|from)", r"(?:submit|file|furnish|send)\s+(?:by|before|on\s+or\s+before)",
        r"closed?\s+(?:on|from|after)", r"(?:application|reply|submission)\s+(?:last|closing)\s+date", r"अंतिम\s+(?:तिथि|दिनांक)",
    ],
    "EVENT_DATE": [
        r"(?:meeting|hearing|exam|interview|inspection)\s+(?:on|date|scheduled)", r"scheduled\s+(?:on|for)\s*[:\-]?\s*$", r"(?:held|conducted|convened)\s+on",
    ],
    "REFERENCE_DATE": [
        r"as\s+(?:on|of)\s*[:\-]?\s*$", r"refer(?:red|ring|ence)\s+(?:to\s+)?(?:dated?|letter)", r"vide\s+(?:order|letter|notification)\s+(?:no\.?\s+)?.*?dated?", r"mentioned\s+(?:above|below)\s+dated?",
    ],
}
# fixed values: words of a letter's head; types that set a limit
HEADER_SIGNS = ["new delhi", "नई दिल्ली", "notification", "अधिसूचना"]
DEADLINES = ["LAST_DATE", "DEADLINE", "CLOSING_DATE", "END_DATE"]
WINDOW = 120


# strings of which every match of the pattern at this place in CONTEXT holds one; texts without them are not searched
HOLDS = {
    "ISSUE_DATE": ["date", "issue", "notification", "order", "circular", "delhi", "issue", "publish", "तिथि", "दिनांक"],
    "EFFECTIVE_DATE": ["effective", "w", "effect", "come", "enforce", "applicable", "प्रभावी"],
    "START_DATE": ["start|commence|begin|open", "from", "admission", "registration", "apply", "आरम्भ"],
    "END_DATE": ["end|expir|clos|conclud", "up", "until", "valid", "समाप्ति"],
    "DEADLINE": ["last", "deadline", "before", "within", "submit|file|furnish|send", "close", "application|reply|submission", "अंतिम"],
    "EVENT_DATE": ["meeting|hearing|exam|interview|inspection", "scheduled", "held|conducted|convened"],
    "REFERENCE_DATE": ["as", "refer", "vide", "mentioned"],
}


def _numbered(n: int):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(n).alias("pattern"), x["value"].alias("value"))


def date_array(text: str, head: int = 500) -> Column:
    """array<struct<start,end,pattern,value,before,after,header>> of the column ``text``: every date once, by the first notation
    that fits its place, with the 120 characters on both sides and whether it stands in a letter's head."""
    found = None
    for n, p in enumerate(DATE_PATTERNS):
        more = F.transform(find_all(text, p), _numbered(n))
        found = more if found is None else F.concat(found, more)
    t = F.col(text)

    def placed(every: Column) -> Column:
        once = F.filter(every, lambda x: ~F.exists(every, lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]) & (y["pattern"] < x["pattern"])))
        return F.transform(once, lambda x: context(t, x["start"], x["end"], x["pattern"], x["value"], head))

    # one element: the place from which the matches are used several times
    return F.get(F.transform(F.array(found), placed), F.lit(0))


def context(text: Column, start: Column, end: Column, pattern: Column, value: Column, head: int = 500) -> Column:
    """The element of date_array for a date at a known place."""
    lead = F.greatest(start - WINDOW, F.lit(0))
    before = F.lower(text.substr(lead + 1, F.least(start, F.lit(WINDOW))))
    header = F.when(start < head, contains_any(F.lower(text.substr(F.lit(1), start)), HEADER_SIGNS)).otherwise(False)
    return F.struct(start.alias("start"), end.alias("end"), pattern.alias("pattern"), value.alias("value"), before.alias("before"), F.lower(text.substr(end + 1, F.lit(WINDOW))).alias("after"), header.alias("header"))


def find_dates(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, start, end, pattern, value, before, after, header), see date_array. Row-wise; the text itself is not copied."""
    t = df.select(F.col(key).alias("_key"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull())
    return each(t, ["_key"], date_array("_t"), "_d").select(F.col("_key").alias(key), "_d.*")


def classify(dates: DataFrame) -> DataFrame:
    """type and type_confidence in place of before, after and header. A sign right before the date weighs more than one anywhere
    within 120 characters; of equal weights the first in the table counts."""
    around = F.concat("before", F.lit(" "), "after")
    # explode() of one element: a place from which neither filters nor projections copy the long expressions
    base = dates.withColumn("_c", F.explode(F.array(F.struct(around.alias("a"))))).withColumns({"_around": F.col("_c.a")})
    scored, order = [], 0
    for kind, patterns in CONTEXT.items():
        for p, holds in zip(patterns, HOLDS[kind]):
            # the distance from the end of the leftmost sign to the date
            far = F.length("before") - F.length(F.regexp_extract("before", f"^((?s:.*?){p})", 1))
            near = F.when(F.col("before").rlike(p), 0.85 - F.least(F.lit(0.20), 0.005 * far)).when(F.col("_around").rlike(p), 0.70)
            s = F.when(contains_any(F.col("_around"), holds.split("|")), near)
            scored.append(F.when(s.isNotNull(), F.struct(F.round(s, 6).alias("s"), F.lit(-order).alias("o"), F.lit(kind).alias("k"))))
            order += 1
    out = base.withColumn("_best", F.explode(F.array(F.array_max(F.array(*scored)))))
    kind = F.coalesce("_best.k", F.when(F.col("header"), "ISSUE_DATE").otherwise("UNKNOWN_DATE"))
    conf = F.coalesce("_best.s", F.when(F.col("header"), 0.65).otherwise(0.0))
    return out.withColumns({"type": kind, "type_confidence": F.round(F.greatest(F.lit(0.30), F.least(F.lit(0.99), conf)), 4)}).drop("_best", "_around", "_c", "before", "after", "header")


def with_model(dates: DataFrame, model: DataFrame, docs: DataFrame, key: str = "document_id", text: str = "text", near: int = 5) -> DataFrame:
    """Adds the dates of a model to those of find_dates: adds source (regex or ner) and ner_score. A model's date is left out if
    one found before it, by a notation or by the model, starts and ends less than ``near`` from its ends.
    model: (key, start, end, score). The dates of one document meet in one row."""
    kind = "array<struct<start:int,end:int,score:double>>"
    seen = dates.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("start", "end")).cast("array<struct<start:int,end:int>>").alias("_seen"))
    own = model.groupBy(F.col(key).alias("_m")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "score"))).cast(kind).alias("_own"))
    both = own.join(seen, F.col("_m") == F.col("_k"), "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<struct<start:int,end:int>>")))
    close = f"y -> abs(y.start - x.start) < {near} and abs(y.end - x.end) < {near}"
    fresh = F.expr(f"aggregate(_own, cast(array() as {kind}), (a, x) -> if(exists(_seen, {close}) or exists(a, {close}), a, concat(a, array(x))))")
    new = both.select("_m", F.explode(fresh).alias("_d")).join(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), F.col("_m") == F.col("_k"))
    value = F.col("_t").substr(F.col("_d.start") + 1, F.col("_d.end") - F.col("_d.start"))
    made = new.select(F.col("_m").alias(key), context(F.col("_t"), F.col("_d.start"), F.col("_d.end"), F.lit(len(DATE_PATTERNS)), value).alias("_x"), F.col("_d.score").alias("ner_score"))
    found = dates.withColumns({"source": F.lit("regex"), "ner_score": F.lit(0.0)})
    return found.unionByName(made.select(key, "_x.*", F.lit("ner").alias("source"), "ner_score"))


def merged_confidence(confidence: Column, ner_score: Column) -> Column:
    """The greater of the type's confidence and the model's score, if there is one."""
    return F.when(ner_score > 0, F.greatest(confidence, ner_score)).otherwise(confidence)


def parse(value: Column) -> Column:
    """The calendar date of a value in one of the known notations; null if there is none. Day before month; where that
    gives no month, month before day."""
    v = F.regexp_replace(F.regexp_replace(value, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"(?i)\bof\s+", "")
    for i, m in enumerate(HINDI_MONTHS.split("|")):
        v = F.replace(v, F.lit(m), F.lit(MONTHS.split("|")[i]))
    v = F.initcap(F.regexp_replace(F.regexp_replace(v, r"[,\s]+", " "), r"[/.]", "-"))
    ways = ["d-M-yyyy", "M-d-yyyy", "d MMMM yyyy", "MMMM d yyyy"]
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(w)).cast("date") for w in ways])


def last_date(dates: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, value, type, start): the first date in text order that sets a limit."""
    return first_by(dates.filter(F.col("type").isin(DEADLINES)), [key], [F.col("start"), F.col("end"), F.col("pattern")]).select(key, "value", "type", "start")
