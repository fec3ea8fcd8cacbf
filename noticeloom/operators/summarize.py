"""Extractive summaries: sentences with offsets, scores, the best of them in text order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_containing, each, find_all, strip

SENTENCE = r"[^.!?\n]+[.!?\n]*"
# fixed values: words that make a sentence important, and what marks boilerplate
KEYWORDS = [
    "notification", "circular", "show cause", "public notice", "advisory", "directive", "deadline", "last date", "closing date", "effective from", "w.e.f.", "dated",
    "eligible", "eligibility", "qualification", "appl", "submit", "submission", "commence", "directed", "instructed", "admission", "fee", "penalty", "required",
    "documents", "enclosure", "contact", "email", "phone", "website",
    "अधिसूचना", "परिपत्र", "अंतिम तिथि", "पात्रता", "आवेदन", "जमा", "आवश्यक", "दस्तावेज़", "सम्पर्क", "कार्यालय", "मंत्रालय", "विभाग", "निर्देश",
]
BOILERPLATE = [r"^copy\s+to\b", r"^copy\s+forwarded\s+to\b", r"^प्रतिलिपि", r"^sd/-", r"^page\s+\d+", r"^\d+$", r"^[a-z0-9\/-]{10,}$"]
LENGTHS = {"SHORT": (1, 2), "STANDARD": (3, 5), "DETAILED": (5, 8)}


def sentences(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, idx, start, end, sentence): stripped text, offsets of the unstripped match; blank ones left out."""
    kept = F.filter(F.transform(find_all("_t", SENTENCE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), strip(x["value"]).alias("sentence"))), lambda x: x["sentence"] != "")
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_t")).transform(each, ["_key"], kept, "_s", "idx").select(F.col("_key").alias(key), "idx", "_s.start", "_s.end", "_s.sentence")


def sentence_array(text: str) -> Column:
    """array<struct<start,end,sentence,low>> of the column ``text``."""
    found = F.transform(find_all(text, SENTENCE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), strip(x["value"]).alias("sentence")))
    return F.transform(F.filter(found, lambda x: x["sentence"] != ""), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["sentence"].alias("sentence"), F.lower(x["sentence"]).alias("low")))


def score_array(sents: Column, spans: Column | None = None) -> Column:
    """array<struct<idx,start,end,sentence,entity,page,score>>, within the row. spans: array of struct with start, end, value and
    page_number: 3 points for each that overlaps the sentence; one without offsets gives 2 to every sentence that holds its value
    (of more than two characters, in any case). page is that of the first that does."""
    n = F.size(sents)

    def points(x: Column) -> tuple[Column, Column]:
        if spans is None:
            return F.lit(0.0), F.lit(None).cast("int")
        placed = lambda y: y["start"].isNotNull() & y["end"].isNotNull()
        over = lambda y: placed(y) & (y["start"] < x["end"]) & (y["end"] > x["start"]) & (y["start"] < y["end"])
        held = lambda y: ~placed(y) & (F.length(y["value"]) > 2) & F.contains(x["low"], F.lower(y["value"]))
        hit = lambda y: F.when(over(y), 3.0).when(held(y), 2.0).otherwise(0.0)
        worth = F.aggregate(spans, F.lit(0.0), lambda a, y: a + hit(y))
        return worth, F.get(F.filter(spans, lambda y: y["page_number"].isNotNull() & (hit(y) > 0)), F.lit(0))["page_number"].cast("int")

    def one(x: Column, i: Column) -> Column:
        worth, page = points(x)
        return F.struct(i.cast("int").alias("idx"), x["start"].alias("start"), x["end"].alias("end"), x["sentence"].alias("sentence"), x["low"].alias("low"), worth.alias("entity"), page.alias("page"))

    def scored(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("idx", "start", "end", "sentence", "entity", "page")], _score(x["low"], x["idx"], n, x["entity"]).alias("score"))

    return F.transform(F.transform(sents, one), scored)


def summary_array(scored: Column, low: int, high: int) -> Column:
    """The picked elements of score_array, in text order: the best by score, then place; ``high`` of them if any sentence has
    points for entities and there are more than ``low``, else ``low``."""
    k = F.when((F.size(scored) > low) & F.exists(scored, lambda x: x["entity"] > 0), high).otherwise(low)
    ranked = F.slice(F.array_sort(F.transform(scored, lambda x: F.struct((-x["score"]).alias("r"), x["idx"].alias("idx"), x.alias("x")))), F.lit(1), k)
    return F.array_sort(F.transform(ranked, lambda x: x["x"]))


def summaries(df: DataFrame, spans: str | None = None, key: str = "document_id", text: str = "text", length: str = "STANDARD", detail: bool = False) -> DataFrame:
    """(key, picked, summary, confidence), within the row: no shuffle. ``spans``: the column of spans, see score_array. A document
    with no more sentences than the minimum is taken whole, with confidence 0.95. With ``detail`` (key, sentence_index, text,
    page_number, entity_score, start, end): one row per picked sentence."""
    low, high = LENGTHS[length.split()[0].upper()]
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_t"), *([F.col(spans).alias("_spans")] if spans else [])).filter(F.length(strip(F.col(text))) > 0)
    # explode() of one element: what is made before is not copied into the lambdas that use it for every sentence
    made = F.struct(sentence_array("_t").alias("sents"), *([F.col("_spans").alias("spans")] if spans else []))
    base = base.select("_key", F.explode(F.array(made)).alias("_m")).filter(F.size("_m.sents") > 0)
    base = base.select("_key", F.explode(F.array(score_array(F.col("_m.sents"), F.col("_m.spans") if spans else None))).alias("_a"))
    base = base.withColumns({"_n": F.size("_a"), "_kept": summary_array(F.col("_a"), low, high)})
    if detail:
        rows = each(base, ["_key"], F.col("_kept"), "_s")
        shown = F.round(F.greatest(F.lit(0.0), F.col("_s.score")), 2)
        return rows.select(F.col("_key").alias(key), F.col("_s.idx").alias("sentence_index"), F.col("_s.sentence").alias("text"), F.coalesce("_s.page", F.lit(1)).alias("page_number"), shown.alias("entity_score"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))
    return base.select(F.col("_key").alias(key), F.size("_kept").alias("picked"), F.array_join(F.transform("_kept", lambda x: x["sentence"]), " ").alias("summary"), summary_confidence(F.col("_kept"), F.col("_n"), low).alias("confidence"))


def summary_confidence(kept: Column, n: Column, low: int) -> Column:
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["score"]) / F.size(kept)
    conf = F.when(n <= low, 0.95).otherwise(F.least(F.lit(0.98), F.greatest(F.lit(0.60), F.round(F.round(0.60 + F.least(F.lit(0.38), mean * 0.05), 6), 2))))
    return F.round(conf, 2)


def sentence_score(entity: Column, n: Column) -> Column:
    """Entity points, one per keyword, a place near the start or end, less 5 for boilerplate. Needs idx and sentence."""
    return _score(F.lower("sentence"), F.col("idx"), n, entity)


def _score(low: Column, idx: Column, n: Column, entity: Column) -> Column:
    place = F.when(idx < 3, 1.5 * (3 - idx)).when(idx >= n - 2, 1.0).otherwise(0.0)
    dull = F.lit(False)
    for p in BOILERPLATE:
        dull = dull | low.rlike(p)
    return entity + count_containing(low, KEYWORDS) + place - F.when(dull, 5.0).otherwise(0.0)


def score_sentences(sents: DataFrame, spans: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """Adds n (sentences of the document), entity and score. spans: (key, start, end), 3 points for each that overlaps.

    The join has the document as equal key beside the range; sentences before it are one row each, so a long document
    is spread by its sentences after the join's own skew handling.
    """
    counted = sents.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    base = sents.join(counted, F.col(key) == F.col("_k")).drop("_k")
    if spans is None:
        base = base.withColumn("entity", F.lit(0.0))
    else:
        s = spans.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        hits = sents.join(s, (F.col(key) == F.col("_k")) & (F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start"))).groupBy(F.col(key).alias("_k"), F.col("idx").alias("_i")).agg((3.0 * F.count("*")).alias("entity"))
        base = base.join(hits, (F.col(key) == F.col("_k")) & (F.col("idx") == F.col("_i")), "left").drop("_k", "_i").withColumn("entity", F.coalesce("entity", F.lit(0.0)))
    return base.withColumn("score", sentence_score(F.col("entity"), F.col("n")))


def summary(scored: DataFrame, key: str = "document_id", length: str = "STANDARD") -> DataFrame:
    """(key, picked, summary, confidence): the best sentences by score, then place, joined in text order. A document with no
    more sentences than the minimum is taken whole, with confidence 0.95."""
    low, high = LENGTHS[length.split()[0].upper()]
    group = Window.partitionBy(key)
    ranked = scored.withColumns({"_r": F.row_number().over(group.orderBy(F.desc("score"), F.asc("idx"))), "_has": F.max("entity").over(group) > 0}).filter(F.col("_r") <= high)
    # a bounded list: at most ``high`` sentences of a document
    top = ranked.groupBy(key).agg(F.first("n").alias("n"), F.first("_has").alias("_has"), F.sort_array(F.collect_list(F.struct("idx", "sentence", "score", "_r"))).alias("_all"))
    k = F.when((F.col("n") > low) & F.col("_has"), F.lit(high)).otherwise(F.lit(low))
    kept = F.filter("_all", lambda x: x["_r"] <= F.col("_k"))
    conf = summary_confidence(kept, F.col("n"), low)
    return top.withColumn("_k", k).select(key, F.size(kept).alias("picked"), F.array_join(F.transform(kept, lambda x: x["sentence"]), " ").alias("summary"), F.round(conf, 2).alias("confidence"))
