"""The whole extraction as one call: fields with evidence, confidence and decision, typed dates, summaries, warnings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dates as D
from . import rules, spans, summarize


class Extraction(NamedTuple):
    """fields: (key, field, value, score, start, end, sentence_start, sentence_end, evidence, page_number, c_ocr, penalty,
    confidence, decision, status); dates: (key, start, end, value, type, type_confidence, day, page_number);
    documents: (key, summary, summary_confidence, consistency_score, warnings)."""

    fields: DataFrame
    dates: DataFrame
    documents: DataFrame


def _grounded(docs: DataFrame, model: DataFrame | None, key: str, text: str) -> DataFrame:
    best = spans.find_best(docs, key, text, noise=False, evidence=True)
    if model is None:
        return best.withColumn("span_status", F.lit("VALID_SPAN"))
    merged = spans.merge(model, best.select(key, "field", "score", "start", "end", "value"), key)
    return spans.evidence(merged, docs, key, text)


def extract(documents: DataFrame, pages: DataFrame | None = None, words: DataFrame | None = None, model: DataFrame | None = None, year_now: int = 2032, key: str = "document_id", text: str = "text", length: str = "STANDARD") -> Extraction:
    """documents: (key, text), cleaned; pages: (key, page_number, start_offset, end_offset and, if known, ocr_quality_score);
    words: (key, page_number, ord, text, confidence, x1, y1, x2, y2), in reading order; model: (key, field, score, start, end,
    value) of a token model. Without words a page's quality stands for their confidence, without pages 1. Texts that are
    null or blank give neither fields nor dates and no document row. Values below their thresholds are withheld."""
    docs = documents.select(key, text).filter(F.length(spans.strip(F.col(text))) > 0)
    found = _grounded(docs, model, key, text)
    quality = F.lit(1.0)
    if pages is not None:
        known = "ocr_quality_score" in pages.columns
        found = spans.page_of(found, pages, key)
        if known:
            q = pages.select(F.col(key).alias("_qk"), F.col("page_number").alias("_qp"), F.col("ocr_quality_score").alias("_q"))
            found = found.join(q, (F.col(key) == F.col("_qk")) & (F.col("page_number") == F.col("_qp")), "left").drop("_qk", "_qp")
            quality = F.coalesce("_q", F.lit(1.0))
    else:
        found = found.withColumn("page_number", F.lit(None).cast("int"))
    found = found.withColumn("_quality", quality).drop("_q")
    if words is not None and pages is not None:
        placed = spans.word_spans(words, [key, "page_number"])
        start = pages.select(F.col(key).alias("_k"), F.col("page_number").alias("_p"), "start_offset")
        placed = placed.join(start, (F.col(key) == F.col("_k")) & (F.col("page_number") == F.col("_p"))).withColumns({"start": F.col("start") + F.col("start_offset"), "end": F.col("end") + F.col("start_offset")})
        over = spans.ocr_overlap(found.select(key, "field", "start", "end"), placed, key).select(F.col(key).alias("_k"), F.col("field").alias("_f"), "c_ocr")
        boxes = spans.evidence_box(found.select(key, "field", "page_number", "evidence"), words, key)
        found = found.join(over, (F.col(key) == F.col("_k")) & (F.col("field") == F.col("_f")), "left").drop("_k", "_f").join(boxes, [key, "field"], "left")
    else:
        found = found.withColumn("c_ocr", F.lit(None).cast("double"))
    whole = docs.select(F.col(key).alias("_k"), F.col(text).alias("_full"))
    year = F.when(F.col("field") == "date", F.year(D.parse(F.col("value"))))
    penalty = spans.field_penalty(F.col("field"), F.col("value"), F.col("_full"), year, year_now)
    found = found.join(whole, F.col(key) == F.col("_k")).withColumn("penalty", penalty).drop("_k", "_full").withColumn("c_ocr", F.coalesce("c_ocr", "_quality")).drop("_quality")
    sure = spans.confidence(F.col("field"), F.col("score"), F.col("c_ocr"), F.col("value").isNotNull(), F.col("span_status") == "VALID_SPAN", F.col("penalty") == 0)
    fields = spans.abstain(found.withColumn("confidence", sure))

    typed = D.find_dates(docs, key, text).withColumns({"source": F.lit("regex"), "ner_score": F.lit(0.0)})
    if model is not None:
        typed = D.with_model(D.find_dates(docs, key, text), model.filter(F.col("field") == "date"), docs, key, text)
    typed = D.classify(typed)
    typed = typed.withColumns({"type_confidence": D.merged_confidence(F.col("type_confidence"), F.col("ner_score")), "day": D.parse(F.col("value"))})
    typed = spans.page_of(typed, pages, key) if pages is not None else typed.withColumn("page_number", F.lit(None).cast("int"))

    accepted = fields.filter(F.col("decision") == "ACCEPT")
    held = accepted.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("start", "end", "value", "page_number")).alias("_spans"), F.sum("penalty").alias("_pen"))  # at most one per field
    none = F.array().cast("array<struct<start:int,end:int,value:string,page_number:int>>")
    joined = docs.join(held, F.col(key) == F.col("_k"), "left").withColumn("_spans", F.coalesce("_spans", none))
    told = summarize.summaries(joined, "_spans", key, text, length).select(F.col(key).alias("_sk"), "summary", F.col("confidence").alias("summary_confidence"))
    score = F.greatest(F.lit(0.0), F.round(F.round(1.0 - F.coalesce("_pen", F.lit(0.0)), 6), 2))
    out = joined.select(key, score.alias("consistency_score")).join(told, F.col(key) == F.col("_sk"), "left").drop("_sk")
    warning = F.lit(None).cast("string")
    if pages is not None and "ocr_quality_score" in pages.columns:
        n = F.greatest(F.lit(1), F.col("end_offset") - F.col("start_offset"))
        doc_q = pages.groupBy(F.col(key).alias("_k")).agg((F.sum(F.col("ocr_quality_score") * n) / F.sum(n)).alias("_q"))
        out = out.join(doc_q, F.col(key) == F.col("_k"), "left").drop("_k")
        warning = spans.ocr_warning(F.col("_q"), spans.quality_word(F.col("_q")))
    low = F.when(F.col("consistency_score") < 0.6, F.lit("Document is highly inconsistent."))
    documents_ = out.withColumn("warnings", F.array_compact(F.array(low, warning))).select(key, "summary", "summary_confidence", "consistency_score", "warnings")
    return Extraction(fields, typed, documents_)


def analyse(documents: DataFrame, as_of: str, key: str = "document_id", text: str = "text", title: str | None = None, date: str | None = None) -> DataFrame:
    """(key, notice_id, metadata, obligations): one row per text of ten characters or more: its metadata, and its obligations in
    order with their deadlines, the one that stands for the whole notice where none was found."""
    fit = documents.filter(rules.valid_input(F.col(text)))
    meta = rules.metadata(fit, as_of, key, text, title, date)
    day = F.to_date(F.lit(as_of))
    due = rules.with_fallback(rules.obligations(fit, key, text), fit, key, text).join(meta.select(F.col(key).alias("_k"), "notice_date"), F.col(key) == F.col("_k")).drop("_k")
    due = due.withColumn("deadline", rules.deadline(F.col("raw_deadline"), rules.base_date(F.col("notice_date"), day))).withColumn("days_left", rules.days_left(F.col("deadline"), day))
    row = F.struct("obligation_id", "line", "priority", "raw_deadline", "deadline", "days_left", "penalty_clause", "penalty_amount", "start", "end", "fallback")
    each = due.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(row)).alias("obligations"))
    ids = fit.select(F.col(key).alias("_i"), rules.notice_id(F.col(text)).alias("notice_id"))
    kept = F.struct(*[F.col(c) for c in meta.columns if c != key]).alias("metadata")
    return meta.select(key, kept).join(each, F.col(key) == F.col("_k")).join(ids, F.col(key) == F.col("_i")).select(key, "notice_id", "metadata", "obligations")
