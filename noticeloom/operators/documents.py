"""Pages and documents: cleaning, offsets, quality, page and document types, choice between PDF and OCR text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouped import running_sum
from ..functions.text import clean, clean_rules

SEPARATOR = "\n\n"


def page_offsets(pages: DataFrame, group: str = "document_id", order: str = "page_number", text: str = "text") -> DataFrame:
    """Adds start_offset and end_offset of every page in the text joined with blank lines. Null pages are empty."""
    n = F.coalesce(F.length(text), F.lit(0)) + len(SEPARATOR)
    out = running_sum(pages, [group], order, n, "start_offset")
    return out.withColumn("end_offset", F.col("start_offset") + F.coalesce(F.length(text), F.lit(0)))


def clean_pages(pages: DataFrame, compatibility: bool = True) -> DataFrame:
    """Cleans ``text``, keeps the delivered text as original_ocr_text (unless present), and recomputes the offsets."""
    keep = pages if "original_ocr_text" in pages.columns else pages.withColumn("original_ocr_text", F.col("text"))
    return page_offsets(keep.withColumn("text", (clean if compatibility else clean_rules)(F.col("text"))))


def full_text(pages: DataFrame) -> DataFrame:
    """(document_id, full_text): pages in order, joined with blank lines. One value holds a whole document by definition."""
    held = F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("t"))))
    return pages.groupBy("document_id").agg(F.array_join(F.transform(held, lambda x: x["t"]), SEPARATOR).alias("full_text"))


def text_quality(text: Column) -> Column:
    """0 to 0.9: share of ordinary characters and plausible word length, less runs of foreign signs; 0 under ten characters."""
    n = F.length(text)
    odd = F.length(F.regexp_replace(text, r"""[\p{L}\p{N}\s.,;:!?@#$%&*()\-/'"\x{0900}-\x{097F}]""", ""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    mean = F.length(F.regexp_replace(text, r"\s+", "")) / F.size(words)
    garbage = F.regexp_count(text, F.lit(r"[^\x{00}-\x{7F}\x{0900}-\x{097F}]{5,}"))
    score = (0.6 * (n - odd) / n + 0.3 * F.when(mean.between(2, 15), 1.0).otherwise(0.5)) * (1.0 - F.least(F.lit(1.0), garbage * 0.15))
    return F.when((n < 10) | (F.size(words) == 0), 0.0).when(n >= 10, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)


def page_type(chars: Column, quality: Column, fonts: Column, images: Column, large_image: Column, min_chars: int = 100) -> Column:
    """TEXT, SCANNED or MIXED of a page."""
    return (
        F.when((chars >= min_chars) & (quality >= 0.5) & fonts, F.when(images & large_image, "MIXED").otherwise("TEXT"))
        .when((chars < min_chars) | (quality < 0.5), "SCANNED")
        .otherwise("MIXED")
    )


def document_type(pages: DataFrame) -> DataFrame:
    """(document_id, pages, document_type): TEXT or SCANNED if all pages are, else MIXED."""
    low, high = F.min("page_type"), F.max("page_type")
    return pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.when((low == high) & low.isin("TEXT", "SCANNED"), low).otherwise("MIXED").alias("document_type"))


def needs_ocr(kind: Column, flag: Column) -> Column:
    return kind.isin("SCANNED", "MIXED", "UNKNOWN") | F.coalesce(flag, F.lit(False))


def longer_text(pdf: Column, ocr: Column) -> Column:
    """The OCR text only where it is longer."""
    return F.when(F.length(ocr) > F.coalesce(F.length(pdf), F.lit(0)), ocr).otherwise(pdf)
