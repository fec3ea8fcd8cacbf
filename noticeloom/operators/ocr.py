"""Words of a page (text, confidence, box) to quality, lines, zones and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, strip

PAGE = ["document_id", "page_number"]
# fixed values: words of signatures; characters that are ordinary
SIGNATURE = ["signature", "signed", "authorized", "signatory", "director", "commissioner", "officer", "secretary", "sd/-", "(sd/-)", "for and on behalf", "name:", "designation:", "seal"]
ORDINARY = r"""[a-zA-Z0-9\s.,;:!?@#$%&*()\-/'"\x{0900}-\x{097F}]"""


def valid_token(t: Column) -> Column:
    """Two characters or more: all digits, or with a Devanagari sign, or at least half letters, or a date."""
    letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}", ""))
    return (F.length(t) >= 2) & (t.rlike(r"^\p{Nd}+$") | t.rlike(r"[\x{0900}-\x{097F}]") | (letters / F.length(t) >= 0.5) | t.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}"))


def quality_label(score: Column) -> Column:
    return F.when(score >= 0.80, "GOOD").when(score >= 0.60, "MODERATE").when(score >= 0.40, "POOR").otherwise("VERY_POOR")


def page_quality(words: DataFrame, area: str | None = None, keys: list[str] = PAGE) -> DataFrame:
    """Per page the mean confidence, share of plausible tokens, density, share of odd characters, language by script, and
    their weighted score. All sums are taken before the shuffle."""
    t = F.coalesce(F.col("text"), F.lit(""))
    solid = F.replace(t, F.lit(" "), F.lit(""))
    g = words.groupBy(*keys).agg(
        F.avg("confidence").alias("_conf"), F.avg(valid_token(F.btrim(t)).cast("double")).alias("_valid"), F.sum(F.length(solid)).alias("_chars"),
        F.sum(F.length(F.regexp_replace(solid, ORDINARY, ""))).alias("_odd"), F.count("*").alias("word_count"),
        F.sum(F.length(t) - F.length(F.regexp_replace(t, r"[\x{0900}-\x{097F}]", ""))).alias("_deva"), F.sum(F.length(t) - F.length(F.regexp_replace(t, "[a-zA-Z]", ""))).alias("_latin"),
        *([F.max(area).alias("_area")] if area else []),
    )
    density = F.least(F.lit(1.0), F.col("_chars") / F.col("_area") * 1500 if area else F.col("_chars") / 3000)
    lang = F.when(F.col("_deva") > F.col("_latin"), "hi").when(F.col("_latin") > 0, "en").otherwise("unknown")
    sure = F.when(lang == "unknown", 0.0).otherwise(0.7)
    odd = F.col("_odd") / F.greatest(F.lit(1), F.col("_chars"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.40 * F.col("_conf") + 0.25 * F.col("_valid") + 0.15 * density + 0.10 * (1.0 - odd) + 0.10 * sure))
    r4 = lambda c: F.round(c + 1e-9, 4)  # noqa: E731  halves round up whatever their binary form
    return g.select(*keys, r4(F.col("_conf")).alias("avg_confidence"), r4(F.col("_valid")).alias("token_validity_ratio"), r4(density).alias("text_density"), r4(odd).alias("abnormal_char_ratio"), lang.alias("language_detected"), "word_count", r4(score).alias("ocr_quality_score"), quality_label(score).alias("quality_label"))


def document_quality(pages: DataFrame) -> DataFrame:
    """Per document the mean of its pages' scores weighted by words, the language of most words, whether pages of more than
    ten words have several, which (the main one if none), and the counts of pages that are good or moderate, and poor."""
    by_lang = pages.groupBy("document_id", "language_detected").agg(F.sum("word_count").alias("_w"), F.sum(F.col("ocr_quality_score") * F.col("word_count")).alias("_q"), F.count("*").alias("_p"), F.count_if(F.col("quality_label").isin("GOOD", "MODERATE")).alias("_good"), F.count_if(F.col("quality_label").isin("POOR", "VERY_POOR")).alias("_poor"), F.max(F.col("word_count") > 10).alias("_big"))
    top = F.max(F.struct("_w", F.col("language_detected").alias("l")))
    several = F.count_if(F.col("_big") & (F.col("language_detected") != "unknown")) > 1
    g = by_lang.groupBy("document_id").agg(F.round(F.sum("_q") / F.sum("_w") + 1e-9, 4).alias("quality"), top.alias("_t"), several.alias("bilingual"), F.sort_array(F.collect_set(F.when(F.col("_big") & (F.col("language_detected") != "unknown"), F.col("language_detected")))).alias("_langs"), F.sum("_p").alias("pages"), F.sum("_good").alias("good_pages"), F.sum("_poor").alias("poor_pages"), F.sum("_w").alias("words"))
    return g.select("document_id", "quality", F.when(F.col("words") > 0, quality_label(F.col("quality"))).otherwise("NO_TEXT").alias("label"), F.col("_t.l").alias("language"), "bilingual", F.when(F.size("_langs") > 0, F.col("_langs")).otherwise(F.array("_t.l")).alias("languages"), "pages", "good_pages", "poor_pages", "words")


def lines(words: DataFrame, tolerance: float = 15.0, keys: list[str] = PAGE) -> DataFrame:
    """(keys, line_no, text, confidence, x1, y1, x2, y2, word_count): words by the centre's height; a line ends where a word lies
    more than ``tolerance`` from the line's first word. The fold runs over one page's words; pages are bounded by paper."""
    held = F.array_sort(F.collect_list(F.struct(((F.col("y1") + F.col("y2")) / 2).alias("y"), "x1", "y1", "x2", "y2", "ord", "text", "confidence")))
    fold = f"""aggregate(_w, named_struct('l', 0, 'y', _w[0].y, 'a', cast(array() as array<int>)),
        (s, w) -> if(abs(w.y - s.y) <= {tolerance}, named_struct('l', s.l, 'y', s.y, 'a', concat(s.a, array(s.l))), named_struct('l', s.l + 1, 'y', w.y, 'a', concat(s.a, array(s.l + 1)))), s -> s.a)"""
    each = words.groupBy(*keys).agg(held.alias("_w")).select(*keys, F.explode(F.arrays_zip("_w", F.expr(fold).alias("_l"))).alias("_z")).select(*keys, F.col("_z._l").alias("line_no"), "_z._w.*")
    parts = F.array_sort(F.collect_list(F.struct("x1", "ord", "text")))
    return each.groupBy(*keys, "line_no").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.round(F.avg("confidence"), 4).alias("confidence"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("word_count"))


def zones(lines_: DataFrame, height: Column, header: float = 0.12, footer: float = 0.10) -> DataFrame:
    """Adds zone: header in the top 12 %, footer in the bottom 10 % of the page, else body."""
    y = (F.col("y1") + F.col("y2")) / 2
    return lines_.withColumn("zone", F.when(y < height * header, "header").when(y > height * (1 - footer), "footer").otherwise("body"))


def paragraphs(lines_: DataFrame, factor: float = 2.0, keys: list[str] = PAGE) -> DataFrame:
    """(keys, paragraph_no, text, line_count, x1, y1, x2, y2): a gap wider than ``factor`` times the mean line height starts one."""
    w = Window.partitionBy(*keys)
    order = w.orderBy("line_no")
    h = F.col("y2") - F.col("y1")
    mean = F.coalesce(F.avg(F.when(h > 0, h)).over(w), F.lit(20.0))
    gap = F.coalesce((F.col("y1") - F.lag("y2").over(order) > mean * factor).cast("int"), F.lit(0))
    marked = lines_.withColumn("_new", gap).withColumn("paragraph_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return marked.groupBy(*keys, "paragraph_no").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("line_count"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def signature(zoned: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, detected, signature): per page the lines with a signing word, those of the footer first, then those among the last
    three of the body; each in order."""
    last = F.row_number().over(Window.partitionBy(*keys, "zone").orderBy(F.desc("line_no")))
    footer = F.col("zone") == "footer"
    signs = (footer | ((F.col("zone") == "body") & (F.col("_r") <= 3))) & contains_any(F.lower("text"), SIGNATURE)
    held = F.array_sort(F.collect_list(F.when(signs, F.struct((~footer).alias("b"), "line_no", "text"))))
    out = zoned.withColumn("_r", last).groupBy(*keys).agg(held.alias("_h"))
    return out.select(*keys, (F.size("_h") > 0).alias("detected"), F.array_join(F.transform("_h", lambda x: x["text"]), "\n").alias("signature"))


def full_text(zones_: DataFrame, paragraphs_: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, full_text): header, the body's paragraphs and footer of every page, what is empty left out. zones_: zone_text();
    paragraphs_: paragraphs() of the body's lines."""
    body = paragraphs_.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_no", "text"))), lambda x: x["text"]), "\n\n").alias("_body"))
    parts = F.filter(F.array("header", "_body", "footer"), lambda x: x.isNotNull() & (x != ""))
    return zones_.join(body, keys, "left").select(*keys, F.array_join(parts, "\n\n").alias("full_text"))


def box_of(quad: Column) -> Column:
    """struct<x1,y1,x2,y2>: the upright box round a polygon given as array<array<double>> of x and y."""
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def words_of_polygons(found: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Words of an engine that gives polygons: upright boxes of whole numbers, confidences to four places.
    found: (keys, ord, text, confidence, quad)."""
    whole = [F.col(f"_b.{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return found.withColumn("_b", box_of(F.col("quad"))).select(*keys, "ord", F.col("ord").alias("line_num"), "text", F.round("confidence", 4).alias("confidence"), *whole)


def words_of_percent(found: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Words of an engine that gives percentages: blank ones and those below 0 are no words, the rest are clamped to 0 to 1.
    found: (keys, ord, line_num, text, confidence, left, top, width, height); ``ord`` counts all entries."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") / 100.0))
    box = [F.col("left").alias("x1"), F.col("top").alias("y1"), (F.col("left") + F.col("width")).alias("x2"), (F.col("top") + F.col("height")).alias("y2")]
    return found.filter((strip(F.col("text")) != "") & (F.col("confidence") >= 0)).select(*keys, "ord", "line_num", strip(F.col("text")).alias("text"), F.round(conf, 4).alias("confidence"), *box)


def text_of_lines(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, text, confidence, word_count): words joined by blanks; a new line where the line number changes or an entry was no
    word. The confidence is the words' mean. A page is one row."""
    held = F.array_sort(F.collect_list(F.struct("ord", "line_num", "text")))
    g = words.groupBy(*keys).agg(held.alias("_w"), F.round(F.avg("confidence"), 4).alias("confidence"), F.count("*").alias("word_count"))
    goes_on = lambda x, y: (x["line_num"] == y["line_num"]) & (x["ord"] == y["ord"] + 1)
    glue = F.transform("_w", lambda x, i: F.concat(F.when(i == 0, "").when(goes_on(x, F.get("_w", i - 1)), " ").otherwise("\n"), x["text"]))
    return g.select(*keys, F.array_join(glue, "").alias("text"), "confidence", "word_count")


# fixed values: the quality of a page whose text needs no recognition
TEXT_PAGE = {"avg_confidence": 0.99, "token_validity_ratio": 0.95, "abnormal_char_ratio": 0.0, "language_detected": "en", "language_confidence": 0.9, "ocr_quality_score": 0.95, "quality_label": "GOOD"}


def text_page_quality(text: Column) -> Column:
    """The quality of such a page as a struct: constants, the number of words, and a density by the text's length."""
    density = F.least(F.lit(1.0), F.coalesce(F.length(text), F.lit(0)) / 3000)
    count = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.struct(*[F.lit(v).alias(k) for k, v in TEXT_PAGE.items()], density.alias("text_density"), count.alias("word_count"))


def zone_text(zoned: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row per page: the text of header, body and footer."""
    held = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return zoned.groupBy(*keys).pivot("zone", ["header", "body", "footer"]).agg(F.array_join(F.transform(held, lambda x: x["text"]), "\n"))
