"""Queries of the nine problems, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from . import canonical, languages, leakage, names, near_copies, pack, spanning, split_oversized, truncation

FIELDS = ["document_type", "document_jurisdiction"]


def p1_text_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized.text_pieces(read(spark, d, "annotation_corpus"), latest="collected_at")


def p1_chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized.chunk_pieces(read(spark, d, "train"))


def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, chunk_index, covered, oversized, loose): per item that is cut, the units its pieces cover together, the
    pieces above the limit, and the joints where a piece does not start the overlap before its forerunner's end."""
    from pyspark.sql import Window

    texts = p1_text_pieces(spark, d).select("document_id", F.lit(-1).alias("chunk_index"), "piece_no", "piece_start", "piece_end", F.lit(4000).alias("most"), F.lit(200).alias("over"))
    chunks = p1_chunk_pieces(spark, d).select("document_id", F.col("chunk_index").cast("int"), "piece_no", "piece_start", "piece_end", F.lit(64).alias("most"), F.lit(16).alias("over"))
    w = Window.partitionBy("document_id", "chunk_index").orderBy("piece_no")  # the pieces of one item
    last = F.lag("piece_end").over(w)
    j = texts.union(chunks).withColumns({"_gain": F.col("piece_end") - F.coalesce(last, F.lit(0)), "_loose": F.coalesce(F.col("piece_start") != last - F.col("over"), F.col("piece_start") != 0)})
    return j.groupBy("document_id", "chunk_index").agg(F.sum("_gain").alias("covered"), F.count_if(F.col("piece_end") - F.col("piece_start") > F.col("most")).alias("oversized"), F.count_if("_loose").alias("loose"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items of more than one piece."""
    texts = p1_text_pieces(spark, d).filter("piece_no = 2").select("document_id", F.lit(-1).alias("chunk_index"))
    chunks = p1_chunk_pieces(spark, d).filter("piece_no = 2").select("document_id", F.col("chunk_index").cast("int").alias("chunk_index"))
    return texts.union(chunks)


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return spanning.assign_splits(read(spark, d, "train"), read(spark, d, "doc_links"))


def p2_forest(spark: SparkSession, d: str) -> DataFrame:
    """The spanning forest of the ties: (a, b, round)."""
    return spanning.spanning_forest(read(spark, d, "doc_links"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    grouped = spanning.groups(read(spark, d, "doc_links"))
    chunked = read(spark, d, "train").select(spanning.norm("document_id").alias("document_id")).distinct()
    return chunked.join(grouped, chunked["document_id"] == grouped["record"]).select("document_id", "group_id")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct typed value with the entry it was mapped to; entry_id 0 reports a value that means none."""
    typed = canonical.typed_values(read(spark, d, "annotation_corpus"), FIELDS)
    used = typed.groupBy("field_name", "value").agg(F.count("*").alias("documents"))
    return canonical.map_values(used.select("field_name", "value"), read(spark, d, "canonical_values")).join(used, ["field_name", "value"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    reference = read(spark, d, "canonical_values")
    typed = canonical.typed_values(read(spark, d, "annotation_corpus"), FIELDS)
    odd = typed.join(reference.select("field_name", F.col("entry_name").alias("value")), ["field_name", "value"], "left_anti")
    mapped = canonical.map_values(odd.select("field_name", "value").distinct(), reference)
    return odd.join(mapped, ["field_name", "value"]).select("document_id", "field_name", "entry_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.copy_pairs(*near_copies.near_copies(read(spark, d, "annotation_corpus")))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.copy_groups(*near_copies.near_copies(read(spark, d, "annotation_corpus")))


def _authorities(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "annotation_corpus").select(F.col("issuing_authority").alias("name"))
    return a.union(read(spark, d, "extracted_metadata").select("issuing_authority"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(_authorities(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = spanning.pairs_within(p5_links(spark, d), "name", "name_class")
    return pairs.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.identify(read(spark, d, "annotation_corpus")).dropDuplicates(["document_id", "segment_no", "seg_start"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.relabel(languages.identify(read(spark, d, "annotation_corpus"))).select("document_id", "segment_no", "lang")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(read(spark, d, "documents"))


# how a public byte-pair vocabulary cuts texts before its merges
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def p7_containers_bpe(spark: SparkSession, d: str, vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", pattern: str = PRETOKENS) -> DataFrame:
    """Sizes in tokens of a public byte-pair vocabulary."""
    return pack.pack(read(spark, d, "documents"), size=pack.bpe_size(spark, vocabulary, pattern))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return pack.fill(p7_containers(spark, d))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pieces, tokens): what the containers hold of every document."""
    return p7_containers(spark, d).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing divided."""
    return p7_containers(spark, d).filter("piece_no = 2").select("doc_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).filter("equal_words >= 12").select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(p8_found(spark, d), read(spark, d, "eval_items"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return truncation.score(read(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).filter("truncated").select("doc_id").distinct()


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(p9_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_text_pieces, p1_chunk_pieces, p1_cover, p2_found, p2_splits, p2_forest, p3_found, p3_values, p4_found, p4_groups, p5_found, p5_links,
            p6_found, p6_segments, p7_found, p7_documents, p7_containers, p7_containers_bpe, p7_fill, p8_found, p8_leaks, p8_items, p9_found, p9_scores, p9_sources,
        )
    }
