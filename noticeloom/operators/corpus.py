"""Curation of a corpus: canonical types, quotas, ids, manifests, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import first_by
from ..functions.text import BLANKS, contains_any

# fixed values: types in order of precedence, the words that mark them, and how many of each are wanted
QUOTAS = {
    "Notification": (10, ["notification"]), "Circular": (10, ["circular"]), "Order": (5, ["order"]), "Guidelines": (5, ["guidelines", "guideline", "advisory"]),
    "Scheme": (10, ["scheme"]), "Public Notice": (10, ["notice", "public advisory"]),
}
TARGETS = ["notification", "circular", "order", "guideline", "scheme", "notice", "advisory", "memorandum"]
SHORTEST, LONGEST = 200, 8000


def canonical_type(c: Column) -> Column:
    """The first type of which a word occurs in the value; null if none does."""
    low = F.lower(F.btrim(c, F.lit(BLANKS)))
    out = None
    for name, (_, marks) in QUOTAS.items():
        out = F.when(contains_any(low, marks), name) if out is None else out.when(contains_any(low, marks), name)
    return out


def content_id(title: Column, text: Column, prefix: str = "NOTGOLD-") -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(F.concat(F.coalesce(title, F.lit("")), F.substring(text, 1, 200))), 1, 8)))


def quota_sample(df: DataFrame, order: list[Column], kind: str = "document_type", text: str = "text") -> DataFrame:
    """The first rows of each canonical type up to its quota, of texts of 200 to 8000 characters. The limit is the operator's
    purpose; it is applied on both sides of the shuffle, so no type's rows meet in one task."""
    fit = df.withColumn("canonical_type", canonical_type(F.col(kind))).filter(F.col("canonical_type").isNotNull() & F.length(F.col(text)).between(SHORTEST, LONGEST))
    most = max(q for q, _ in QUOTAS.values())
    ranked = first_by(fit, ["canonical_type"], order, most)
    r = F.row_number().over(Window.partitionBy("canonical_type").orderBy(*order))
    quota = None
    for name, (q, _) in QUOTAS.items():
        quota = F.when(F.col("canonical_type") == name, q) if quota is None else quota.when(F.col("canonical_type") == name, q)
    return ranked.withColumn("pick", r).filter(F.col("pick") <= quota)


def quota_manifest(sample: DataFrame) -> DataFrame:
    """(canonical_type, target, collected) for every type, also those without rows."""
    dim = sample.sparkSession.createDataFrame([(n, q) for n, (q, _) in QUOTAS.items()], "canonical_type string, target int")
    got = sample.groupBy(F.col("canonical_type").alias("_t")).agg(F.count("*").alias("_n"))
    return dim.join(got, F.col("canonical_type") == F.col("_t"), "left").select("canonical_type", "target", F.coalesce("_n", F.lit(0)).alias("collected"))


def backfill(sample: DataFrame, second: DataFrame, order: list[Column], kind: str, text_columns: list[str], title_columns: list[str]) -> DataFrame:
    """Rows of a second source for what the quota of one type still lacks: the first text column of 200 characters or more, cut
    at 8000, under the first title there is."""
    text = F.coalesce(*[F.when(F.length(c) >= SHORTEST, F.substring(F.col(c), 1, LONGEST)) for c in text_columns])
    lack = max(0, QUOTAS[kind][0] - sample.filter(F.col("canonical_type") == kind).count())
    title = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in title_columns], F.lit("Untitled"))
    picked = second.select(text.alias("text"), title.alias("document_title"), F.struct(*order).alias("_o")).filter("text is not null")
    return picked.orderBy("_o").limit(lack).select("text", "document_title", F.lit(kind).alias("canonical_type"))


def target_rows(df: DataFrame, kind: str = "document_type", title: str = "document_title", text: str = "text") -> DataFrame:
    """Rows with a text whose type or title names a kind of notice."""
    both = F.lower(F.concat_ws(" ", kind, title))
    return df.filter(F.col(text).isNotNull() & (F.col(text) != "") & contains_any(both, TARGETS))


def ingest_manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, rows): how many values of each column are null or empty."""
    g = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    return g.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("_x")).select("_x.column", "_x.missing", "rows")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Corpora with differing columns under each other, with the name of their source."""
    out = None
    for name, df in sources.items():
        d = df.withColumn("source_dataset", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
