"""Readers and writers: JSON lines with their faults, text files, pages and words from plug-ins, splits, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = "array<struct<label:string,start:int,end:int,text:string>>"
ANNOTATIONS = f"document_id string, text string, entities {ENTITIES}"


def _paths(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """(those that exist, those that do not), by the file system each belongs to."""
    have, lack = [], []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        (have if fs.globStatus(path) else lack).append(p)
    return have, lack


def read_jsonl(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, list[str]]:
    """(rows, missing paths): blank and malformed lines are left out; adds source_file. Missing files are reported, not raised."""
    have, lack = _paths(spark, paths)
    if not have:
        return spark.createDataFrame([], schema + ", source_file string"), lack
    df = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(have)
    return df.filter(F.col("_corrupt").isNull()).drop("_corrupt").withColumn("source_file", F.col("_metadata.file_path")), lack


def read_jsonl_numbered(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """(source_file, line_no, raw, row, error): every non-blank line with its number; error is PARSE_ERROR or null. Each file is one
    value, as line numbers need; the lines are spread from there."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.posexplode(F.split("value", "\n")).alias("_i", "raw"))
    parsed = F.from_json("raw", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = whole.filter(F.trim("raw") != "").withColumn("row", parsed)
    return out.select("source_file", (F.col("_i") + 1).alias("line_no"), "raw", "row", F.when(F.col("row").isNull() | F.col("row._corrupt").isNotNull(), "PARSE_ERROR").alias("error"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(document_id, text): whole files; the id is the file's name."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("document_id"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """(path, length, suffix); contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").option("recursiveFileLookup", True).load(path)
    return df.select("path", "length", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"))


def read_pages(spark: SparkSession, path: str, reader, schema: str) -> DataFrame:
    """Pages made by a plug-in: ``reader(name, bytes)`` yields dicts of ``schema`` for a file. Without a reader no text is made up."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in reader(p, c)]
            yield pd.DataFrame(rows)

    return files.mapInPandas(run, schema)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports, one JSON file each, keyed by model_name."""
    score = "struct<precision:double,recall:double,f1:double>"
    return spark.read.schema(f"model_name string, overall {score}, per_field map<string,{score}>, calibration struct<ece:double,brier_score:double>").option("multiLine", True).json(path)


def describe_source(df: DataFrame) -> DataFrame:
    """(column, type, position) of a source, without reading it."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)], "column string, type string, position int")


def with_defaults(df: DataFrame, key: str = "document_id") -> DataFrame:
    """Ids and titles where they lack: an id is a hash of the content, so it needs no order over all rows."""
    made = F.concat(F.lit("DOC-"), F.upper(F.substring(F.md5(F.concat_ws("\x1f", "document_title", "text")), 1, 12)))
    return df.withColumns({key: F.coalesce(F.nullif(F.col(key), F.lit("")), made), "document_title": F.coalesce(F.nullif(F.col("document_title"), F.lit("")), F.lit("Untitled"))})


def write_jsonl(df: DataFrame, paths: str | list[str], mode: str = "errorifexists") -> None:
    """JSON lines, not escaped; several paths get the same rows from one evaluation."""
    many = [paths] if isinstance(paths, str) else paths
    kept = df.persist() if len(many) > 1 else df
    for p in many:
        kept.write.mode(mode).option("ignoreNullFields", False).json(p)
    if len(many) > 1:
        kept.unpersist()


def write_splits(df: DataFrame, path: str, label_map: dict[str, int]) -> None:
    """Rows by split, and the label map beside them."""
    df.write.mode("overwrite").partitionBy("split").json(f"{path}/chunks")
    spark = df.sparkSession
    row = [(list(label_map), label_map)]
    write_one(spark.createDataFrame(row, "labels array<string>, label2id map<string,int>"), f"{path}/label_map")


def write_one(df: DataFrame, path: str) -> None:
    """A manifest or parameter set of one row, as one file. More rows are an error, not dropped."""
    if len(df.limit(2).collect()) > 1:
        raise ValueError("more than one row for a file of one")
    df.coalesce(1).write.mode("overwrite").json(path)


def rewrite(spark: SparkSession, path: str, schema: str, keep) -> None:
    """Filters JSON lines in place: the new files are complete before the old ones go."""
    old, new = f"{path}.old", f"{path}.new"
    spark.read.schema(schema).json(path).filter(keep).write.mode("overwrite").json(new)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(p(path), p(old)):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(p(new), p(path)):
        fs.rename(p(old), p(path))
        raise OSError(f"{new} could not take the place of {path}")
    fs.delete(p(old), True)


def read_one(spark: SparkSession, path: str) -> dict:
    """What write_one wrote."""
    return spark.read.json(path).first().asDict(recursive=True)


def split_sizes(df: DataFrame, column: str = "split") -> DataFrame:
    """(split, rows)."""
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """Token sets for training: (input_ids, attention_mask, labels), records without one of them left out."""
    return spark.read.schema("input_ids array<int>, attention_mask array<int>, labels array<int>").json(path).dropna()


def write_documents(df: DataFrame, path: str, key: str = "document_id") -> None:
    """One folder per document; writing a document again replaces its own folder only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
