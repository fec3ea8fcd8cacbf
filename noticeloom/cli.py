"""python -m noticeloom.cli COMMAND: validate, convert, calibrate, curate, profile. Inputs and outputs are JSON lines or Parquet."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotate, corpus, stats
from .session import session
from .sources import files

RECORDS = files.ANNOTATIONS + ", document_type string, document_title string, issuing_authority string, issue_date string"


def _records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, lines with their faults)."""
    lines = files.read_jsonl_numbered(spark, paths, RECORDS)
    return lines.filter("error is null").select("row.*"), lines


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    records, lines = _records(spark, a.input)
    errors = annotate.validate(records)
    r = annotate.validation_report(records, errors, parse_errors=lines, strict=a.strict).first()
    for k, v in r.asDict().items():
        print(f"{k}: {v}")
    if a.verbose:
        for e in errors.orderBy("document_id", "entity_index").limit(1000).collect():  # a report for the eye
            print(*e)
    return 0 if r["is_clean"] else 1


def convert(spark: SparkSession, a: argparse.Namespace) -> int:
    records, _ = _records(spark, a.input)
    chunks = annotate.training_chunks(records, size=a.max_length - 2, stride=a.stride)
    out = annotate.chunk_splits(chunks, annotate.exact_splits(chunks, validation=a.val_ratio, test=a.test_ratio, seed=a.seed))
    files.write_splits(out, a.outdir, {x: i for i, x in enumerate(annotate.BIO)})
    return 0


def calibrate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Input: Parquet with logits and label; rows of the ignored label are left out."""
    df = spark.read.parquet(*a.input).filter(F.col("label") != a.ignore_index)
    t = stats.fit_temperature(df, "logits", "label")
    files.write_one(stats.nll(df, "logits", "label", [t]), a.outdir)
    return 0


def curate(spark: SparkSession, a: argparse.Namespace) -> int:
    df = spark.read.parquet(*a.input)
    sample = corpus.quota_sample(df, [F.xxhash64("document_id"), F.col("document_id")])
    files.write_jsonl(sample, f"{a.outdir}/sample", "overwrite")
    corpus.quota_manifest(sample).coalesce(1).write.mode("overwrite").json(f"{a.outdir}/manifest")
    return 0


def profile(spark: SparkSession, a: argparse.Namespace) -> int:
    df = spark.read.parquet(*a.input)
    stats.missing_values(df, df.columns).write.mode("overwrite").json(f"{a.outdir}/missing")
    files.write_one(stats.footprint(df), f"{a.outdir}/footprint")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="noticeloom")
    sub = p.add_subparsers(dest="command", required=True)
    for f in (validate, convert, calibrate, curate, profile):
        s = sub.add_parser(f.__name__)
        s.set_defaults(run=f)
        s.add_argument("--input", nargs="+", required=True)
        if f is not validate:
            s.add_argument("--outdir", required=True)
    v, c = sub.choices["validate"], sub.choices["convert"]
    v.add_argument("--verbose", action="store_true")
    v.add_argument("--strict", action="store_true")
    c.add_argument("--max-length", type=int, default=512)
    c.add_argument("--stride", type=int, default=128)
    c.add_argument("--val-ratio", type=float, default=0.15)
    c.add_argument("--test-ratio", type=float, default=0.15)
    c.add_argument("--seed", type=int, default=42)
    sub.choices["calibrate"].add_argument("--ignore_index", type=int, default=-100)
    a = p.parse_args(argv)
    return a.run(spark or SparkSession.getActiveSession() or session("noticeloom"), a)


if __name__ == "__main__":
    sys.exit(main())
