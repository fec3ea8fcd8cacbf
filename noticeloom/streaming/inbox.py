"""Notices as they arrive: a drop folder analysed without state, an inbox keyed by document, corrections merged back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import valid_input
from ..sources.files import write_documents

NOTICES = "document_id string, text string, received_at timestamp"


def drop_folder(spark: SparkSession, path: str, schema: str = NOTICES, delete: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the JSON lines put into a folder; with ``delete`` files go when they have been read."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("cleanSource", "delete") if delete else r).json(path)


def once(stream: DataFrame, within: str = "1 day", key: str = "document_id", at: str = "received_at") -> DataFrame:
    """Notices delivered again within the time are dropped; the state is bounded by the watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours", at: str = "received_at", by: str = "source") -> DataFrame:
    """Notices by source and hour of arrival, late ones admitted for two hours."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("notices"))


def run(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, quarantine: str | None = None, available_now: bool = True):
    """Analyses every batch and writes it by document, so a batch done twice changes nothing. Texts too short go to quarantine."""

    def batch(df: DataFrame, _: int) -> None:
        kept = df.persist()
        write_documents(analyse(kept.filter(valid_input(F.col("text")))), out)
        if quarantine:
            kept.filter(~valid_input(F.col("text"))).write.mode("append").json(quarantine)
        kept.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def merge_corrections(corpus: DataFrame, corrections: DataFrame, key: str = "document_id") -> DataFrame:
    """The corpus with corrected documents in place of its own."""
    return corpus.join(corrections.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti").unionByName(corrections, allowMissingColumns=True)
