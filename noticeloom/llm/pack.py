"""Problem 7: fill containers of fixed capacity with documents.

Sizes are counted in the JVM (or by a public tokenizer in Arrow batches). Only a document longer than
a container is divided, into full containers and a rest. Items are dealt to shards by a hash, so that
a shard has about ``shard_items`` items whatever the input; each shard is packed by vector best fit:
items in falling size go to the open container with room in every dimension (tokens, documents,
attention cost = sum of squared lengths) whose weighted residual norm after the placement is least
(``rule="residual"``) or whose residual has the largest weighted dot product with the item
(``rule="dot"``). A shard leaves at most its last few containers slack, so the loss does not grow.

Null, empty and blank texts have size 0 and take a place but no tokens. Rows with the same id count
once, with the longest size; rows without an id are one item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

PUNCT = r"!-/:-@\[-`{-~"
PATTERN = rf"[{PUNCT}]|[^ \t\r\n{PUNCT}]+"


def pattern_size(text: Column) -> Column:
    """Tokens: each ASCII punctuation character, each longest run of other non-blank characters."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("int")


def bpe_size(spark: SparkSession, path: str, pattern: str):
    """A column function that counts tokens of the byte-pair vocabulary in the tiktoken file ``path``, which is sent to the
    executors; ``pattern`` cuts texts before the merges."""
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    @F.pandas_udf("int")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0)

    return lambda text: F.coalesce(size(text), F.lit(0))


def best_fit(sizes: np.ndarray, capacity: int, max_items: int, attention: float, weights=(1.0, 0.25, 0.25), rule: str = "residual") -> np.ndarray:
    """The container of each item, numbered from 0. Items must not exceed the capacity; one whose square exceeds ``attention`` is alone."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), dtype=np.int64)
    cap = np.array([capacity, max_items, attention], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    room = np.empty((max(16, len(sizes)), 3))
    ids = np.empty(len(room), dtype=np.int64)
    live = made = 0
    least = float(sizes.min()) if len(sizes) else 0.0
    for step, k in enumerate(order):
        t = float(sizes[k])
        need = np.array([t, 1.0, t * t])
        best = -1
        if live:
            fits = np.flatnonzero((room[:live, 0] >= t) & (room[:live, 1] >= 1) & (room[:live, 2] >= t * t))
            if len(fits):
                r = room[fits]
                score = -((((r - need) / cap) ** 2) @ w) if rule == "residual" else ((r / cap) * (need / cap)) @ w
                best = int(fits[int(np.argmax(score))])
        if best < 0:
            room[live], ids[live], best = cap, made, live
            live, made = live + 1, made + 1
        room[best] -= need
        out[k] = ids[best]
        if room[best, 0] < max(least, 1e-9) or room[best, 1] < 1 or room[best, 2] < least * least:  # full: the last open one takes its place
            live -= 1
            room[best], ids[best] = room[live], ids[live]
    return out


def items(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 512, size=pattern_size) -> DataFrame:
    """(key, piece_no, token_start, n_tokens): a document, or its parts if it exceeds the capacity."""
    ship(df.sparkSession)
    sized = df.select(F.col(key).alias("_key"), size(F.col(text)).alias("_n")).groupBy("_key").agg(F.max("_n").alias("_n"))
    return sized.select("_key", "_n", F.explode(F.expr(f"sequence(0, greatest(cast(ceil(_n / {capacity}) as int) - 1, 0))")).alias("_p")).select(
        F.col("_key").alias(key), (F.col("_p") + 1).alias("piece_no"), (F.col("_p") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("_n") - F.col("_p") * capacity).alias("n_tokens")
    )


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 512, max_items: int = 64, attention: float | None = None, size=pattern_size, shard_items: int = 8192, rule: str = "residual") -> DataFrame:
    """(container_id, key, piece_no, token_start, n_tokens): every document placed once, divided only if
    longer than ``capacity``. container_id is unique over all shards and repeatable. ``attention`` bounds the sum of
    squared lengths; an item whose own square exceeds it has a container alone. Its default is three quarters of the capacity
    squared, since a sum of squares above the capacity squared can't occur: two long items then don't share a container."""
    ship(df.sparkSession)
    attention = float(0.75 * capacity * capacity if attention is None else attention)
    if attention <= 0:
        raise ValueError("the attention capacity must be positive")
    found = items(df, key, text, capacity, size)
    kind = found.schema[key].dataType.simpleString()
    shards = max(1, -(-df.count() // shard_items))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece_no"], kind="stable", na_position="first").reset_index(drop=True)
        at = best_fit(pdf["n_tokens"].to_numpy(), capacity, max_items, attention, rule=rule)
        return pd.DataFrame({"container_id": [f"{s}-{c}" for s, c in zip(pdf["_shard"], at)], key: pdf[key], "piece_no": pdf["piece_no"], "token_start": pdf["token_start"], "n_tokens": pdf["n_tokens"]})

    # the key travels as a string: pandas would turn whole numbers beside a null into floats
    # packing is work for the processor: as many tasks as shards, up to some per core, which no adaptive plan merges
    tasks = min(shards, max(200, 8 * df.sparkSession.sparkContext.defaultParallelism))
    return (
        found.withColumn("_shard", F.pmod(F.xxhash64(key, "piece_no"), F.lit(shards)).cast("int"))
        .withColumn(key, F.col(key).cast("string"))
        .repartition(tasks, "_shard")
        .groupBy("_shard")
        .applyInPandas(place, f"container_id string, `{key}` string, piece_no int, token_start int, n_tokens int")
        .withColumn(key, F.col(key).cast(kind))
    )


def fill(packed: DataFrame, capacity: int = 512) -> DataFrame:
    """One row: containers used, tokens, the containers that tokens alone would need, and the share filled."""
    return packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.ceil(F.sum("t") / capacity).alias("lower_bound"), (F.sum("t") / (F.count("*") * capacity)).alias("filled")
    )
