"""Grouped helpers that stay safe when one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], order: str, value: Column, name: str, width: int = 1024) -> DataFrame:
    """The sum of ``value`` over the group's rows before this one, by the whole-number column ``order`` (unique in the group).

    Two levels: rows are windowed in stretches of ``width`` orders, stretches by their sums. No task sorts a whole group.
    Null values count 0.
    """
    part = F.floor(F.col(order) / width)
    v = F.coalesce(value, F.lit(0))
    base = df.withColumns({"_part": part, "_value": v})
    keys = [F.col(g) for g in group]
    sums = base.groupBy(*group, "_part").agg(F.sum("_value").alias("_s")).withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_s")).select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_before")
    on = F.col("_part") == F.col("_p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inner = Window.partitionBy(*keys, F.col("_part")).orderBy(order)
    return base.join(sums, on, "left").withColumn(name, F.coalesce("_before", F.lit(0)) + F.sum("_value").over(inner) - F.col("_value")).drop("_part", "_value", "_p", "_before", *[f"_g_{g}" for g in group])


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a total order; limited on both sides of the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
