"""Statistics: profiles, selective prediction, calibration, conformal sets, entity scores, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, count), nulls counted too; with ``top`` only the most frequent, ties by value."""
    g = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return g if top is None else g.orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(top)


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, percent)."""
    g = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return g.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("_x")).select("_x.column", "_x.nulls", F.when(F.col("_n") > 0, F.round(100.0 * F.col("_x.nulls") / F.col("_n"), 4)).otherwise(0.0).alias("percent"))


def describe(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, least, quartiles (exact, interpolated), greatest. Exact percentiles keep a histogram of
    distinct values per group, partial before the shuffle."""
    d = df.withColumn("_v", value.cast("double")).filter("_v is not null")
    q = lambda p: F.percentile("_v", F.lit(p))
    return d.groupBy(*(by or [])).agg(F.count("*").alias("count"), F.avg("_v").alias("mean"), F.stddev("_v").alias("std"), F.min("_v").alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("_v").alias("max"))


def duplicates(df: DataFrame, subset: list[str]) -> DataFrame:
    """One row: rows, and rows that repeat an earlier one's subset; nulls are equal. Values are hashed before the shuffle."""
    h = F.struct(*[F.col(c) for c in subset])
    g = df.select(F.md5(F.to_json(h)).alias("_h")).groupBy("_h").agg(F.count("*").alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def footprint(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and the characters of all values written as text."""
    chars = [F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)) for f in df.schema.fields for c in [f.name] if f.dataType.typeName() not in ("array", "map", "struct")]
    total = chars[0] if chars else F.lit(0)
    for c in chars[1:]:
        total = total + c
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), total.alias("characters"))


def selective(df: DataFrame, least: float, conf: str = "confidence", correct: str = "is_correct", missing: str = "is_missing_in_ground_truth") -> DataFrame:
    """Coverage, precision (1 if nothing is accepted), abstention, and the share of missing cases that were answered."""
    ok = F.col(conf) >= least
    g = df.agg(F.count("*").alias("n"), F.count_if(ok).alias("a"), F.count_if(ok & F.col(correct)).alias("c"), F.count_if(F.col(missing)).alias("m"), F.count_if(ok & F.col(missing)).alias("f"))
    share = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(empty)
    return g.select(share("a", "n", 0.0).alias("coverage"), share("c", "a", 1.0).alias("selective_precision"), (1.0 - share("a", "n", 0.0)).alias("abstention_rate"), share("f", "m", 0.0).alias("false_answer_rate_missing"))


def threshold_sweep(df: DataFrame, steps: int = 100, conf: str = "confidence", correct: str = "is_correct") -> DataFrame:
    """(step, coverage, precision) for thresholds 0, 1/steps, ..., 1. Rows are first counted by the highest threshold they pass,
    so the sweep runs over steps + 1 rows, not over the data times the grid."""
    from pyspark.sql import Window

    b = F.greatest(F.lit(-1), F.floor(F.round(F.col(conf) * steps, 9))).cast("int")
    counted = df.filter(F.col(conf).isNotNull()).groupBy(F.least(F.lit(steps), b).alias("_b")).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("c"))
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    w = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    j = grid.join(counted, F.col("step") == F.col("_b"), "left").select("step", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("a"), F.sum(F.coalesce("c", F.lit(0))).over(w).alias("c"))
    total = F.max("a").over(Window.partitionBy(F.lit(1)))
    return j.withColumn("t", total).filter("step >= 0").select("step", F.when(F.col("t") > 0, F.col("a") / F.col("t")).otherwise(0.0).alias("coverage"), F.when(F.col("a") > 0, F.col("c") / F.col("a")).otherwise(1.0).alias("precision"))


def best_threshold(sweep: DataFrame, target: float) -> DataFrame:
    """The lowest threshold of the greatest coverage whose precision meets the target."""
    return sweep.filter(F.col("precision") >= target).orderBy(F.desc("coverage"), F.asc("step")).limit(1)


def calibration_bins(df: DataFrame, bins: int = 10, conf: str = "confidence", correct: str = "is_correct", zero: bool = False) -> DataFrame:
    """(bin, n, accuracy, mean_confidence) for bins (lo, hi]; a confidence of 0 is in none, or with ``zero`` in bin 0."""
    b = F.least(F.lit(bins), F.ceil(F.round(F.col(conf) * bins, 9))).cast("int")
    rows = df.filter(F.col(conf) >= 0) if zero else df.filter(F.col(conf) > 0)
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(conf).alias("mean_confidence"))


def ece(df: DataFrame, bins: int = 10, conf: str = "confidence", correct: str = "is_correct") -> DataFrame:
    """Expected calibration error: the bins' gaps weighted by their share of all rows."""
    b = calibration_bins(df, bins, conf, correct, zero=True)
    gap = F.when(F.col("bin") > 0, F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")).otherwise(0.0)
    return b.agg(F.coalesce(F.try_divide(F.sum(gap), F.sum("n")), F.lit(0.0)).alias("ece"))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits; the greatest is subtracted first."""
    e = F.transform(logits, lambda x: F.exp((x.cast("double") - F.array_max(logits).cast("double")) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def brier(df: DataFrame, probs: str, label: str) -> DataFrame:
    """Mean squared distance of the probabilities from the true class's unit vector."""
    d = F.aggregate(F.transform(probs, lambda p, i: F.pow(p - (i == F.col(label)).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.avg(d).alias("brier"))


def nll(df: DataFrame, logits: str, label: str, temperatures: list[float]) -> DataFrame:
    """(temperature, nll): mean negative log likelihood on a grid, in one pass."""
    top = F.array_max(logits).cast("double")

    def at(t: float) -> Column:
        z = F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x.cast("double") - top) / t)))
        return z - (F.get(logits, F.col(label)).cast("double") - top) / t

    g = df.agg(*[F.avg(at(t)).alias(f"t{i}") for i, t in enumerate(temperatures)])
    return g.select(F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)])).alias("_x")).select("_x.*")


def fit_temperature(df: DataFrame, logits: str, label: str, low: float = 0.05, high: float = 20.0, rounds: int = 4, points: int = 12) -> float:
    """The temperature of least nll, by grids that close in; each round is one aggregate of a few numbers."""
    best = 1.0
    for _ in range(rounds):
        grid = [low * (high / low) ** (i / (points - 1)) for i in range(points)]
        rows = sorted((r["nll"], r["temperature"]) for r in nll(df, logits, label, grid).collect() if r["nll"] is not None)
        if not rows:
            return best
        best = rows[0][1]
        k = grid.index(best)
        low, high = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    return best


def conformal_quantile(df: DataFrame, probs: str, label: str, alpha: float = 0.1, bins: int = 4096) -> DataFrame:
    """(n, q_hat): the quantile min(1, ceil((n+1)(1-alpha))/n) of 1 - p_true, interpolated. Exact in two passes: scores are counted by
    bin, then only the bins that hold the two ranks are sorted; so no task holds all scores."""
    import math

    s = df.select((1.0 - F.get(probs, F.col(label))).alias("_s")).filter("_s is not null")
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("_s") * bins))).cast("int")
    counts = sorted((r["_b"], r["_n"]) for r in s.groupBy(b.alias("_b")).agg(F.count("*").alias("_n")).collect())  # at most ``bins`` rows
    n = sum(c for _, c in counts)
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([(0, None)], "n long, q_hat double")
    at = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n) * (n - 1)
    ranks = [math.floor(at), min(math.floor(at) + 1, n - 1)]
    found = []
    for rank in ranks:
        before = 0
        for k, c in counts:
            if rank < before + c:
                rows = s.filter(b == k).orderBy("_s").offset(rank - before).limit(1)
                found.append(rows.first()[0])
                break
            before += c
    return spark.createDataFrame([(n, found[0] + (found[1] - found[0]) * (at - ranks[0]))], "n long, q_hat double")


def prediction_set(probs: Column, q_hat: Column) -> Column:
    """Classes with a probability of at least 1 - q_hat; without q_hat the likeliest if it has one half."""
    every = F.sequence(F.lit(0), F.size(probs) - 1)
    return F.when(q_hat.isNotNull(), F.filter(every, lambda i: F.get(probs, i) >= 1.0 - q_hat)).otherwise(F.filter(every, lambda i: (F.get(probs, i) >= 0.5) & (F.get(probs, i) == F.array_max(probs))))


def entity_scores(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of entities equal in keys, first_token, last_token and label."""
    on = [*keys, "first_token", "last_token", "label"]
    g, f = gold.select(*on).distinct().withColumn("_g", F.lit(1)), found.select(*on).distinct().withColumn("_f", F.lit(1))
    j = g.join(f, on, "full_outer").groupBy("label").agg(F.count_if(F.col("_g").isNotNull() & F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return j.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def model_pivot(reports: DataFrame, metric: str, models: list[str]) -> DataFrame:
    """One row per field, one column per model. reports: (model_name, per_field map of structs)."""
    return reports.select("model_name", F.explode("per_field").alias("field", "_m")).groupBy("field").pivot("model_name", models).agg(F.first(F.col(f"_m.{metric}")))


def badge(conf: Column, status: Column) -> Column:
    return F.when((status == "HIGH_CONFIDENCE") | (conf >= 0.80), "HIGH").when((status == "LOW_CONFIDENCE") | (conf >= 0.60), "MEDIUM").otherwise("LOW")
