"""Problem 9: find texts that were cut off, and how often each source cuts.

A logistic regression over hashed features of a text's end (closing characters, last words, shape of
the last lines, open brackets) and of its length against its source's length limit. It is trained on
a bounded sample (``train_rows``): every sampled text as it stands is taken for intact, and copies of
them, cut by us inside a word or sentence, are the positives. Since some of the sampled texts are
truncated themselves, those which the first model calls cut leave the intact side before the next fit.
Of a sampled text longer than ``longest`` its last ``longest`` characters are taken, so that the sample is bounded in
characters, too. The length statistics come from all rows; every row is scored. Where the rows allow no model (none of
them can be cut: all are shorter than 24 characters, or end where a cut can't be told), score and truncated are null:
nothing is judged.

A source's limits show as spikes in its length histogram, which counts distinct texts, so that exact copies are
no evidence: ``at`` = distinct texts of the source with exactly this length, against ``rest`` = the largest count at
any length that is no limit. A source may have several limits; a text is seen against the next one from its length up.

Null, empty and blank texts are no truncated texts and have no row in the scores. A null source is a source of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, ship

BITS = 16
TAIL = 240
SALTS = 64
BROADCAST_SOURCES = 200_000  # sources and limits together: some 10 MB
# fixed values: what shorteners, broken encodings and broken escapes leave at a cut
MARKS = ["…", "...", " ...", " [...]", "[…]", " (...)", "... (more)", " [cut]", "�", "�", "&am", "&", "\\", "\\u0", "%2", "<"]
STOPS = ".!?।॥"


def _shape(s: str) -> str:
    out = []
    for c in s:
        k = "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else "m" if ord(c) > 127 else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def features(tail: str, n: int, at: float, rest: float, over: float, open_brackets: int) -> list[int]:
    """Hashed feature numbers. ``tail`` ends the text; ``n`` is its length; ``over``: length minus the source's limit."""
    body = tail.rstrip(" \t\r\n")
    lines = body.split("\n")
    last = lines[-1].strip()
    prev = next((x.strip() for x in reversed(lines[:-1]) if x.strip()), "")
    words = last.split()
    w = words[-1].lower() if words else ""
    w2 = words[-2].lower() if len(words) > 1 else ""
    end = body[-1:]
    stop = max((body.rfind(c) for c in STOPS), default=-1)
    since = len(body) - 1 - stop
    spike = int(min(6, np.log2(max(at, 1.0)))), int(np.clip(np.log2(max(at, 1.0) / max(rest, 1.0)), -1, 4))
    gap = int(over) if -3 <= over <= 0 else (1 if over > 0 else -4)
    stopped = end in STOPS and end != ""
    closing = "s" if stopped else _shape(end)
    blank_before = len(lines) > 1 and not lines[-2].strip()
    f = [
        "bias", f"end={end}", f"kind={closing}", f"lastlen={min(len(w), 14)}", f"w={w}", f"w2={w2} {w}", f"shape={_shape(last)[-10:]}", f"shapes={_shape(last)[:12]}",
        f"nw={min(len(words), 9)}", f"first={words[0].lower() if words else ''}", f"prev={prev.lower()[-24:]}", f"prevshape={_shape(prev)[-8:]}", f"line={blank_before}{min(len(words), 6)}{closing}",
        f"since={min(since // 12, 8)}", f"blank={len(tail) - len(body)}", f"spike={spike[0]}", f"ratio={spike[1]}", f"gap={gap}", f"gapend={gap}{closing}", f"ratioend={spike[1]}{closing}",
        f"open={min(open_brackets, 2)}", f"round={n % 100 == 0}{n & (n - 1) == 0}", f"cap={_shape(prev)[-4:]}|{_shape(last)[:6]}|{min(len(words), 5)}",
    ]
    low = body.lower()
    f += [f"s{k}={low[-k:]}" for k in range(1, 7)]
    f += [f"p{k}={w[:k]}" for k in (3,)] + [f"l={last.lower()[:12]}"] + [f"word={x.lower()}" for x in words[-4:-1]]
    mask = (1 << BITS) - 1
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in f]


def _fit(rows: list[list[int]], y: np.ndarray, steps: int = 120, rate: float = 0.3, l2: float = 2e-5) -> np.ndarray:
    """Logistic regression by full-batch AdaGrad; classes weigh alike."""
    lens = np.array([len(r) for r in rows])
    ids, owner = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), lens)
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        z = np.bincount(owner, w[ids], len(rows))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(ids, e[owner], 1 << BITS) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def _score(w: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    if not rows:
        return np.empty(0)
    z = np.array([w[r].sum() for r in rows])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cut_copy(text: str, seed: int, limit: float) -> str | None:
    """The text cut inside a word or sentence, by a repeatable choice: at the source's limit, near the end or anywhere."""
    rng = np.random.default_rng(seed & 0xFFFFFFFF)
    n = len(text.rstrip(" \t\r\n"))
    if n < 24:
        return None
    way = rng.random()
    if limit > 0 and 24 < limit < n and way < 0.4:
        k = int(limit)
    elif way < 0.6:
        k = n - int(rng.integers(1, min(90, n // 2)))
    else:
        k = int(rng.integers(max(12, n // 6), n))
    head = text[:k]
    if rng.random() < 0.4:  # at a word's end
        sp = head.rfind(" ")
        head = head[:sp] if sp > 12 else head
    bare = head.rstrip(" \t\r\n")
    rest = text[len(bare) :].lstrip(" \t\r\n")
    if not rest or not bare or bare[-1] in STOPS or "\n" in text[len(bare) : len(bare) + 2]:
        return None  # that would be a natural end
    if rng.random() < 0.2:
        head = bare + MARKS[int(rng.integers(len(MARKS)))]
    return head


def _over(n: int, limits: list[int]) -> int:
    """Length minus the next limit from it up, else minus the largest; -99 without limits."""
    return n - min((x for x in limits if x >= n), default=max(limits)) if len(limits) else -99


def train(sample: pd.DataFrame, rounds: int = 3, doubt: float = 0.4, seed: int = 5) -> np.ndarray | None:
    """sample: text (its end, if it is long), n (length of the whole), limits, limit_at. Returns the weights; None if there are
    no intact texts or none that can be cut.

    Texts at a limit of their source are no examples of intact ones. A share of the copies, and a much
    smaller one of the intact texts, is given the length features of a text at a limit. The texts taken
    for intact are judged by models that have not seen them (two folds); doubtful ones leave.
    """
    rng = np.random.default_rng(seed)
    neg, pos, pos_of = [], [], []
    at_limits = (float(v) for v in iter(lambda: rng.integers(3, 200), None))
    for i, r in enumerate(sample.itertuples()):
        if -3 <= _over(r.n, r.limits) <= 0:
            neg.append(None)
        else:
            opened = max(0, r.text.count("(") - r.text.count(")"))
            at, rest, over = (next(at_limits), 1.0, 0) if rng.random() < 0.05 else (1.0, r.limit_at, _over(r.n, r.limits))
            neg.append(features(r.text[-TAIL:], r.n, at, rest, over, opened))
        before = int(r.n) - len(r.text)  # what stands before the end of a long text
        for j in range(2):
            c = cut_copy(r.text, zlib.crc32(r.text[:200].encode("utf-8", "surrogatepass")) * 7 + 31 * j, max((x for x in r.limits if x < r.n), default=0) - before)
            if c:
                n = before + len(c)
                at, rest, over = (next(at_limits), 1.0, -int(rng.integers(0, 3))) if rng.random() < 0.3 else (1.0, r.limit_at, _over(n, r.limits))
                pos.append(features(c[-TAIL:], n, at if over == 0 else 1.0, rest if over == 0 else at, over, max(0, c.count("(") - c.count(")"))))
                pos_of.append(i)
    keep = np.array([x is not None for x in neg], dtype=bool)
    if not keep.any() or not pos:
        return None
    neg = [x if x is not None else [] for x in neg]
    fold, pos_fold = np.arange(len(neg)) % 2, np.array(pos_of) % 2

    def fit(own: np.ndarray, of: np.ndarray) -> np.ndarray:
        n, p = [neg[i] for i in np.flatnonzero(own)], [pos[i] for i in np.flatnonzero(of)]
        return _fit(n + p, np.r_[np.zeros(len(n)), np.ones(len(p))]) if n and p else np.zeros(1 << BITS)

    start = keep.copy()
    for _ in range(rounds):
        judged = keep.copy()
        for k in (0, 1):
            w = fit(keep & (fold == k), pos_fold == k)
            other = np.flatnonzero(start & (fold != k))
            judged[other] = _score(w, [neg[i] for i in other]) < doubt
        if not judged.any() or (judged == keep).all():
            break
        keep = judged
    return fit(keep, np.ones(len(pos), dtype=bool))


def lengths(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Per source, over all rows: its limits as (length, distinct texts, rest) by length, and the largest count of any length.

    With the lengths in falling order of their counts, the limits are those before the last fall to a half or less from a
    count of at least 3, unless they outnumber the other lengths by more than one (then the source has few lengths by nature).
    A length with 10 texts and twice the count of any other within 64 characters is a limit, too: a rare one of a large source.
    """
    n = (
        df.filter(F.length(F.col(text)) > 0)
        .select(F.col(source).alias("_s"), F.length(F.col(text)).alias("_n"), F.xxhash64(F.col(text)).alias("_h"))
        .distinct()
        .groupBy("_s", "_n")
        .agg(F.count("*").alias("_c"))
    )
    whole = Window.partitionBy("_s")
    ranks = whole.orderBy(F.desc("_c"), F.desc("_n"))
    near = whole.orderBy("_n")
    ranked = n.select(
        "*",
        F.row_number().over(ranks).alias("_r"),
        F.coalesce(F.lead("_c").over(ranks), F.lit(0)).alias("_next"),
        F.count("*").over(whole).alias("_k"),
        F.coalesce(F.greatest(F.max("_c").over(near.rangeBetween(-64, -1)), F.max("_c").over(near.rangeBetween(1, 64))), F.lit(0)).alias("_near"),
    )
    falls = (F.col("_c") >= 3) & (F.col("_c") >= 2 * F.col("_next")) & (2 * F.col("_r") <= F.col("_k") + 1)
    ranked = ranked.withColumn("_last", F.coalesce(F.max(F.when(falls, F.col("_r"))).over(whole), F.lit(0)))
    ranked = ranked.withColumn("_spike", (F.col("_r") <= F.col("_last")) | ((F.col("_c") >= 10) & (F.col("_c") >= 2 * F.col("_near"))))
    rest = F.when(F.col("_r") <= F.col("_last"), F.coalesce(F.max(F.when(~F.col("_spike"), F.col("_c"))).over(whole), F.lit(0))).otherwise(F.col("_near"))
    spike = F.when(F.col("_spike"), F.struct(F.col("_n").alias("n"), F.col("_c").cast("double").alias("at"), rest.cast("double").alias("rest")))
    return ranked.select("_s", "_c", spike.alias("_l")).groupBy("_s").agg(F.sort_array(F.collect_list("_l")).alias("_limits"), F.max("_c").cast("double").alias("_limit_at"))


def sampled(row: Column, rows: int, wanted: int) -> Column:
    """Is this row, by a hash of its columns, one of about ``wanted`` of ``rows``? Rounded up, so that no size gives an empty sample."""
    return F.pmod(row, F.lit(1 << 62)) < F.lit(min(1 << 62, -(-(1 << 62) * wanted // max(1, rows))))


def _with_stats(rows: DataFrame, stats: DataFrame, sources: int) -> DataFrame:
    """Adds the statistics of the row's source. Those of few sources are broadcast, after a count; of very many, both sides are
    shuffled with a hot source's rows spread over SALTS."""
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(stats), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
    right = stats.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return left.join(right, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_salt2")), "left").drop("_s", "_salt", "_salt2")


def score(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", train_rows: int = 6000, longest: int = 8000) -> DataFrame:
    """(key, source, score, truncated) for every row with a non-blank text. Rows are not merged. The model is fitted on at most
    2 * train_rows rows (expected: train_rows), of each the last ``longest`` characters; on one without rows that can be cut
    score and truncated are null."""
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession, "lengths")
    base = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text")).filter(F.length(F.btrim("_text", F.lit(" \t\r\n"))) > 0)
    stats = scratch.keep(lengths(base, "_source", "_text"), "stats")
    size_of = stats.agg(F.count("*").alias("s"), F.coalesce(F.sum(F.size("_limits")), F.lit(0)).alias("l")).first()
    sources = size_of["s"] + size_of["l"]
    rows = df.count()
    sample = (
        _with_stats(base.filter(sampled(F.xxhash64(F.lit(11), "_key"), rows, train_rows)), stats, sources)
        .select(F.substring("_text", -longest, longest).alias("text"), F.length("_text").alias("n"), F.coalesce("_limits.n", F.array().cast("array<int>")).alias("limits"), F.coalesce("_limit_at", F.lit(0.0)).alias("limit_at"))
        .orderBy(F.xxhash64("text"))
        .limit(2 * train_rows)  # the documented bound of the training sample
        .toPandas()
    )
    weights = train(sample)
    if weights is None:
        return base.select(F.col("_key").alias(key), F.col("_source").alias(source), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("truncated"))

    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for tail, n, at, rest, over, opened in batches:
            yield pd.Series(_score(weights, [features(*r) for r in zip(tail, n, at, rest, over, opened)]))

    size = F.length("_text")
    count = lambda c: F.length("_text") - F.length(F.replace("_text", F.lit(c)))
    lean = base.select("_key", "_source", F.substring("_text", -TAIL, TAIL).alias("_tail"), size.alias("_n"), F.greatest(count("(") - count(")"), F.lit(0)).alias("_open"))
    # the next limit from the length up, else the largest; null without limits
    limit = F.coalesce(F.get(F.filter("_limits", lambda x: x["n"] >= F.col("_n")), F.lit(0)), F.get("_limits", F.size("_limits") - 1))
    at_limit = F.col("_n") == F.col("_limit.n")
    ready = _with_stats(lean, stats, sources).withColumn("_limit", limit).select(
        "_key", "_source",
        probability(
            "_tail", "_n",
            F.when(at_limit, F.col("_limit.at")).otherwise(F.lit(1.0)),
            F.when(at_limit, F.col("_limit.rest")).otherwise(F.coalesce("_limit_at", F.lit(0.0))),
            F.coalesce((F.col("_n") - F.col("_limit.n")).cast("double"), F.lit(-99.0)),
            "_open",
        ).alias("_p"),
    )
    return ready.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_p").alias("score"), (F.col("_p") >= 0.5).alias("truncated"))


def by_source(scored: DataFrame, source: str = "source") -> DataFrame:
    """(source, documents, truncated, share); the last two are null where nothing was judged."""
    return scored.groupBy(source).agg(F.count("*").alias("documents"), F.sum(F.col("truncated").cast("int")).alias("truncated")).withColumn("share", F.col("truncated") / F.col("documents"))
