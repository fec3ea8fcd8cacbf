"""Problem 2: splits that keep related records together.

Connected components by contraction of minimum edges (Boruvka): every component picks its least edge, the
picked edges form trees of components, pointer doubling takes each tree to its root, edges inside a component
go. The number of components with edges at least halves in a round, so rounds grow with the logarithm of the
input. Every round's picks are written to the shared folder: together they are a spanning forest, which
``spanning_forest`` gives as rows and keeps under a path; ``groups_of`` reads groups from it. Only counts reach the driver; edges, labels and forest stay in tables, so a lost executor costs no more than one round.

Hot nodes (a third of all edges at one key) are no bottleneck: picks are aggregated before the shuffle, and an
end's new label is looked up with the node salted.

Splits: a root's weight is its number of chunks. Roots heavy enough to upset the proportions (more than
1/``heavy`` of all chunks, hence fewer than ``heavy`` of them) are dealt first, largest first, each to the split
that lacks most. The rest are stratified by size band (powers of two) and dealt systematically: along each
band, in hash order, the running sum of chunks runs through the shares that the splits still lack.
Proportions are met to within the largest light root.

Ids and keys are compared in upper case without outer blanks. Null, blank and "not known" keys tie nothing, nor
does a record tied to itself. Repeated rows change nothing. Records without any tie are groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch

BLANK = " \t\r\n"
# fixed values: keys that say that nothing is known
NOT_KNOWN = ["UNKNOWN", "NOT KNOWN", "N/A", "NA", "N.A.", "NONE", "NULL", "NIL", "-", "--", "?", "??", "TBD", "NOT AVAILABLE", "NOT STATED", "NOT GIVEN", "UNSPECIFIED", "(UNKNOWN)", "(NOT KNOWN)"]
SALTS = 16


def norm(c: Column | str) -> Column:
    return F.upper(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANK)))


def ties(links: DataFrame, record: str = "document_id", kind: str = "link_kind", key: str = "link_key", direct: str = "revision_of") -> DataFrame:
    """(a, b): records and keys as nodes of one graph. Records are "D:id", keys "K:key"; the key of a ``direct``
    link is itself a record."""
    rec, k = norm(record), norm(key)
    ok = (F.length(rec) > 0) & (F.length(k) > 0) & ~k.isin(NOT_KNOWN)
    # a key both shared and naming a record ties either way
    edge = F.struct(F.concat(F.lit("D:"), rec).alias("a"), F.when(F.col(kind) == direct, F.concat(F.lit("D:"), k)).otherwise(F.concat(F.lit("K:"), k)).alias("b"))
    return links.filter(ok).select(edge.alias("_e")).select("_e.a", "_e.b").filter("a <> b").distinct()


def _relabel(edges: DataFrame, labels: DataFrame, end: str, to: str) -> DataFrame:
    """``to`` = the label of ``end``. The hot ends are spread over SALTS by their edge; labels are copied to each salt."""
    left = edges.withColumn("_salt", F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int"))
    right = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    # copies of one label compress so well that their size says little: never broadcast
    return left.join(right.hint("merge"), (F.col(end) == F.col("_n")) & (F.col("_salt") == F.col("_s")), "left").withColumn(to, F.coalesce("_l", end)).drop("_n", "_l", "_s", "_salt")


def forest(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 64) -> tuple[DataFrame | None, list[str]]:
    """(labels (node, label) | None, names of the written tables of picked edges (u, v, round))."""
    spark = edges.sparkSession
    live = scratch.keep(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct().withColumns({"x": F.col("u"), "y": F.col("v")}), f"{name}-live-0")
    maps: list[str] = []
    picks: list[str] = []
    for step in range(max_rounds + 1):
        if live.isEmpty():
            break
        if step == max_rounds:  # each round halves the components, so only a fault gets here
            raise RuntimeError(f"components are unfinished after {max_rounds} rounds")
        # order of edges: a hash first, so that chains do not contract one link a round; then the ends, for uniqueness
        weight = F.struct(F.xxhash64("u", "v").alias("w"), "u", "v", "x", "y")
        ends = live.select(F.col("x").alias("c"), weight.alias("e")).union(live.select(F.col("y").alias("c"), weight.alias("e")))
        pick = ends.groupBy("c").agg(F.min("e").alias("e")).select("c", F.when(F.col("e.x") == F.col("c"), F.col("e.y")).otherwise(F.col("e.x")).alias("p"), "e.u", "e.v")
        pick = scratch.keep(pick, f"{name}-pick-{step}")
        picks.append(f"{name}-pick-{step}")
        # mutual picks have one pair of ends: the smaller of the two is the root. No key has more than two rows
        two = pick.groupBy(F.least("c", "p").alias("lo"), F.greatest("c", "p").alias("hi")).agg(F.count("*").alias("n"), F.min("c").alias("c"), F.min("p").alias("p"))
        own = F.when(F.col("n") == 2, F.array(F.struct(F.col("lo").alias("c"), F.col("lo").alias("p")), F.struct(F.col("hi").alias("c"), F.col("lo").alias("p")))).otherwise(F.array(F.struct("c", "p")))
        parent = scratch.keep(two.select(F.explode(own).alias("_e")).select("_e.c", "_e.p"), f"{name}-up-{step}-0")
        for hop in range(1, 64):  # pointer doubling
            # many children of one root: looking up its parent is salted too
            nxt = _relabel(parent.select(F.col("c").alias("u"), F.col("p").alias("v")), parent.select(F.col("c").alias("node"), F.col("p").alias("label")), "v", "g").select(F.col("u").alias("c"), F.col("g").alias("p"), (F.col("g") != F.col("v")).alias("_moved"))
            nxt = scratch.keep(nxt, f"{name}-up-{step}-{hop}")
            scratch.drop(f"{name}-up-{step}-{hop - 1}")
            moved = nxt.filter("_moved").limit(1).count()
            parent = nxt.select("c", "p")
            if not moved:
                break
        maps.append(f"{name}-up-{step}-{hop}")
        labels = parent.select(F.col("c").alias("node"), F.col("p").alias("label"))
        live2 = _relabel(_relabel(live, labels, "x", "x2"), labels, "y", "y2").filter("x2 <> y2").select("u", "v", F.col("x2").alias("x"), F.col("y2").alias("y"))
        # of parallel edges between two components the least will do
        live2 = live2.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct(F.xxhash64("u", "v").alias("w"), "u", "v")).alias("e")).select("e.u", "e.v", "x", "y")
        live2 = scratch.keep(live2, f"{name}-live-{step + 1}")
        scratch.drop(f"{name}-live-{step}")
        live = live2
    if not maps:
        return None, picks
    labels = None
    for m in maps:
        up = spark.read.parquet(scratch.path(m)).select(F.col("c").alias("node"), F.col("p").alias("label"))
        if labels is None:
            labels = up
        else:
            # roots of earlier rounds move on; many nodes share a root: salted look-up
            labels = _relabel(labels.select(F.col("node").alias("u"), F.col("label").alias("v")), up, "v", "g").select(F.col("u").alias("node"), F.col("g").alias("label"))
    return scratch.keep(labels, f"{name}-labels"), picks


def salted_lookup(left: DataFrame, on: str, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of ``right`` (one row per key) where ``on`` equals ``key``, also if a third of all rows have one value."""
    own = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    held = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.join(held.hint("merge"), (F.col(on) == F.col(key)) & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_s")


def pairs_within(members: DataFrame, item: str, group: str, block: int = 2000) -> DataFrame:
    """(a, b), a < b: all pairs of items of one group, items being unique. A group of more than ``block`` items is cut into blocks,
    and each pair of its blocks is a key of its own, so that no task holds a hot group."""
    parts = members.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / block).cast("int").alias("_k"), F.count("*").alias("_m")).filter("_m > 1").drop("_m")
    sized = salted_lookup(members.select(F.col(item).alias("_i"), F.col(group).alias("_o")), "_o", parts, "_g").filter("_k is not null")
    own = F.pmod(F.xxhash64("_i"), F.col("_k")).cast("int")
    each = sized.select("_i", "_o", own.alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_c"))
    each = each.select("_i", "_o", "_b", F.least("_b", "_c").alias("_lo"), F.greatest("_b", "_c").alias("_hi"))
    a, b = each.toDF("a", "_o", "_ba", "_lo", "_hi"), each.toDF("b", "_o", "_bb", "_lo", "_hi")
    # within one block all pairs, between two blocks only those of different ones: each pair has one key
    return a.join(b.hint("merge"), ["_o", "_lo", "_hi"]).filter((F.col("a") < F.col("b")) & ((F.col("_lo") == F.col("_hi")) | (F.col("_ba") != F.col("_bb")))).select("a", "b")


def spanning_forest(links: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """(a, b, round): the picked edges; they span every group without a cycle. With ``path`` they are kept there as a table."""
    scratch = Scratch(links.sparkSession, "forest")
    _, picks = forest(ties(links, **columns), scratch, "ties")
    out = links.sparkSession.createDataFrame([], "a string, b string, round int")
    for n, pick in enumerate(picks):
        out = out.union(links.sparkSession.read.parquet(scratch.path(pick)).select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(n).alias("round")))
    out = out.groupBy("a", "b").agg(F.min("round").alias("round"))  # both ends may pick an edge
    if path is None:
        return out
    out.write.mode("overwrite").parquet(path)
    return links.sparkSession.read.parquet(path)


def groups_of(tree: DataFrame) -> DataFrame:
    """(record, group_id) from a kept forest, as groups() gives it, without the links."""
    return _grouped(tree.sparkSession, forest(tree.select("a", "b"), Scratch(tree.sparkSession, "tree"), "tree")[0])


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of every node with an edge (a, b); component is the least node of the component."""
    labels, _ = forest(edges, scratch, name)
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return _relabel(labels.select(F.col("node").alias("u"), F.col("label").alias("v")), least.select(F.col("label").alias("node"), F.col("component").alias("label")), "v", "component").select(F.col("u").alias("node"), "component")


def groups(links: DataFrame, **columns: str) -> DataFrame:
    """(record, group_id): records tied to others; group_id is the least record id of the group."""
    scratch = Scratch(links.sparkSession, "groups")
    return _grouped(links.sparkSession, forest(ties(links, **columns), scratch, "ties")[0])


def _grouped(spark: SparkSession, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return spark.createDataFrame([], "record string, group_id string")
    docs = labels.filter(F.col("node").startswith("D:")).select(F.expr("substring(node, 3)").alias("record"), "label")
    sized = docs.groupBy("label").agg(F.min("record").alias("group_id"), F.count("*").alias("_n")).filter("_n > 1")
    lab = sized.select(F.col("label").alias("node"), F.col("group_id").alias("label"))
    return _relabel(docs.select(F.col("record").alias("u"), F.col("label").alias("v")), lab.withColumn("label", F.concat(F.lit("G"), "label")), "v", "g").filter("g <> v").select(F.col("u").alias("record"), F.expr("substring(g, 2)").alias("group_id"))


def assign_splits(chunks: DataFrame, links: DataFrame, shares: dict[str, float] | None = None, heavy: int = 1000, seed: int = 42, key: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """(key, index, group_id, split), one row per distinct chunk. Keys are given in upper case without outer blanks."""
    shares = shares or {"train": 0.70, "validation": 0.15, "test": 0.15}
    scratch = Scratch(chunks.sparkSession, "splits")
    distinct = chunks.select(norm(key).alias("_d"), F.col(index).alias("_i")).distinct()
    per_doc = distinct.groupBy("_d").agg(F.count("*").alias("_n"))
    grouped = scratch.keep(per_doc.join(groups(links), F.col("_d") == F.col("record"), "left").select("_d", "_n", F.coalesce("group_id", "_d").alias("_g")), "groups")
    roots = scratch.keep(grouped.groupBy("_g").agg(F.sum("_n").alias("_w")), "roots")
    total = roots.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    names = list(shares)
    want = {s: shares[s] * total for s in names}
    dealt: list[tuple[str, str]] = []
    least = max(1, -(-total // heavy))
    for g, w in roots.filter(F.col("_w") > least).orderBy(F.desc("_w"), "_g").collect():  # fewer than ``heavy`` rows
        s = max(names, key=lambda x: (want[x], -names.index(x)))
        want[s] -= w
        dealt.append((g, s))
    lack = {s: max(0.0, v) for s, v in want.items()}
    rest = sum(lack.values()) or 1.0
    # systematic dealing: the share of a band's chunks that lies before a root's middle, in hash order, read
    # against the lacking shares; off by no more than one root a band and border. The running sum is built
    # from sums per hash bucket, so no window spans a whole band.
    light = roots.filter(F.col("_w") <= least).withColumns({"_band": F.floor(F.log2("_w")).cast("int"), "_h": F.xxhash64(F.lit(seed), "_g")}).withColumn("_b", F.pmod("_h", F.lit(256)).cast("int"))
    band = Window.partitionBy("_band")
    before = light.groupBy("_band", "_b").agg(F.sum("_w").alias("_s")).withColumns({"_before": F.sum("_s").over(band.orderBy("_b")) - F.col("_s"), "_all": F.sum("_s").over(band)}).drop("_s")
    run = light.join(before, ["_band", "_b"]).withColumn("_at", F.col("_before") + F.sum("_w").over(Window.partitionBy("_band", "_b").orderBy("_h", "_g")) - F.col("_w") / 2)
    place = F.col("_at") / F.col("_all") * rest
    split, edge = None, 0.0
    for s in names[:-1]:
        edge += lack[s]
        split = F.when(place < edge, F.lit(s)) if split is None else split.when(place < edge, F.lit(s))
    light = run.select("_g", split.otherwise(F.lit(names[-1])).alias("split") if split is not None else F.lit(names[-1]).alias("split"))
    first = chunks.sparkSession.createDataFrame(dealt, "_g string, split string")
    by_doc = grouped.join(light.union(first), "_g", "left").select("_d", F.col("_g").alias("group_id"), F.coalesce("split", F.lit(names[0])).alias("split"))
    # a document may hold a third of all chunks: the look-up is salted
    left = distinct.withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(SALTS)).cast("int"))
    right = by_doc.withColumnRenamed("_d", "_e").withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_salt") == F.col("_salt2")), "left").select(F.col("_d").alias(key), F.col("_i").alias(index), "group_id", F.coalesce("split", F.lit(names[0])).alias("split"))
