"""Problem 3: map typed values to the entries of a reference list, or report that none is meant.

Distinct values are mapped once. A BK-tree over the folded entry names and other accepted names, under
the Levenshtein metric, returns every entry within a length-dependent distance; the triangle inequality
prunes. A value is asked for as typed, then without what is appended to it (brackets, "No. 5", "/ Urgent",
", District X") and with the parts round a comma swapped; the nearest entry wins, and of equally near
entries of different identity none.

What the metric can't see in whole names (initials, contractions such as "Dmd. Notice") is found by a second tree of the
same kind: its keys are the short forms generated from every word of the entries (beginnings, consonants, first letter with an
ending, letters in alphabetical order) and from runs of words (their initials). Each word of a value is asked for in that tree; only entries
all of whose words answered, in this order, are read word by word, and only an unambiguous reading counts.

The reference is dealt to shards of about ``shard_entries`` names; one shard is broadcast, more meet the values in blocks, as
a stated query set. In either case a shard gives, for every reading of a value, its nearest entries; ties are settled and
readings taken in their order after the merge. So the number of shards changes nothing.

Null and blank values map to nothing and give no row; a value equal to an entry name maps to it at
distance 0. An empty reference list leaves every value at 0.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

from .edits import fold, levenshtein, reads_as, words

BLANK = " \t\r\n"
STEPS = "field_name string, value string, step int, cost int, lo int, hi int, counts boolean, how string"  # lo, hi: least and largest of the nearest entries


class BKTree:
    """Burkhard-Keller tree; find() returns every (item, distance) within a radius."""

    def __init__(self, items: list[str]):
        self.root: list | None = None
        for x in items:
            self._add(x)

    def _add(self, x: str) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while (d := levenshtein(x, node[0])) != 0:
            if d not in node[1]:
                node[1][d] = [x, {}]
                return
            node = node[1][d]

    def find(self, x: str, radius: int) -> list[tuple[str, int]]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            item, kids = todo.pop()
            d = levenshtein(x, item)
            if d <= radius:
                out.append((item, d))
            todo += [kid for e, kid in kids.items() if d - radius <= e <= d + radius]
        return out


def radius(s: str) -> int:
    """Edits allowed in a value of this length; short codes must be exact."""
    n = len(s)
    return 0 if n <= 4 else 1 if n == 5 else 2 if n <= 8 else 3 if n <= 15 else 4


_SEPARATOR = re.compile(r"\s*[(\[]|\s+[-–/|]\s+|\s*[,;:]\s+|\s+&\s+")


def forms(folded: str) -> list[str]:
    """The value as typed, then its readings without additions, in falling order of trust."""
    s = folded.strip(" .,:;-")
    out = [s]
    m = re.fullmatch(r"([^,]+),\s*([^,]+)", s)
    if m:
        out.append(f"{m[2]} {m[1]}")
    head = _SEPARATOR.split(s, maxsplit=1)[0].strip(" .,")
    out.append(head)
    for base in (s, head):
        w = base.split(" ")
        out += [" ".join(w[:k]).strip(" .,") for k in range(len(w) - 1, 0, -1)]
    return list(dict.fromkeys(x for x in out if x))


def short_forms(w: str) -> set[str]:
    """The word, its beginnings, its consonants behind the first letter and their beginnings, its first letter with one or
    two of the others (so that any abbreviation of up to five letters is near a form) or with its ends, and its letters in
    alphabetical order (marked by "=")."""
    bones = w[0] + "".join(c for c in w[1:] if c not in "aeiou")
    out = {x[:k] for x in (w, bones) for k in range(1, len(x) + 1)} | {w[0] + w[k:] for k in range(2, len(w) - 2)} | {_letters(w)}
    return out | {w[0] + a for a in w[1:]} | {w[0] + a + b for i, a in enumerate(w[1:], 2) for b in set(w[i:])}


def _letters(w: str) -> str:
    return "=" + "".join(sorted(w))


def variants(full: list[str], most: int = 8) -> list[list[str]]:
    """The words of a name, and with one run of two to ``most`` words as their initials."""
    out = [full]
    for i in range(len(full)):
        for j in range(i + 2, min(len(full), i + most) + 1):
            out.append([*full[:i], "".join(w[0] for w in full[i:j]), *full[j:]])
    return out


class Matcher:
    """The names of one field: a tree of names, a tree of their words' short forms, and the entries by name."""

    def __init__(self, names: list[tuple[str, int]]):
        self.entries: dict[str, set[int]] = {}
        for name, entry in names:
            self.entries.setdefault(fold(name), set()).add(entry)
        self.tree = BKTree(sorted(self.entries))
        # names by (words, place, word), runs of words also as their initials
        self.at: dict[tuple[int, int, str], set[str]] = {}
        self.split = {n: words(n) for n in self.entries}
        short: dict[str, set[str]] = {}
        for name, full in self.split.items():
            for variant in variants(full):
                for i, w in enumerate(variant):
                    self.at.setdefault((len(variant), i, w), set()).add(name)
                    if w not in short.get(w, ()):
                        for form in short_forms(w):
                            short.setdefault(form, set()).add(w)
        self.short = short
        self.short_tree = BKTree(sorted(short))
        self.known: dict[str, set[str]] = {}

    def words_of(self, w: str) -> set[str]:
        """The entries' words of which ``w`` may be a short or misspelt form."""
        if w not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            r = 0 if len(w) <= 2 else 1 if len(w) == 3 else 2
            hits = self.short_tree.find(w, r) + (self.short_tree.find(_letters(w), 0) if len(w) >= 4 else [])
            self.known[w] = {full for form, _ in hits for full in self.short[form]}
        return self.known[w]

    def readable(self, parts: list[str]) -> set[str]:
        """The names whose words all may be meant by the parts, one by one."""
        left: set[str] | None = None
        for i, w in enumerate(parts):
            here = {n for full in self.words_of(w) for n in self.at.get((len(parts), i, full), ())}
            left = here if left is None else left & here
            if not left:
                return set()
        return left or set()

    def near(self, s: str) -> tuple[int, int, int] | None:
        """(distance, least, largest) of the nearest entries; None if there is none within the radius."""
        found = self.tree.find(s, radius(s))
        if not found:
            return None
        least = min(d for _, d in found)
        ids = {i for n, d in found if d == least for i in self.entries[n]}
        return least, min(ids), max(ids)

    def steps(self, value: str) -> Iterator[tuple[int, int, int, int, bool, str]]:
        """STEPS of the value's readings in falling order of trust. One counts if its nearest entry is a single one."""
        f = fold(value)
        for k, s in enumerate(forms(f)):
            if hit := self.near(s):
                # a shortened reading must leave most of a word standing
                yield k, *hit, k == 0 or len(s) > 4 or hit[0] == 0 and len(s) > 2, "edit" if k == 0 else "part"
        for k, s in enumerate(forms(f)):
            w = words(s)
            letters = "".join(w)
            if len(letters) < 2 or (len(w) == 1 and len(letters) < 3 and "." not in f):
                continue
            costs: dict[int, int] = {}
            for p in [list(w), list(letters)] if len(w) == 1 and len(letters) <= 5 else [list(w)]:
                for name in self.readable(p):
                    c = reads_as(p, self.split[name])
                    if c is not None:
                        for i in self.entries[name]:
                            costs[i] = min(costs.get(i, 99), c)
            if costs:
                least = min(costs.values())
                ids = [i for i, c in costs.items() if c == least]
                yield 100_000 + k, least, min(ids), max(ids), True, "abbreviation"

    def match(self, value: str) -> tuple[int, int | None, str]:
        """(entry or 0, distance or cost of the reading, how)."""
        for _, cost, lo, hi, counts, how in self.steps(value):
            if counts and lo == hi:
                return lo, cost, how
        return 0, None, "none"


def _names(reference: DataFrame) -> DataFrame:
    all_names = F.array_union(F.array(F.col("entry_name")), F.coalesce(F.col("alt_names"), F.array().cast("array<string>")))
    return reference.select(F.col("field_name"), F.col("entry_id").cast("int").alias("entry_id"), F.explode(all_names).alias("name")).filter("name is not null and field_name is not null and entry_id is not null")


def _matchers(names) -> dict[str, Matcher]:
    by: dict[str, list[tuple[str, int]]] = {}
    for field, entry, name in names:
        by.setdefault(field, []).append((name, entry))
    return {f: Matcher(v) for f, v in by.items()}


_BUILT: dict[str, dict[str, Matcher]] = {}


def _built(token: str, names) -> dict[str, Matcher]:
    """The trees of one shard, made once in a worker."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = _matchers(names)
    return _BUILT[token]


_COLUMNS = ["field_name", "value", "step", "cost", "lo", "hi", "counts", "how"]


def _steps(matchers: dict[str, Matcher], pdf: pd.DataFrame, alone: bool) -> pd.DataFrame:
    """STEPS of many values. ``alone``: no other shard can alter a reading that decides, so what comes after it is left out."""
    rows = []
    for field, value in zip(pdf["field_name"], pdf["value"]):
        decided = False
        for x in matchers[field].steps(value) if field in matchers else ():
            rows.append((field, value, *x))
            if decided := alone and x[4] and x[2] == x[3]:
                break
        if not decided:
            rows.append((field, value, 1_000_000, 0, 0, 0, True, "none"))
    return pd.DataFrame(rows, columns=_COLUMNS)


def map_values(values: DataFrame, reference: DataFrame, shard_entries: int = 50_000, frame: int = 50_000) -> DataFrame:
    """values: (field_name, value), distinct; returns (field_name, value, entry_id, distance, how), one row per value, entry_id 0 where none is meant.
    ``frame``: about so many values meet a shard at a time."""
    spark = values.sparkSession
    ship(spark)
    names = _names(reference)
    few = [tuple(r) for r in names.limit(shard_entries + 1).collect()]  # bounded by the limit
    token = uuid.uuid4().hex
    # matching is work for the processor, not for the shuffle: as many tasks as cores, which no adaptive plan merges
    tasks = 2 * spark.sparkContext.defaultParallelism
    if len(few) <= shard_entries:
        held = spark.sparkContext.broadcast(few)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matchers = _built(token, held.value)
            for pdf in batches:
                yield _steps(matchers, pdf, alone=True)

        asked = values.select("field_name", "value").repartition(tasks, F.xxhash64("field_name", "value"))
        won = asked.mapInPandas(run, STEPS)
    else:
        shards = -(-names.count() // shard_entries)
        salts = max(1, -(-values.count() // frame))

        def both(at: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _steps(_built(f"{token}-{at[0]}", right[["field_name", "entry_id", "name"]].itertuples(index=False, name=None)), left, alone=False)

        # a stated query set against the reference in blocks
        asked = values.select("field_name", "value", F.pmod(F.xxhash64("value"), F.lit(salts)).alias("_salt"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))
        block = F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("_shard")
        held_ = names.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("_salt"))
        tasks = max(tasks, min(shards * salts, 10_000))
        won = asked.repartition(tasks, "_shard", "_salt").groupBy("_shard", "_salt").cogroup(held_.repartition(tasks, "_shard", "_salt").groupBy("_shard", "_salt")).applyInPandas(both, STEPS)
    # per reading the nearest of all shards; the first reading with a single nearest entry wins
    step = won.groupBy("field_name", "value", "step").agg(F.min(F.struct("cost", "lo", "counts", "how")).alias("_b"), F.max(F.struct((-F.col("cost")).alias("c"), "hi")).alias("_t"))
    best = step.filter("_b.counts and _b.lo = _t.hi").groupBy("field_name", "value").agg(F.min(F.struct("step", "_b.lo", "_b.cost", "_b.how")).alias("_w"))
    return best.select("field_name", "value", F.col("_w.lo").alias("entry_id"), F.when(F.col("_w.how") != "none", F.col("_w.cost")).alias("distance"), F.col("_w.how").alias("how"))


def typed_values(df: DataFrame, fields: list[str], key: str = "document_id") -> DataFrame:
    """(key, field_name, value): the non-blank values, once per key, field and value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]))
    return df.select(F.col(key).alias("_key"), pairs.alias("_p")).select(F.col("_key").alias(key), "_p.field_name", "_p.value").filter(F.length(F.btrim("value", F.lit(BLANK))) > 0).distinct()


def map_fields(df: DataFrame, reference: DataFrame, fields: list[str], key: str = "document_id") -> DataFrame:
    """(key, field_name, value, entry_id, distance, how) for every typed value; each distinct value is matched once."""
    typed = typed_values(df, fields, key)
    mapped = map_values(typed.select("field_name", "value").distinct(), reference)
    return typed.join(mapped, ["field_name", "value"]).select(key, "field_name", "value", "entry_id", "distance", "how")
