"""Problem 5: link the spellings of one office or officer.

Every distinct raw value is read once: lower case, look-alike digits, honorifics and "(HQ)" off, then as an
office (head word, subject, place; or initials of these), or as an officer (given name or initial, surname,
post). A reading in fixed order is the normalised name, in which reordered parts no longer differ. The word lists that
expand short heads and posts only normalise; ``lists=NO_LISTS`` links without them (README has the recall of both).

Names are joined within ``K`` edits by the pigeonhole principle: a text is cut into k + 1 segments, one of which any text
within k edits must contain unharmed, at a position shifted by at most what the edits before and behind it allow. The
segments of one name of every reading form an inverted index; the shifted substrings of every name look them up, also of
names read alike, which meet their reading's name at distance 0. The pairs found are verified by banded edit distance and by
comparing the readings. Each name gives several texts: the normalised name; initials and place, as abbreviations are too
far from their full names; the place among offices of one head, the subject among those without a place, and the surname
among officers of one initial and post, as the rest may differ by more than K edits.

A segment that many names share is cut in blocks on both sides, and each pair of blocks is a key of its own.
Linked readings are merged by contraction of minimum edges (the operator of problem 2), so chains of any length work.

Null and blank values name nobody and are not linked. Values are neither trimmed nor folded in the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .edits import abbreviates, banded, fold, levenshtein, words
from .spanning import components, salted_lookup

K = 2
SHORT = 6

# fixed values: words that head the names of offices, and their usual short forms
HEADS = ["agency", "authority", "board", "bureau", "commission", "commissionerate", "committee", "corporation", "council", "department", "directorate", "division", "inspectorate", "ministry", "office", "registry", "secretariat", "tribunal"]
SHORT_HEADS = {
    "auth": "authority", "authy": "authority", "bd": "board", "brd": "board", "bur": "bureau", "buro": "bureau", "comm": "commission", "commrate": "commissionerate", "commte": "commissionerate",
    "corp": "corporation", "corpn": "corporation", "coun": "council", "cncl": "council", "dept": "department", "deptt": "department", "dte": "directorate", "dirte": "directorate",
    "div": "division", "insptte": "inspectorate", "inspt": "inspectorate", "min": "ministry", "mo": "ministry", "m": "ministry", "ofc": "office", "oo": "office", "off": "office", "sectt": "secretariat",
}
PLACELESS = {"ministry"}
# fixed values: posts of officers, word by word; and honorifics
POST_WORDS = ["additional", "assistant", "chief", "collector", "commissioner", "controller", "deputy", "director", "engineer", "executive", "general", "inspector", "joint", "junior", "manager", "magistrate", "officer", "registrar", "secretary", "senior", "superintendent", "under", "principal", "special"]
SHORT_POSTS = {"addl": "additional", "asst": "assistant", "commr": "commissioner", "dy": "deputy", "dir": "director", "engr": "engineer", "ex": "executive", "exe": "executive", "jt": "joint", "secy": "secretary", "supdt": "superintendent", "u": "under", "regr": "registrar"}
HONORIFICS = {"shri", "smt", "dr", "mr", "mrs", "ms", "sri", "kum", "km", "prof"}
JOINTS = {"of", "the", "at", "and", "for", "hq", "in", "&"}


class Lists(NamedTuple):
    """The vocabulary that readings are normalised by."""

    heads: list[str] = HEADS
    short_heads: dict[str, str] = SHORT_HEADS
    placeless: set[str] = PLACELESS
    posts: list[str] = POST_WORDS
    short_posts: dict[str, str] = SHORT_POSTS
    honorifics: set[str] = HONORIFICS


LISTS = Lists()
NO_LISTS = Lists([], {}, set(), [], {}, set())


def _lookup(word: str, full: list[str], short: dict[str, str], strict: bool = False) -> str | None:
    """The vocabulary word that ``word`` is, abbreviates or misspells."""
    if word in full:
        return word
    if word in short:
        return short[word]
    if strict or len(word) < 4:
        return None
    best: tuple[int, str] | None = None
    for form, meant in [*short.items(), *((f, f) for f in full)]:
        if len(form) < 4:
            continue
        most = 2 if min(len(word), len(form)) >= 7 and form == meant else 1
        d = 1 if sorted(word) == sorted(form) else levenshtein(word, form, most)
        if d <= most and (best is None or d < best[0]):
            best = (d, meant)
    return best[1] if best else None


def _post(ws: list[str], lists: Lists) -> list[str] | None:
    out = [_lookup(w, lists.posts, lists.short_posts) for w in ws]
    return out if out and all(out) else None  # type: ignore[return-value]


def read(raw: str, lists: Lists = LISTS) -> dict | None:
    """The reading of a raw value: kind (office, initials, officer), and its parts as folded words."""
    s = fold(raw)
    if not words(s):
        return None
    s = re.sub(r"\(\s*hq\s*\)", " ", s)
    s = re.sub(r"^the\s+", "", s.strip(" .,;-"))
    ws = words(s)
    # officers
    honor = bool(ws) and ws[0] in lists.honorifics
    body = re.sub(r"^(%s)\b\.?\s*" % "|".join(sorted(lists.honorifics)), "", s) if honor else s
    officer = _officer(body, honor, lists)
    if officer:
        return officer
    # initials: letters of the raw value tell BoHC from a word
    bare = re.sub(r"^The\s+", "", raw.strip())
    m = re.match(r"^((?:[A-Za-z]\.\s?){3,}|[A-Z]o[A-Z]{1,4}\b)", bare)
    if m:
        letters = re.sub(r"[^a-z]", "", m[1].lower())
        rest = words(fold(bare[m.end() :]))
        place = " ".join(w for w in rest if w not in JOINTS)
        return {"kind": "initials", "head": letters[0], "subject": letters, "place": place}
    return _office(s, lists)


def _officer(s: str, honor: bool, lists: Lists) -> dict | None:
    post: list[str] | None = None
    name = s
    m = re.match(r"^(.*?)\s*\(([^)]*)\)\s*$", s)
    if m and (p := _post(words(m[2]), lists)):
        name, post = m[1], p
    elif "," in s:
        parts = [x.strip() for x in s.split(",")]
        if p := _post(words(parts[-1]), lists):
            name, post = ", ".join(parts[:-1]), p
    if post is None:
        w = words(s)
        if len(w) > 2 and len(w[0]) == 1 and (p := _post(w[2:], lists)):  # G Surname Post
            name, post = f"{w[0]} {w[1]}", p
    if post is None:
        if re.fullmatch(r"[^\W\d_]{4,} [^\W\d_]\.?", s):  # Surname G.
            w = words(s)
            return {"kind": "officer", "surname": w[0], "given": w[1], "post": ""}
        w = words(s)
        plain = len(w) == 2 and min(map(len, w)) > 2 and "," not in s and not any(_lookup(x, lists.heads, lists.short_heads) for x in w)
        if not (honor or plain):
            return None
    comma = re.match(r"^([^,]+),\s*([^,]+)$", name)
    w = words(name)
    if len(w) < 2:
        return None
    if comma:
        order = "surname"
        surname, given = words(comma[1])[-1], words(comma[2])[0]
    elif len(w[-1]) == 1:
        order, surname, given = "surname", w[0], w[-1]
    else:
        order, surname, given = "any" if len(w[0]) > 1 and not honor else "given", w[-1], w[0]
    return {"kind": "officer", "surname": surname, "given": given, "post": " ".join(post or []), "order": order}


def _office(s: str, lists: Lists) -> dict:
    place = ""
    core = s
    m = re.match(r"^(.*?)\s*\(([^)]+)\)\s*$", core)
    if m:
        core, place = m[1], m[2]
    elif m := re.match(r"^([^:]+):\s+(.+)$", core):
        place, core = m[1], m[2]
    elif m := re.match(r"^(.+?)(?:,\s*|\s+-\s+|\s+at\s+)([^,]+)$", core):
        core, place = m[1], m[2]
    w = [x for x in words(core) if x not in JOINTS]
    places = [x for x in words(place) if x not in JOINTS]
    head, at = "", -1
    order = [0, len(w) - 1, *range(1, len(w) - 1)] if w else []
    for strict in (True, False):
        for i in order:
            # an abbreviation of one letter or two stands first
            if (h := _lookup(w[i], lists.heads, lists.short_heads, strict)) and (len(w[i]) > 3 or i == 0):
                head, at = h, i
                break
        if head:
            break
    subject = [x for i, x in enumerate(w) if i != at]
    if head and not places and head not in lists.placeless and at == len(w) - 1 and len(subject) > 1:
        places, subject = subject[:1], subject[1:]  # Place Subject Head
    return {"kind": "office", "head": head, "subject": " ".join(subject), "place": " ".join(places)}


class Signature(NamedTuple):
    """A text to be joined on: only those of one block meet, within ``k`` edits, of short texts (under SHORT characters) ``small``."""

    block: str
    text: str
    small: int = K
    k: int = K

    def within(self, n: int) -> int:
        """The edits allowed against a text of length n."""
        return self.small if min(n, len(self.text)) < SHORT else self.k


def normalised(r: dict) -> str:
    """The reading as one text, its parts in fixed order."""
    parts = (r["given"], r["surname"], r["post"]) if r["kind"] == "officer" else (r.get("head", ""), r["subject"], r["place"])
    return " ".join(x for x in parts if x)


def signatures(r: dict) -> list[Signature]:
    """What the name is joined on. All that same() accepts is near in one of them."""
    out = [Signature("n:" + r["kind"], normalised(r))]
    if r["kind"] == "officer":
        for given, surname in {(r["given"], r["surname"]), (r["surname"], r["given"])}:
            if surname and given and (len(surname) > 2 or surname == r["surname"]):  # Surname Given without a comma
                # a post meets the same post and none; none meets all
                out += [Signature(f"p:{given[0]}:{post}", surname, 1) for post in {r["post"], "*"}]
    elif r["kind"] == "initials":
        out.append(Signature("o", f"{r['subject']}|{r['place']}") if r["place"] else Signature("m", r["subject"], 0, 0))
    elif r["head"]:
        initials = r["head"][0] + "o" + "".join(x[0] for x in r["subject"].split())
        if r["place"]:
            out += [Signature("o", f"{initials}|{r['place']}"), Signature("l:" + r["head"], r["place"], 0)]
        else:
            out += [Signature("m", initials, 0, 0), Signature("f:" + r["head"], r["subject"])]
    else:
        out.append(Signature("x", f"{r['subject']} {r['place']}".strip()))
    return [x for x in out if x.text]


def index_keys(r: dict) -> set[tuple[str, str, int]]:
    """(segment, text, edits) under which a name stands in the index; the segment names its block, text length and number."""
    out = set()
    for sig in signatures(r):
        n = len(sig.text)
        for k in {sig.within(m) for m in range(max(1, n - sig.k), n + sig.k + 1)}:
            out |= {(f"{sig.block}\x1f{k}\x1f{n}\x1f{i}\x1f{seg}", sig.text, k) for i, _, seg in segments(sig.text, k)}
    return out


def probe_keys(r: dict) -> set[tuple[str, str, int]]:
    """(segment, text, edits) under which names near to this one stand."""
    out = set()
    for sig in signatures(r):
        block: str | None = sig.block
        if r["kind"] == "officer" and sig.block.startswith("p:"):
            # with a post: those of the same post, and those without one; without a post: all, who stand under the star
            star = sig.block.endswith(":*")
            if r["post"]:
                block = sig.block[:-1] if star else sig.block
            elif not star:
                block = None
        if block is None:
            continue
        for k in {sig.small, sig.k}:
            out |= {(f"{block}\x1f{k}\x1f{n}\x1f{i}\x1f{x}", sig.text, k) for n, i, x in probes(sig.text, k) if sig.within(n) == k}
    return out


def _swapped(r: dict) -> dict:
    return r | {"surname": r["given"], "given": r["surname"]}


def _close(a: str, b: str, k: int) -> bool:
    return banded(a, b, k) <= k


def _given_fits(a: str, b: str) -> bool:
    if not a or not b or a[0] != b[0]:
        return False
    if len(a) == 1 or len(b) == 1 or _close(a, b, 2) or abbreviates(a, b) or abbreviates(b, a):
        return True
    return len(a) >= 3 and len(b) >= 3 and a[:2] == b[:2] and min(len(a), len(b)) <= 5  # a short form


def _words_fit(a: list[str], b: list[str]) -> bool:
    spent = 0
    for x, y in zip(a, b):
        if x == y or abbreviates(x, y) or abbreviates(y, x):
            continue
        d = banded(x, y, 2)
        if d > (2 if min(len(x), len(y)) >= 5 else 1):
            return False
        spent += d
    return len(a) == len(b) and spent <= 3


def same(a: dict, b: dict) -> bool:
    """Do the readings name the same office or officer?"""
    kinds = {a["kind"], b["kind"]}
    if kinds == {"officer"}:
        if a["post"] and b["post"] and a["post"] != b["post"]:
            return False
        k = 2 if min(len(a["surname"]), len(b["surname"])) >= 6 else 1
        return _close(a["surname"], b["surname"], k) and _given_fits(a["given"], b["given"])
    if "officer" in kinds:
        return False
    pk = 2 if min(len(a["place"]), len(b["place"])) >= 6 else 0
    if bool(a["place"]) != bool(b["place"]) or not _close(a["place"], b["place"], pk):
        return False
    if kinds == {"initials"}:
        return a["subject"] == b["subject"]
    if "initials" in kinds:
        i, o = (a, b) if a["kind"] == "initials" else (b, a)
        return bool(o["head"]) and i["subject"] == o["head"][0] + "o" + "".join(x[0] for x in o["subject"].split())
    if a["head"] != b["head"]:
        return False
    x, y = a["subject"].split(), b["subject"].split()
    if _words_fit(x, y):
        return True
    return _close("".join(x), "".join(y), 2) or (sorted(x) == sorted(y))


def segments(s: str, k: int = K) -> list[tuple[int, int, str]]:
    """(number, start, segment) of the even partition into k + 1 parts."""
    n, parts = len(s), min(k, max(0, len(s) - 1)) + 1
    cuts = [round(i * n / parts) for i in range(parts + 1)]
    return [(i, cuts[i], s[cuts[i] : cuts[i + 1]]) for i in range(parts)]


def probes(s: str, k: int = K) -> set[tuple[int, int, str]]:
    """(length, number, substring): of any text of that length within k edits, one segment stands here. Segment i may have
    moved by i edits before it, and by k - i behind it, counted from the end."""
    out = set()
    for n in range(max(1, len(s) - k), len(s) + k + 1):
        parts = segments("?" * n, k)
        whole = len(parts) == k + 1  # shorter texts have fewer segments than edits
        d = len(s) - n
        for i, start, seg in parts:
            lo, hi = (max(start - i, start + d - (k - i)), min(start + i, start + d + (k - i))) if whole else (start - k, start + k)
            for at in range(max(0, lo), min(len(s) - len(seg), hi) + 1):
                out.add((n, i, s[at : at + len(seg)]))
    return out


READING = "raw string, class_key string, kind string, head string, subject string, place string, surname string, given string, post string"
_PARTS = ["kind", "head", "subject", "place", "surname", "given", "post"]


def readings(values: DataFrame, column: str = "name", lists: Lists = LISTS) -> DataFrame:
    """READING of every distinct non-blank value. class_key is equal for values read alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf["_v"]:
                r = read(raw, lists)
                if r:
                    parts = [r.get(p, "") or "" for p in _PARTS]
                    rows.append((raw, "|".join(parts), *parts))
            yield pd.DataFrame(rows, columns=["raw", "class_key", *_PARTS])

    distinct = values.select(F.col(column).alias("_v")).filter(F.length(F.btrim("_v", F.lit(" \t\r\n"))) > 0).distinct()
    return distinct.mapInPandas(run, READING)


def candidate_pairs(names: DataFrame, scratch: Scratch, block: int = 2000) -> DataFrame:
    """(rid, cid): names and readings, by the hashes of raw value and class_key, that have a segment in common at a fitting
    position and whose texts are within the edits allowed. names: READING with rid and cid."""

    def keys(batches: Iterator[pd.DataFrame], make, column: str) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r[column], *x) for r in pdf.to_dict("records") for x in make(r)]
            yield pd.DataFrame(rows, columns=["id", "segment", "text", "k"])

    kind = "id long, segment string, text string, k int"
    short = lambda df, to: df.select(F.col("id").alias(to), F.xxhash64("segment").alias("segment"), F.col("text").alias(f"t_{to}"), "k")
    one = names.groupBy("cid", "class_key").agg(F.min_by(F.struct(*_PARTS), "raw").alias("_p")).select("cid", "_p.*")
    held = scratch.keep(short(one.mapInPandas(lambda b: keys(b, index_keys, "cid"), kind), "cid").drop("k"), "index")
    asked = scratch.keep(short(names.select("rid", *_PARTS).mapInPandas(lambda b: keys(b, probe_keys, "rid"), kind), "rid"), "probes")
    # hot segments: blocks of names on both sides; what is asked for and not held has no counterpart
    n_held = held.groupBy(F.col("segment").alias("_s")).agg(F.count("*").alias("_h"))
    n_asked = asked.groupBy(F.col("segment").alias("_t")).agg(F.count("*").alias("_a"))
    many = n_held.join(n_asked, F.col("_s") == F.col("_t")).filter((F.col("_h") > block) | (F.col("_a") > block))
    hot = scratch.keep(many.select("_s", F.ceil(F.col("_h") / block).cast("int").alias("_ph"), F.ceil(F.col("_a") / block).cast("int").alias("_pa")), "hot")
    if not hot.isEmpty():
        parts = lambda c: F.coalesce(F.col(c), F.lit(1))
        every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
        held = salted_lookup(held, "segment", hot, "_s").select("cid", "t_cid", "segment", F.pmod(F.xxhash64("cid"), parts("_ph")).cast("int").alias("_bh"), every("_pa").alias("_ba"))
        asked = salted_lookup(asked, "segment", hot, "_s").select("rid", "t_rid", "k", "segment", F.pmod(F.xxhash64("rid"), parts("_pa")).cast("int").alias("_ba"), every("_ph").alias("_bh"))
    keys_ = [c for c in ("segment", "_bh", "_ba") if c in held.columns]
    # compresses too well for its size to tell: never broadcast. Texts too far apart go before anything is shuffled again
    met = held.join(asked.hint("merge"), keys_).filter(F.expr("levenshtein(t_cid, t_rid, k) >= 0"))
    return met.select("rid", "cid").distinct()


def _whole(r: dict) -> bool:
    """Not mere initials of an office, nor an officer without a post: such readings may fit several."""
    return r["kind"] == "office" or bool(r["post"])


def links(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(raw, a, b, bare): the candidates whose readings a and b name the same; a is the reading of raw, b may be the same one."""
    parts = F.struct(*_PARTS)
    classes = names.groupBy("cid", "class_key").agg(F.min_by(parts, "raw").alias("rb")).withColumnRenamed("cid", "_k")
    mine = names.select(F.col("rid").alias("_r"), "raw", F.col("class_key").alias("own"), parts.alias("ra"))
    sides = salted_lookup(salted_lookup(candidates, "cid", classes, "_k"), "rid", mine, "_r")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["ra"], pdf["rb"]):
                hit = x == y or same(x, y)
                if not hit and x["kind"] == y["kind"] == "officer":
                    hit = same(_swapped(x), y) or same(x, _swapped(y))
                ok.append(hit)
            bare = [not (_whole(x) and _whole(y)) for x, y, k in zip(pdf["ra"], pdf["rb"], ok) if k]
            yield pdf.loc[ok, ["raw", "own", "class_key"]].set_axis(["raw", "a", "b"], axis=1).assign(bare=bare)

    return sides.select("raw", "own", "class_key", "ra", "rb").mapInPandas(run, "raw string, a string, b string, bare boolean")


def link_names(values: DataFrame, column: str = "name", lists: Lists = LISTS) -> DataFrame:
    """(name, name_class, links): one row per distinct non-blank raw value that can be read; equal classes name the same. links
    counts the other readings that this one is itself linked with, not over others.

    An officer given without a post ("Surname G.") or an office given by initials joins the one it fits, unless
    several that are told apart by their posts or names fit it alike.
    """
    scratch = Scratch(values.sparkSession, "names")
    read_ = scratch.keep(readings(values, column, lists).withColumns({"rid": F.xxhash64("raw"), "cid": F.xxhash64("class_key")}), "readings")
    every = scratch.keep(links(read_, candidate_pairs(read_, scratch)), "links")
    own = every.filter("a = b").select("raw", F.col("a").alias("class_key"))
    found = scratch.keep(every.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bare").distinct(), "found")
    sure = components(found.filter(~F.col("bare")).select("a", "b"), scratch, "sure")
    # links of bare values: only where all of a bare value's whole partners are one component
    posts = read_.groupBy("class_key").agg(F.max((F.col("kind") == "office") | (F.col("post") != "")).alias("_has"))
    bare = found.filter("bare").select("a", "b").union(found.filter("bare").select(F.col("b").alias("a"), F.col("a").alias("b")))
    bare = salted_lookup(bare, "a", posts.select(F.col("class_key").alias("_k"), "_has"), "_k").filter(~F.col("_has")).select("a", "b")
    bare = salted_lookup(bare, "b", posts.select(F.col("class_key").alias("_k"), "_has"), "_k").select("a", "b", "_has")
    homed = salted_lookup(bare, "b", sure.select(F.col("node").alias("_k"), "component"), "_k").select("a", "b", "_has", F.coalesce("component", "b").alias("_home"))
    single = homed.filter("_has").groupBy("a").agg(F.countDistinct("_home").alias("_n"), F.min("_home").alias("_to")).filter("_n = 1").select("a", F.col("_to").alias("b"))
    among = homed.filter(~F.col("_has")).join(homed.filter("_has").select("a").distinct(), "a", "left_anti").select("a", "b")
    both = scratch.keep(found.filter(~F.col("bare")).select("a", "b").union(single).union(among), "both")
    final = components(both, scratch, "final")
    ends = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = ends.select(F.col("a").alias("_d")).union(ends.select("b")).groupBy("_d").agg(F.count("*").cast("int").alias("links"))
    facts = final.join(degree, F.col("node") == F.col("_d"), "left").select("node", "component", "links")
    return salted_lookup(own, "class_key", facts, "node").select(F.col("raw").alias("name"), F.coalesce("component", "class_key").alias("name_class"), F.coalesce("links", F.lit(0)).alias("links"))
