import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("noticeloom.llm")
from noticeloom.llm import canonical, edits, languages, leakage, names, near_copies, pack, spanning, split_oversized, truncation  # noqa: E402
from noticeloom.session import Scratch  # noqa: E402


# ---- edit distances


def plain(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        r = [i]
        for j, y in enumerate(b, 1):
            r.append(min(p[j - 1] + (x != y), p[j] + 1, r[-1] + 1))
        p = r
    return p[-1]


@given(st.text("abक", max_size=9), st.text("abक", max_size=9), st.integers(0, 4))
def test_edit_distances(a, b, k):
    assert edits.levenshtein(a, b) == plain(a, b)
    assert edits.banded(a, b, k) == min(plain(a, b), k + 1)


# ---- 1 splitting


def texts_of(rng, n):
    return "".join(rng.choice(["word ", "two, ", "end. ", "x\n", "\n\n", "क्षि ", "z" * rng.randint(1, 90)]) for _ in range(n))


def test_pieces_join_to_the_item():
    rng = random.Random(4)
    for n in (1, 30, 400, 3000):
        t = texts_of(rng, n)
        for limit, overlap in ((40, 0), (100, 20), (400, 199)):
            p = split_oversized.cut_text(t, limit, overlap)
            assert p[0][0] == 0 and p[-1][1] == len(t) and all(0 < e - s <= limit for s, e in p)
            assert all(b[0] == a[1] - overlap for a, b in zip(p, p[1:]))
            assert t[: p[0][1]] + "".join(t[a[1] : b[1]] for a, b in zip(p, p[1:])) == t


def test_cuts_are_the_strongest_and_rightmost():
    rng = np.random.default_rng(1)
    at = np.flatnonzero(rng.random(500) < 0.3) + 1
    s = rng.integers(1, 6, len(at))
    table = split_oversized.StrongestCut(at, s, 80)
    for _ in range(500):
        lo = int(rng.integers(0, 480))
        hi = lo + int(rng.integers(0, 60))
        inside = [(x, p) for p, x in zip(at, s) if lo <= p <= hi]
        assert table.query(lo, hi) == (max(inside)[1] if inside else -1)


def test_a_stronger_cut_beats_a_later_one():
    text = "a" * 20 + " " + "b" * 23 + "\n\n" + "c" * 10 + ", " + "d" * 60 + " end"
    assert split_oversized.cut_text(text, 100, 10)[0] == (0, 46)  # the paragraph, not the comma nor the limit
    assert split_oversized.cut_text("a" * 20 + "\n\n" + "b" * 60 + " " + "c" * 60, 100, 10)[0] == (0, 83)  # a piece has a quarter of the limit at least


def test_oversized_rows(spark):
    long = "One sentence here. " * 300
    rows = [("a", long, 1, "clash"), ("a", long, 2, "clash"), ("b", "  " + "x" * 4000 + "\n", 1, None), ("c", "x" * 4001, None, None), ("d", None, 1, None), ("e", "", 1, None), (None, long, 1, None)]
    df = spark.createDataFrame(rows, "document_id string, text string, collected_at int, piece string")
    got = split_oversized.text_pieces(df, latest="collected_at")
    assert Counter(r["document_id"] for r in got.filter("piece_no = 2").collect()) == {"a": 1, "c": 1, None: 1}
    assert all(r["piece"].endswith(". ") or r["piece_no"] > 1 for r in got.filter("document_id = 'a'").collect())
    assert split_oversized.text_pieces(df.limit(0)).count() == 0


def test_oversized_chunks(spark):
    def row(k, n, mask=1):
        toks = ["[CLS]"] + [f"t{i}" if i % 5 else "." for i in range(n)] + ["[SEP]", "[PAD]"]
        m = [1] + [mask] * n + [1, 0]
        return (k, 0, toks, list(range(len(toks))), m, ["O"] * len(toks), [0] * len(toks), 1)

    rows = [row("a", 64), row("b", 65), row("b", 65), row("c", 300), row("d", 300, 0), ("e", 0, None, None, None, None, None, 1), ("f", 0, [], [], [], [], [], 1)]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, tokens array<string>, input_ids array<int>, attention_mask array<int>, labels array<string>, label_ids array<int>, doc_label_id int")
    got = split_oversized.chunk_pieces(df).collect()
    assert {r["document_id"] for r in got} == {"b", "c"}
    c = sorted((r for r in got if r["document_id"] == "c"), key=lambda r: r["piece_no"])
    assert all(len(r["tokens"]) == len(r["input_ids"]) <= 64 for r in c) and all(b["tokens"][:16] == a["tokens"][-16:] for a, b in zip(c, c[1:]))
    assert all(r["tokens"][-1] == "." for r in c[:-1])


# ---- 2 groups and splits


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for x in list(parent):
        out[find(x)].add(x)
    return {x: min(g) for g in out.values() for x in g}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)] + [(f"r{rng.randint(0, 60)}", f"r{rng.randint(0, 60)}") for _ in range(40)] + [("q", "q")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r["node"]: r["component"] for r in spanning.components(df, Scratch(spark, "t")).collect()}
    tied = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {k: v for k, v in union_find(pairs).items() if k in tied}
    assert spanning.components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_forest_spans(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]
    s = Scratch(spark, "t")
    _, picks = spanning.forest(spark.createDataFrame(pairs, "a string, b string"), s, "f")
    tree = {(r["u"], r["v"]) for p in picks for r in spark.read.parquet(s.path(p)).collect()}
    assert len(tree) == 3 and union_find(tree) == union_find(pairs)


LINKS = "document_id string, link_kind string, link_key string"


def test_kept_forest(spark, tmp_path):
    rows = [("a", "author", "k"), ("b", "author", "k"), ("c", "revision_of", "b"), ("a", "entity", "e"), ("c", "entity", "e"), ("x", "author", "y"), ("z", "author", "y"), ("q", "author", None)]
    links = spark.createDataFrame(rows, LINKS)
    tree = spanning.spanning_forest(links, path=str(tmp_path / "tree"))
    edges = [(r["a"], r["b"]) for r in tree.collect()]
    want = {tuple(r) for r in spanning.groups(links).collect()}
    assert len(edges) == 6 and len({x for e in edges for x in e}) == 8  # nodes less groups
    assert {tuple(r) for r in spanning.groups_of(spark.read.parquet(str(tmp_path / "tree"))).collect()} == want == {("A", "A"), ("B", "A"), ("C", "A"), ("X", "X"), ("Z", "X")}
    assert spanning.spanning_forest(links.limit(0)).count() == 0


def test_unfinished_components_are_an_error(spark):
    with pytest.raises(RuntimeError):
        spanning.forest(spark.createDataFrame([("a", "b")], "a string, b string"), Scratch(spark, "t"), "f", max_rounds=0)


def test_groups(spark):
    rows = [(" a1", "author", "K1 "), ("B1", "entity", "k1"), ("c1", "revision_of", " b1\n"), ("d1", "author", "unknown"), ("e1", "author", "UNKNOWN "), ("f1", "author", None), ("g1", "author", " "), ("h1", "revision_of", "H1"), (None, "author", "K1"), ("i1", "author", "own")]
    got = {tuple(r) for r in spanning.groups(spark.createDataFrame(rows + rows, LINKS)).collect()}
    assert got == {("A1", "A1"), ("B1", "A1"), ("C1", "A1")}
    assert spanning.groups(spark.createDataFrame([], LINKS)).count() == 0


def test_splits_keep_groups_and_proportions(spark):
    rng = random.Random(3)
    chunks = [(f"D{rng.randint(0, 900)}", i) for i in range(6000)] + [("BIG", i) for i in range(700)] + [("big ", 5)]
    links = [(f"d{rng.randint(0, 900)}", "author", f"K{rng.randint(0, 700)}") for _ in range(500)]
    c, k = spark.createDataFrame(chunks, "document_id string, chunk_index int"), spark.createDataFrame(links, LINKS)
    got = spanning.assign_splits(c, k).collect()
    assert len(got) == len({(a.strip().upper(), i) for a, i in chunks})
    by = defaultdict(set)
    for r in got:
        by[r["group_id"]].add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    n = Counter(r["split"] for r in got)
    assert abs(n["train"] / len(got) - 0.70) < 0.02 and abs(n["test"] / len(got) - 0.15) < 0.02
    again = spanning.assign_splits(c.repartition(7), k).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


# ---- 3 canonical values

REF = [("t", 1, "Notification", ["अधिसूचना"]), ("t", 2, "Circular", None), ("t", 3, "Office Order", []), ("t", 4, "Office Memorandum", []), ("t", 5, "Tender Notice", ["Notice Inviting Tender"]), ("j", 1, "Kesharbhum", ["KB"]), ("j", 2, "Chandrakot Union Area", ["CKU"])]


@given(st.lists(st.text("abc", max_size=8), max_size=30), st.text("abc", max_size=8), st.integers(0, 3))
@settings(max_examples=60)
def test_bk_tree_finds_all(items, x, r):
    got = dict(canonical.BKTree(items).find(x, r))
    assert got == {i: plain(i, x) for i in set(items) if plain(i, x) <= r}


@pytest.mark.parametrize("shard", [50_000, 3])
def test_mapping(spark, shard):
    want = {
        ("t", "notificaton"): 1, ("t", "NOTIFICATION (Revised)"): 1, ("t", "Circ."): 2, ("t", "Circluar No. 78"): 2, ("t", "Order, Office"): 3, ("t", "O.O."): 3, ("t", "O.M."): 4, ("t", "N0tification"): 1, ("t", "NIT"): 5, ("t", "अधिसूचना"): 1,
        ("t", "Lunch menu"): 0, ("t", "??"): 0, ("j", "kb"): 1, ("j", "Chandrakot UA"): 2, ("j", "Kesharbhum, District Xyz"): 1, ("j", "Nuponijawadi"): 0, ("z", "Circular"): 0,
    }
    ref = spark.createDataFrame(REF, "field_name string, entry_id int, entry_name string, alt_names array<string>")
    got = canonical.map_values(spark.createDataFrame(list(want), "field_name string, value string"), ref, shard_entries=shard).collect()
    assert {(r["field_name"], r["value"]): r["entry_id"] for r in got} == want
    assert {r["entry_id"] for r in canonical.map_values(spark.createDataFrame([("t", "Circular")], "field_name string, value string"), ref.limit(0)).collect()} == {0}


def test_word_tree_reads_as_a_scan_of_all_names():
    rng = random.Random(3)
    pool = "notification circular office order memorandum tender inviting demand recruitment guidelines extraordinary gazette corrigendum hearing summons observation audit scheme document".split()
    names = sorted({" ".join(rng.sample(pool, rng.randint(1, 4))) for _ in range(60)})
    m = canonical.Matcher([(n, i) for i, n in enumerate(names)])

    def shorten(w):
        way = rng.randrange(6)
        bones = w[0] + "".join(c for c in w[1:] if c not in "aeiou")
        if way == 0:
            return w[: rng.randint(1, len(w))]
        if way == 1:
            return bones[: rng.randint(1, len(bones))]
        if way == 2:
            return w[0] + w[rng.randint(2, len(w) - 3) :]
        k = rng.randrange(1, len(w) - 1)
        return [w, w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "x" + w[k + 1 :]][way - 3]

    found = 0
    for _ in range(800):
        w = rng.choice(names).split()
        short = ["".join(x[0] for x in w)] if len(w) > 1 and rng.random() < 0.2 else [shorten(x) for x in w]
        want = {n for n in names if edits.reads_as(list(short), n.split()) is not None}
        got = {n for n in m.readable(short) if edits.reads_as(list(short), n.split()) is not None}
        assert got == want, short
        found += bool(want)
    assert found > 750


def test_shards_map_as_one_tree(spark):
    rng = random.Random(6)
    stems = ["".join(rng.choice("abc") for _ in range(7)) for _ in range(6)]
    near = lambda w: "".join(rng.choice("abc") if rng.random() < 0.2 else c for c in w)
    ref = [("t", i, f"{near(rng.choice(stems))} {near(rng.choice(stems))}", None) for i in range(40)] + [("t", 100 + i, near(w), None) for i, w in enumerate(stems * 3)]
    ref = spark.createDataFrame(ref, "field_name string, entry_id int, entry_name string, alt_names array<string>")
    asked = {f"{near(rng.choice(stems))} {near(rng.choice(stems))}" for _ in range(60)} | {f"{near(rng.choice(stems))}, No. 5" for _ in range(60)}
    values = spark.createDataFrame([("t", v) for v in asked] + [("z", "abc")], "field_name string, value string")
    one, shards = ({tuple(r) for r in canonical.map_values(values, ref, shard_entries=n).collect()} for n in (50_000, 12))
    assert one == shards and len({r[2] for r in one}) > 5


def test_typed_values(spark):
    df = spark.createDataFrame([("d", "A", " ", 1), ("d", "A", None, 1), ("e", None, "\n", 1)], "document_id string, t string, j string, value int")
    assert [tuple(r) for r in canonical.typed_values(df, ["t", "j"]).collect()] == [("d", "t", "A")]


# ---- 4 near copies


def similarity(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / sum((x | y).values())


@pytest.mark.parametrize("block", [4000, 3])
def test_near_copies_equal_brute_force(spark, block):
    rng = random.Random(5)
    base = [[f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.choice([2, 5, 12, 40, 90]))] for _ in range(40)]
    rows = []
    for i, b in enumerate(base):
        rows.append((f"{i}", " ".join(b)))
        for k in range(3):
            c = b[:]
            for _ in range(rng.randint(0, max(1, len(b) // 8))):
                c[rng.randrange(len(c))] = f"w{rng.randint(0, 500)}"
            rng.shuffle(c) if k == 2 else None
            rows.append((f"{i}-{k}", "\n ".join(c)))
    rows += [("n", None), ("e", ""), ("s", " \n"), ("u", "x y x y Z"), ("v", "Y\ty x X z"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "document_id string, text string").withColumn("rep", F.lit(1))
    m, p = near_copies.near_copies(df, block=block)
    got = {tuple(r) for r in near_copies.copy_pairs(m, p).collect()}
    live = [(k, t) for k, t in dict(rows).items() if t and t.strip()]
    assert got == {(min(a, b), max(a, b)) for i, (a, s) in enumerate(live) for b, t in live[i + 1 :] if similarity(s, t) >= 0.8 - 1e-12}
    g = {r["document_id"]: r["class_id"] for r in near_copies.copy_groups(m, p).collect()}
    assert set(g) == {k for k, _ in live} and {k: v for k, v in union_find(got).items()} == {k: v for k, v in g.items() if any(k in x for x in got)}


def test_of_several_texts_the_greatest_counts(spark):
    w = " ".join(f"w{i}" for i in range(20))
    for low, high in (("a ", "z "), ("q ", "r ")):
        rows = [("k", low + "other words of a text"), ("k", high + w), ("m", low + w), ("n", low + "other words of a text")]
        m, p = near_copies.near_copies(spark.createDataFrame(rows, "document_id string, text string"))
        assert {tuple(r) for r in near_copies.copy_pairs(m, p).collect()} == {("k", "m")}


@pytest.mark.parametrize(("cold", "block"), [(0, 4000), (6, 4000), (40, 5)])
def test_near_copies_without_shared_cold_columns(spark, monkeypatch, cold, block):
    monkeypatch.setattr(near_copies, "ROUND_BYTES", 100_000)  # several rounds
    rng = random.Random(11)
    rows = []
    for i in range(40):
        b = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.choice([2, 4, 5, 12, 40, 90, 300]))]
        for k in range(4):
            c = b[:]
            for _ in range(rng.randint(0, max(1, len(b) // 8)) if k else 0):
                at = rng.randrange(len(c))
                c[at : at + rng.randint(0, 1)] = [f"w{rng.randint(0, 400)}"] * (rng.random() < 0.7 or len(c) < 2)
            rows.append((f"{i}-{k}", " ".join(c)))
    m, p = near_copies.near_copies(spark.createDataFrame(rows, "document_id string, text string"), block=block, cold=cold)
    got = [tuple(r) for r in near_copies.copy_pairs(m, p).collect()]
    assert len(got) == len(set(got)) and set(got) == {(min(a, b), max(a, b)) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if similarity(s, t) >= 0.8 - 1e-12}


def test_work_a_row_is_bounded_while_the_corpus_grows(spark):
    """Texts over a closed vocabulary: products and postings of a row stay about as many over four times the rows."""
    rng = random.Random(3)
    weights = [1 / (i + 20) for i in range(1500)]
    texts = [" ".join(rng.choices([f"w{i}" for i in range(1500)], weights, k=120)) for _ in range(2400)]
    work = []
    for n in (600, 2400):
        rows = near_copies.rows_of(spark.createDataFrame([(f"{i}", t) for i, t in enumerate(texts[:n])], "document_id string, text string"), "document_id", "text", wide=False).cache()
        counts = spark.sparkContext.broadcast(near_copies.column_counts(rows))
        cold = near_copies.coldest(counts.value, n, 40)
        by = near_copies.columns_of(rows, counts, 0.8, 4000, cold).groupBy("column").count().agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()
        parts = near_copies.parts_of(rows, counts, 0.8, cold).count()
        assert by[1] <= 40 / near_copies.FITTING * n
        work.append((by[0] + parts) / n)
        rows.unpersist()
    assert work[1] < 2 * work[0]


@given(st.integers(1, 3000), st.integers(0, 3000), st.integers(0, 600), st.integers(0, 600))
def test_parts_outnumber_the_differences(n, m, cold_n, cold_m):
    m = min(n, max(m, -(-4 * n // 5)))
    left = [x / 9 - c for x, c in ((n, cold_n), (m, cold_m))]
    a, b = sorted(int(np.searchsorted(near_copies.LEVELS, x - 1e-9)) for x in left)
    assert near_copies._deal(b, a < b) > int(np.floor((n + m) / 9 + 1e-9)) - cold_n - cold_m


@pytest.mark.parametrize("block", [3, 2000])
def test_pairs_within_groups(spark, block):
    rows = [(f"h{i}", "hot") for i in range(40)] + [("a", "g"), ("b", "g"), ("c", "lone"), ("d", None), ("e", None)]
    got = [tuple(r) for r in spanning.pairs_within(spark.createDataFrame(rows, "n string, g string"), "n", "g", block).collect()]
    want = {(x, y) for x, g in rows for y, h in rows if g == h and g and x < y}
    assert len(got) == len(want) and set(got) == want


def test_near_copies_of_nothing(spark):
    m, p = near_copies.near_copies(spark.createDataFrame([], "document_id string, text string"))
    assert m.count() == p.count() == near_copies.copy_groups(m, p).count() == 0


# ---- 5 names


def test_names(spark):
    groups = [
        ["Board of Health Camps, Choshabaruwadi", "BoHC, Choshabaruwadi", "Board of Heal. Camps, Choshabaruwadi", "Brd. of Health Camps, Choshabaruwadi", "Health Camps Board (Choshabaruwadi)", "Board of Health Camps - Choshabaruwadi ", "Choshabaruwadi Health Camps Board", "B0ard of Health Camps, Choshabarruwadi"],
        ["Board of Health Camps, Sukurahawadi", "Sukurahawadi: Bord of Health Camps"],
        ["Ministry of River Transport", "MoRT", "M/o of River Transport", "River Transport Ministry", "Min. Riveer Transport"],
        ["Ministry of Rural Affairs", "MoRA"],
        ["Shri Gopalkrishna Hochulidu, Joint Registrar", "G Hochulidu Jt. Registrar", "Hochulidu G.", "Hochulidu Gopalkrishna, Jt. Registrar", "HOCHULIDU, GOPALKRISHNA (JOINT REGISTRAR)", "Gopal Hochulidu, Joint Registrar"],
        ["Smt. Lakshmi Hochulidu, Superintendent", "Lachmi Hochulidu, Supdt."],
    ]
    rows = [(n,) for g in groups for n in g] + [(None,), (" ",), (groups[0][0],)]
    got = {r["name"]: r["name_class"] for r in names.link_names(spark.createDataFrame(rows, "name string")).collect()}
    assert set(got) == {n for g in groups for n in g}
    for g in groups:
        assert len({got[n] for n in g}) == 1, g
    assert len(set(got.values())) == len(groups)
    assert names.link_names(spark.createDataFrame([], "name string")).count() == 0


def test_blocks_of_hot_segments_lose_nothing(spark):
    rows = [(f"{g} Rao, {p}",) for g in ("Anil", "Amar", "Arun", "A", "Asha", "Bela") for p in ("Joint Registrar", "Jt. Registrar", "Supdt.")] + [("Board of Health Camps, Northtown",), ("Health Camps Board (Northtown)",)]
    read_ = names.readings(spark.createDataFrame(rows, "name string")).withColumns({"rid": F.xxhash64("raw"), "cid": F.xxhash64("class_key")})
    one, many = ({tuple(r) for r in names.candidate_pairs(read_, Scratch(spark, "t"), block).collect()} for block in (2000, 2))
    assert one == many and len(one) > len(rows)


def test_links_count_readings(spark):
    rows = [("Ministry of River Transport",), ("River Transport Ministry",), ("Ministry of Rivver Transport",), ("MoRT",), ("Board of Health Camps, Northtown",)]
    got = {r["name"]: (r["name_class"], r["links"]) for r in names.link_names(spark.createDataFrame(rows, "name string")).collect()}
    assert len({c for n, (c, _) in got.items() if "Board" not in n}) == 1
    assert got["Ministry of River Transport"][1] == got["River Transport Ministry"][1] == 2 and got["Board of Health Camps, Northtown"][1] == 0


def test_without_word_lists(spark):
    """The lists only normalise: misspelt and reordered names are linked without them, short forms of words are not."""
    rows = [("Board of Health Camps, Choshabaruwadi",), ("Boord of Health Camps - Choshabaruwadi",), ("The Board of Health Camps at Choshabaruwadi",), ("Council of Hill Roads, Yimedikawadi",)]
    got = {r["name"]: r["name_class"] for r in names.link_names(spark.createDataFrame(rows, "name string"), lists=names.NO_LISTS).collect()}
    assert len({got[n] for (n,) in rows[:3]}) == 1 and len(set(got.values())) == 2


def test_offices_with_misspelt_place_and_subject(spark):
    """Every pair of placed offices that same() accepts is a candidate: the place and the subject may be misspelt at once."""
    pairs = [
        ("Board of Health Camps, Choshabaruwadi", "Board of Camps Health, Choshabarruwadi"),
        ("Directorate of River Transport, Sukurahawadi", "Directorate of Kiver Transport, Sukurehavadi"),
        ("Council of Rural Trade Permits, Gamedhipur", "Council of Permits Rural Trade, Gamedipurr"),
    ]
    read = [tuple(names.read(n) for n in p) for p in pairs]
    assert all(names.same(a, b) for a, b in read)
    got = {r["name"]: r["name_class"] for r in names.link_names(spark.createDataFrame([(n,) for p in pairs for n in p], "name string")).collect()}
    assert all(got[a] == got[b] for a, b in pairs) and len(set(got.values())) == len(pairs)


def test_initials_of_two_offices_are_left_alone(spark):
    rows = [("Ministry of River Transport",), ("Ministry of Rural Trade",), ("MoRT",), ("River Transport Ministry",)]
    got = {r["name"]: r["name_class"] for r in names.link_names(spark.createDataFrame(rows, "name string")).collect()}
    assert got["Ministry of River Transport"] == got["River Transport Ministry"] and len(set(got.values())) == 3


@given(st.text("abcd", min_size=3, max_size=14), st.text("abcd", min_size=3, max_size=14))
@settings(max_examples=300)
def test_pigeonhole_misses_nothing(a, b):
    if plain(a, b) <= names.K:
        held = {(len(a), i, s) for i, _, s in names.segments(a)}
        assert held & names.probes(b)


# ---- 6 languages


def corpora(n):
    rng = random.Random(9)
    words = {"en": "the notice shall be sent to every office before the date of payment".split(), "hi": "यह सूचना सभी कार्यालय को भेजी जाएगी और भुगतान किया जाता है".split(), "mr": "ही सूचना सर्व कार्यालयांना पाठवावी आणि रक्कम भरणे आवश्यक आहे".split(), "hl": "yah soochna sabhi karyalay ko bheji jaegi aur bhugtan kiya jata hai".split()}
    make = lambda k: " ".join(rng.choice(words[k]) for _ in range(14)) + ("। " if k in ("hi",) else ". ")
    return [("hi" if k == "hl" else k, "".join(make(k) for _ in range(4))) for k in words for _ in range(n)], make


def test_languages(spark):
    rows, make = corpora(25)
    data = [(f"d{i}", t, l if i % 10 else "en") for i, (l, t) in enumerate(rows)]
    mixed = "NOTICE\nNo. 5\n\n" + make("en") + make("en") + "\n" + make("hi") + "(form) " + make("hi") + "\nSd/-\n(Name)"
    data += [("mix", mixed, "EN"), ("null", None, "en"), ("empty", "", None), ("digits", "12 34\n56", None), ("none", make("mr"), None)]
    df = spark.createDataFrame(data, "document_id string, text string, lang string").withColumn("confidence", F.lit("clash"))
    got = languages.identify(df).collect()
    first = {r["document_id"]: r["doc_lang"] for r in got}
    assert all(first[f"d{i}"] == l for i, (l, _) in enumerate(rows)) and first["none"] == "mr"
    m = sorted((r["segment_no"], r["lang"], r["seg_start"], r["seg_end"]) for r in got if r["document_id"] == "mix")
    assert [x[1] for x in m] == ["en", "hi"] and m[0][2] == 0 and m[0][3] == m[1][2] and m[1][3] == len(mixed)
    assert not {"null", "empty", "digits"} & set(first) and all(0 <= r["confidence"] <= 1 for r in got)
    bad = {r["document_id"] for r in languages.relabel(languages.identify(df)).collect()}
    assert "mix" in bad and "none" in bad and "d1" not in bad
    assert languages.identify(df.limit(0)).count() == 0


def test_batches_score_as_single_texts():
    rows, _ = corpora(12)
    table = languages.train([t for _, t in rows], [l for l, _ in rows])
    texts = [t for _, t in rows] + ["", "x", "\n", "😀 " * 50]
    assert list(languages._segments_many(texts, table, 16.0)) == [languages.segments(t, table) for t in texts]


# ---- 7 containers


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 100, 255, 300, 511, 512, 513, 1500])))) for i in range(300)] + [(1000, None), (1001, ""), (None, "a, b"), (5, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece_no", F.lit("clash"))
    for rule in ("residual", "dot"):
        p = pack.pack(df, shard_items=100, max_items=20, rule=rule)
        got = p.collect()
        by = defaultdict(list)
        for r in got:
            by[r["container_id"]].append(r["n_tokens"])
        assert all(sum(v) <= 512 and len(v) <= 20 for v in by.values())
        assert all(len(v) == 1 or sum(n * n for n in v) <= 0.75 * 512 * 512 for v in by.values())
        size = defaultdict(int)
        for r in got:
            size[r["doc_id"]] += r["n_tokens"]
        want = {}
        for k, t in rows:
            n = len((t or "").replace(",", " , ").split())
            want[k] = max(want.get(k, 0), n)
        assert dict(size) == want
        assert {r["doc_id"] for r in got if r["piece_no"] == 2} == {k for k, n in want.items() if n > 512}
        f = pack.fill(p).first()
        assert f["containers"] <= 1.1 * f["lower_bound"] + 8
    assert pack.pack(df.limit(0)).count() == 0


def test_attention_capacity_binds(spark):
    rows = [(i, "w " * n) for i, n in enumerate([100] * 31 + [400] * 3 + [512, 600, 0, 0] + [10] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in ("residual", "dot"):
        by = defaultdict(list)
        for r in pack.pack(df, attention=2 * 100 * 100, rule=rule).collect():
            by[r["container_id"]].append(r["n_tokens"])
        assert all(sum(v) <= 512 and (len(v) == 1 or sum(n * n for n in v) <= 20_000) for v in by.values())
        assert sum(map(sum, by.values())) == sum(len(t.split()) for _, t in rows)
        assert Counter(n for v in by.values() if len(v) == 1 for n in v)[400] == 3


def test_fill_of_the_tables(spark):
    """At most 2 % more containers than the tokens alone would need, plus the last ones of the shards."""
    from noticeloom.llm import queries

    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no test tables")
    f = queries.p7_fill(spark, d).first()
    assert f["lower_bound"] <= f["containers"] <= 1.02 * f["lower_bound"] + 8


def test_pattern_size(spark):
    df = spark.createDataFrame([("a, b!!c\td", 7), (None, 0), ("", 0), (" \n", 0), ("é[x]", 4)], "t string, n int")
    assert df.filter(pack.pattern_size(F.col("t")) != F.col("n")).count() == 0


# ---- 8 leaks


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocab = ["alpha", "of", "the", "report", "कार्य", "x1", "notice", "a"]
    words = lambda n: [rng.choice(vocab) + (str(rng.randint(0, 9)) if rng.random() < 0.3 else "") for _ in range(n)]
    items = [(i, words(rng.choice([8, 12, 30, 60]))) for i in range(25)]
    docs = []
    for k in range(120):
        w = words(rng.randint(0, 80))
        if k % 3 == 0:
            src = items[k % 25][1]
            n = rng.choice([5, 11, 12, 13, 40])
            at = rng.randint(0, max(0, len(src) - n))
            part = src[at : at + n]
            w = w[:20] + [x.upper() + "," if rng.random() < 0.2 else x for x in part] + w[20:]
        docs.append((k, " \n ".join(w) if k % 2 else ", ".join(w)))
    docs += [(500, None), (501, ""), (502, " "), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("edits", F.lit(1))
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, None), (98, "")], "item_id long, text string")
    norm = lambda t: leakage.normalise(t).split(" ") if t else []
    grams = lambda w: {tuple(w[j : j + 12]) for j in range(len(w) - 11)}
    want = {(k, n) for k, t in docs for n, w in items if grams(norm(t)) & grams(norm(" ".join(w)))}
    for block in (20_000, 10):
        got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i, block_items=block).filter("equal_words >= 12").collect()}
        assert got == want
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("block", [20_000, 2])
def test_short_items_leak_as_a_whole(spark, block):
    items = [(1, "a b c d e"), (2, "Yes!"), (3, "x"), (4, "some longer item of more than twelve letters"), (5, "...")]
    docs = [(1, "so A, b c d e."), (2, "ba b c d e"), (3, "yes"), (4, "yesterday (x)"), (5, "a b c d"), (6, "said: some longer item of more than twelve letters"), (7, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in leakage.leaks(d, spark.createDataFrame(items, "item_id long, text string"), block_items=block).select("doc_id", "item_id", "edits", "equal_words").collect()}
    assert got == {(1, 1, 0, 5), (3, 2, 0, 1), (4, 3, 0, 1), (6, 4, 0, 8)}


def test_many_texts_under_one_item(spark):
    word = lambda i, j: f"w{i}x{j}"
    text = lambda i: " ".join(word(i, j) for j in range(14))
    items = spark.createDataFrame([(7, text(i)) for i in range(60)], "item_id long, text string")
    d = spark.createDataFrame([(i, "intro " + text(i)) for i in range(0, 60, 7)] + [(99, "nothing here")], "doc_id long, text string")
    assert {r["doc_id"] for r in leakage.leaks(d, items, block_items=5, block_chars=600).collect()} == set(range(0, 60, 7))


def test_recall_of_edited_passages():
    """Passages of 12 to 60 words, copied with as many random edits as the budget allows, in foreign text."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9)))
    some = lambda n: [word() for _ in range(n)]
    items, docs = [], []
    for i in range(300):
        w = some(80)
        n = rng.randint(12, 60)
        at = rng.randint(0, 80 - n)
        part = list(" ".join(w[at : at + n]))
        for _ in range(int(0.04 * len(part))):
            k, way = rng.randrange(len(part)), rng.randrange(3)
            part[k : k + 1] = [[], [part[k], rng.choice("abcdef")], [rng.choice("abcdef")]][way]
        items.append((i, " ".join(w)))
        docs.append(" ".join(some(30)) + " " + "".join(part) + " " + " ".join(some(30)))
    got = {(r, k) for r, k, *_ in leakage._search(leakage.ItemIndex(items, 12, 12, 0.04), docs)}
    assert len(got & {(i, i) for i in range(300)}) >= 297 and all(r == k for r, k in got)


def test_leaks_with_edits(spark):
    src = "the divisional engineer shall collect a sealed statement from every registered tenant before the monsoon season begins in full"
    d = spark.createDataFrame([(1, "Intro. " + src.replace("collect", "colect").replace("tenant", "tennant") + " Outro."), (2, "nothing of the kind at all")], "doc_id long, text string")
    i = spark.createDataFrame([(7, src)], "item_id long, text string")
    got = leakage.leaks(d, i).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)] and 0 < got[0]["edits"] <= 6


def test_leaks_whose_edits_open_gaps():
    """Each passage of 12 words or more within the budget is found, wherever its edits are and whatever surrounds it."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 6)))
    some = lambda n: " ".join(word() for _ in range(n))

    def edited(t, places):
        for p in places:
            t = t[:p] + "z" + t[p + 1 :]
        return t

    shortest = "abcd " * 11 + "efghi"  # 60 characters, 2 edits
    shortest = " ".join(w[:3] + "qrstuvwxyz"[i % 10] for i, w in enumerate(shortest.split()))
    shortest += "x" * (60 - len(shortest))
    cases = [(shortest, some(9) + " " + edited(shortest, (23, 35)) + " " + some(9), shortest)]
    for _ in range(30):
        w = [word() for _ in range(40)]
        n = rng.randint(12, 30)
        part = " ".join(w[5 : 5 + n])
        k = int(0.04 * len(part))
        first = rng.randint(0, len(part) - 1 - 12 * k)
        gap = rng.randint(8, 12)
        cases.append((" ".join(w), some(9) + " " + edited(part, [first + gap * j for j in range(k)]) + " " + some(9), part))
    # one edit in each five-word stretch of the whole, but none that counts too much in 12 words of it
    w = [word() + "abc" for _ in range(36)]
    whole = " ".join(w)
    dense = " ".join(x if 12 <= i < 24 and i != 18 else x[:-1] + "z" for i, x in enumerate(w) if i % 3 or 12 <= i < 24)
    cases.append((whole, dense, " ".join(w[12:24])))
    index = leakage.ItemIndex([(i, c[0]) for i, c in enumerate(cases)], 12, 12, 0.04)
    got = {(row, item): (a, b, e) for row, item, a, b, e, _ in leakage._search(index, [c[1] for c in cases])}
    assert {(i, i) for i in range(len(cases))} <= set(got) and len(got) == len(cases)


def test_qgram_hashes_do_not_depend_on_place():
    cp = np.frombuffer("abcabcabcdabcabc".encode("utf-32-le"), dtype=np.uint32)
    h = leakage.qgram_hashes(cp, 3)
    s = "abcabcabcdabcabc"
    assert all((h[i] == h[j]) == (s[i : i + 3] == s[j : j + 3]) for i in range(len(h)) for j in range(len(h)))


# ---- 9 truncation


def notices(n, seed=1):
    rng = random.Random(seed)
    w = "applicants officers tenants renew submit collect permit ledger statement counter Tuesday Monday district quarter".split()
    out = []
    for i in range(n):
        body = " ".join("The " + " ".join(rng.choice(w) for _ in range(rng.randint(5, 12))) + "." for _ in range(rng.randint(3, 12)))
        end = rng.choice(["", "\n\nEncl: %d" % rng.randint(1, 9), "\n\nSd/-\n(%s)\nOfficer, Northtown" % rng.choice(["Abara", "Obinu", "Keretu"])])
        out.append(body + end)
    return out


def test_truncation(spark):
    texts = notices(700)
    rng = random.Random(4)
    rows, cut = [], set()
    for i, t in enumerate(texts):
        s = "s1" if i % 2 else "s2"
        if s == "s1" and len(t) > 300:
            t, _ = t[:300], cut.add(i)
        elif i % 11 == 0:
            k = rng.randint(len(t) // 3, len(t) - 30)
            t = t[:k] + ("…" if i % 2 == 0 else "")
            cut.add(i)
        if t.rstrip()[-1:] == "." or "\n" in t[-4:]:
            cut.discard(i)
        rows.append((i, t, s))
    rows += [(9000, None, "s1"), (9001, "", None), (9002, " \n", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    got = truncation.score(df)
    hit = {r["doc_id"] for r in got.filter("truncated").collect()}
    assert len(hit & cut) / len(cut) > 0.9 and len(hit & cut) / len(hit) > 0.85
    by = {r["source"]: r["share"] for r in truncation.by_source(got).collect()}
    assert by["s1"] > by["s2"] and got.count() == 700
    assert truncation.score(df.limit(0)).count() == 0


def test_sample_is_never_empty(spark):
    """Also of 10**11 rows some 6000 are taken; the share is not rounded down to none."""
    for rows in (6 * 10**9, 10**11, 10**15):
        bound = -(-(1 << 62) * 6000 // rows)
        assert 0 < bound < 1 << 62 and abs(bound / (1 << 62) * rows - 6000) < 1
    ids = spark.range(200_000)
    assert 4500 < ids.filter(truncation.sampled(F.xxhash64(F.lit(11), "id"), 200_000, 6000)).count() < 7500
    assert ids.filter(truncation.sampled(F.xxhash64(F.lit(11), "id"), 0, 6000)).count() == 200_000


def test_no_model_judges_nothing(spark):
    df = spark.createDataFrame([(1, "too short", "s"), (2, "x", None)], "doc_id long, text string, source string")
    assert [(r["score"], r["truncated"]) for r in truncation.score(df).collect()] == [(None, None)] * 2
    assert {r["source"]: (r["documents"], r["share"]) for r in truncation.by_source(truncation.score(df)).collect()} == {"s": (1, None), None: (1, None)}


def test_long_texts_train_by_their_ends(spark):
    """A model of the texts' last 600 characters finds about as much as one of the whole texts."""
    texts = [" ".join(notices(6, seed=i)) for i in range(700)]
    rows = [(i, t if i % 10 else t[: t.rfind(" ", 0, len(t) // 2 + i) - 2], "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ends, whole = ({r["doc_id"] for r in truncation.score(df, longest=k).filter("truncated").collect()} for k in (600, 100_000))
    cut = set(range(0, 700, 10))
    assert min(len(t) for _, t, _ in rows) > 600 and len(ends & cut) >= 0.85 * len(whole & cut) > 20 and len(ends - cut) <= 5


def test_limits_of_distinct_texts(spark):
    """Copies neither make nor hide a limit, and a source may have several."""
    text = lambda n, i: f"{i:04d}" + "x" * (n - 4)
    rows = [("hidden", text(1200, i)) for i in range(4)] + [("hidden", text(404, 0))] * 3 + [("hidden", text(700 + i, i)) for i in range(3)]
    rows += [("copied", text(900, 0))] * 9 + [("copied", text(500 + 7 * i, i)) for i in range(6)]
    rows += [("two", text(1000, i)) for i in range(30)] + [("two", text(1024, i)) for i in range(20)] + [("two", text(300 + i, i)) for i in range(60)]
    rows += [(None, text(600, i)) for i in range(5)] + [(None, text(310, 1)), ("short", "ab")]
    rows += [("large", text(200 + i, 100 * i + j)) for i in range(50) for j in range(15)] + [("large", text(3000, i)) for i in range(12)]
    rows += [("few", text(40 + i, 100 * i + j)) for i, n in enumerate((20, 18, 15, 10, 3, 1)) for j in range(n)]
    got = truncation.lengths(spark.createDataFrame(rows, "source string, text string")).collect()
    assert {r["_s"]: [x["n"] for x in r["_limits"]] for r in got} == {"hidden": [1200], "copied": [], "two": [1000, 1024], None: [600], "short": [], "large": [3000], "few": []}
