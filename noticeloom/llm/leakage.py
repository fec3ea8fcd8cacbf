"""Problem 8: passages of evaluation items inside corpus documents.

Both sides are normalised alike (lower case, ASCII punctuation and danda as blanks, single blanks). By the
q-gram lemma two passages of length L that differ by at most k edits share at least L + 1 - q (k + 1)
q-grams, and these lie on diagonals (place in the document minus place in the item) no more than k apart.

1. The q-grams of the items form an inverted index. Every q-gram of every document is hashed (prefix sums, so
   at a fixed cost per character) and looked up, first in a bit table, then in the sorted index.
2. Windows of a document in which too few q-grams occur in any item are left out.
3. What remains meets the index's postings: hits are counted by item in diagonal bands that overlap, so that
   every passage lies whole in one of them. A window as long as the longest passage is slid over each band; windows
   whose count meets the edit-budget bound make the regions, however wide the gaps that edits open.
4. Regions are verified by banded alignment, and the longest run of equal words is measured. Of a region that exceeds
   the budget as a whole, every passage in it is aligned by itself.

The shortest passage looked for has ``min_words`` words of an item (all of a shorter item); an edit budget of
``edits`` per character is allowed for. Passages of fewer than twice as many words are looked for: of a longer one
within the budget, a part of such a length is within it, too. A run of ``min_words`` equal words is always found: its q-grams all
lie on one diagonal and are at least as many as the bound asks for.

An item of fewer than ``q`` normalised characters has no q-gram and no edit allowed; it is looked up as a whole, between
word bounds, by the hash of a window of its own length.

Items are a stated query set: blocks of about ``block_items`` items and ``block_chars`` characters are shipped to the workers.
With more than one block the corpus is still scanned once: against a bit table of the q-grams of all items (fixed size),
which leaves the documents with a window dense enough for some item; only these, written to the shared folder, meet the
blocks. Null, empty and blank texts leak nothing. Rows with one id count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship

from .edits import banded

BITS = 23
BLOCK = 400_000  # characters looked up at a time
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~।"

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BLANKS: list[np.ndarray] = []


def _blank_table() -> np.ndarray:
    if not _BLANKS:
        t = np.zeros(0x10000, dtype=bool)
        t[[ord(c) for c in PUNCT + " \t\r\n"]] = True
        _BLANKS.append(t)
    return _BLANKS[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, in whole blocks."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        inv = pow(BASE, -1, 1 << 64)
        out = []
        for b in (BASE, inv):
            p = np.ones(size, dtype=np.uint64)
            step, m = 1, b
            with np.errstate(over="ignore"):
                while step < size:  # p[i + step] = p[i] * b**step
                    p[step : 2 * step] = p[:step] * np.uint64(m)
                    step, m = step * 2, (m * m) & _MASK
            out.append(p)
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def qgram_hashes(cp: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every window of q code points, the same wherever it stands."""
    n = len(cp)
    if n < q:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((cp.astype(np.uint64) + np.uint64(0x51ED270B)) * down[:n], dtype=np.uint64)])
        h = (s[q:] - s[:-q]) * up[: n - q + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def normalise_many(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets): texts one after the other, each followed by a 0; blanks single."""
    joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts).lower() + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = _blank_table()[np.minimum(cp, 0xFFFF)] & (cp < 0x10000)
    cp = np.where(blank, np.uint32(32), cp)
    keep = np.ones(len(cp), dtype=bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | (cp[:-1] == 0)))
    keep[0] = not blank[0]
    cp = cp[keep]
    ends = np.flatnonzero(cp == 0)
    return cp, np.concatenate([[0], ends + 1])


def normalise(text: str) -> str:
    cp, _ = normalise_many([text])
    return cp[:-1].tobytes().decode("utf-32-le", "surrogatepass").strip(" ")


def _nearest(pattern: np.ndarray, rows: list[int], text: np.ndarray, most: int) -> list[tuple[int, int]]:
    """For each of the first ``rows`` characters of the pattern: (least edits to any substring of the text, where the last such one ends).
    Ends early once all are above ``most``."""
    places, wanted, out = np.arange(len(text) + 1), set(rows), []
    d = np.zeros(len(text) + 1, dtype=np.int64)
    for i, c in enumerate(pattern, 1):
        new = d + 1
        np.minimum(new[1:], d[:-1] + (text != c), out=new[1:])
        d = np.minimum.accumulate(new - places) + places
        least = int(d.min())
        if least > most:
            break
        if i in wanted:
            out.append((least, int(np.flatnonzero(d == least)[-1])))
    return out


class ItemIndex:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int, min_words: int, edits: float):
        self.q, self.min_words, self.edits = q, min_words, edits
        self.ids, self.texts, self.least, self.budget, self.runs, self.spans = [], [], [], [], [], []
        self.most, self.reach = [], []
        hashes, owner, place = [], [], []
        short: dict[int, list[tuple[int, int]]] = {}  # length: (hash, item number)
        for i, text in items:
            s = normalise(text)
            w = s.split(" ")
            if not s:
                continue
            if len(s) < q:
                h = qgram_hashes(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), len(s))
                short.setdefault(len(s), []).append((int(h[0]), len(self.ids)))
                for held, v in zip((self.ids, self.texts, self.spans, self.least, self.budget, self.most, self.reach, self.runs), (i, s, len(s), 1, 0, 0, 1, {s})):
                    held.append(v)
                continue
            k = min(min_words, len(w))
            ends = np.cumsum([len(x) + 1 for x in w])
            starts = ends - np.array([len(x) + 1 for x in w])
            length = int((ends[k - 1 :] - 1 - starts[: len(w) - k + 1]).min())  # of the shortest passage
            each = np.unique(np.concatenate([ends[n - 1 :] - 1 - starts[: len(w) - n + 1] for n in range(k, min(2 * k - 1, len(w)) + 1)]))
            allowed = self.allowed(each)
            self.least.append(int(np.maximum(1, each + 1 - q * (allowed + 1)).min()))
            self.budget.append(int(self.allowed(np.array([length]))[0]))
            self.most.append(int(allowed.max()))
            self.reach.append(int((each + allowed).max()) - q + 1)  # q-grams in the longest passage, as it stands in a document
            self.runs.append({" ".join(w[j : j + k]) for j in range(len(w) - k + 1)})
            h = qgram_hashes(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), q)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids), dtype=np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(i)
            self.texts.append(s)
            self.spans.append(length)
        self.short = {n: (np.array([h for h, _ in v], dtype=np.uint64), np.array([k for _, k in v])) for n, v in ((n, sorted(v)) for n, v in short.items())}
        self.bits = np.zeros(1 << BITS, dtype=bool)
        if not hashes:
            self.keys = np.empty(0, dtype=np.uint64)
            return
        h, o, p = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(h, kind="stable")
        h, self.owner, self.place = h[order], o[order], p[order]
        self.keys, self.first = np.unique(h, return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.bits[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
        # windows: the longest passage of all, and the fewest q-grams any passage keeps
        self.window = max(self.reach)
        self.fewest = min(n for n, t in zip(self.least, self.texts) if len(t) >= q)
        self.least, self.budget, self.most, self.reach = np.array(self.least), np.array(self.budget), np.array(self.most), np.array(self.reach)

    def allowed(self, length: np.ndarray) -> np.ndarray:
        """Edits allowed in passages of these lengths; some q-gram must stay whole."""
        return np.minimum((self.edits * length).astype(np.int64), np.maximum(0, length // self.q - 1))

    def whole(self, cp: np.ndarray) -> np.ndarray:
        """Rows (item, from, to): where a short item stands between word bounds."""
        edge = np.concatenate([[True], (cp == 32) | (cp == 0), [True]])  # edge[i]: what stands before i
        out = []
        for n, (keys, items) in self.short.items():
            h = qgram_hashes(cp, n)
            at = np.flatnonzero(edge[: len(h)] & edge[n + 1 : n + 1 + len(h)])
            first, last = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
            k = last - first
            pick = np.repeat(first, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            at = np.repeat(at, k)
            out.append(np.stack([items[pick], at, at + n], axis=1))
        return np.concatenate(out).astype(np.int64) if out else np.empty((0, 3), dtype=np.int64)

    def regions(self, cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (item, document place from, to, item place from, to) of regions that meet their bounds."""
        none = np.empty((0, 5), dtype=np.int64)
        h = qgram_hashes(cp, self.q)
        if not len(h) or not len(self.keys):
            return none
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(at):
            return none
        row = np.searchsorted(self.keys, h[at])
        row[row == len(self.keys)] = 0
        ok = self.keys[row] == h[at]
        at, row = at[ok], row[ok]
        hit = np.zeros(len(h) + 1, dtype=np.int32)
        hit[at + 1] = 1
        total = np.cumsum(hit)
        w = min(self.window, len(h))
        dense = np.flatnonzero(total[w:] - total[:-w] >= self.fewest)
        if not len(dense):
            return none
        cover = np.zeros(len(h) + 1, dtype=np.int32)
        np.add.at(cover, dense, 1)
        np.add.at(cover, dense + w, -1)
        live = np.cumsum(cover)[:-1] > 0
        ok = live[at]
        at, row = at[ok], row[ok]
        n = self.last[row] - self.first[row]
        if not n.sum():
            return none
        pick = np.repeat(self.first[row] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, ip, dp = self.owner[pick].astype(np.int64), self.place[pick].astype(np.int64), np.repeat(at, n).astype(np.int64)
        width = self.most[item].astype(np.int64) + 1
        band = (dp - ip + 8192 * width) // width
        # every hit lies in two bands of double width
        item, ip, dp, band = np.tile(item, 2), np.tile(ip, 2), np.tile(dp, 2), np.concatenate([band, band - 1])
        order = np.lexsort((dp, band, item))
        item, ip, dp, band = item[order], ip[order], dp[order], band[order]
        new = np.ones(len(item), dtype=bool)
        doc = np.searchsorted(offsets, dp, "right")
        new[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (doc[1:] != doc[:-1])
        # hits within one window that meets the bound belong together
        at = (np.cumsum(new) - 1) * (len(h) + self.window + 1) + dp
        stop = np.searchsorted(at, at + self.reach[item])
        full = np.flatnonzero(stop - np.arange(len(at)) >= self.least[item])
        inside, joined = np.zeros(len(at) + 1, dtype=np.int32), np.zeros(len(at) + 1, dtype=np.int32)
        np.add.at(inside, full, 1)
        np.add.at(inside, stop[full], -1)
        np.add.at(joined, full + 1, 1)
        np.add.at(joined, stop[full], -1)
        inside, joined = np.cumsum(inside)[:-1] > 0, np.cumsum(joined)[:-1] > 0
        start = np.flatnonzero(inside & ~joined)
        end = np.flatnonzero(inside & np.append(~joined[1:], True)) + 1
        # runs without wide gaps are tried by themselves, too
        new[1:] |= dp[1:] - dp[:-1] > 2 * self.q
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(item))
        keep = (last - first) >= self.least[item[first]]
        start, end = np.concatenate([start, first[keep]]), np.concatenate([end, last[keep]])
        if not len(start):
            return none
        out = np.empty((len(start), 5), dtype=np.int64)
        for k, (a, b) in enumerate(zip(start, end)):
            out[k] = item[a], dp[a], dp[b - 1] + self.q, ip[a:b].min(), ip[a:b].max() + self.q
        return np.unique(out, axis=0)

    def passage(self, doc: str, r: np.ndarray) -> tuple[int, int, int, int] | None:
        """(edits, 0, from, to): the longest passage within its budget in or round the region."""
        item, a, b, c, d = (int(x) for x in r)
        most, text = int(self.most[item]), self.texts[item]
        margin = (self.q + 1) * most  # what edits at a passage's ends may take from its q-grams
        a, c = max(0, a - margin), max(0, c - margin)
        x = np.array([ord(ch) for ch in doc[a : b + margin]], dtype=np.int64)
        y = np.array([ord(ch) for ch in text], dtype=np.int64)
        ends = np.append(np.flatnonzero(y == 32), len(y))
        starts = np.append(0, ends[:-1] + 1)
        k = min(self.min_words, len(ends))
        best = None
        for i in range(len(ends) - k + 1):
            if starts[i] < c or ends[i + k - 1] > d + margin:
                continue
            to = ends[i + k - 1 : i + 2 * k - 1]
            rows = (to[to <= d + margin] - starts[i]).tolist()
            for n, (edits, end) in zip(rows, _nearest(y[starts[i] : starts[i] + rows[-1]], rows, x, most)):
                if edits <= int(self.allowed(np.array([n]))[0]) and (best is None or (n, -edits) > best[:2]):
                    best = n, -edits, int(starts[i]), end
        if best is None:
            return None
        n, edits, at, end = best
        back = _nearest(y[at : at + n][::-1], [n], x[:end][::-1], most)  # from the end backwards
        return -edits, 0, a + end - back[0][1], a + end

    def verify(self, doc: str, r: np.ndarray) -> tuple[int, int, int, int] | None:
        """(edits, words in the longest equal run up to min_words, from, to) if there is a leaked passage in the region."""
        item, a, b, c, d = (int(x) for x in r)
        # whole words round the region
        a = doc.rfind(" ", 0, a + 1) + 1
        e = doc.find(" ", b)
        b = len(doc) if e < 0 else e
        text = self.texts[item]
        words = doc[a:b].split(" ")
        k = len(next(iter(self.runs[item])).split(" "))
        run = k if any(" ".join(words[j : j + k]) in self.runs[item] for j in range(len(words) - k + 1)) else 0
        x, y = doc[int(r[1]) : int(r[2])], text[c:d]
        allowed = max(int(self.budget[item]), int(len(y) * int(self.budget[item]) / max(1, self.spans[item])))
        edits = 0 if x == y else banded(x, y, allowed)
        whole = min(len(x), len(y)) >= self.spans[item] - int(self.budget[item])  # as long as a passage looked for
        return (edits, run, int(r[1]), int(r[2])) if run or (whole and edits <= allowed) else self.passage(doc, r)


_INDEXES: dict[str, ItemIndex] = {}


def _index(token: str, items: list[tuple[int, str]], *args) -> ItemIndex:
    """The index of one block, made once in a worker."""
    if token not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[token] = ItemIndex(items, *args)
    return _INDEXES[token]


def _dense(src: DataFrame, wanted: DataFrame, q: int, min_words: int, edits: float) -> DataFrame:
    """The rows of ``src`` that have a window with enough q-grams of any items, or may hold a short item. One scan; the table of
    bits of the items' q-grams is made by the workers and has a fixed size."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = ItemIndex(list(zip(range(b.num_rows), b.column(0).to_pylist())), q, min_words, edits)
            word = np.packbits(index.bits).view(np.int64) if len(index.keys) else np.empty(0, np.int64)
            at = np.flatnonzero(word)
            size, fewest = (index.window, index.fewest) if len(index.keys) else (0, 1 << 30)
            n = max(1, len(at))
            col = lambda v: pa.array(np.full(n, v, dtype=np.int32))
            cols = [pa.array(at.astype(np.int32) if len(at) else np.array([0], np.int32)), pa.array(word[at] if len(at) else np.array([0], np.int64)), col(size), col(fewest), col(min(index.short, default=q))]
            yield pa.RecordBatch.from_arrays(cols, names=["w", "b", "size", "fewest", "short"])

    made = wanted.select("_t").mapInArrow(facts, "w int, b long, size int, fewest int, short int")
    got = made.groupBy("w").agg(F.bit_or("b").alias("b"), F.max("size").alias("size"), F.min("fewest").alias("fewest"), F.min("short").alias("short")).toArrow()  # at most 2**BITS / 64 rows
    words_ = np.zeros(1 << (BITS - 6), dtype=np.int64)
    words_[got.column("w").to_numpy()] = got.column("b").to_numpy()
    size, fewest, short = (int(f(got.column(c).to_numpy())) for f, c in ((np.max, "size"), (np.min, "fewest"), (np.min, "short")))
    held = src.sparkSession.sparkContext.broadcast(words_)
    if short < q:  # a short item may stand anywhere
        return src

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value.view(np.uint8)).astype(bool)
        for b in batches:
            keep = []
            for i, t in enumerate(b.column(1).to_pylist()):
                h = qgram_hashes(normalise_many([t])[0], q)
                total = np.concatenate([[0], np.cumsum(bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])])
                w = min(size, len(h))
                if len(h) and (total[w:] - total[: len(total) - w]).max() >= fewest:
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return src.mapInArrow(run, src.schema)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", q: int = 12, min_words: int = 12, edits: float = 0.04, block_items: int = 20_000, block_chars: int = 40_000_000) -> DataFrame:
    """(key, item_key, region_start, region_end, edits, equal_words): one row per document and item that share a
    passage, for the region with the longest equal run, then the longest. Places count normalised characters;
    equal_words is min_words (or the item's length, if shorter) if that many consecutive words are equal, else 0."""
    spark = documents.sparkSession
    ship(spark)
    wanted = items.select(F.col(item_key).alias("_i"), F.col(item_text).alias("_t")).filter(F.length(F.btrim("_t", F.lit(" \t\r\n"))) > 0).distinct()
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_t")), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["c"] // block_chars))
    kind, ikind = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    src = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    block_of = lambda n: F.pmod(F.xxhash64("_i", "_t"), F.lit(n))
    if blocks > 1:
        scratch = Scratch(spark, "leaks")
        wanted = scratch.keep(wanted, "items")
        src = scratch.keep(_dense(src, wanted, q, min_words, edits), "dense")
        # items are spread by a hash of id and text; blocks that turn out too large are halved until none is (a single text may be)
        while blocks < size["n"] and wanted.groupBy(block_of(blocks)).agg(F.count("*").alias("n"), F.sum(F.length("_t")).alias("c")).filter((F.col("n") > 1) & ((F.col("n") > 2 * block_items) | (F.col("c") > 4 * block_chars))).limit(1).count():
            blocks *= 2
    schema = f"_key {kind}, _item {ikind}, region_start int, region_end int, edits int, equal_words int"
    schema_type = _arrow_type(items, item_key)
    token, found = uuid.uuid4().hex, None
    for n in range(blocks):
        block = wanted if blocks == 1 else wanted.filter(block_of(blocks) == n)
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in block.collect()])  # bounded above

        def run(batches: Iterator[pa.RecordBatch], held=held, n=n) -> Iterator[pa.RecordBatch]:
            index = _index(f"{token}-{n}", held.value, q, min_words, edits)
            for b in batches:
                rows = list(_search(index, b.column(1).to_pylist()))
                take = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                cols = [take, pa.array([index.ids[r[1]] for r in rows], schema_type)] + [pa.array([r[j] for r in rows], pa.int32()) for j in range(2, 6)]
                yield pa.RecordBatch.from_arrays(cols, names=["_key", "_item", "region_start", "region_end", "edits", "equal_words"])

        part = src.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    best = F.max(F.struct("equal_words", (F.col("region_end") - F.col("region_start")).alias("_l"), (-F.col("edits")).alias("_e"), "region_start", "region_end", "edits"))
    return found.groupBy("_key", "_item").agg(best.alias("_b")).select(F.col("_key").alias(key), F.col("_item").alias(item_key), "_b.region_start", "_b.region_end", "_b.edits", "_b.equal_words")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _search(index: ItemIndex, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item number, from, to, edits, equal words) of the verified regions of many texts."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < BLOCK):
            size += len(texts[b])
            b += 1
        cp, offsets = normalise_many(texts[a:b])
        for item, lo, hi in index.whole(cp).tolist() if index.short else ():
            k = int(np.searchsorted(offsets, lo, "right")) - 1
            yield a + k, item, lo - int(offsets[k]), hi - int(offsets[k]), 0, index.texts[item].count(" ") + 1
        found = index.regions(cp, offsets)
        if len(found):
            doc = np.searchsorted(offsets, found[:, 1], "right") - 1
            for k in np.unique(doc):
                lo, hi = int(offsets[k]), int(offsets[k + 1]) - 1
                text = cp[lo:hi].tobytes().decode("utf-32-le", "surrogatepass")
                for r in found[doc == k]:
                    at = r.copy()
                    at[1] -= lo
                    at[2] -= lo
                    if (v := index.verify(text, at)) is not None:
                        yield a + int(k), int(r[0]), v[2], v[3], v[0], v[1]
        a = b


def leaked_items(found: DataFrame, items: DataFrame, item_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(item_key, documents): the items that leaked, with the number of documents they leaked to."""
    return found.groupBy(item_key).agg(F.countDistinct(key).alias("documents"))
