"""Problem 4: groups of records that are slightly changed copies of each other.

Two texts are near copies if they share at least ``threshold`` of their words as multisets (shared
min(n, m), total max(n, m) per word). A word's k-th occurrence is a feature of its own, so this is the
Jaccard similarity of sets, and the overlaps are the entries of the product of the sparse document by
feature matrix with its transpose. That product is computed in blocks and never in full:

* texts with equal multisets are one class from the start; only one representative goes on;
* columns are put in one global order, rare ones first, and parted into cold and hot ones. Frequencies are counted
  over the classes, in a fixed number of hash counters; colliding counters or columns (32-bit numbers) cost
  candidates, never results; a column whose counter says 1 meets no other row. ``cold`` is the highest frequency
  up to which all products of columns come to at most PRODUCTS a row, so it falls, as a share, while the corpus grows;
* a pair whose first shared column is cold shares one of the first |x| - ceil(t |x|) + 1 columns of x and the like of
  y, so the product runs over the cold columns of these prefixes;
* any other pair shares no cold column: all of them are differences, and of the D = (1-t)/(1+t) (|x| + |y|)
  differences allowed only D - cold(x) - cold(y) are left to the hot columns. These are dealt by a hash to
  more parts than that, so one part is equal in both rows, and its columns together are the key. A row's share
  (1-t)/(1+t) |x| - cold(x) sets its level, and a pair meets in the parts of its higher level;
* the rows of a key are sorted by size, and a row is multiplied only with those of fitting size
  (t |y| <= |x|). Behind a shared cold column both rows must have enough columns left for t/(1+t) (|x| + |y|);
* every posting carries a parity bitmap of the columns (of the hot ones, for parts), as wide as the row is long; two
  bitmaps differ in no more bits than the rows differ in columns, so pairs that differ in more bits than allowed are
  discarded where they meet, first by 128 bits, then by all;
* a cold column with more than ``block`` rows is cut into blocks of rows, and each pair of blocks is its own key;
* keys are joined in as many rounds as keep a round's postings near the size of the rows;
* of what is left, the overlap of the whole rows is counted exactly, and pairs below the bound are discarded.

The result loses no pair. Texts without words (null, empty, blank) resemble nothing. Rows with one key and one
text count once; of several texts under one key the greatest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .spanning import SALTS, components, pairs_within, salted_lookup

COUNTERS = 22  # bits
FEW = 500_000  # numbers that each executor may hold
PRODUCTS = 8000  # a row, of rows that share a cold column
FITTING = 0.2  # the part of them whose sizes fit, about
LEVELS = 1.5 ** np.arange(40)  # upper bounds of what a row leaves to the hot columns
ROUND_BYTES = 64_000_000  # postings of a round at least
POSTING = "column long, id long, meta long, bits binary"
_EXOTIC = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _row_features(text: str, hashes: _Hashes) -> np.ndarray:
    """Sorted 64-bit features: one per occurrence of a word; words are the pieces between blank characters."""
    low = text.lower()
    words = [w for w in re.split("[ \t\r\n]+", low) if w] if _EXOTIC.search(low) else low.split()
    a = np.sort(np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
    if len(a) > 1:  # the k-th of equal words gets a hash of its own
        first = np.concatenate([[True], a[1:] != a[:-1]])
        at = np.arange(len(a))
        k = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (a ^ (k * np.uint64(0x9E3779B97F4A7C15))) * np.where(k > 0, np.uint64(0xD6E8FEB86659FD93), np.uint64(1))
        a = np.sort(mixed)
    return a


def _mix(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(32))


def _parities(row: np.ndarray, features: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """Of each row a bitmap of ``widths`` bits (a power of two): of every bit the parity of the features that fall on it."""
    out: list[bytes] = [b""] * len(widths)
    mixed = _mix(features.astype(np.uint64)) >> np.uint64(8)
    for w in np.unique(widths):
        of = np.flatnonzero(widths == w)
        place = np.full(len(widths), -1, dtype=np.int64)
        place[of] = np.arange(len(of))
        here = place[row]
        on = here >= 0
        at = here[on] * w + (mixed[on] & np.uint64(w - 1)).astype(np.int64)
        bits = np.packbits((np.bincount(at, minlength=len(of) * w) & 1).astype(np.uint8).reshape(len(of), w), axis=1, bitorder="little")
        for i, b in zip(of.tolist(), bits):
            out[i] = b.tobytes()
    return out


def _width(n: np.ndarray, share: float) -> np.ndarray:
    """The power of two from ``share`` of the row's size, 128 at least."""
    return 1 << np.maximum(7, np.ceil(np.log2(np.maximum(n * share, 1))).astype(np.int64))


def _bits(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(axis=-1, dtype=np.int64)


def rows_of(df: DataFrame, key: str, text: str, wide: bool) -> DataFrame:
    """(key, n, sig_a, sig_b, features): one per input row with words; equal signatures mean equal multisets.
    features: packed 64-bit numbers, or only their upper halves."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _Hashes()
        for b in batches:
            keys, ns, sa, sb, fs = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if len(hashes) > 300_000:
                    hashes.clear()
                a = _row_features(t, hashes)
                if not len(a):
                    continue
                h = xxhash.xxh128_intdigest(a.tobytes())
                keys.append(i)
                ns.append(len(a))
                sa.append((h >> 64) - (1 << 63))
                sb.append((h & ((1 << 64) - 1)) - (1 << 63))
                fs.append(a.tobytes() if wide else (a >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(ns, pa.int32()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()), pa.array(fs, pa.binary())], names=["_key", "n", "sig_a", "sig_b", "features"])

    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length(F.btrim("_text", F.lit(" \t\r\n"))) > 0)
    return src.mapInArrow(run, f"_key {kind}, n int, sig_a long, sig_b long, features binary").withColumn("id", F.xxhash64("_key", "sig_a", "sig_b"))


def column_counts(rows: DataFrame, bits: int = COUNTERS) -> np.ndarray:
    """How many rows have a column in each of 2**bits counters, over all rows. The counters, not the columns,
    reach the driver: their number is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int32)
        for b in batches:
            raw = b.column(0).to_pylist()
            for i in range(0, len(raw), 2000):
                np.add.at(total, (np.frombuffer(b"".join(raw[i : i + 2000]), dtype=np.uint32) >> np.uint32(32 - bits)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        step = 1 << 16
        for i in range(0, len(at), step):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + step].astype(np.int32)), pa.array(total[at[i : i + step]])], names=["counter", "c"])

    got = rows.select("features").mapInArrow(run, "counter int, c int").groupBy("counter").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[got.column("counter").to_numpy()] = got.column("c").to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def coldest(counts: np.ndarray, rows: int, products: int = PRODUCTS) -> int:
    """The highest frequency up to which the products of all columns come to ``products`` a row at most."""
    by = np.bincount(np.sort(counts[counts > 1]))
    total = np.cumsum(by * np.arange(len(by), dtype=np.float64) ** 2) * FITTING / 2
    within = np.flatnonzero(total <= products * float(rows))
    return min(int(within[-1]), (1 << 20) - 1) if len(within) else 1


def _deal(k: int, lower: bool) -> int:
    """The number of parts in which rows of level k meet each other, or rows of lower levels: more than their differences."""
    return int(np.floor(LEVELS[k] + LEVELS[k - lower] + 1e-6)) + 1


def _slices(b: pa.RecordBatch, rows: int = 2048, features: int = 500_000) -> Iterator[pa.RecordBatch]:
    n = np.cumsum(b.column(1).to_numpy().astype(np.int64))
    a = 0
    while a < b.num_rows:
        z = min(a + rows, max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + features, "right"))))
        yield b.slice(a, z - a)
        a = z


def _some(b: pa.RecordBatch, bits: int, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, sizes, and of all features the row, the number and the frequency."""
    ids, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
    if n.max() >= 1 << 22:
        raise ValueError(f"a text of {n.max()} words; at most {(1 << 22) - 1} fit a posting")
    f = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint32)
    return ids, n, np.repeat(np.arange(len(n)), n), f, c[f >> np.uint32(32 - bits)]


def _turn(ids: np.ndarray, column: np.ndarray, who: np.ndarray, meta: np.ndarray, turn: tuple[int, int], maps) -> Iterator[pa.RecordBatch]:
    """The postings whose round it is. maps: gives the bitmaps of the rows."""
    if turn[1] > 1:
        on = _mix(column.view(np.uint64)) % np.uint64(turn[1]) == turn[0]
        column, who, meta = column[on], who[on], meta[on]
    if len(column):
        got = pa.array(maps(), pa.binary())
        for a in range(0, len(column), 50_000):
            x = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(column[x]), pa.array(ids[who[x]]), pa.array(meta[x]), got.take(pa.array(who[x]))], names=["column", "id", "meta", "bits"])


def columns_of(rows: DataFrame, counts, threshold: float, block: int, cold: int, turn: tuple[int, int] = (0, 1), bits: int = COUNTERS) -> DataFrame:
    """(column, id, meta, bits): the cold columns of every row's prefix, of one of so many rounds. column: the number of the
    column and of a pair of its blocks, even; meta: the row's size, the column's place in it and the row's block; bits: the row's bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                yield from some(b)

    def some(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, n, row, f, df = _some(b, bits, counts.value)
        on = df <= cold
        # by row, frequency and number; cold is below 2 ** 20
        key = np.sort(row[on].astype(np.uint64) << np.uint64(52) | df[on].astype(np.uint64) << np.uint64(32) | f[on])
        r, d, t = (key >> np.uint64(52)).astype(np.int64), (key >> np.uint64(32) & np.uint64((1 << 20) - 1)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        each = np.bincount(r, minlength=len(n))
        place = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each)
        on = (place <= (n - np.ceil(threshold * n - 1e-9).astype(np.int64))[r]) & (d > 1)
        r, d, t, place = r[on], d[on], t[on], place[on]
        k = -(-d // block)
        own = np.where(k > 1, (ids[r] & 0x7FFFFFFF) % k, 0)
        copies = np.repeat(np.arange(len(k)), k)
        other = np.arange(len(copies)) - np.repeat(np.cumsum(k) - k, k)
        lo, hi = np.minimum(own[copies], other), np.maximum(own[copies], other)
        who = r[copies]
        yield from _turn(ids, t[copies] << 32 | (lo & 0x7FFF) << 17 | (hi & 0x7FFF) << 1, who, n[who] << 40 | place[copies] << 16 | (own[copies] & 0x7FFF), turn, lambda: _parities(row, f, _width(n, 0.75)))

    return rows.select("id", "n", "features").mapInArrow(run, POSTING)


def parts_of(rows: DataFrame, counts, threshold: float, cold: int, turn: tuple[int, int] = (0, 1), bits: int = COUNTERS) -> DataFrame:
    """(column, id, meta, bits): the parts of every row's hot columns, as long as a row near to it may share no cold one.
    column: the part, odd; meta: whether it is the row of the higher level, the row's size, its cold columns, and whether rows of one
    level meet; bits: the bitmap of the hot columns."""
    share = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                yield from some(b)

    def some(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, n, row, f, df = _some(b, bits, counts.value)
        hot = df > cold
        n_hot = np.bincount(row[hot], minlength=len(n))
        n_cold = n - n_hot
        member = (n_cold <= n - np.ceil(threshold * n - 1e-9).astype(np.int64)) & (n_hot > 0)
        if not member.any():
            return
        # what a row leaves to its hot columns, and what a row near to it may leave at most
        level = np.searchsorted(LEVELS, share * n - n_cold - 1e-9)
        top = np.searchsorted(LEVELS, share * n / threshold - 1e-9)
        hr, hf = row[hot], f[hot]
        first = np.cumsum(n_hot) - n_hot
        worth, deal = _mix(hf.astype(np.uint64) + np.uint64(1)), _mix(hf.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)
        columns, whos, metas = [], [], []
        for j in range(int(level[member].min()), int(top[member].max()) + 1):
            for lower in (False, True) if j else (False,):
                r = np.flatnonzero(member & ((level <= j) & (j <= np.maximum(top, level)) if lower else level == j))
                if not len(r):
                    continue
                m, each = _deal(j, lower), n_hot[r]
                at = np.arange(each.sum()) + np.repeat(first[r] - (np.cumsum(each) - each), each)
                sums = np.zeros(len(r) * m, dtype=np.uint64)
                np.add.at(sums, np.repeat(np.arange(len(r)) * m, each) + (deal[at] % np.uint64(m)).astype(np.int64), worth[at])
                part = np.tile(np.arange(m, dtype=np.uint64), len(r))
                columns.append((_mix(sums ^ _mix(part << np.uint64(16) | np.uint64(2 * j + lower + 1))) | np.uint64(1)).view(np.int64))
                whos.append(np.repeat(r, m))
                metas.append(np.repeat(((level[r] == j) & lower).astype(np.int64) << 62 | n[r] << 40 | n_cold[r] << 16 | (not lower), m))
        yield from _turn(ids, np.concatenate(columns), np.concatenate(whos), np.concatenate(metas), turn, lambda: _parities(hr, hf, _width(n, 0.375)))

    return rows.select("id", "n", "features").mapInArrow(run, POSTING)


def _differ(at: tuple[np.ndarray, np.ndarray], start: np.ndarray, words: np.ndarray, data: np.ndarray, step: int = 100_000) -> np.ndarray:
    """In how many bits the bitmaps of pairs differ, the wider one folded to the width of the other."""
    got = np.empty(len(at[0]), dtype=np.int64)
    narrow, broad = np.minimum(words[at[0]], words[at[1]]), np.maximum(words[at[0]], words[at[1]])
    for w, v in {(int(a), int(b)) for a, b in zip(*(np.unique(np.stack([narrow, broad]), axis=1) if len(narrow) else ((), ())))}:
        of = np.flatnonzero((narrow == w) & (broad == v))
        for a in range(0, len(of), max(1, step // v)):
            o = of[a : a + max(1, step // v)]
            folded = []
            for side in (at[0][o], at[1][o]):
                x = data[start[side][:, None] + np.arange(w)]
                for more in range(w, v, w):
                    wider = words[side] > more
                    x[wider] ^= data[start[side[wider]][:, None] + np.arange(more, more + w)]
                folded.append(x)
            got[o] = _bits(folded[0] ^ folded[1])
    return got


def _products(col: np.ndarray, ids: np.ndarray, meta: np.ndarray, start: np.ndarray, words: np.ndarray, data: np.ndarray, t: float, step: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of the entries that count, for whole columns sorted by (column, meta). The bitmaps are words of data."""
    higher, n, pos, own = meta >> 62, (meta >> 40) & 0x3FFFFF, (meta >> 16) & 0xFFFFFF, (meta & 0xFFFF).astype(np.int16)
    parts = (col & 1).astype(bool)
    two = parts & (own == 0)  # rows of a higher and of lower levels meet
    free = parts | (((col >> 17) & 0x7FFF) == ((col >> 1) & 0x7FFF))
    left = (1 - t) / (1 + t) * n - np.where(parts, pos, 0)
    b0, b1 = _fold(start, words, data)
    group = np.concatenate([[0], np.cumsum(col[1:] != col[:-1])])
    width = int(n.max() / t) + 3
    line = (2 * group + higher) * width + n
    fit = 2 * group * width + np.ceil(t * n - 1e-9).astype(np.int64)
    first, k = np.zeros(len(col), dtype=np.int64), np.zeros(len(col), dtype=np.int64)
    x = np.flatnonzero(~two)
    first[x] = np.searchsorted(line, fit[x])
    k[x] = x - first[x]
    x = np.flatnonzero(two & (higher == 1))
    first[x] = np.searchsorted(line, fit[x])
    k[x] = np.searchsorted(line, 2 * group[x] * width + np.floor(n[x] / t + 1e-9).astype(np.int64), "right") - first[x]
    total = np.cumsum(k)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + step)))
        kk = k[a:b]
        i = np.repeat(np.arange(a, b, dtype=np.int32), kk)
        j = np.arange(len(i), dtype=np.int32) - np.repeat((np.cumsum(kk) - kk - first[a:b]).astype(np.int32), kk)
        a = b
        differ = np.bitwise_count(b0[i] ^ b0[j])
        differ += np.bitwise_count(b1[i] ^ b1[j])
        ok = np.flatnonzero(differ <= left[i] + left[j] + 1e-6)
        i, j = i[ok], j[ok]
        ok = (free[i] | (own[i] != own[j])) & (ids[i] != ids[j])
        # the column is the first one that the rows share
        least = np.ceil(t / (1 + t) * (n[i] + n[j]) - 1e-9).astype(np.int64)
        ok &= parts[i] | (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least)
        i, j, least = i[ok], j[ok], least[ok]
        most = n[i] + n[j] - 2 * least - np.where(parts[i], pos[i] + pos[j], 0)
        ok = _differ((i, j), start, words, data) <= most
        i, j = i[ok], j[ok]
        yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def _fold(start: np.ndarray, words: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps folded to 128 bits."""
    b0, b1 = data[start], data[start + 1]
    for more in range(2, int(words.max(initial=2)), 2):
        wider = np.flatnonzero(words > more)
        b0[wider] ^= data[start[wider] + more]
        b1[wider] ^= data[start[wider] + more + 1]
    return b0, b1


def _candidates(post: DataFrame, threshold: float) -> DataFrame:
    """(x, y), x < y: pairs of rows that meet under a key and differ within the size-derived bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(0).to_numpy()
            whole = int(np.searchsorted(column, column[-1]))  # the last column may go on in the next batch
            if column[-1] != last or len(held) == 0:
                held.append(b.slice(0, whole))
                yield from emit(held)
                held = [b.slice(whole)]
            else:
                held.append(b)
            last = column[-1]
        yield from emit(held)

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks() if held else None
        if t is None or t.num_rows < 2:
            return
        col, ids, meta = (t.column(i).chunk(0).to_numpy() for i in range(3))
        keep = np.concatenate([[False], col[1:] == col[:-1]])
        keep |= np.concatenate([keep[1:], [False]])  # rows that meet another one
        if not keep.any():
            return
        raw = t.column(3).chunk(0).filter(pa.array(keep)).to_pylist()
        words = np.array([len(x) // 8 for x in raw], dtype=np.int64)
        for x, y in _products(col[keep], ids[keep], meta[keep], np.cumsum(words) - words, words, np.frombuffer(b"".join(raw), dtype=np.uint64), threshold):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    met = post.repartition("column").sortWithinPartitions("column", "meta").mapInArrow(run, "x long, y long")
    return met.distinct()


def _rounds(rows: DataFrame, post, n: int, aim: int, sample: int = 2000) -> int:
    """So many that the postings of each come to ``aim`` bytes, by a sample of the rows. post: gives the postings of rows."""
    share = max(1, n // sample)
    got = post(rows.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)).agg(F.sum(F.length("bits") + 32)).first()[0] or 0
    return max(1, round(got * share / aim))


def near_copies(df: DataFrame, key: str = "document_id", text: str = "text", threshold: float = 0.8, block: int = 4000, cold: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members (key, rep), pairs (x, y, similarity)): every key with the representative of its class of equal
    multisets, and the pairs of near representatives. cold: the highest frequency of a cold column, else by the counts."""
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    kind = df.schema[key].dataType.simpleString()
    rows = scratch.keep(rows_of(df, key, text, wide=False), "rows")
    members = rows.groupBy("_key").agg(F.max(F.struct("sig_a", "sig_b", "id")).alias("_s"), F.count_distinct("sig_a", "sig_b").alias("_n")).select("_key", "_s.*", "_n")
    # of keys with several texts (their number is small beside the input) the greatest text counts
    several = members.filter("_n > 1").select(F.col("_key").alias("_m"))
    texts = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(several, F.col("_k").eqNullSafe(F.col("_m")), "left_semi").groupBy("_k").agg(F.max("_t").alias("_t"))
    members = members.filter("_n = 1").drop("_n").union(rows_of(texts, "_k", "_t", wide=False).select("_key", "sig_a", "sig_b", "id"))
    classes = members.groupBy("sig_a", "sig_b").agg(F.min(F.struct("_key", "id")).alias("_r"))
    out = scratch.keep(members.join(classes, ["sig_a", "sig_b"]).select(F.col("_key").alias(key), F.col("_r._key").alias("rep"), F.col("_r.id").alias("rep_id")), "members")
    # rows that stand for no class: few, unless copies abound; then those that do are written
    others = scratch.keep(rows.select("id").distinct().join(out.select("rep_id").distinct(), F.col("id") == F.col("rep_id"), "left_anti"), "others")
    if others.count() <= FEW:
        rows = rows.join(F.broadcast(others), "id", "left_anti")
    else:
        rows = scratch.keep(rows.join(others, "id", "left_anti"), "reps")
        scratch.drop("rows")
    n = rows.count()
    counts = spark.sparkContext.broadcast(column_counts(rows))
    cold = coldest(counts.value, n) if cold is None else min(cold, (1 << 20) - 1)
    aim = max(ROUND_BYTES, 8 * int(counts.value.sum(dtype=np.int64)))  # twice the rows
    met = []
    for what, post in (
        ("columns", lambda r, turn=(0, 1): columns_of(r, counts, threshold, block, cold, turn)),
        ("parts", lambda r, turn=(0, 1): parts_of(r, counts, threshold, cold, turn)),
    ):
        rounds = _rounds(rows, post, n, aim)
        met += [scratch.keep(_candidates(post(rows, (i, rounds)), threshold), f"met-{what}-{i}") for i in range(rounds)]
    cand = scratch.keep(reduce(DataFrame.union, met).distinct(), "candidates")
    for name in ("rows", "reps", "others"):
        scratch.drop(name)
    # the whole rows of what is left, from the texts
    ids = cand.select(F.col("x").alias("rep_id")).union(cand.select("y")).distinct()
    wanted = scratch.keep(out.select("rep", "rep_id").distinct().join(ids, "rep_id"), "wanted")
    texts = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(wanted.select(F.col("rep").alias("_k")).distinct(), "_k")
    whole = scratch.keep(rows_of(texts, "_k", "_t", wide=True).select("id", "_key", "features").join(wanted.select(F.col("rep_id").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "whole")
    both = cand.join(whole.select(F.col("id").alias("x"), F.col("_key").alias("rx"), F.col("features").alias("fx")), "x").join(whole.select(F.col("id").alias("y"), F.col("_key").alias("ry"), F.col("features").alias("fy")), "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sim = [], []
            for i, (p, q) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                shared = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                s = shared / (len(p) + len(q) - shared)
                if s >= threshold - 1e-12:
                    keep.append(i)
                    sim.append(s)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(sim, pa.float64())], names=["x", "y", "similarity"])

    found = both.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y"), "fx", "fy").mapInArrow(verify, f"x {kind}, y {kind}, similarity double")
    return out.select(key, "rep"), scratch.keep(found, "pairs")


def copy_pairs(members: DataFrame, pairs: DataFrame, key: str = "document_id") -> DataFrame:
    """(key_a, key_b): all pairs of different keys whose texts are near copies, the smaller first, equal texts included.
    Copies of a hot text are paired in blocks."""
    equal = pairs_within(members, key, "rep").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    # a representative may stand for many copies: their rows are spread over salts, the pairs are copied to each
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sides = members.select(F.col(key).alias("_k"), F.col("rep").alias("_r"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_s"))
    met = pairs.select("x", "y", every.alias("_s")).join(sides.toDF("_a", "x", "_s"), ["x", "_s"]).select("y", "_a", every.alias("_s"))
    near = met.join(sides.toDF("_b", "y", "_s"), ["y", "_s"]).select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))
    return equal.union(near).select(F.col("_a").alias(f"{key}_a"), F.col("_b").alias(f"{key}_b"))


def copy_groups(members: DataFrame, pairs: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, class_id, links): one row per key; class_id is the least key of its group of near copies, linked
    directly or over others; links counts the other texts it is near to."""
    scratch = Scratch(members.sparkSession, "copies")
    comp = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch, "near")
    degree = pairs.select(F.col("x").alias("_r")).union(pairs.select("y")).groupBy("_r").agg(F.count("*").alias("links"))
    facts = comp.join(degree, F.col("node") == F.col("_r"), "left")  # one row per representative with links
    return salted_lookup(members, "rep", facts, "node").select(key, F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("int").alias("links"))
