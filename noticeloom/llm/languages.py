"""Problem 6: the language of every text and of its parts, whatever its label says.

Multinomial naive Bayes over hashed character trigrams. A class is a language in a script ("hi" has one in
Devanagari and one in Latin letters). Training takes a bounded sample of labelled rows; since labels may be
wrong, sentences are labelled again by the model and the model is fitted anew, a few times. The matrix of log
probabilities is broadcast; batches are scored in numpy: the code points of many texts lie in one array, every
trigram picks its row of the matrix, sums per sentence give the scores.

A text's sentences are then read as one sequence: the best path through the languages, where a change costs
``switch`` nats. Lines that are no sentences (headings, numbers, tables, closings) hardly weigh, so they go with
the segment they stand at. Confidence is the posterior of the summed scores, tempered by the square root of
their length, since neighbouring trigrams are not independent.

Null, empty and blank texts and texts without any letter give no row. Offsets count code points, half-open, and
the segments of a text cover it from its first to its last character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

BITS = 16
# fixed values: the languages and the scripts they are written in; scripts by ranges of code points
LANGUAGES = {"en": ["latin"], "hi": ["devanagari", "latin"], "mr": ["devanagari"], "bn": ["bengali"], "ta": ["tamil"]}
SCRIPTS = {"latin": [(0x41, 0x24F)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)]}
CLASSES = [(lang, s) for lang, scripts in LANGUAGES.items() for s in scripts]
STOPS = [ord(c) for c in ".!?।॥"]
BLOCK = 300_000  # characters scored at a time

_LUT: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """fold: code point -> lower letter or mark, everything else a space; letter: is it a letter."""
    if not _LUT:
        import unicodedata

        fold, letter = np.full(0x10000, 32, dtype=np.uint32), np.zeros(0x10000, dtype=bool)
        for i in range(0x10000):
            k = unicodedata.category(chr(i))[0] if not 0xD800 <= i < 0xE000 else "C"
            if k in "LM":
                low = chr(i).lower()
                fold[i] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else i
                letter[i] = k == "L"
        _LUT["fold"], _LUT["letter"] = fold, letter
        script = np.zeros(0x10000, dtype=np.int8)
        for n, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a : b + 1] = n
        _LUT["script"] = np.where(letter, script, 0).astype(np.int8)
        stop, blank = np.zeros(0x10000, dtype=bool), np.zeros(0x10000, dtype=bool)
        stop[STOPS] = True
        blank[[32, 9, 10, 13]] = True
        _LUT["stop"], _LUT["blank"] = stop, blank
    return _LUT


def code_points(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(cp < 0x10000, cp, 0xFFFF)


def grams(cp: np.ndarray) -> np.ndarray:
    """The row of each position's trigram (of the character, the one before and the one after); 2**BITS: none. 32-bit numbers."""
    t = _tables()
    c = t["fold"][cp]
    p = np.concatenate([np.array([32], dtype=np.uint32), c, np.array([32], dtype=np.uint32)])
    with np.errstate(over="ignore"):
        h = p[:-2] * np.uint32(0x9E3779B1) + p[1:-1] * np.uint32(0x85EBCA77) + p[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
    return np.where(c == 32, np.int32(1 << BITS), (h & np.uint32((1 << BITS) - 1)).astype(np.int32))


def units(cp: np.ndarray) -> np.ndarray:
    """Starts of sentences and lines, with the length as last element."""
    t = _tables()
    ends = np.zeros(len(cp), dtype=bool)
    ends[:-1] = t["stop"][cp[:-1]] & t["blank"][cp[1:]]
    ends |= cp == 10
    starts = np.concatenate([[0], np.flatnonzero(ends) + 1, [len(cp)]])
    return np.unique(starts)


def unit_facts(cp: np.ndarray, starts: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per unit: letters, trigrams, sentence?, scores by class. The matrix of trigram rows is made block by block."""
    t = _tables()
    first = starts[:-1]
    letters = np.add.reduceat(t["letter"][cp].astype(np.int32), first) if len(first) else np.zeros(0, np.int32)
    g = grams(cp)
    counts = np.add.reduceat((g < (1 << BITS)).astype(np.int32), first) if len(first) else np.zeros(0, np.int32)
    scores = np.zeros((len(first), table.shape[1] if table is not None else 0), dtype=np.float64)
    if table is not None:
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(first, first[a] + BLOCK, "right")) - 1)
            lo, hi = first[a], starts[b]
            for s in range(lo, hi, BLOCK):  # one unit may be longer than a block
                e = min(hi, s + BLOCK) if b == a + 1 else hi
                at = np.maximum(first[a:b], s) - s
                scores[a:b] += np.add.reduceat(table[g[s:e]], at, axis=0)
                if e == hi:
                    break
            a = b
    # the last character that is no blank
    idx = np.where(t["blank"][cp], -1, np.arange(len(cp)))
    last = np.maximum.reduceat(idx, first) if len(first) else np.zeros(0, np.int64)
    closed = (last >= 0) & t["stop"][cp[np.maximum(last, 0)]]
    sentence = (closed & (letters >= 12)) | (letters >= 60)
    return letters, counts, sentence, scores


def _fit(g: np.ndarray, c: np.ndarray, classes: int) -> np.ndarray:
    """g: trigram rows; c: the class of each."""
    counts = np.bincount(g * np.int32(classes) + c.astype(np.int32), minlength=((1 << BITS) + 1) * classes).reshape(-1, classes).astype(np.float64)
    counts[-1] = 0
    total = counts[:-1].sum(axis=0)
    table = np.log((counts + 0.02) / (total + 0.02 * (1 << BITS)))
    table[-1] = 0
    return table.astype(np.float32)


def train(texts: list[str], labels: list[str | None], rounds: int = 3) -> np.ndarray:
    """The matrix of log probabilities: trigram rows by CLASSES. Units count once per distinct text of a class."""
    scripts = list(SCRIPTS)
    found: list[tuple[np.ndarray, int, int]] = []  # trigrams, script, label's class or -1
    t = _tables()
    for text, label in zip(texts, labels):
        cp = code_points(text)
        if not len(cp):
            continue
        starts = units(cp)
        letters, _, sentence, _ = unit_facts(cp, starts, None)
        g = grams(cp)
        lang = (label or "").strip().lower()
        for i in np.flatnonzero(sentence):
            a, b = starts[i], starts[i + 1]
            s = np.bincount(t["script"][cp[a:b]], minlength=len(scripts) + 1)[1:]
            if not s.sum():
                continue
            script = scripts[int(s.argmax())]
            c = CLASSES.index((lang, script)) if (lang, script) in CLASSES else -1
            found.append((g[a:b], int(s.argmax()), c))
    table = np.zeros(((1 << BITS) + 1, len(CLASSES)), dtype=np.float32)
    known = [x for x in found if x[2] >= 0]
    if not known:
        return table
    fit = lambda units_, c: _fit(np.concatenate(units_), np.repeat(c, [len(u) for u in units_]), len(CLASSES))
    table = fit([x[0] for x in known], np.array([x[2] for x in known]))
    # a class must be in the unit's script
    barred = np.array([[s != name for _, s in CLASSES] for name in scripts])
    every, script_of = [x[0] for x in found], np.array([x[1] for x in found])
    g, size = np.concatenate(every), np.array([len(u) for u in every])
    starts = np.cumsum(size) - size
    for _ in range(rounds):
        score = np.empty((len(every), len(CLASSES)))
        a = 0
        while a < len(every):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK)))
            score[a:b] = np.add.reduceat(table[g[starts[a] : starts[b - 1] + size[b - 1]]], starts[a:b] - starts[a], axis=0)
            a = b
        score[barred[script_of]] = -np.inf
        table = _fit(g, np.repeat(score.argmax(axis=1), size), len(CLASSES))
    return table


def _posterior(score: np.ndarray, n: float) -> np.ndarray:
    z = score / np.sqrt(max(1.0, n))
    e = np.exp(z - z.max())
    return e / e.sum()


_OF_CLASS = np.array([list(LANGUAGES).index(lang) for lang, _ in CLASSES])
_NAMES = list(LANGUAGES)


def _by_language(scores: np.ndarray) -> np.ndarray:
    """Per unit the best class of each language."""
    out = np.full((len(scores), len(_NAMES)), -np.inf)
    for c, k in enumerate(_OF_CLASS):
        out[:, k] = np.maximum(out[:, k], scores[:, c])
    return out


def _path(cost: np.ndarray, switch: float) -> np.ndarray:
    """The best sequence of languages: sum of scores less ``switch`` per change."""
    n, k = cost.shape
    back = np.zeros((n, k), dtype=np.int8)
    v = cost[0].copy()
    for i in range(1, n):
        b = int(v.argmax())
        stay, move = v, v[b] - switch
        back[i] = np.where(stay >= move, np.arange(k), b)
        v = np.maximum(stay, move) + cost[i]
    out = np.empty(n, dtype=np.int64)
    out[-1] = int(v.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def segments(text: str, table: np.ndarray, switch: float = 16.0, facts=None) -> list[tuple[str, int, int, float]]:
    """(language, start, end, confidence) in order."""
    cp = code_points(text)
    if not len(cp):
        return []
    starts = units(cp)
    return segments_of(starts, *unit_facts(cp, starts, table), switch=switch)


def segments_of(starts, letters, counts, sentence, scores, switch: float = 16.0) -> list[tuple[str, int, int, float]]:
    if not letters.sum():
        return []
    langs = _by_language(scores)
    best = langs.argmax(axis=1)
    body = np.flatnonzero(sentence)
    if not len(body):
        lang = np.full(len(letters), int(langs.sum(axis=0).argmax()))
    elif (best[body] == best[body[0]]).all():
        lang = np.full(len(letters), int(best[body[0]]))
    else:
        lang = _path(np.where(sentence[:, None], langs, 0.02 * langs), switch)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(lang)) + 1, [len(lang)]])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = sentence[a:b] if sentence[a:b].any() else np.ones(b - a, dtype=bool)
        p = _posterior(langs[a:b][own].sum(axis=0), float(counts[a:b][own].sum()))
        out.append((_NAMES[int(lang[a])], int(starts[a]), int(starts[b]), round(float(p[int(lang[a])]), 4)))
    return out


def fit(df: DataFrame, key: str = "document_id", text: str = "text", lang: str = "lang", train_rows: int = 3000, longest: int = 6000) -> np.ndarray:
    """Fits on at most 2 * train_rows labelled rows (expected: train_rows), chosen by a hash of the key; of a text longer than
    ``longest`` characters a stretch of that length is taken, at a place chosen by a hash. So the sample is bounded in characters."""
    labelled = F.lower(F.btrim(F.col(lang))).isin(list(LANGUAGES)) & (F.length(F.col(text)) > 0)
    rows = df.filter(labelled).count()
    bound = min(1 << 62, -(-(1 << 62) * train_rows // max(1, rows)))
    h = F.xxhash64(F.lit(3), F.col(key), F.col(text))
    at = F.pmod(h, F.greatest(F.length(text) - longest + 1, F.lit(1))).cast("int") + 1
    sample = df.filter(labelled & (F.pmod(h, F.lit(1 << 62)) < bound)).select(F.col(text).substr(at, F.lit(longest)).alias("t"), F.col(lang).alias("l"), h.alias("h")).orderBy("h", "t").limit(2 * train_rows)
    got = sample.toArrow()
    return train(got.column("t").to_pylist(), got.column("l").to_pylist())


def identify(df: DataFrame, key: str = "document_id", text: str = "text", lang: str = "lang", table: np.ndarray | None = None, switch: float = 16.0, **training) -> DataFrame:
    """(key, given, segment_no, lang, confidence, seg_start, seg_end, doc_lang, doc_confidence, n_langs): one row per
    segment of every row with a text; ``given`` is the delivered label."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(fit(df, key, text, lang, **training) if table is None else table)
    names = ["_key", "given", "segment_no", "lang", "confidence", "seg_start", "seg_end", "doc_lang", "doc_confidence", "n_langs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = b.column(2).to_pylist()
            row, no, lg, cf, ss, se, dl, dc, nl = ([] for _ in range(9))
            for i, found in enumerate(_segments_many(texts, m, switch)):
                if not found:
                    continue
                size: dict[str, int] = {}
                sure: dict[str, float] = {}
                for x, s, e, c in found:
                    size[x] = size.get(x, 0) + e - s
                    sure[x] = sure.get(x, 0.0) + c * (e - s)
                main = max(size, key=lambda x: (size[x], x))
                for k, (x, s, e, c) in enumerate(found, 1):
                    for col, v in zip((row, no, lg, cf, ss, se, dl, dc, nl), (i, k, x, c, s, e, main, round(sure[main] / max(1, size[main]), 4), len(size))):
                        col.append(v)
            at = pa.array(row, pa.int64())
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(lg, pa.string()), pa.array(cf, pa.float64()), pa.array(ss, pa.int32()), pa.array(se, pa.int32()), pa.array(dl, pa.string()), pa.array(dc, pa.float64()), pa.array(nl, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = df.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_given"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    return src.mapInArrow(run, f"_key {kind}, given string, segment_no int, lang string, confidence double, seg_start int, seg_end int, doc_lang string, doc_confidence double, n_langs int").withColumnRenamed("_key", key)


def _segments_many(texts: list[str], table: np.ndarray, switch: float) -> Iterator[list[tuple[str, int, int, float]]]:
    """segments() of many texts; short texts share one array of code points."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < BLOCK):
            size += len(texts[b]) + 1
            b += 1
        cp = code_points("\n".join(texts[a:b]) + "\n")
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        starts = units(cp)  # every text ends with a line feed here
        facts = unit_facts(cp, starts, table)
        bounds = np.searchsorted(starts, offsets)
        for k in range(b - a):
            i, j = bounds[k], bounds[k + 1]
            own = starts[i : j + 1] - offsets[k]
            own[-1] -= 1  # the line feed added above
            yield segments_of(own, *(f[i:j] for f in facts), switch=switch)
        a = b


def relabel(segments_: DataFrame, key: str = "document_id") -> DataFrame:
    """Segments of rows whose label is missing or wrong, or whose text uses several languages."""
    wrong = F.col("given").isNull() | (F.lower("given") != F.col("doc_lang")) | (F.col("n_langs") > 1)
    return segments_.filter(wrong).dropDuplicates([key, "segment_no", "lang"])
