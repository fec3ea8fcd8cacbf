"""Problem 1: cut oversized texts and token chunks at natural boundaries.

A boundary is a place where the text pauses; its strength says how long. A sparse table over the
boundaries answers "the strongest cut in this window, the rightmost of equals" in two look-ups.
A piece ends at the strongest boundary of the permissible window, which reaches from the least length of a
piece (a quarter of the limit, and more than the overlap) to the limit; without any boundary there, at the limit.
The next piece starts ``overlap`` units before that end. Joining the pieces without their overlaps gives the item back, character for character.

Nulls, empty and blank texts are never oversized. Rows delivered twice give one item. Items whose
key is null are one item per key value, as in GROUP BY.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

BLANK = " \t\r\n"
SPECIAL = ["[CLS]", "[SEP]", "[PAD]"]
CUTS = "array<struct<piece_start:int,piece_end:int>>"

# strengths of boundaries
WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4, 5
_STOPS = np.array([ord(c) for c in ".!?।॥…"], dtype=np.uint32)
_PAUSES = np.array([ord(c) for c in ",;:|"], dtype=np.uint32)


class StrongestCut:
    """Range maximum over boundaries (position, strength), as a sparse table; ties go to the right."""

    def __init__(self, positions: np.ndarray, strengths: np.ndarray, widest: int):
        self.at = positions.astype(np.int64)
        level = (strengths.astype(np.int64) << 40) | self.at
        self.levels, width = [level], 1
        while 2 * width <= min(len(level), max(1, widest)):
            prev = self.levels[-1]
            self.levels.append(np.maximum(prev[:-width], prev[width:]))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """The best position in [lo, hi], or -1."""
        a, b = np.searchsorted(self.at, lo, "left"), np.searchsorted(self.at, hi, "right")
        if a >= b:
            return -1
        k = int(b - a).bit_length() - 1
        best = max(self.levels[k][a], self.levels[k][b - (1 << k)])
        return int(best & ((1 << 40) - 1))


def text_boundaries(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts lie behind runs of blank characters. A full stop behind a short word or before a digit or
    small letter is taken for an abbreviation and weighs as much as a word's end."""
    blank = (cp == 32) | (cp == 9) | (cp == 10) | (cp == 13)
    ends = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    starts = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if len(ends) and (not len(starts) or starts[0] > ends[0]):
        ends = ends[1:]  # blanks before the first word
    starts = starts[: len(ends)]
    if not len(ends):
        return ends, ends
    newlines = np.concatenate([[0], np.cumsum(cp == 10)])
    lines = newlines[ends] - newlines[starts]
    before, after = cp[starts - 1], cp[ends]
    word = starts - np.concatenate([[0], ends[:-1]])
    abbreviation = (before == ord(".")) & ((word <= 4) | ((after >= 48) & (after <= 57)) | ((after >= 97) & (after <= 122)))
    strength = np.where(np.isin(before, _PAUSES), CLAUSE, WORD)
    strength = np.where(np.isin(before, _STOPS) & ~abbreviation, SENTENCE, strength)
    strength = np.where(lines >= 2, PARAGRAPH, np.where(lines == 1, LINE, strength))
    return ends, strength


def token_boundaries(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Between tokens; never before a ``##`` continuation."""
    at, strength = [], []
    for i in range(1, len(tokens)):
        now, prev = tokens[i] or "", tokens[i - 1] or ""
        if now.startswith("##"):
            continue
        s = WORD
        if prev[-1:] in (".", "!", "?", "।", "॥") and not now[:1].isdigit():
            s = SENTENCE
        elif prev[-1:] in (",", ";", ":", "|") and not now[:1].isdigit():
            s = CLAUSE
        at.append(i)
        strength.append(s)
    return np.array(at, dtype=np.int64), np.array(strength, dtype=np.int64)


def cut(n: int, at: np.ndarray, strength: np.ndarray, limit: int, overlap: int, hard=None) -> list[tuple[int, int]]:
    """Half-open pieces of [0, n) of at most ``limit``."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    if n <= limit:
        return [(0, n)]
    table = StrongestCut(at, strength, limit) if len(at) else None
    out, start = [], 0
    while n - start > limit:
        lo, hi = start + max(limit // 4, overlap + 1), start + limit
        end = table.query(lo, hi) if table else -1
        if end < 0:
            end = hard(lo, hi) if hard else hi
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def hard(lo: int, hi: int) -> int:
        end = hi
        while end > max(lo, hi - 16) and unicodedata.category(text[end])[0] == "M":
            end -= 1  # not between a letter and its vowel sign
        return end

    at, strength = text_boundaries(cp)
    return cut(len(cp), at, strength, limit, overlap, hard)


def cut_tokens(tokens, limit: int, overlap: int) -> list[tuple[int, int]]:
    at, strength = token_boundaries(list(tokens))
    return cut(len(tokens), at, strength, limit, overlap)


def text_pieces(df: DataFrame, key: str = "document_id", text: str = "text", latest: str | None = None, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(key, piece_no, piece_start, piece_end, piece) of every text longer than ``limit`` code points
    without its outer blanks. Offsets count code points of the trimmed text. Of rows with one key the
    latest (then greatest) text counts."""
    ship(df.sparkSession)

    @F.pandas_udf(CUTS)
    def cuts(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"piece_start": a, "piece_end": b} for a, b in cut_text(t, limit, overlap)])

    body = F.btrim(F.col(text), F.lit(BLANK))
    order = F.struct(F.col(latest), body) if latest else F.struct(body)
    long = (
        df.filter(F.length(body) > limit)
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(order).alias("_best"))
        .select("_key", F.col("_best").getField("col2" if latest else "col1").alias("_text"))
    )
    return long.withColumn("_cuts", cuts("_text")).select("_key", "_text", F.posexplode("_cuts").alias("_i", "_c")).select(
        F.col("_key").alias(key),
        (F.col("_i") + 1).alias("piece_no"),
        F.col("_c.piece_start").alias("piece_start"),
        F.col("_c.piece_end").alias("piece_end"),
        F.expr("substring(_text, _c.piece_start + 1, _c.piece_end - _c.piece_start)").alias("piece"),
    )


def is_content(token: Column, mask: Column) -> Column:
    return F.coalesce((mask == 1) & ~token.isin(SPECIAL), F.lit(False))


def chunk_pieces(df: DataFrame, keys: tuple[str, str] = ("document_id", "chunk_index"), limit: int = 64, overlap: int = 16) -> DataFrame:
    """(keys, piece_no, piece_start, piece_end, tokens, input_ids, labels, label_ids) of every chunk with
    more than ``limit`` content tokens (attention_mask 1, no special token); the parallel arrays are cut
    alike. Null arrays have no content."""
    ship(df.sparkSession)

    @F.pandas_udf(CUTS)
    def cuts(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"piece_start": a, "piece_end": b} for a, b in cut_tokens(t, limit, overlap)])

    zipped = F.arrays_zip("tokens", "input_ids", "attention_mask", "labels", "label_ids")
    content = F.filter(zipped, lambda x: is_content(x["tokens"], x["attention_mask"]))
    n = F.size(F.filter(F.arrays_zip("tokens", "attention_mask"), lambda x: is_content(x["tokens"], x["attention_mask"])))
    long = (
        df.filter((F.size("tokens") > limit) & (n > limit))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], content.alias("_content"))
        .groupBy("_k0", "_k1")
        .agg(F.max("_content").alias("_content"))
    )
    part = lambda c: F.slice(F.transform("_content", lambda x: x[c]), F.col("_c.piece_start") + 1, F.col("_c.piece_end") - F.col("_c.piece_start")).alias(c)
    return (
        long.withColumn("_cuts", cuts(F.transform("_content", lambda x: F.coalesce(x["tokens"], F.lit("")))))
        .select("_k0", "_k1", "_content", F.posexplode("_cuts").alias("_i", "_c"))
        .select(
            *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
            (F.col("_i") + 1).alias("piece_no"),
            F.col("_c.piece_start").alias("piece_start"),
            F.col("_c.piece_end").alias("piece_end"),
            *[part(c) for c in ("tokens", "input_ids", "labels", "label_ids")],
        )
    )
