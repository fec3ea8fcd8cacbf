"""Edit distance, abbreviations and the folding of typed values, shared by problems 3 and 5."""

from __future__ import annotations

import re
import unicodedata


def levenshtein(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance (a true metric) by bit vectors, one machine step per character of ``b``.
    With ``most``: any value above it may be returned as ``most + 1``."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | (1 << i)
    m = len(a)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d = mask, 0, m
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        ph, mh = ((ph << 1) | 1) & mask, (mh << 1) & mask
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv
    return d


def banded(a: str, b: str, k: int) -> int:
    """Edit distance if it is at most ``k``, else k + 1: only the 2k + 1 diagonals round the main one are filled."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    far = k + 1
    prev = {j: j for j in range(min(m, k) + 1)}
    for i in range(1, n + 1):
        row, best = {}, far
        for j in range(max(0, i - k), min(m, i + k) + 1):
            v = i if j == 0 else min(prev.get(j - 1, far) + (a[i - 1] != b[j - 1]), prev.get(j, far) + 1, row.get(j - 1, far) + 1)
            row[j] = v
            best = min(best, v)
        if best > k:
            return far
        prev = row
    return min(prev.get(m, far), far)


# fixed values: digits that stand for letters in scanned or typed words
_LOOKS = {"0": "o", "1": "l", "5": "s"}


def fold(value: str) -> str:
    """Lower case, compatibility form; digits inside words become the letters they resemble; all blanks one space."""
    s = unicodedata.normalize("NFKC", value).casefold()
    s = re.sub(r"(?<=[^\W\d_])[015]|[015](?=[^\W\d_])", lambda m: _LOOKS[m[0]], s)
    return " ".join(s.split())


def words(s: str) -> list[str]:
    """Runs of letters, digits and combining marks; apostrophes and inner strokes join (adv'y, m/o)."""
    s = re.sub(r"(?<=\w)['’/](?=\w)", "", s)
    return [w for w in re.split(r"[^\wऀ-෿]+", s) if w]


def abbreviates(short: str, full: str) -> bool:
    """Same first letter, and the letters of ``short`` occur in ``full`` in this order."""
    if not short or not full or short[0] != full[0] or len(short) >= len(full):
        return False
    it = iter(full)
    return all(c in it for c in short)


def word_matches(a: str, b: str) -> int | None:
    """Cost of reading ``a`` as the word ``b``: 0 equal, 2 abbreviation or small typo, None no match."""
    if a == b:
        return 0
    if abbreviates(a, b):
        return 2
    if len(a) >= 4 and sorted(a) == sorted(b):  # letters that changed places count twice in the metric
        return 2
    most = 0 if min(len(a), len(b)) < 4 else 1 if min(len(a), len(b)) < 6 else 2
    return 2 if most and levenshtein(a, b, most) <= most else None


def reads_as(short: list[str], full: list[str]) -> int | None:
    """Cost of reading the words ``short`` as ``full``: word by word, or one word as the initials of several."""
    if not short and not full:
        return 0
    if not short or not full:
        return None
    best = None
    c = word_matches(short[0], full[0])
    if c is not None and (r := reads_as(short[1:], full[1:])) is not None:
        best = c + r
    w = short[0]
    for n in range(2, min(len(w), len(full)) + 1):
        if len(w) == n and all(w[i] == full[i][0] for i in range(n)) and (r := reads_as(short[1:], full[n:])) is not None:
            best = 1 + r if best is None else min(best, 1 + r)
    return best
