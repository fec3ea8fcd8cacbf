"""Column functions over text. Offsets are code points, half-open."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \n\r\t\f\u000b"
# fixed values: code points that cleaning replaces, and by what
REPLACED = "\u00a0\u2018\u2019\u201c\u201d\u2013\u2014\u2010"
REPLACING = " ''\"\"---"
REMOVED = "\u200b\u200c\u200d\u00ad"
# all blanks but the line feed, as a class of a regular expression
INNER_BLANKS = r"[\t\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ALL_BLANKS = INNER_BLANKS[:-1] + r"\n]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _q(s: str) -> str:
    """A pattern as a Spark SQL raw string literal."""
    if '"' in s:
        return "r'" + s.replace("'", "\\x27") + "'"
    return f'r"{s}"'


def _nfkc(c: Column) -> Column:
    """Made when used: a UDF's type can only be parsed where there is a session."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return nfkc(c)


def replace_code_points(c: Column) -> Column:
    return F.translate(c, REPLACED + REMOVED, REPLACING)


def normalise_unicode(c: Column) -> Column:
    """NFKC and replacements. Texts of ASCII only never leave the JVM."""
    return replace_code_points(F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_nfkc(F.when(~c.rlike(r"^\p{ASCII}*$"), c))))


def remove_page_artifacts(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)\bPage\s+\d+(\s+of\s+\d+)?\b", "")
    return F.regexp_replace(c, r"(?m)^[ \t]*[-—][ \t]*\d+[ \t]*[-—][ \t]*$", "")


def normalise_whitespace(c: Column) -> Column:
    """Lines end at line feeds only. Lines stripped of all blanks, inner spaces and tabs single, at most one blank line in a
    row, the whole stripped."""
    c = F.regexp_replace(c, rf"{INNER_BLANKS}*\n{INNER_BLANKS}*", "\n")
    c = F.regexp_replace(c, rf"^{ALL_BLANKS}+|{ALL_BLANKS}+$", "")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def clean(c: Column) -> Column:
    return normalise_whitespace(remove_page_artifacts(normalise_unicode(c)))


def clean_rules(c: Column) -> Column:
    """clean() without the compatibility form: all of it in the JVM."""
    return normalise_whitespace(remove_page_artifacts(replace_code_points(c)))


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital and goes on small."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), "")


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def each(df: DataFrame, keep: list[str], array: Column, name: str, index: str | None = None) -> DataFrame:
    """One row per element of the array, with the kept columns. An inner explode lets Spark infer a filter on the array and copy
    the expression that makes it, however dear, into that filter; so this explodes outer and drops the nulls behind it."""
    made = F.posexplode_outer(array).alias(index, name) if index else F.explode_outer(array).alias(name)
    return df.select(*keep, made).filter(F.col(name).isNotNull())


def find_all(text: str, pattern: str, block: int = 32) -> Column:
    """array<struct<start,end,value>> of all matches of a pattern without empty matches, in the column named ``text``.

    Places are running sums of the lengths of matches and gaps. The fold appends to an array, which copies it; so it
    runs over blocks of matches, and texts with very many matches stay linear but for a small factor.
    """
    p = _q(pattern)
    kind = "array<struct<start:int,end:int,value:string>>"
    step = """(s, x) -> named_struct('p', s.p + length(x.g) + length(x.m),
        'a', concat(s.a, array(named_struct('start', s.p + length(x.g), 'end', s.p + length(x.g) + length(x.m), 'value', x.m))))"""
    return F.expr(
        f"""transform(array(regexp_extract_all({text}, {p}, 0)), ms -> transform(
            array(zip_with(ms, slice(split({text}, {p}, -1), 1, size(ms)), (m, g) -> named_struct('m', m, 'g', g))), all -> aggregate(
            transform(sequence(0, greatest(size(all) - 1, 0) div {block}), b -> slice(all, cast(b * {block} + 1 as int), {block})),
            named_struct('p', 0, 'a', cast(array() as array<{kind}>)),
            (t, part) -> transform(array(aggregate(part, named_struct('p', t.p, 'a', cast(array() as {kind})), {step})), r -> named_struct('p', r.p, 'a', concat(t.a, array(r.a))))[0],
            t -> flatten(t.a)))[0])[0]"""
    )


def first_capture(text: str, before: str, group: str, flags: str = "", needs: list[str] | None = None, needs_in: str | None = None) -> Column:
    """struct<start,end,value> of the first place where ``before`` is followed by ``group``; null if nowhere.

    One pass over the text: the whole match is taken out, its place is that of its first occurrence as a string (an earlier
    occurrence would have matched itself), and the group is the match's end. ``needs``: strings one of which every match
    holds; texts without them are not searched. ``needs_in``: the column to look in instead of ``text``.
    """
    whole = f"regexp_extract({text}, {_q(f'{flags}(?:{before})(?:{group})')}, 0)"
    part = f"regexp_extract(w, {_q(f'{flags}^(?:{before})({group})')}, 1)" if before else "w"
    if needs:
        guard = " or ".join(f"contains({needs_in or text}, '{n}')" for n in needs)
        whole = f"case when {guard} then {whole} else '' end"
    return F.expr(
        f"""transform(array({whole}), w -> case when w <> '' then
            transform(array({part}), g -> named_struct('start', locate(w, {text}) - 1 + length(w) - length(g), 'end', locate(w, {text}) - 1 + length(w), 'value', g))[0] end)[0]"""
    )


def rfind(text: Column, part: str) -> Column:
    """0-based place of the last occurrence, -1 if there is none."""
    at = F.locate(part[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - len(part) + 1).otherwise(-1)


def contains_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def count_containing(c: Column, parts: list[str]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + c.contains(p).cast("int")
    return out


def lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def word_count(c: Column) -> Column:
    s = strip(c)
    return F.when(F.length(s) > 0, F.size(F.split(s, r"\s+"))).otherwise(0)
