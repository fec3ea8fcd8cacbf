"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

STRIP = "' ' || chr(10) || chr(13) || chr(9) || chr(12) || chr(11)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP})"


def any_of(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def find_all(source: str, key: str, text: str, pattern: str) -> str:
    """SELECT key, i (from 1), start, end, value, t of all matches."""
    p = q(pattern)
    return f"""SELECT {key}, i, s AS "start", s + length(m[i]) AS "end", m[i] AS value, t FROM (
        SELECT {key}, t, m, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
        FROM (SELECT {key}, {text} AS t, regexp_extract_all({text}, {p}, 0) AS m, string_split_regex({text}, {p}) AS g FROM {source} WHERE {text} IS NOT NULL) a,
             unnest(range(1, len(m) + 1)) AS u(i)) b"""


def cascade(x: str, table, value: int, default: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, row[0])} THEN {q(row[value])}" for row in table) + (f" ELSE {q(default)}" if default is not None else "") + " END"
