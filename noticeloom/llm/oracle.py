"""DuckDB SQL for those queries of the nine problems that SQL can express."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(13) || chr(10)"
_PUNCT = r"!-/:-@\[-`{-~"
# fixed values: as in the operator
_NOT_KNOWN = "'UNKNOWN','NOT KNOWN','N/A','NA','N.A.','NONE','NULL','NIL','-','--','?','??','TBD','NOT AVAILABLE','NOT STATED','NOT GIVEN','UNSPECIFIED','(UNKNOWN)','(NOT KNOWN)'"


def oracle_sql() -> dict[str, str]:
    p8_words = f"list_filter(string_split_regex(regexp_replace(lower(text), '[{_PUNCT}।]', ' ', 'g'), '[ \\t\\r\\n]+'), lambda w: w <> '')"
    p8_found = f"""
        WITH d AS (SELECT doc_id, {p8_words} AS w FROM documents WHERE text IS NOT NULL),
             i AS (SELECT item_id, {p8_words} AS w FROM eval_items WHERE text IS NOT NULL),
             dn AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 10, 1))) AS t(k)),
             gi AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 10, 1))) AS t(k))
        SELECT DISTINCT doc_id, item_id FROM dn JOIN gi USING (g)"""
    return {
        "p1_found": f"""
            SELECT DISTINCT document_id, -1 AS chunk_index FROM annotation_corpus WHERE length(trim(text, {_BLANK})) > 4000
            UNION ALL
            SELECT DISTINCT document_id, chunk_index FROM train
            WHERE len(list_filter(list_zip(tokens, attention_mask), lambda x: x[2] = 1 AND x[1] NOT IN ('[CLS]', '[SEP]', '[PAD]'))) > 64""",
        "p2_found": f"""
            WITH RECURSIVE l AS (
                SELECT upper(trim(document_id, {_BLANK})) AS d, upper(trim(link_key, {_BLANK})) AS k, link_kind FROM doc_links),
            ok AS (SELECT DISTINCT 'D:' || d AS d, CASE WHEN link_kind = 'revision_of' THEN 'D:' ELSE 'K:' END || k AS k FROM l
                   WHERE d <> '' AND k <> '' AND k NOT IN ({_NOT_KNOWN})),
            e AS (SELECT d AS a, k AS b FROM ok UNION SELECT k, d FROM ok),
            reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
            g AS (SELECT a, min(b) AS root, count(*) AS n FROM reach WHERE a[1:2] = 'D:' AND b[1:2] = 'D:' GROUP BY a)
            SELECT a[3:] AS document_id, root[3:] AS group_id FROM g
            WHERE n > 1 AND a[3:] IN (SELECT upper(trim(document_id, {_BLANK})) FROM train)""",
        "p4_found": r"""
            WITH t AS (SELECT document_id, max(text) AS text FROM annotation_corpus GROUP BY 1),
                 w AS (SELECT document_id, unnest(list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda x: x <> '')) AS w FROM t),
                 k AS (SELECT document_id, w, count(*) AS c FROM w GROUP BY ALL),
                 n AS (SELECT document_id, sum(c) AS n FROM k GROUP BY 1),
                 s AS (SELECT a.document_id AS x, b.document_id AS y, sum(least(a.c, b.c)) AS s FROM k a JOIN k b ON a.w = b.w AND a.document_id < b.document_id GROUP BY ALL)
            SELECT x AS document_id_a, y AS document_id_b FROM s JOIN n p ON p.document_id = x JOIN n q ON q.document_id = y WHERE s >= 0.8 * (p.n + q.n - s)""",
        "p1_cover": f"""
            SELECT DISTINCT document_id, -1 AS chunk_index, n AS covered, 0 AS oversized, 0 AS loose FROM (
                SELECT document_id, length(trim(arg_max(text, (collected_at, trim(text, {_BLANK}))), {_BLANK})) AS n FROM annotation_corpus WHERE length(trim(text, {_BLANK})) > 4000 GROUP BY 1)
            UNION ALL
            SELECT DISTINCT document_id, chunk_index, n, 0, 0 FROM (SELECT document_id, chunk_index, len(list_filter(list_zip(tokens, attention_mask), lambda x: x[2] = 1 AND x[1] NOT IN ('[CLS]', '[SEP]', '[PAD]'))) AS n FROM train) WHERE n > 64""",
        "p4_groups": r"""
            WITH RECURSIVE t AS (SELECT document_id, max(text) AS text FROM annotation_corpus GROUP BY 1),
                 w AS (SELECT document_id, unnest(list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda x: x <> '')) AS w FROM t),
                 k AS (SELECT document_id, w, count(*) AS c FROM w GROUP BY ALL),
                 n AS (SELECT document_id, sum(c) AS n, md5(string_agg(w || chr(31) || c, chr(30) ORDER BY w)) AS h FROM k GROUP BY 1),
                 s AS (SELECT a.document_id AS x, b.document_id AS y, sum(least(a.c, b.c)) AS s FROM k a JOIN k b ON a.w = b.w AND a.document_id <> b.document_id GROUP BY ALL),
                 e AS (SELECT x, y, q.h AS h, p.h AS own FROM s JOIN n p ON p.document_id = x JOIN n q ON q.document_id = y WHERE s >= 0.8 * (p.n + q.n - s)),
                 r(a, b) AS (SELECT document_id, document_id FROM n UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
            SELECT a AS document_id, min(b) AS class_id, any_value(coalesce(links, 0)) AS links FROM r LEFT JOIN (SELECT x, count(DISTINCT h) AS links FROM e WHERE h <> own GROUP BY 1) l ON l.x = r.a GROUP BY 1""",
        "p7_documents": rf"""
            SELECT doc_id, greatest(1, ceil(n / 512.0)::BIGINT) AS pieces, n AS tokens FROM (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[{_PUNCT}]|[^ \t\r\n{_PUNCT}]+')), 0) AS n FROM documents)""",
        "p7_found": rf"""
            SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[{_PUNCT}]|[^ \t\r\n{_PUNCT}]+')) > 512""",
        "p8_found": p8_found,
        "p8_items": f"SELECT item_id, count(DISTINCT doc_id) AS documents FROM ({p8_found}) GROUP BY 1",
    }
