"""DuckDB SQL of the queries on conversations, quality rules and vector codes, written on its own over whole tables."""
from __future__ import annotations

_WORD = "[^\\x20\\x09-\\x0D]+"
_ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: crc32 of an ASCII string: eight shifts for each byte, by the reflected polynomial (a fixed value).
_CRC32 = """
    xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda k: ascii(substr({0}, k, 1))::BIGINT),
        lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT)"""


def _options() -> str:
    """Rows (f, ins, edit, k, cost, t): from state f up to two inserts, then one edit of a row of kind k, to state t."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    rows = []
    for f in range(4):
        g = f
        for n in range(3):
            for kind in "suao-":
                rows.append((f, "I" * n + "D", kind, 2 * n + 3, g, 0))
                if kind != "-":
                    rows.append((f, "I" * n + "R", kind, 2 * n + 2, after[g], 1))
            keeps = [("s", 1)] * (g == 0) + [("a", 3)] * (g == 2) + [("u", 2)] * (g != 2)
            rows += [(f, "I" * n + "K", kind, 2 * n, t, 1) for kind, t in keeps]
            g = after[g]
    return ", ".join(f"({f}, '{edit}', '{kind}', {cost}, {t}, {stays})" for f, edit, kind, cost, t, stays in rows)


CONVERSATIONS = f"""
    WITH RECURSIVE d AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_CRC32.format("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations),
    r AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                 CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM d, range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) WHERE h <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c FROM r),
    f AS (SELECT *, trim(text, ' \t\n' || chr(11) || chr(12) || chr(13)) AS body, count(*) OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
                 lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
    k AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN body NOT SIMILAR TO '(?s).*[.!?]' THEN 'truncated' ELSE '' END AS fault FROM f),
    e AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN c IN ('s', 'u', 'a') THEN c ELSE 'o' END AS kind FROM k),
    n AS (SELECT conv_id, count(*) AS n FROM e GROUP BY conv_id),
    options(f, edit, kind, cost, t, stays) AS (VALUES {_options()}),
    best AS (
        SELECT conv_id, n AS i, s AS f, c AS cost, a AS audit FROM n, (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) x(s, c, a)
        UNION ALL
        SELECT conv_id, i, f, m.c, m.a FROM (
            SELECT b.conv_id, b.i - 1 AS i, p.f, min({{'c': b.cost + p.cost + p.stays * (e.fault = 'truncated')::INT, 'a': p.edit || b.audit}}) AS m
            FROM best b JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i JOIN options p ON p.t = b.f AND p.kind = e.kind
            GROUP BY b.conv_id, b.i, p.f)),
    plan AS (SELECT conv_id, cost, audit FROM best WHERE i = 0 AND f = 0),
    letters AS (SELECT conv_id, q, substr(audit, q, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS q FROM plan)),
    pos AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w AS j FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY q)),
    kept AS (SELECT pos.conv_id, q, j, edit, e.role, CASE edit WHEN 'I' THEN '' ELSE e.text END AS text,
                    first_value(edit = 'K' AND e.c = 's') OVER (PARTITION BY pos.conv_id ORDER BY q) AS led
             FROM pos LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM pos.conv_id AND e.i = pos.i WHERE edit <> 'D'),
    told AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j + led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY q) AS repaired
             FROM kept GROUP BY conv_id),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                      count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                      count(*) FILTER (prior || c NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id)
    SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
           coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) w LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM w.conv_id
    LEFT JOIN plan ON plan.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM w.conv_id"""

QUALITY_RULES = f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    b AS (SELECT r, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM t),
    l AS (SELECT r, source, line, regexp_extract_all(translate(line, {_ASCII_LOWER}), '{_WORD}') AS lw FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM t)),
    d AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE len(lw) > 0 GROUP BY r),
    g AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
    p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g), range(3) x(k) WHERE c > 1 GROUP BY r),
    u AS (SELECT min(r) AS r, source FROM t GROUP BY source, text), h AS (SELECT source, count(*) AS docs FROM u GROUP BY source),
    m AS (SELECT u.source, array_to_string(lw, ' ') AS line, count(DISTINCT u.r) AS n FROM u JOIN l USING (r) WHERE len(lw) > 0 GROUP BY u.source, array_to_string(lw, ' ')),
    q AS (SELECT m.source, line FROM m JOIN h ON h.source IS NOT DISTINCT FROM m.source WHERE n > 20 AND 100 * n > docs),
    z AS (SELECT r, sum(len(lw))::BIGINT AS lost FROM l JOIN q ON q.source IS NOT DISTINCT FROM l.source AND q.line = array_to_string(lw, ' ') GROUP BY r),
    s AS (SELECT t.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_line_words
          FROM t JOIN b USING (r) LEFT JOIN d USING (r) LEFT JOIN p USING (r) LEFT JOIN z USING (r))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_line_words) >= 50 * n_words AS kept FROM s"""


def _rounds(n: int) -> str:
    out = []
    for k in range(n + 1):
        out.append(f"""
    a{k} AS MATERIALIZED (
        SELECT x.r, x.p, min({{'d': list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': c.e}}) AS m
        FROM part x JOIN c{k} c USING (p) GROUP BY x.r, x.p)""")
        if k < n:
            out.append(f"""
    s{k} AS (SELECT a.p, a.m.e AS e, j, sum(x.x[j])::HUGEINT AS s, count(*) AS n FROM a{k} a JOIN part x USING (r, p), range(1, len(x.x) + 1) y(j) GROUP BY a.p, a.m.e, j),
    n{k} AS (SELECT p, e, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY j) AS x FROM s{k} GROUP BY p, e),
    c{k + 1} AS MATERIALIZED (SELECT p, e, x FROM n{k} UNION ALL SELECT p, e, x FROM c{k} ANTI JOIN n{k} USING (p, e))""")
    return ",".join(out)


VECTOR_CODES = f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda e: floor(4096 * e::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    part AS MATERIALIZED (SELECT r, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS x FROM v, range(8) y(p)),
    c0 AS MATERIALIZED (SELECT p, e, x FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v QUALIFY e < 16) USING (r)),{_rounds(6)},
    g AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a6 GROUP BY r),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN g USING (r), h"""
