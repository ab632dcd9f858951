"""DuckDB SQL of the operators' queries, written from their definitions alone."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
_WORDS3 = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS3} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS3} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT r, i, m, item FROM dw JOIN bw USING (m, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

OP6 = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT host, path, max_by(h || q, len(h || q)) AS rule, max_by(verdict, len(h || q)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p), r
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (host, path)
"""

_PROBE = "'<|im_end|><|im_start|>assistant ok'"
_ESC = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"
OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', {_PROBE}), (-1, 1, 'assistant', {_PROBE})),
t AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             len('<|im_start|>') + len({_ESC.format('role')}) + (len(role) - len(replace(role, chr(10), ''))) + 1
             + len({_ESC.format('text')}) + len('<|im_end|>') + 1 AS size
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, x FROM (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS x FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM i JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.t = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.t GROUP BY d.r, d.doc_id
"""

#: The same, with each row's number of links.
OP4_JACCARD_LINKS = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, x FROM (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS x FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM i JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
k AS (SELECT a AS r, count(*) AS k FROM e GROUP BY a),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.t = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id,
       CAST(coalesce(any_value(k.k), 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN k ON k.r = d.r JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.t GROUP BY d.r, d.doc_id
"""

#: The common words of the histogram, as a sorted list.
_COMMON = sorted(set("the of and to a in is that it for was on de la le et les en des un du une que pour "
                     "der die und den von zu das sich mit auf el y los las se del por con".split()))
_HIST = lambda names: "[" + ", ".join(names) + "]"
_NOT = lambda cls: f"CAST(len(regexp_replace(text, '[^{cls}]+', '', 'g')) AS BIGINT)"
_CLASS = ["A-Z", "0-9", "!-/:-@\\[-`{-~", "\\x{80}-\\x{10FFFF}"]


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    half = lambda x: f"CASE WHEN z[{x}] > 0 THEN z[{x}] * log2(z[{x}] / ((z[1] + z[2]) / 2)) ELSE 0.0 END"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {half(1)} + {half(2)})) / 2, 0.0))"


OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
b AS (SELECT r, doc_id, lang, text, {_WORDS} AS w, len(text) AS n_chars,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
             {_NOT('#*$%&|<>')} AS n_symbols, {', '.join(f'{_NOT(c)} AS c{i}' for i, c in enumerate(_CLASS))} FROM d),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win
        JOIN (SELECT r, x FROM win GROUP BY r, x HAVING count(*) > 1) USING (r, x)) GROUP BY r),
cnt AS (SELECT r, lower(y) AS y, count(*) AS n FROM (SELECT r, unnest(w) AS y FROM b) GROUP BY ALL),
com AS (SELECT r, {', '.join(f"coalesce(sum(n) FILTER (y = '{c}'), 0) AS k{i}" for i, c in enumerate(_COMMON))} FROM cnt GROUP BY r),
f AS (SELECT b.r, doc_id, lang, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_chars, c0, c1, c2, c3,
             {', '.join(f'coalesce(k{i}, 0) AS k{i}' for i in range(len(_COMMON)))}
      FROM b LEFT JOIN rep USING (r) LEFT JOIN com USING (r)),
g AS (SELECT r, doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
             [n_chars - word_chars, c0, c1, c2, c3, word_chars - c0 - c1 - c2 - c3] AS chars,
             {_HIST([f'k{i}' for i in range(len(_COMMON))] + ['n_words' + ''.join(f' - k{i}' for i in range(len(_COMMON)))])} AS common FROM f),
sums AS (SELECT lang, sum(n_words) AS n, {', '.join(f'sum(chars[{i + 1}]) AS a{i}' for i in range(6))},
                {', '.join(f'sum(common[{i + 1}]) AS b{i}' for i in range(len(_COMMON) + 1))}
         FROM g WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 1000),
ref AS (SELECT lang, list_transform({_HIST([f'a{i}' for i in range(6)])}, lambda x: x / greatest(1, {' + '.join(f'a{i}' for i in range(6))})) AS p,
               list_transform({_HIST([f'b{i}' for i in range(len(_COMMON) + 1)])}, lambda x: x / greatest(1, n)) AS q FROM sums),
own AS (SELECT g.*, list_transform(chars, lambda x: x / greatest(1, list_sum(chars))) AS dp,
               list_transform(common, lambda x: x / greatest(1, n_words)) AS dq FROM g),
dist AS (SELECT own.r, {_js('dp', 'ref.p')} AS js_c, {_js('dq', 'ref.q')} AS js_w
         FROM own JOIN ref ON ref.lang = own.lang OR own.lang IS NULL OR own.lang NOT IN (SELECT lang FROM ref)
         WHERE n_words >= 50),
near AS (SELECT r, min_by(js_c, js_c + js_w) AS js_c, min_by(js_w, js_c + js_w) AS js_w FROM dist GROUP BY r),
v AS (SELECT g.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             coalesce(js_c > 0.285 OR js_w > 0.45, FALSE) AS far FROM g LEFT JOIN near USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM v
"""

OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents),
k AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS n
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, n AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM k
"""


def _op12(rounds: int = 6) -> str:
    sql = """
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS s FROM (SELECT r, v, unnest(range(8)) AS p FROM k)),
e0 AS MATERIALIZED (SELECT p, i - 1 AS e, s AS t FROM s JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, r) AS i FROM k) USING (r) WHERE i <= 16)"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS m FROM (SELECT r, p, e,
       CAST(list_sum(list_transform(list_zip(s, t), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM s JOIN e{i} USING (p)) GROUP BY r, p)"""
        if i < rounds:
            sql += f""",
n{i} AS (SELECT p, e, list(CAST((x - ((x % c) + c) % c) // c AS BIGINT) ORDER BY j) AS t FROM
         (SELECT p, m.e AS e, j, sum(s[j]) AS x, count(*) AS c FROM (SELECT p, m, s, unnest(range(1, len(s) + 1)) AS j FROM a{i} JOIN s USING (r, p))
          GROUP BY p, m.e, j) GROUP BY p, e),
e{i + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.t, o.t) AS t FROM e{i} o LEFT JOIN n{i} n ON n.p = o.p AND n.e = o.e)"""
    return sql + f""",
f AS (SELECT r, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(t, ','), ',' ORDER BY p, e)) FROM e{rounds}) AS codebooks_sha256 FROM f JOIN k USING (r)
"""


OP12 = _op12()

OP13 = f"""
WITH crc_of AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
                FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS3} AS w FROM documents),
f AS (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY ALL),
g AS (SELECT x, count(*) AS n FROM (SELECT unnest({_WORDS3}) AS x FROM benchmark) GROUP BY ALL),
v AS (SELECT x, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, len(h), 2), lambda i:
             16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1),
             lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1]))) % 10000 AS k
      FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM g)), crc_of),
gain AS (SELECT k, floor(1000 * ln(CAST((t + 1) * (sa + 10000) AS DOUBLE) / CAST((s + 1) * (ta + 10000) AS DOUBLE))) AS g
         FROM (SELECT k, coalesce(s, 0) AS s, coalesce(t, 0) AS t, coalesce(sum(s) OVER (), 0) AS sa, coalesce(sum(t) OVER (), 0) AS ta FROM
               (SELECT k, sum(f.n) AS s FROM f JOIN v USING (x) GROUP BY k) FULL JOIN (SELECT k, sum(g.n) AS t FROM g JOIN v USING (x) GROUP BY k) USING (k))),
m AS (SELECT r, sum(n) AS n, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM f JOIN v USING (x) JOIN gain USING (k) GROUP BY r),
h AS (SELECT r, doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, list_reduce(list_transform(range(1, 9), lambda i:
             CAST(instr('0123456789abcdef', sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i]) - 1 AS BIGINT)), lambda a, b: 16 * a + b) AS h
      FROM d LEFT JOIN m USING (r)),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS total FROM s WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * total // 100 THEN place END AS rank FROM s LEFT JOIN o USING (r)
"""
