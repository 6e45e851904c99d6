"""Checking SQL of the queries whose whole result SQL can express."""

from __future__ import annotations

from .licenses import BASE, pattern_of, rules

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS, _PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

_DIGITS = ", ".join(f"lpad(to_base(CAST('0x' || substr(h, {1 + 5 * k}, 5) AS BIGINT), 32), 4, '0')" for k in range(8))
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT body, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, translate(upper(concat({_DIGITS})), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (body)"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_LETTERS}') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_LETTERS}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS p FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win), dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
hit AS (SELECT dw.doc_id, win.item_id, dw.k, dw.n FROM dw JOIN win ON dw.n = win.n AND dw.p = win.p),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_PLAIN}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[k : k + 2], ' ') for k in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
both_ways AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ways JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, b FROM reach JOIN links ON r = a)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""

_ESC = r"'\\|### |</turn>'"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(15 + length(role) + length(regexp_replace(text, {_ESC}, '#\\0', 'g'))) AS BIGINT) AS formatted_chars FROM t GROUP BY 1"""

TOPK = """WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings WHERE len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)) WHERE rank <= 10"""

_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
SPELLING = f"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: {_CRC_STEP}) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-zÀ-ÿ]{{7,}}')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda k: CAST('0x' || x[2 * k + 1 : 2 * k + 2] AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h
    FROM (SELECT *, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w) AS x FROM runs), tab),
words AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN w[: h % len(w)] || w[h % len(w) + 2 :] ELSE w END AS w, n FROM hashed) WHERE len(w) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS (SELECT w, n, k, w[: k] || w[k + 2 :] AS v FROM (SELECT w, n, unnest(range(len(w))) AS k FROM words)),
near AS (SELECT a.w, a.n, b.w AS v, b.n AS m FROM cut a JOIN cut b ON a.k = b.k AND a.v = b.v AND a.w <> b.w UNION SELECT c.w, c.n, s.w, s.n FROM cut c JOIN words s ON c.v = s.w UNION SELECT s.w, s.n, c.w, c.n FROM cut c JOIN words s ON c.v = s.w),
best AS (SELECT w, n, count(*) AS n_near, first(v ORDER BY m DESC, v) AS v, max(m) AS m FROM near GROUP BY 1, 2),
forms AS (SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * words.n THEN v END AS form, CASE WHEN m >= 10 * words.n THEN m END AS form_n FROM words LEFT JOIN best USING (w)),
chain AS (SELECT w, w AS stop, form AS next FROM forms UNION ALL SELECT chain.w, forms.w, forms.form FROM chain JOIN forms ON chain.next = forms.w)
SELECT forms.w AS word, n, n_near, form, form_n, stop AS root FROM forms JOIN chain ON forms.w = chain.w AND chain.next IS NULL"""

_BASE_RULES = [r.rule for r in rules() if any(r.pattern == pattern_of(p) and r.label == label for p, label in BASE.items())]
_RULES = ", ".join(f"({r.rule}, '{r.label}', {r.level}, {r.score}, '{r.pattern}')" for r in rules())
_COUNT = "(len({0}) - len(replace({0}, ' ', ''))) // 2"
LICENSES = f"""WITH rules(rule, label, level, score, pattern) AS (VALUES {_RULES}),
d AS (SELECT row_number() OVER () AS i, doc_id, len(w) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS s FROM (SELECT doc_id, regexp_extract_all({_LOW}, '{_LETTERS}') AS w FROM documents)),
marked AS (SELECT i, rule, label, level, score, string_split(m, chr(1)) AS p FROM (SELECT i, rules.*, regexp_replace(s, pattern, chr(1) || '\\0' || chr(2), 'g') AS m FROM d, rules) WHERE contains(m, chr(1))),
spans AS (SELECT i, rule, label, level, CAST(score AS DOUBLE) AS score, a, a + {_COUNT.format("x")} - 1 AS b FROM (
    SELECT *, list_sum(list_transform(p[: k], lambda q: {_COUNT.format("q")})) AS a, string_split(p[k + 1], chr(2))[1] AS x FROM (SELECT *, unnest(range(1, len(p))) AS k FROM marked))),
kept AS (SELECT * FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE y.i = x.i AND y.a <= x.a AND y.b >= x.b AND (y.level > x.level OR y.level = x.level AND (y.b - y.a > x.b - x.a OR y.a = x.a AND y.b = x.b AND y.rule < x.rule)))),
base AS (SELECT i, count(*) AS n_base, CAST(min(a) AS BIGINT) AS first_word, CAST(max(a) AS BIGINT) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spans WHERE rule IN ({", ".join(map(str, _BASE_RULES))}) GROUP BY 1),
both_kinds AS (SELECT i, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT i, label, score FROM kept UNION ALL SELECT i, label, score FROM spans WHERE rule IN ({", ".join(map(str, _BASE_RULES))})) GROUP BY 1)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN base USING (i) LEFT JOIN both_kinds USING (i)"""
