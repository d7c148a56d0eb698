"""DuckDB SQL that gives the results of the registered queries."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_W6 = f"regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_W6} AS w FROM documents),
b AS (SELECT item_id, {_W6} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, w[s : s + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0) x
),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT rid, m, s, w[s : s + m - 1] AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, ms WHERE len(w) >= m) x
),
hit AS (SELECT DISTINCT dw.rid, dw.s, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM hit) x GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) x GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""


def _esc(x: str) -> str:
    for a, b in (("^", "^^"), ("<|", "<^|"), ("</s>", "<^/s>"), ("<s>", "<^s>"), ("[INST]", "[^INST]"), ("[/INST]", "[^/INST]"), ("<<SYS>>", "<^<SYS>>"), ("<</SYS>>", "<^</SYS>>")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


OP7 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
n AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_esc("text")}) + CASE WHEN before IS NOT DISTINCT FROM role THEN 11 ELSE 22 + length({_esc("role")}) END + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

_W2 = f"regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^ \\x09-\\x0D]+')"

OP2 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_W2} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, w[i : i + 1] AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0) x
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ids AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY sh) AS t FROM s),
pair AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM ids a JOIN ids b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM (SELECT x, y, c, p.n AS nx, q.n AS ny FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y) z WHERE 100 * c >= 80 * (nx + ny - c)
),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(r.m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) r USING (doc_id)
"""

OP1 = r"""
WITH p AS (SELECT page_id AS i, url, coalesce(html, '') AS html, substr(md5(coalesce(html, '')), 1, 16) AS tag, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS args
  FROM p
),
c AS (
  SELECT *, CASE WHEN regexp_matches(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') THEN host || path || CASE WHEN args <> '' THEN '?' || args ELSE '' END ELSE u END AS canon,
    (i * 37) % 86400 AS t0, (i * 37) % 86400 + (i % 7) * 3600 AS t1, lpad(CAST(i AS VARCHAR), 12, '0') AS n
  FROM q
),
best AS (
  SELECT v.i, max(struct_pack(t := r.t0, n := r.n, tag := r.tag, html := r.html)) AS r
  FROM c v JOIN c r ON r.canon = v.canon AND r.t0 < v.t1 GROUP BY v.i
),
j AS (
  SELECT c.*, b.r, CASE WHEN i % 13 = 0 THEN NULL WHEN i % 11 = 0 THEN 'x' || tag ELSE tag END AS mine
  FROM c LEFT JOIN best b USING (i)
),
s AS (SELECT *, CASE WHEN r IS NULL THEN 'missing' WHEN mine IS NULL THEN 'unvalidated' WHEN mine = r.tag THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT 'v' || n AS record_id, canon AS canonical_url, status, 'r' || r.n AS response_id,
  coalesce('W/"' || mine || '"', '') AS etag, 'max-age=' || CAST(i % 100 AS VARCHAR) AS cache_control,
  CASE WHEN status = 'resolved' THEN 'text/html' ELSE 'text/plain' END AS content_type, CASE WHEN status = 'resolved' THEN '' ELSE 'HIT' END AS x_cache,
  CAST(CASE WHEN status = 'resolved' THEN strlen(r.html) ELSE 0 END AS BIGINT) AS n_body, CASE WHEN status = 'resolved' THEN md5(r.html) ELSE '' END AS body_md5
FROM s
"""


def _op9() -> str:
    from .mixing import TARGETS

    dims = list(TARGETS)
    share = {d: "CASE " + d + " " + " ".join(f"WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in TARGETS[d].items()) + " END" for d in dims}
    out = """
WITH d AS MATERIALIZED (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) AS BIGINT) AS n, source, lang,
    CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[Ll]icen[sc]e|[Cc]opyright|[Ww]arranty') THEN 'legal' WHEN regexp_matches(text, '@|password|https?://') THEN 'contact' ELSE 'prose' END AS topic
  FROM documents
),
c0 AS (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS n, CAST(1 AS DOUBLE) AS w FROM d GROUP BY ALL HAVING sum(n) > 0),
""".replace("\\\\", "\\")
    named = {d: f"(SELECT sum(s) FROM (SELECT DISTINCT {d}, {share[d]} AS s FROM c0) z)" for d in dims}
    k = 0
    for _ in range(25):
        for d in dims:
            out += f"c{k + 1} AS MATERIALIZED (SELECT source, lang, topic, n, w * ({share[d]} / {named[d]}) / (sum(n * w) OVER (PARTITION BY {d}) / sum(n) OVER ()) AS w FROM c{k}),\n"
            k += 1
    return out + f"""k AS (SELECT *, row_number() OVER o AS j, sum(n) OVER o - n AS saturated, sum(n * w) OVER () - (sum(n * w) OVER o - n * w) AS rest, 0.5e0 * sum(n) OVER () AS budget FROM c{k} WINDOW o AS (ORDER BY w DESC, source, lang, topic)),
f AS (SELECT (budget - saturated) / rest AS c, budget FROM k WHERE rest > 0 AND budget > saturated AND (budget - saturated) / rest * w <= 1 ORDER BY j LIMIT 1),
p AS MATERIALIZED (
  SELECT d.*, w, coalesce(least(1.0e0, c * w), 0.5e0) AS p, budget, CAST('0x' || substr(md5('mix/' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0e0 AS u
  FROM d LEFT JOIN c{k} USING (source, lang, topic), f
),
b AS MATERIALIZED (SELECT *, CASE WHEN p > 0 THEN least(CAST(floor(u / p * 10000) AS BIGINT), 20000) ELSE 20000 END AS part FROM p),
t AS (SELECT part, sum(sum(n)) OVER (ORDER BY part) AS n, max(budget) AS budget FROM b WHERE part < 20000 GROUP BY part),
z AS (SELECT part AS last FROM t ORDER BY abs(n - budget), part LIMIT 1)
SELECT doc_id, n AS mix_tokens, round(w, 6) AS mix_weight, round(p, 6) AS mix_prob, part <= last AS mix_kept FROM b, z
"""


OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[ \x09-\x0D]*[^ \x09-\x0D]+|[ \x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
k AS (SELECT *, len(w) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
),
p AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS pre, array_to_string(list_slice(w, a + 1, b), '') AS mid, array_to_string(list_slice(w, b + 1, n), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

OP13 = f"""
WITH RECURSIVE o AS (
  SELECT id, w, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]{{7,}}')) AS w FROM documents) x GROUP BY ALL
),
x AS (SELECT *, hex(encode(id || ':' || w)) AS hx FROM o),
h AS MATERIALIZED (
  SELECT w, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(hx) // 2)]),
    lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda v, y: xor(v >> 1, 3988292384 * (v & 1))))), 4294967295) AS h
  FROM x
),
v AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h) x
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v) x),
near AS MATERIALIZED (
  SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = cut.rest
  UNION SELECT v.word, cut.word FROM cut JOIN v ON v.word = cut.rest
),
best AS (SELECT x, count(*) AS n_near, first(y ORDER BY n DESC, encode(y)) AS y, max(n) AS m FROM near JOIN v ON v.word = y GROUP BY x),
f AS MATERIALIZED (
  SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= 10 * n THEN y END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN best ON x = word
),
walk(word, here, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
e AS (SELECT word, last(here ORDER BY step) AS root FROM walk GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""

SQL = {"op1_revisits": OP1, "op2_superminhash": OP2, "op6_winnowing": OP6, "op7_chat_format": OP7, "op9_mixing": _op9(), "op12_fill_in_middle": OP12, "op13_spelling": OP13}
