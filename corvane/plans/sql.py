"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from .queries import MATRIX, TYPED, Q

EV = """WITH e AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, CAST(user_id AS VARCHAR) AS thread_id, event_type AS source, CASE WHEN event_id % 5 = 0 THEN 'multimodal' ELSE 'text' END AS content_type,
  ts AS created_at, props AS metadata, CASE WHEN event_id % 3 = 0 THEN event_type END AS summary, value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, ts FROM events)
"""
CH = """WITH c AS (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') || lpad(CAST(turn AS VARCHAR), 4, '0') AS id, CAST(conv_id AS VARCHAR) AS thread_id, CASE WHEN role = 'user' THEN 'user' ELSE 'agent' END AS source, text,
  make_timestamp((1700000000 + conv_id * 60 + turn) * 1000000) AS created_at FROM conversations)
"""
TG = "WITH t AS (SELECT doc_id, unnest([lang, source]) AS tag FROM documents)\n"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')"
VEC = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in Q) + "]"
DIST = f"round(list_distance(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {VEC}), 6)"


#: The entries of written(): documents, German ones revised, without those of one source, and all turns.
FIN = CH + """, fin AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, CASE WHEN lang = 'de' THEN text || ' Revised, that with this.' ELSE text END AS text, CASE WHEN lang = 'de' AND text IS NOT NULL THEN 2 ELSE 1 END AS version
  FROM documents WHERE source IS DISTINCT FROM 'src3' UNION ALL SELECT 'c' || id, text, 1 FROM c)
"""


def _bm25(leaves: list[str], cond: str, of: str = "documents") -> str:
    """leaves: counting expressions over t, the tokens."""
    n = ", ".join(f"{x} AS n{i}" for i, x in enumerate(leaves))
    df = ", ".join(f"count(*) FILTER (WHERE n{i} > 0) AS d{i}" for i in range(len(leaves)))
    part = " + ".join(f"greatest(ln((docs - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * n{i} * 2.2e0 / (n{i} + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))" for i in range(len(leaves)))
    return f"""t AS MATERIALIZED (SELECT doc_id, {TOKENS} AS t FROM {of}),
k AS MATERIALIZED (SELECT doc_id, len(t) AS dl, {n} FROM t),
s AS (SELECT count(*) AS docs, avg(dl) AS avgdl, {df} FROM k),
f AS (SELECT doc_id AS id, round({part}, 6) AS score FROM k, s WHERE {cond})
"""


def _word(w: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{w}'))"


def _prefix(w: str) -> str:
    return f"len(list_filter(t, lambda x: starts_with(x, '{w}')))"


def _phrase(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len(t)), lambda i: t[i] = '{a}' AND t[i + 1] = '{b}'))"


LEGS = "WITH " + _bm25([_word(w) for w in ("for", "was", "only")], "n0 > 0 AND n1 > 0 AND n2 > 0") + f""",
g AS (SELECT vec_id AS id, {DIST} AS distance FROM embeddings),
fr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS fts_rank FROM f QUALIFY fts_rank <= 200),
gr AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS semantic_rank FROM g QUALIFY semantic_rank <= 200),
u AS (SELECT coalesce(fr.id, gr.id) AS id, coalesce(1e0 / (60 + fts_rank), 0) + coalesce(1e0 / (60 + semantic_rank), 0) AS rrf, fts_rank, semantic_rank, score AS fts_score, distance AS semantic_distance FROM fr FULL JOIN gr ON fr.id = gr.id)
"""


def _fold(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lit(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else repr(v)


def _eq(v: object, op: str = "=") -> str:
    if isinstance(v, bool):
        return f"(k = 'BOOLEAN' AND s {op} '{_lit(v)}')"
    if isinstance(v, str):
        return f"(k = 'VARCHAR' AND {_fold('s')} {op} {_fold(_lit(v))})"
    return f"(k IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') AND TRY_CAST(s AS DECIMAL(38, 10)) {op} {v!r})"


def _case(op: str, v: object) -> str:
    cmp_ = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
    if op in ("eq", "ne"):
        return _eq(v, "=" if op == "eq" else "<>")
    if op in cmp_:
        return f"(k = 'VARCHAR' AND s {cmp_[op]} {_lit(v)})" if isinstance(v, str) else _eq(v, cmp_[op])
    present = "(k IS NOT NULL AND k <> 'NULL')"
    if op == "in":
        return "(" + " OR ".join(_eq(x) for x in v) + ")"
    if op == "not_in":
        return f"({present} AND NOT coalesce({_case('in', v)}, false))"
    if op in ("exists", "is_not_null"):
        return present
    if op == "not_exists":
        return f"(NOT coalesce({present}, false))"
    if op == "is_null":
        return "(k = 'NULL')"
    if op == "array_contains":
        inner = _eq(v).replace("k =", "json_type(x) =").replace("k IN", "json_type(x) IN").replace("(s ", "(json_extract_string(x, '$') ").replace(" s ", " json_extract_string(x, '$') ").replace("(s,", "(json_extract_string(x, '$'),")
        return f"(k = 'ARRAY' AND len(list_filter(CAST(CASE WHEN k = 'ARRAY' THEN j ELSE '[]' END AS JSON[]), lambda x: coalesce({inner}, false))) > 0)"
    fn = {"contains": "contains", "starts_with": "starts_with", "ends_with": "ends_with"}[op]
    return f"(k = 'VARCHAR' AND {fn}({_fold('s')}, {_fold(_lit(v))}))"


TY = """WITH t AS (SELECT doc_id AS id, coalesce(lang, '') AS l, coalesce(source, '') AS s0, CAST(n_chars AS VARCHAR) AS n, CAST(doc_id AS VARCHAR) AS i FROM documents),
m AS (SELECT id, CASE WHEN id % 13 = 12 THEN '{}' ELSE '{"v":' || CASE id % 13 WHEN 0 THEN n WHEN 1 THEN n || '.5' WHEN 2 THEN '-' || i WHEN 3 THEN '"' || l || '"' WHEN 4 THEN '"' || upper(l) || '"' WHEN 5 THEN '"' || s0 || '"' WHEN 6 THEN '"' || n || '"'
  WHEN 7 THEN '[' || n || ',"' || l || '",true]' WHEN 8 THEN '["' || upper(l) || '",' || i || ']' WHEN 9 THEN '{"b":1}' WHEN 10 THEN 'null' ELSE CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END END || '}' END AS metadata FROM t),
v AS (SELECT id, metadata, json_extract(metadata, '$.v') AS j, json_type(metadata, '$.v') AS k, json_extract_string(metadata, '$.v') AS s FROM m)
"""
META = EV + "SELECT id, metadata FROM e WHERE "

SQL = {
    "scan_filter_topk": EV + "SELECT id, thread_id, source, metadata FROM e WHERE created_at >= TIMESTAMP '2020-01-01' AND k > 50 ORDER BY created_at DESC, id DESC LIMIT 50",
    "scan_date_range": EV + "SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM e WHERE created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-21' AND source = 'click'",
    "scan_offset_page": EV + "SELECT id, source FROM e ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40",
    "ranked_page": EV + "SELECT id, value FROM (SELECT * FROM e ORDER BY value DESC, id LIMIT 100) x ORDER BY value DESC, id LIMIT 10 OFFSET 90",
    "keyset_page": CH
    + """, p AS (SELECT * FROM c ORDER BY id DESC LIMIT 201), n AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS n, coalesce(sum(length(text)) OVER (ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT id, (SELECT max(n) > 200 FROM n) OR (SELECT max(b) > 20000 FROM n WHERE n <= 200) AS truncated FROM n WHERE n <= 200 AND b <= 20000""",
    "lookup_ids": EV + "SELECT id, source FROM e WHERE event_id IN (3, 77, 500, 999999999)",
    "prefix_lookup": EV + "SELECT id FROM e WHERE starts_with(id, '00000000012') ORDER BY id LIMIT 5",
    "display_format": CH
    + f"""SELECT id, CASE WHEN length(text) <= 300 THEN text WHEN instr(reverse(text[:300]), ' ') > 0 AND 300 - instr(reverse(text[:300]), ' ') > 210 THEN text[:300 - instr(reverse(text[:300]), ' ')] || '...' ELSE text[:300] || '...' END AS text_content,
  length(text) > 300 AS is_truncated, '' AS summary, {ISO.format("created_at")} AS created_at FROM c""",
    "meta_eq": META + "k = 7", "meta_ne": META + "k <> 7", "meta_gt": META + "k > 90", "meta_gte": META + "k >= 91", "meta_lt": META + "k < 5", "meta_lte": META + "k <= 4", "meta_in": META + "k IN (1, 2)",
    "meta_not_in": META + "k NOT IN (1, 2)", "meta_exists": META + "k IS NOT NULL", **{f"meta_{op}": TY + f"SELECT id, metadata FROM v WHERE coalesce({_case(op, v)}, false)" for op, v in TYPED}, "meta_is_not_null": META + "k IS NOT NULL",
    "meta_typed_matrix": TY + "SELECT id, " + ", ".join(f"coalesce({_case(op, v)}, false) AS \"{n}\"" for n, op, v in MATRIX) + " FROM v",
    "meta_columns_matrix": TY + "SELECT id, " + ", ".join(f"coalesce({_case(op, v)}, false) AS \"{n}\"" for n, op, v in MATRIX) + " FROM v",
    "meta_columns_search": TY + "SELECT id, metadata FROM v WHERE k IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(CASE WHEN k IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN s END AS DOUBLE) > 100 AND CAST(CASE WHEN k IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN s END AS DOUBLE) <= 5000.5",
    "tags_any_semi": TG + "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM t WHERE tag IN ('de', 'src3'))",
    "tags_of_entries": TG + "SELECT d.doc_id AS id, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM t WHERE t.doc_id = d.doc_id), '') AS tags FROM documents d",
    "missing_embeddings_anti": "SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "thread_list": EV + f"SELECT thread_id, count(*) AS entry_count, count(DISTINCT source) AS source_types, CAST(sum(CASE WHEN content_type = 'multimodal' THEN 1 ELSE 0 END) AS BIGINT) AS multimodal_count, {ISO.format('min(created_at)')} AS first_entry, {ISO.format('max(created_at)')} AS last_entry, max(id) AS last_id FROM e GROUP BY thread_id",
    "counts_by_source": EV + "SELECT source, count(*) AS n FROM e GROUP BY source",
    "counts_by_content_type": EV + "SELECT content_type, count(*) AS n FROM e GROUP BY content_type",
    "totals": EV + "SELECT count(*) AS total_entries, count(DISTINCT thread_id) AS total_threads FROM e",
    "avg_per_thread": EV + "SELECT round(avg(n), 2) AS average FROM (SELECT count(*) AS n FROM e GROUP BY thread_id) x",
    "top_threads": EV + "SELECT thread_id, count(*) AS n FROM e GROUP BY thread_id ORDER BY n DESC, thread_id LIMIT 5",
    "top_tags": TG + "SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 10",
    "tag_statistics": TG + "SELECT count(*) AS total_tags, count(DISTINCT tag) AS unique_tags, (SELECT round(avg(n), 2) FROM (SELECT count(*) AS n FROM t GROUP BY doc_id) x) AS avg_tags_per_entry FROM t",
    "thread_statistics": TG
    + """SELECT count(*) AS entry_count, count(*) FILTER (WHERE doc_id % 2 = 0) AS user_count, count(*) FILTER (WHERE doc_id % 2 <> 0) AS agent_count, CAST(0 AS BIGINT) AS multimodal_count,
  (SELECT string_agg(tag, ',' ORDER BY tag) FROM (SELECT DISTINCT tag FROM t WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')) x) AS tags, count(*) FILTER (WHERE n_chars > 1000) AS image_count FROM documents WHERE lang = 'de'""",
    "summary_coverage": EV + "SELECT count(*) FILTER (WHERE coalesce(summary, '') <> '') AS with_summary, round(100.0 * count(*) FILTER (WHERE coalesce(summary, '') <> '') / count(*), 2) AS coverage FROM e",
    "embedding_statistics": """WITH m AS (SELECT vec_id // 10 AS context_id, count(*) AS chunk_count, max(len(embedding)) AS dimensions FROM embeddings GROUP BY 1)
SELECT count(*) AS total_entries, count(context_id) AS embedded, round(100.0 * count(context_id) / count(*), 2) AS coverage, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS total_chunks, coalesce(round(avg(chunk_count), 2), 0) AS avg_chunks, CAST(coalesce(sum(chunk_count * dimensions * 4), 0) AS BIGINT) AS bytes
FROM documents LEFT JOIN m ON doc_id = context_id""",
    "adjacent_dedup": CH
    + """, r AS (SELECT * FROM c UNION ALL SELECT id || 'x', thread_id, source, text, created_at FROM c WHERE id[-1:] IN ('0', '3', '6')),
g AS (SELECT *, CASE WHEN lag(source) OVER w IS NOT DISTINCT FROM source AND lag(sha256(text)) OVER w IS NOT DISTINCT FROM sha256(text) THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY thread_id ORDER BY id)),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY thread_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT min(id) AS id, thread_id, min_by(source, id) AS source, count(*) AS version, CAST(length(min_by(text, id)) AS BIGINT) AS n_chars FROM h GROUP BY thread_id, run""",
    "latest_per_thread_source": CH + "SELECT thread_id, source, max(id) AS id, sha256(max_by(text, id)) AS content_hash FROM c GROUP BY thread_id, source",
    "content_hash": "SELECT doc_id AS id, sha256(text) AS content_hash FROM documents",
    "merge_patch_flat": "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN '{\"n\":' || CAST(event_id AS VARCHAR) || '}' ELSE '{\"k\":1,\"n\":' || CAST(event_id AS VARCHAR) || '}' END AS metadata FROM events",
    "merge_patch_nested": "SELECT event_id AS id, '{\"a\":{\"b\":{\"c\":' || CAST(event_id AS VARCHAR) || ',\"f\":3},\"e\":[1,null]}}' AS metadata FROM events",
    "tags_replaced": TG + "SELECT doc_id AS context_entry_id, tag FROM t WHERE tag IS NOT NULL AND doc_id % 2 <> 0 UNION ALL SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, unnest(['new', lower(trim(lang))]) AS tag FROM documents WHERE doc_id % 4 = 2) x WHERE tag IS NOT NULL AND tag <> ''",
    "fts_cover_density": f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), p AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w FROM t),
m AS (SELECT doc_id, i, w, lag(i) OVER o AS j, lag(w) OVER o AS v FROM p WHERE w IN ('that', 'with') WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id AS id, round(sum(CASE WHEN v <> w THEN 0.1e0 / (i - j) ELSE 0 END), 9) AS score FROM m GROUP BY doc_id HAVING count(DISTINCT w) = 2""",
    "fts_highlight": "WITH " + _bm25([_word("that"), _word("with")], "n0 > 0 AND n1 > 0") + r""", top AS (SELECT id FROM f ORDER BY score DESC, id DESC LIMIT 20)
SELECT id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), lambda x: CASE WHEN strip_accents(lower(x)) IN ('that', 'with') THEN '<mark>' || x || '</mark>' ELSE x END), '') AS highlighted FROM top JOIN documents ON doc_id = id""".replace("\\\\", "\\"),
    "grep_content": """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(lower(text), 'idiot')),
x AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS n FROM l),
y AS (SELECT *, ls[n] AS line, CAST(coalesce(list_sum(list_transform(ls[1:n - 1], lambda z: length(z) + 1)), 0) AS BIGINT) AS pos FROM x WHERE contains(lower(ls[n]), 'idiot')),
z AS (SELECT *, unnest(list_filter(range(1, length(line) - 3), lambda i: lower(substr(line, i, 5)) = 'idiot')) AS i FROM y),
r AS (SELECT *, row_number() OVER (ORDER BY id, pos + i) AS rn, count(*) OVER () AS total FROM z)
SELECT id, CAST(n AS INTEGER) AS line_number, line, CAST(pos + i - 1 AS INTEGER) AS start, CAST(pos + i + 4 AS INTEGER) AS "end", CASE WHEN n > 1 THEN ls[n - 1] ELSE '' END AS before, CASE WHEN n < len(ls) THEN ls[n + 1] ELSE '' END AS after, total > 100 AS truncated FROM r WHERE rn <= 100""",
    "retention_delete": EV + "SELECT id FROM e WHERE NOT (CAST(thread_id AS BIGINT) < 50 AND created_at < TIMESTAMP '2024-01-15')",
    "version_update": CH + "SELECT id, CAST(CASE WHEN length(text) > 400 AND length(text) % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, CASE WHEN length(text) > 400 AND length(text) % 2 = 0 THEN 'short' ELSE '' END AS summary FROM c",
    "knn_l2": f"SELECT vec_id, {DIST} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20",
    "knn_filtered": f"SELECT vec_id, {DIST} AS distance FROM embeddings WHERE label % 3 = 0 ORDER BY distance, vec_id LIMIT 20",
    "best_chunk_per_entry": f"""WITH c AS (SELECT vec_id // 10 AS context_id, list_distance(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {VEC}) AS d, CAST(vec_id % 10 * 100 AS INTEGER) AS start_index FROM embeddings)
SELECT context_id, round(d, 6) AS distance, start_index, start_index + 100 AS end_index FROM c QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY d, start_index) = 1""",
    "knn_many": """WITH c AS (SELECT vec_id, vec_id // 10 AS context_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
b AS (SELECT q.vec_id AS query_id, c.context_id, min(list_distance(q.v, c.v)) AS d FROM c q, c WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, context_id) AS INTEGER) AS rank, context_id, round(d, 5) AS distance FROM b QUALIFY rank <= 5""",
    "quantized_size": "SELECT CAST(count(*) * (12 + 24) AS BIGINT) AS bytes FROM embeddings",
    "fts_match": "WITH " + _bm25([_word("that"), _word("with")], "n0 > 0 AND n1 > 0") + "SELECT * FROM f",
    "fts_scan": "WITH " + _bm25([_word("that"), _word("with")], "n0 > 0 AND n1 > 0") + "SELECT * FROM f",
    "fts_hybrid_words": "WITH " + _bm25([_word(w) for w in ("for", "was", "only", "that", "with")], "n0 > 0 OR n1 > 0 OR n2 > 0 OR n3 > 0 OR n4 > 0") + "SELECT * FROM f",
    "fts_prefix": "WITH " + _bm25([_prefix("tha"), _prefix("wit")], "n0 > 0 AND n1 > 0") + "SELECT * FROM f",
    "fts_phrase": "WITH " + _bm25([_phrase("of", "the")], "n0 > 0") + "SELECT * FROM f",
    "fts_boolean": "WITH " + _bm25([_phrase("of", "the"), _word("with"), _word("that")], "(n0 > 0 OR n1 > 0) AND n2 > 0 AND doc_id NOT IN (SELECT doc_id FROM t WHERE list_contains(t.t, 'clown'))") + "SELECT * FROM f",
    "fts_bm25_topk": "WITH " + _bm25([_word(w) for w in ("for", "was", "only")], "n0 > 0 AND n1 > 0 AND n2 > 0") + "SELECT * FROM f ORDER BY score DESC, id DESC LIMIT 20",
    "fts_postings": f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term",
    "hybrid_rrf": LEGS + "SELECT id, round(rrf, 9) AS rrf, CAST(fts_rank AS INTEGER) AS fts_rank, CAST(semantic_rank AS INTEGER) AS semantic_rank, fts_score, semantic_distance FROM u ORDER BY u.rrf DESC, id LIMIT 100",
    "fusion_overlap": LEGS + "SELECT count(fts_rank) AS fts_count, count(semantic_rank) AS semantic_count, count(*) FILTER (WHERE fts_rank IS NOT NULL AND semantic_rank IS NOT NULL) AS overlap, count(*) AS total FROM u",
    "grep_files": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains(text, 'disgusting')",
    "grep_count": r"SELECT CAST(doc_id AS VARCHAR) AS id, CAST(len(regexp_extract_all(text, '\bthe th[a-z]+')) AS BIGINT) AS match_count FROM documents WHERE regexp_matches(text, '\bthe th[a-z]+')",
    "read_range": """SELECT doc_id AS id, CAST(least(10, length(text)) AS INTEGER) AS char_start, CAST(least(60, length(text)) AS INTEGER) AS char_end, substr(text, least(10, length(text)) + 1, least(60, length(text)) - least(10, length(text))) AS content,
  CAST(len(string_split(substr(text, 1, least(10, length(text))), chr(10))) AS INTEGER) AS line_start, CAST(len(string_split(substr(text, 1, greatest(least(60, length(text)) - 1, least(10, length(text)))), chr(10))) AS INTEGER) AS line_end FROM documents""",
    "line_range": "SELECT doc_id AS id, CAST(len(l) AS BIGINT) AS lines, array_to_string(l[2:3], chr(10)) AS content FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n') AS l FROM documents) x",
    "outline_counts": "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(2 AS BIGINT) AS nodes, CAST(length(text) + 2 + 4 * (length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS n_chars FROM documents",
    "entries_after_writes": FIN + "SELECT doc_id AS id, CAST(version AS BIGINT) AS version, sha256(text) AS content_hash, length(text) AS n_chars FROM fin",
    "chunks_after_writes": FIN
    + r"""SELECT doc_id AS id, sha256(text) AS content_hash, CAST(CASE WHEN length(text) > 1500 THEN length(text) - length(regexp_replace(text, '^\s+', '')) ELSE 0 END AS INTEGER) AS first,
  CAST(CASE WHEN length(text) > 1500 THEN length(regexp_replace(text, '\s+$', '')) ELSE length(text) END AS INTEGER) AS last FROM fin""",
    "fts_after_writes": FIN + ", " + _bm25([_word("that"), _word("with")], "n0 > 0 AND n1 > 0", "fin") + "SELECT * FROM f",
    "uuid7_ids": EV + "SELECT id, 32 AS digits, '7' AS version, epoch_us(created_at) // 1000 AS millis FROM e",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
