"""The engine's queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions.queries import CLUSTERS, cluster_lookup, expand_query, parse_query
from ..functions.text import CJK_RANGES, FOLD_FROM, FOLD_TO
from .catalog import BUDGET, CODE, NEEDLE, PHRASE, WORDS

CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) = 1)"
FILES = "(SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1)"
EVENTS = r"""(SELECT * FROM (SELECT event_id, ts, op, regexp_replace(path, '^(\./)+', '') AS path, regexp_replace(dest_path, '^(\./)+', '') AS dest_path, received_at
    FROM file_events WHERE ts IS NOT NULL AND path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, ts, path) = 1)"""


def tokens(c: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({c}, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def bm25(table: str, key: str, text: str, phrases: list[list[str]]) -> str:
    """CTEs that end in scored(id, score)."""

    def count(p: list[str]) -> str:
        if len(p) == 1:
            return f"len(list_filter(t, lambda x: x = '{p[0]}'))"
        wanted = " " + "  ".join(p) + " "
        joined = "' ' || array_to_string(t, '  ') || ' '"
        return f"CAST((length({joined}) - length(replace({joined}, '{wanted}', ''))) / {len(wanted)} AS BIGINT)"

    n = range(len(phrases))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    part = lambda i: f"CASE WHEN c{i} > 0 THEN ({idf(i)}) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * dl / a)) ELSE 0 END"
    return f"""words AS (SELECT {key} AS id, {tokens(text)} AS t FROM {table}),
        counted AS (SELECT id, len(t) AS dl, {", ".join(f"{count(p)} AS c{i}" for i, p in enumerate(phrases))} FROM words),
        stats AS (SELECT count(*) AS n, avg(dl) AS a, {", ".join(f"count(*) FILTER (c{i} > 0) AS d{i}" for i in n)} FROM counted),
        scored AS (SELECT id, {" + ".join(part(i) for i in n)} AS score FROM counted, stats WHERE {" OR ".join(f"c{i} > 0" for i in n)})"""


def camel(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"


def identifiers(c: str) -> str:
    return f"flatten(list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9]*'), lambda r: string_split({camel('r')}, ' ')), lambda p: len(p) > 1))"


def pairs(c: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({c}, '[{CJK}]+'), lambda r: CASE WHEN length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))"


BLOB = f"""concat_ws(chr(10), coalesce(symbol, ''), coalesce(qualified_name, ''), coalesce(array_to_string(imports, ' '), ''), coalesce(signature, ''), coalesce(docstring, ''), coalesce(content, ''),
    nullif(array_to_string({identifiers("concat_ws(' ', coalesce(symbol, ''), coalesce(qualified_name, ''), coalesce(array_to_string(imports, ' '), ''), coalesce(content, ''))")}, ' '), ''),
    nullif(array_to_string({pairs("concat_ws(chr(10), coalesce(docstring, ''), coalesce(content, ''))")}, ' '), ''))"""


def top(inner: str, name: str, n: int, filtered: str = "") -> str:
    return f"WITH {inner} SELECT id AS {name}, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank FROM scored {filtered} ORDER BY 2 DESC, 1 LIMIT {n}"


def substring(needle: str) -> str:
    s = needle.lower()
    starts = f"len(list_filter(range(1, length(t) + 1), lambda i: substring(t, i, {len(s)}) = '{s}'))"
    idf = "CASE WHEN ln((n - d + 0.5) / (d + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d + 0.5) / (d + 0.5)) END"
    return f"""names AS (SELECT chunk_id AS id, lower(concat_ws(' ', symbol, qualified_name)) AS t FROM {CHUNKS}),
        found AS (SELECT id, greatest(length(t) - 2, 0) AS dl, CASE WHEN contains(t, '{s}') THEN {starts} ELSE 0 END AS c FROM names),
        about AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (c > 0) AS d FROM found),
        named AS (SELECT id, ({idf}) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / a)) AS score FROM found, about WHERE c > 0)"""


def recall(words: str, needle: str | None, n: int = 20, digits: int = 6) -> str:
    """CTEs that end in fused(id, score)."""
    ranked = lambda t: f"SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM {t} QUALIFY r <= {n}"
    other = f"{substring(needle)}, b AS ({ranked('named')})," if needle else "b AS (SELECT id, r FROM a WHERE false),"
    return f"""{bm25(CHUNKS, "chunk_id", BLOB, parse_query(words))}, a AS ({ranked("scored")}), {other}
        fused AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)"""


def module(c: str) -> str:
    return rf"replace(regexp_replace(regexp_replace({c}, '\.[^./]+$', ''), '^(src|lib|app|pkg)/', ''), '/', '.')"


CANDIDATE = r"CASE WHEN regexp_matches(i, '[/\\]') THEN regexp_replace(regexp_extract(i, '([^/\\]+)[/\\]*$', 1), '(.)\.[^.]+$', '\1') ELSE i END"
LINKED = r"""(SELECT *, regexp_extract(lead(file_path) OVER (PARTITION BY repo_id ORDER BY file_path), '([^/]+)\.[^./]+$', 1) AS next FROM """ + CHUNKS + """ WHERE chunk_type = 'module')"""
MODULES = f"""mods AS (SELECT {module("file_path")} AS name, file_path AS source_path, end_line - start_line + 1 AS lines_of_code,
    CASE WHEN next IS NULL THEN imports ELSE list_append(imports, CASE WHEN start_line % 2 = 0 THEN '../near/' || next || '.ts' ELSE next END) END AS imports FROM {LINKED}),
    modnames AS (SELECT name, max(source_path) AS source_path FROM mods GROUP BY name)"""
PLAIN = MODULES.replace(LINKED, f"(SELECT *, NULL AS next FROM {CHUNKS} WHERE chunk_type = 'module')")
EDGES = f"""{MODULES},
    deps AS (SELECT DISTINCT src, {CANDIDATE} AS dep FROM (SELECT name AS src, unnest(imports) AS i FROM mods)),
    edges AS (SELECT DISTINCT src, dst FROM (SELECT src, coalesce((SELECT name FROM modnames m WHERE m.name = dep), (SELECT min(name) FROM modnames m WHERE ends_with(m.name, '.' || dep))) AS dst FROM deps WHERE dep <> '') WHERE dst IS NOT NULL AND dst <> src)"""
SYMBOLS = f"""syms AS (SELECT * FROM (SELECT {module("file_path")} AS parent, {module("file_path")} || '.' || symbol AS name, chunk_type AS type, symbol, signature, start_line AS location, file_path FROM {CHUNKS} WHERE chunk_type IN ('function', 'class'))
    WHERE parent IN (SELECT name FROM modnames) QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path DESC, location DESC) = 1)"""
NODES = f"""{EDGES}, {SYMBOLS},
    nodes AS (SELECT * FROM (SELECT name, type, parent, NULL::VARCHAR AS source_path, location, 1 AS o FROM syms UNION ALL SELECT name, 'module', NULL, source_path, 1, 0 FROM modnames) QUALIFY row_number() OVER (PARTITION BY name ORDER BY o DESC) = 1)"""
PUBLIC = f"""{EDGES}, public AS (SELECT {module("file_path")} AS name, symbol, file_path, start_line FROM {CHUNKS} WHERE chunk_type IN ('function', 'class') AND NOT starts_with(symbol, '_')),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_path, start_line, symbol) - 1 AS position FROM public WHERE name IN (SELECT name FROM modnames))"""
PLAIN_EDGES = EDGES.replace(MODULES, PLAIN)
NEXT = "near AS (SELECT src AS name, dst AS neighbour FROM edges UNION SELECT dst, src FROM edges)"
RERANK_Q = "flush ledger archive"


def rerank(query: str, rest: str = "score") -> str:
    """The raised score, over columns symbol, qualified_name, signature, docstring and score."""
    words = sorted(set(query.lower().split()))
    name, text = "lower(coalesce(qualified_name, ''))", "concat_ws(' ', nullif(lower(coalesce(signature, '')), ''), nullif(lower(coalesce(docstring, '')), ''))"
    hits = " + ".join(f"(contains({text}, '{w}') OR contains({name}, '{w}'))::INT" for w in words)
    listed = ", ".join(f"'{w}'" for w in words)
    inside = " OR ".join(f"contains({name}, '{w}')" for w in words)
    return f"""round_even(score + CASE WHEN lower(symbol) IN ({listed}) THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN {inside} THEN 0.03::DOUBLE ELSE 0 END
        + CASE WHEN {hits} > 1 THEN 0.01::DOUBLE * ({hits} - 1) ELSE 0 END + CASE WHEN coalesce(docstring, '') <> '' THEN 0.02::DOUBLE ELSE 0 END
        + 0.01::DOUBLE / greatest(1, length({name}) - length(replace({name}, '.', ''))), 6)"""


FETCHED = """(SELECT idx, file_path, lines, CASE WHEN lines IS NOT NULL THEN greatest(1, start_line - coalesce({b}, 0)) END AS first, CASE WHEN lines IS NOT NULL THEN least(len(lines), end_line + coalesce({a}, 0)) END AS last FROM requests LEFT JOIN
    (SELECT file_path, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS lines FROM """ + FILES + """ WHERE content IS NOT NULL) USING (file_path))"""
CONTENT = "CASE WHEN lines IS NULL THEN NULL WHEN first > len(lines) OR last < first THEN '' ELSE array_to_string(lines[first:last], chr(10)) END"


def estimate(c: str) -> str:
    plain = rf"length(regexp_replace({c}, '[^\x{{0}}-\x{{7F}}]', '', 'g'))"
    return f"CAST(greatest(1, floor(1.5::DOUBLE * (length({c}) - {plain}) + 0.25::DOUBLE * {plain})) AS INTEGER)"


HEAD = "concat_ws(' ', coalesce(file_path, ''), coalesce(qualified_name, ''), coalesce(signature, ''), coalesce(language, ''), coalesce(chunk_type, ''))"
PACKED = f"""costs AS (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) AS position, {estimate("coalesce(content, '')")} + {estimate(HEAD)} AS cost FROM {CHUNKS}),
    packed AS (SELECT file_path, position, cost, cost <= {BUDGET} AS included, CASE WHEN cost <= {BUDGET} THEN cost ELSE 0 END AS running FROM costs WHERE position = 1
      UNION ALL SELECT c.file_path, c.position, c.cost, p.running + c.cost <= {BUDGET}, CASE WHEN p.running + c.cost <= {BUDGET} THEN p.running + c.cost ELSE p.running END
      FROM packed p JOIN costs c ON c.file_path = p.file_path AND c.position = p.position + 1)"""
SEEN = f"(SELECT c.chunk_id, c.content_hash, e.op FROM {CHUNKS} c LEFT JOIN (SELECT * FROM {EVENTS} QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1) e ON e.path = c.file_path)"
OLD = f"(SELECT chunk_id, content_hash FROM {SEEN} WHERE op IS NULL OR op <> 'created')"
NEW = f"(SELECT chunk_id, CASE WHEN op = 'modified' THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM {SEEN} WHERE op IS NULL OR op NOT IN ('deleted', 'moved'))"
DIFF = f"""SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN o.chunk_id IS NULL THEN 'added' WHEN n.chunk_id IS NULL THEN 'deleted' WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'unchanged' ELSE 'updated' END AS status
    FROM {OLD} o FULL JOIN {NEW} n ON o.chunk_id = n.chunk_id"""
_LOOKUP = ", ".join(f"('{w}', '{s}')" for w, group in cluster_lookup(CLUSTERS).items() for s in group if s != w)
_EXPANDED = expand_query("flush ledger")
KNN = """SELECT q.vec_id AS query_id, v.vec_id AS id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, v.vec_id) AS INTEGER) AS rank, round(s, 6) AS similarity
    FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings v, LATERAL (SELECT list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s) WHERE q.vec_id <> v.vec_id"""

ORACLES: dict[str, str] = {
    "bm25_topk": top(bm25("documents", "doc_id", "text", parse_query(WORDS)), "doc_id", 20),
    "bm25_phrase": top(bm25("documents", "doc_id", "text", parse_query(PHRASE)), "doc_id", 20),
    "bm25_from_postings": top(bm25("documents", "doc_id", "text", parse_query(PHRASE)), "doc_id", 20),
    "bm25_filtered": top(bm25(CHUNKS, "chunk_id", BLOB, parse_query(CODE)), "chunk_id", 20, f"WHERE id IN (SELECT chunk_id FROM chunks WHERE language = 'python' AND file_path GLOB '*/tests/*')"),
    "postings_terms": f"SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term HAVING count(*) >= 3",
    "substring_channel": f"WITH {substring(NEEDLE)} SELECT id AS chunk_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank FROM named ORDER BY 2 DESC, 1 LIMIT 20",
    "rrf_hybrid": f"WITH {recall(NEEDLE, NEEDLE)} SELECT id AS chunk_id, round(score, 6) AS score FROM fused",
    "graph_boost": f"""WITH {recall(NEEDLE, NEEDLE)}, {PLAIN_EDGES}, {NEXT}, placed AS (SELECT id, score, {module("split_part(id, '::', 1)")} AS module FROM fused),
        best AS (SELECT module FROM placed ORDER BY round(score, 6) DESC, id LIMIT 1)
        SELECT id AS chunk_id, round(score + CASE WHEN module IN (SELECT neighbour FROM near WHERE name IN (SELECT module FROM best)) THEN 0.5::DOUBLE / 61 ELSE 0 END, 6) AS score FROM placed""",
    "rerank_heuristic": f"SELECT chunk_id, {rerank(RERANK_Q)} AS score FROM (SELECT *, 0.0::DOUBLE AS score FROM {CHUNKS})",
    "diversify": f"""WITH {bm25(CHUNKS, "chunk_id", BLOB, parse_query(CODE))}, best AS (SELECT id, round(score, 6) AS score FROM scored),
        n AS (SELECT id, score, row_number() OVER (PARTITION BY split_part(id, '::', 1) ORDER BY score DESC, id) - 1 AS e FROM best) SELECT id AS chunk_id, round(score - 0.15::DOUBLE * e, 6) AS score FROM n""",
    "search_pipeline": f"""WITH {recall(_EXPANDED, _EXPANDED, 40)}, {PLAIN_EDGES}, {NEXT}, placed AS (SELECT id, score, {module("split_part(id, '::', 1)")} AS module FROM fused),
        best AS (SELECT module FROM placed ORDER BY round(score, 6) DESC, id LIMIT 1),
        cut AS (SELECT id AS chunk_id, round_even(score + CASE WHEN module IN (SELECT neighbour FROM near WHERE name IN (SELECT module FROM best)) THEN 0.5::DOUBLE / 61 ELSE 0 END, 6) AS score FROM placed ORDER BY 2 DESC, 1 LIMIT 10),
        ranked AS (SELECT chunk_id, file_path, symbol, {rerank("flush ledger")} AS score FROM cut JOIN {CHUNKS} USING (chunk_id)),
        n AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) - 1 AS e FROM ranked)
        SELECT chunk_id, file_path, symbol, CASE WHEN e > 0 THEN round_even(score - 0.15::DOUBLE * e, 6) ELSE score END AS score FROM n""",
    "camel_split": f"SELECT chunk_id, {camel('symbol')} AS parts FROM {CHUNKS}",
    "identifier_parts": f"SELECT chunk_id, coalesce(array_to_string({identifiers("coalesce(signature, '')")}, ' '), '') AS parts FROM {CHUNKS}",
    "terms_dedup": f"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_concat(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'),
        lambda w: list_prepend(w, string_split({camel('w')}, ' ')))), {pairs("coalesce(text, '')")}), lambda x: lower(x)))), ' '), '') AS terms FROM documents""",
    "cjk_bigrams": f"SELECT doc_id, coalesce(array_to_string({pairs("coalesce(text, '')")}, ' '), '') AS pairs FROM documents",
    "sanitize_phrase": r"SELECT chunk_id, trim(regexp_replace(regexp_replace(coalesce(signature, ''), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM " + CHUNKS,
    "glob_filter": f"SELECT chunk_id FROM {CHUNKS} WHERE file_path GLOB '*tests/**.py'",
    "content_hash": f"SELECT chunk_id, sha256(content) AS digest FROM {CHUNKS}",
    "token_estimate": f"SELECT doc_id, {estimate('text')} AS tokens FROM documents WHERE text IS NOT NULL",
    "language_of": f"""SELECT file_id, CASE regexp_extract(file_path, '(\\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript'
        WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.mts' THEN 'typescript' WHEN '.cts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.java' THEN 'java' END AS language FROM {FILES}""",
    "window_fetch": f"SELECT idx, file_path, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, {CONTENT} AS content FROM {FETCHED.format(b='context_before', a='context_after')}",
    "window_presets": f"SELECT idx, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(length({CONTENT}) AS INTEGER) AS chars FROM {FETCHED.format(b=2, a=2)}",
    "budget_pack": f"WITH RECURSIVE {PACKED} SELECT file_path, CAST(position AS INTEGER) AS position, cost, included, running FROM packed",
    "assembled": f"WITH RECURSIVE {PACKED} SELECT file_path, max(running) AS token_estimate, CAST(count(*) FILTER (included) AS BIGINT) AS n_results, bool_or(NOT included) AS truncated FROM packed GROUP BY file_path",
    "module_naming": f"SELECT file_id, {module('file_path')} AS module FROM {FILES}",
    "graph_nodes": f"WITH {NODES} SELECT name, type, parent, source_path, location FROM nodes",
    "graph_edges": f"WITH {EDGES} SELECT src, dst FROM edges",
    "graph_stats": f"WITH {NODES} SELECT count(*) FILTER (type = 'module') AS total_modules, count(*) FILTER (type IN ('function', 'class')) AS total_symbols, (SELECT count(*) FROM edges) AS total_edges FROM nodes",
    "graph_exports": f"WITH {PUBLIC} SELECT m.name, coalesce(string_agg(symbol, ' ' ORDER BY position), '') AS exports FROM modnames m LEFT JOIN ordered o ON o.name = m.name GROUP BY m.name",
    "neighbors": f"WITH {EDGES}, {NEXT} SELECT name, neighbour FROM near",
    "module_context": f"WITH {PUBLIC}, {NEXT} SELECT near.name, neighbour, CAST(position AS INTEGER) AS position, symbol FROM near JOIN ordered ON ordered.name = neighbour WHERE position < 3",
    "file_symbols": f"SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) AS INTEGER) AS position, chunk_type, symbol FROM {CHUNKS}",
    "project_symbols_top20": f"SELECT file_path, symbol, start_line FROM {CHUNKS} WHERE chunk_type IN ('function', 'class') QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) <= 20",
    "symbols_by_file": f"SELECT file_path, count(*) AS symbols, greatest(count(*) - 20, 0) AS more FROM {CHUNKS} WHERE chunk_type IN ('function', 'class') GROUP BY file_path",
    "file_imports": f"SELECT file_path, coalesce(array_to_string(imports[1:20], ' '), '') AS imports FROM {CHUNKS} WHERE chunk_type = 'module'",
    "index_status": "SELECT count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT file_path) AS n_files FROM chunks",
    "manifest_diff": DIFF,
    "change_counters": f"SELECT status, count(*) AS n FROM ({DIFF}) GROUP BY status",
    "upsert_merge": f"SELECT * FROM {OLD} WHERE chunk_id NOT IN (SELECT chunk_id FROM {NEW}) UNION ALL SELECT * FROM {NEW}",
    "file_diff": f"""WITH i AS (SELECT DISTINCT file_path FROM chunks), c AS (SELECT DISTINCT file_path FROM source_files), m AS (SELECT DISTINCT file_path FROM {FILES} WHERE mtime > TIMESTAMP '2025-06-01')
        SELECT file_path, 'deleted' AS status FROM i WHERE file_path NOT IN (FROM c) UNION ALL SELECT file_path, 'added' FROM c WHERE file_path NOT IN (FROM i) UNION ALL SELECT file_path, 'modified' FROM m WHERE file_path IN (FROM i) AND file_path IN (FROM c)""",
    "mtime_changed": f"SELECT file_id FROM {FILES} WHERE mtime > TIMESTAMP '2025-06-01'",
    "delete_file": f"SELECT chunk_id, file_path FROM {CHUNKS} WHERE file_path NOT IN (SELECT path FROM {EVENTS} WHERE op = 'deleted')",
    "collision_ids": f"SELECT chunk_id AS old, file_path || '::' || symbol || CASE WHEN row_number() OVER (PARTITION BY file_path, symbol ORDER BY start_line, chunk_id) > 1 THEN ':' || start_line ELSE '' END AS new FROM {CHUNKS}",
    "block_islands": f"""WITH e AS (SELECT event_id, path, ts, op IN ('deleted', 'moved') AS c FROM {EVENTS}), s AS (SELECT *, (c OR coalesce(lag(c) OVER w, true))::INT AS s FROM e WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
        b AS (SELECT *, CAST(sum(s) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS block FROM s) SELECT event_id, block, CAST(max(block) OVER (PARTITION BY path) + 1 AS INTEGER) AS blocks FROM b""",
    "synonym_lookup": f"WITH t(word, synonym) AS (VALUES {_LOOKUP}), w AS (SELECT DISTINCT doc_id, unnest({tokens('text')}) AS word FROM documents WHERE length(text) > 0) SELECT word, synonym, count(*) AS n FROM w JOIN t USING (word) GROUP BY ALL",
    "cosine_knn": f"SELECT * FROM ({KNN}) WHERE rank <= 3",
    "cosine_threshold": f"SELECT query_id, id, similarity FROM ({KNN}) WHERE similarity >= 0.3",
    "move_explode": f"""SELECT event_id, path, action FROM (SELECT event_id, path, 'delete' AS action FROM {EVENTS} WHERE op IN ('deleted', 'moved') UNION ALL SELECT event_id, dest_path, 'upsert' FROM {EVENTS} WHERE op = 'moved'
        UNION ALL SELECT event_id, path, 'upsert' FROM {EVENTS} WHERE op NOT IN ('deleted', 'moved')) WHERE path IS NOT NULL AND path <> ''""",
    "debounce_batch": f"SELECT event_id, path, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS f FROM {EVENTS}) WHERE f IS NULL OR f - ts >= INTERVAL 500 MILLISECONDS",
    "latest_event": f"SELECT path, max(ts) AS ts FROM {EVENTS} GROUP BY path",
    "cooldown_batch": f"""WITH RECURSIVE e AS (SELECT path, ts FROM {EVENTS}), fired AS (SELECT path, min(ts) AS ts FROM e GROUP BY path
        UNION ALL SELECT path, ts FROM (SELECT f.path, min(e.ts) AS ts FROM fired f JOIN e ON e.path = f.path AND e.ts >= f.ts + INTERVAL 3600 SECONDS GROUP BY f.path, f.ts)) SELECT DISTINCT path, ts FROM fired""",
    "bm25_stored": "",
    "search_stored": "",
    "symbol_rules": """SELECT chunk_id, coalesce(CASE language WHEN 'go' THEN symbol[1] <> upper(symbol[1]) WHEN 'rust' THEN symbol = '' OR symbol[1] = lower(symbol[1]) WHEN 'java' THEN false ELSE starts_with(symbol, '_') END, false) AS private,
        coalesce(language NOT IN ('go', 'java') AND regexp_matches(signature, '(^|[\\s@])async\\s+(def|function|fn|unsafe|extern|with|for|[\\w$#\\[*])'), false) AS asynchronous FROM """ + CHUNKS,
    "chunk_rows": f"SELECT chunk_id, coalesce(array_to_string(imports, '|'), '') AS imports, nullif(parent_class, '') AS parent_class, nullif(docstring, '') AS docstring FROM {CHUNKS}",
    "graph_node_fields": f"""WITH {NODES}, public AS (SELECT {module("file_path")} AS name, symbol, file_path, start_line FROM {CHUNKS} WHERE chunk_type IN ('function', 'class') AND NOT starts_with(symbol, '_')),
        lines AS (SELECT name, max_by(lines_of_code, source_path) AS lines_of_code FROM mods GROUP BY name), listed AS (SELECT name, string_agg(symbol, ' ' ORDER BY file_path, start_line, symbol) AS exports FROM public GROUP BY name)
        SELECT n.name, n.type, CASE WHEN n.type = 'module' THEN l.lines_of_code END AS lines_of_code, CASE WHEN n.type = 'module' THEN coalesce(e.exports, '') END AS exports, s.signature, CASE WHEN s.name IS NOT NULL THEN starts_with(s.symbol, '_') END AS is_private
        FROM nodes n LEFT JOIN lines l ON l.name = n.name LEFT JOIN listed e ON e.name = n.name LEFT JOIN syms s ON s.name = n.name AND n.type = s.type""",
    # the chunks of SOURCES, by hand
    "chunk_rules": """SELECT * FROM (VALUES ('a/repo.py::<module>', 'module', 'repo', '', 1, 4, 'os .near'), ('a/repo.py::total', 'function', 'total', '', 7, 12, ''), ('a/repo.py::Store', 'class', 'Store', '', 15, 16, ''),
        ('a/repo.py::Store.__init__', 'method', '__init__', 'Store', 18, 19, ''), ('a/repo.py::Store.load', 'method', 'load', 'Store', 21, 22, ''), ('b.go::<module>', 'module', 'b', '', 1, 1, ''), ('b.go::Load', 'function', 'Load', '', 5, 7, ''),
        ('c.js::<module>', 'module', 'c', '', 1, 1, ''), ('c.js::B', 'class', 'B', '', 2, 3, ''), ('c.js::B.y', 'method', 'y', 'B', 4, 4, ''), ('c.js::z', 'function', 'z', '', 6, 6, ''),
        ('D.java::<module>', 'module', 'D', '', 1, 1, ''), ('D.java::A', 'class', 'A', '', 2, 2, ''), ('D.java::A.A', 'method', 'A', 'A', 3, 3, ''), ('D.java::A.b', 'method', 'b', 'A', 4, 4, ''),
        ('e.rs::<module>', 'module', 'e', '', 1, 1, ''), ('e.rs::A', 'class', 'A', '', 3, 3, ''), ('e.rs::c', 'function', 'c', '', 4, 4, ''), ('f.py::f', 'function', 'f', '', 1, 2, ''), ('f.py::f:5', 'function', 'f', '', 5, 6, ''))
        t(chunk_id, chunk_type, symbol, parent_class, start_line, end_line, imports)""",
    # worked out by hand from the rules of the query language and the groups of synonyms
    "query_phrases": """SELECT * FROM (VALUES ('ledger rebuilt cohort missing index', 0, 'ledger'), ('ledger rebuilt cohort missing index', 1, 'rebuilt'), ('ledger rebuilt cohort missing index', 2, 'cohort'), ('ledger rebuilt cohort missing index', 3, 'missing'), ('ledger rebuilt cohort missing index', 4, 'index'),
        ('"search falls back" roster', 0, 'search falls back'), ('"search falls back" roster', 1, 'roster'),
        ('flush ledgerIndex archive', 0, 'flush'), ('flush ledgerIndex archive', 1, 'ledgerindex'), ('flush ledgerIndex archive', 2, 'ledger'), ('flush ledgerIndex archive', 3, 'index'), ('flush ledgerIndex archive', 4, 'archive'),
        ('检索引擎 parseHTTPServer_index', 0, '检索'), ('检索引擎 parseHTTPServer_index', 1, '索引'), ('检索引擎 parseHTTPServer_index', 2, '引擎'), ('检索引擎 parseHTTPServer_index', 3, 'parsehttpserver'), ('检索引擎 parseHTTPServer_index', 4, 'parse'), ('检索引擎 parseHTTPServer_index', 5, 'http'), ('检索引擎 parseHTTPServer_index', 6, 'server'), ('检索引擎 parseHTTPServer_index', 7, 'index')) t(query, position, phrase)""",
    "synonym_expand": """SELECT * FROM (VALUES ('load user file', 'load user file get fetch retrieve obtain read query select account profile document'), ('flush cache', 'flush cache buffer pool memoize'),
        ('parse config error', 'parse config error analyze inspect examine extract setting option preference parameter env exception'), ('unknownword', 'unknownword'), ('find find auth', 'find find auth search locate lookup discover scan authenticate login signin sign_in')) t(query, expanded)""",
    # bursts as runs without a gap of half a second, instead of session windows
    "stream_sessions": f"""WITH e AS (SELECT path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) < INTERVAL 500 MILLISECONDS THEN 0 ELSE 1 END AS starts, event_id FROM {EVENTS}),
        runs AS (SELECT path, ts, sum(starts) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT path, max(ts) AS ts, count(*) AS n FROM runs GROUP BY path, run""",
}
ORACLES["bm25_stored"], ORACLES["search_stored"] = ORACLES["bm25_topk"], ORACLES["search_pipeline"]
