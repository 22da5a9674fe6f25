"""DuckDB SQL of the queries in ``archive``."""

from __future__ import annotations

from noteloom.functions import text as T
from noteloom.operators import views
from noteloom.plans import tables as D
from noteloom.plans.archive import CONCEPTS
from noteloom.plans.knowledge import _EXAMPLES, _GRAPH, _WHOLE_FOLDER
from noteloom.plans.retrieval import TOKENS_SQL, bm25_sql, stem_sql

_N = f"WITH {D.NOTES_SQL}"
_PASS = f"{_N}, {D.PASSPORTS_SQL}"
_HEADED = f"""{_N}, headed AS (SELECT n.doc_id, path, lang, source, text || chr(10) || '#' || lang || '/x [[' || source || '#part|alias]] [[ b ]]' AS body FROM notes n JOIN documents d ON n.doc_id = d.doc_id),
  whole AS (SELECT *, '---' || chr(10) || 'tags: [' || lang || ', ''' || source || ''']' || chr(10) || 'title: "T ' || doc_id || '"' || chr(10) || 'aliases:' || chr(10) || '  - A' || doc_id || chr(10) || '  - ' || lang || chr(10) || 'pinned: true' || chr(10) || '---' || chr(10) || body AS content FROM headed)"""
_PLACED = f"""{_HEADED}, placed AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN '.hidden/' || path WHEN doc_id % 11 = 0 THEN 'a/trash/' || path WHEN doc_id % 7 = 0 THEN regexp_replace(path, 'md$', 'PNG') WHEN doc_id % 17 = 0 THEN regexp_replace(path, 'md$', 'txt') ELSE path END AS file FROM whole),
  kept AS (SELECT * FROM placed WHERE doc_id % 13 <> 0 AND doc_id % 11 <> 0), md AS (SELECT * FROM kept WHERE file LIKE '%.md')"""
_TALK = "talk AS (SELECT 'task' || CAST(u.conv_id % 7 AS VARCHAR) AS task, u.text AS input, a.text AS output, u.conv_id * 1000 + u.turn AS ts FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_LEASES = "leases AS (SELECT path AS note_path, 'd' || CAST(doc_id % 3 AS VARCHAR) AS device_id, doc_id * 10 + 1000 AS expires_at FROM notes WHERE doc_id % 2 = 0)"
_CARDS = f"""{_PASS}, cards AS (SELECT CASE WHEN doc_id % 23 = 0 THEN path || '.txt' ELSE path END AS path, doc_id, char_count AS size, doc_id % 400 AS age, one_line_summary, concepts, domain, difficulty,
  doc_id % 4 AS cue_count, CASE doc_id % 10 WHEN 1 THEN 'permanent' WHEN 2 THEN 'literature' ELSE note_type END AS note_type, 'z' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS zettel_id, doc_id % 3 AS neighbour_count, doc_id % 9 AS graph_node_count FROM passports JOIN notes USING (path))"""
_SHOWN = {
    "dense": ("true", "CAST(size / 6 AS VARCHAR)"), "orphans": ("neighbour_count = 0", "path"), "graph_rich": ("graph_node_count >= 5", "CAST(graph_node_count AS VARCHAR)"),
    "by_domain": ("true", "domain"), "recent": ("true", "CAST(1 + age AS VARCHAR)"), "permanent": ("note_type = 'permanent'", "zettel_id"), "literature": ("note_type = 'literature'", "path"),
    "fleeting": ("note_type = 'fleeting'", "CAST(1 + age AS VARCHAR)"), "cued": ("cue_count > 0", "CAST(cue_count AS VARCHAR)"),
}
_base, _out = stem_sql("t")
_rich = views.VIEWS["graph_rich"]
_VIEW_LINES = ["views:", "  - type: table", "    name: graph_rich", "    filters:", '      - file.ext == "md"', f"      - {_rich.where}", "    order:", *(f"      - {c}" for c in _rich.columns), "    sort:", "      - property: graph_node_count", "        direction: DESC"]
_STATS = "count(*) AS n, CAST(count_if(len(concepts) > 0) AS BIGINT) AS with_concepts, CAST(count_if(one_line_summary <> '') AS BIGINT) AS with_summary, CAST(count_if(note_type = 'fleeting') AS BIGINT) AS fleeting, CAST(count_if(note_type = 'literature') AS BIGINT) AS literature, CAST(count_if(note_type = 'permanent') AS BIGINT) AS permanent"
_STAT_NAMES = ("n", "with_concepts", "with_summary", "fleeting", "literature", "permanent")
_VERSION = "'v' || CAST(doc_id % 3 AS VARCHAR) || '.'"
_GUESS = ", ".join(f"{{'n': len(list_filter(ws, lambda w: list_contains({list(words)}, w))), 'lang': '{lang}'}}" for lang, words in T.LANGUAGE_WORDS.items())

_INDEX_SEARCH = f"""{D.QUERIES_SQL}, t AS (SELECT path, unnest({TOKENS_SQL.format('body')}) AS t, unnest(range(0, len({TOKENS_SQL.format('body')}))) AS pos FROM notes),
      st AS (SELECT path, pos, {_out} AS token FROM (SELECT path, pos, {_base} AS b FROM t)), tf AS (SELECT path, token, count(*) AS tf, min(pos) AS pos FROM st GROUP BY path, token),
      dl AS (SELECT path, sum(tf) AS dl FROM tf GROUP BY path), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT token, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf, stats GROUP BY token, n),
      cut AS (SELECT * FROM tf QUALIFY row_number() OVER (PARTITION BY path ORDER BY tf DESC, pos) <= 200),
      terms AS (SELECT DISTINCT query_id, {_out} AS token FROM (SELECT query_id, {_base} AS b FROM (SELECT query_id, unnest({TOKENS_SQL.format('query')}) AS t FROM queries))),
      s AS (SELECT query_id, path, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, list_sort(list_distinct(list(token))) AS matched FROM terms JOIN cut USING (token) JOIN df USING (token) JOIN dl USING (path), stats GROUP BY query_id, path)
      SELECT query_id, path, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank, array_to_string(matched, ',') AS matched FROM s WHERE score > 0 QUALIFY rank <= 30"""
_WHOLE_SEARCH = _INDEX_SEARCH.replace(" QUALIFY row_number() OVER (PARTITION BY path ORDER BY tf DESC, pos) <= 200", "")
_KEPT_UP = "notes AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CASE WHEN doc_id % 10 = 0 AND doc_id % 21 <> 0 THEN lang || ' ' || CAST(doc_id AS VARCHAR) ELSE text END AS body FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 <> 0 OR doc_id % 21 = 0)"

ORACLES = {
    "watcher_outcomes": """WITH RECURSIVE ev AS (
        SELECT *, row_number() OVER (PARTITION BY root ORDER BY ms, own, path) AS k FROM (SELECT 'r' || CAST(user_id % 30 AS VARCHAR) AS root, 'p' || CAST(event_id % 7 AS VARCHAR) AS path, event_type = 'error' AS own, epoch_us(ts) // 1000 AS ms FROM events)
      ), closing AS (SELECT max(ms) - 3600000 AS w FROM ev),
      run AS (
        SELECT DISTINCT root, CAST(0 AS BIGINT) AS k, []::STRUCT(tm BIGINT, path VARCHAR)[] AS pending, []::STRUCT(tm BIGINT, path VARCHAR)[] AS waiting, []::STRUCT(path VARCHAR, tm BIGINT, outcome VARCHAR)[] AS told FROM ev
        UNION ALL
        SELECT root, CASE WHEN due THEN k ELSE k + 1 END, CASE WHEN len(p) > 3 THEN p[2:] ELSE p END, CASE WHEN len(w) > 3 THEN w[2:] ELSE w END,
          CASE WHEN due AND next.kind = 0 THEN list_concat([{'path': next.path, 'tm': next.tm, 'outcome': 'stable'}], CASE WHEN len(w) > 3 THEN [{'path': w[1].path, 'tm': next.tm, 'outcome': 'let go'}] ELSE [] END)
            WHEN due THEN [{'path': next.path, 'tm': next.tm, 'outcome': 'missed'}]
            WHEN own AND len(waiting) > len(w) THEN [{'path': path, 'tm': ms, 'outcome': 'seen'}]
            WHEN NOT own AND len(p) > 3 THEN [{'path': p[1].path, 'tm': ms, 'outcome': 'evicted'}] ELSE [] END
        FROM (
          SELECT *, CASE WHEN due AND next.kind = 0 THEN list_filter(pending, lambda x: x.path <> next.path) WHEN due OR own THEN pending ELSE list_sort(list_append(list_filter(pending, lambda x: x.path <> path), {'tm': ms, 'path': path})) END AS p,
            CASE WHEN due AND next.kind = 0 THEN list_sort(list_append(list_filter(waiting, lambda x: x.path <> next.path), {'tm': next.tm + 14400000, 'path': next.path})) WHEN due THEN list_filter(waiting, lambda x: x.path <> next.path) WHEN own THEN list_filter(waiting, lambda x: x.path <> path) ELSE waiting END AS w
          FROM (
            SELECT *, coalesce(next.tm <= coalesce(ms, (SELECT w FROM closing)), false) AS due FROM (
              SELECT r.root, r.k, r.pending, r.waiting, e.path, e.own, e.ms,
                list_sort(list_concat(list_transform(r.pending, lambda x: {'tm': x.tm + 18000000, 'kind': 0, 'path': x.path}), list_transform(r.waiting, lambda x: {'tm': x.tm, 'kind': 1, 'path': x.path})))[1] AS next
              FROM run r LEFT JOIN ev e ON e.root = r.root AND e.k = r.k + 1))
          WHERE due OR ms IS NOT NULL)
      )
      SELECT root, t.path AS path, t.tm AS at_ms, t.outcome AS outcome FROM (SELECT root, unnest(told) AS t FROM run)""",
    "lease_expiry": """WITH RECURSIVE req AS (
        SELECT 'n' || CAST(user_id AS VARCHAR) AS note_path, 'd' || CAST(event_id % 3 AS VARCHAR) AS device, event_type = 'error' AS rel, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id % 3) AS k FROM events
      ), run AS (
        SELECT DISTINCT note_path, CAST(0 AS BIGINT) AS k, NULL::VARCHAR AS device, CAST(0 AS BIGINT) AS ms, NULL::VARCHAR AS outcome, NULL::VARCHAR AS holder, CAST(0 AS BIGINT) AS until, NULL::VARCHAR AS over, CAST(0 AS BIGINT) AS over_at FROM req
        UNION ALL
        SELECT note_path, k, device, ms, outcome, CASE outcome WHEN 'released' THEN NULL WHEN 'granted' THEN device ELSE live END, CASE WHEN outcome IN ('granted', 'renewed') THEN ms + 21600000 ELSE until END, CASE WHEN live IS NULL THEN holder END, until
        FROM (SELECT *, CASE WHEN rel THEN CASE WHEN live = device THEN 'released' WHEN live IS NULL THEN 'no lease' ELSE 'not owner' END WHEN live IS NULL THEN 'granted' WHEN live = device THEN 'renewed' ELSE 'refused' END AS outcome
          FROM (SELECT q.note_path, q.k, q.device, q.ms, q.rel, r.holder, r.until, CASE WHEN r.until > q.ms THEN r.holder END AS live FROM run r JOIN req q ON q.note_path = r.note_path AND q.k = r.k + 1))
      )
      SELECT note_path, device AS device_id, ms AS at_ms, outcome, holder FROM run WHERE k > 0
      UNION ALL SELECT note_path, over, over_at, 'expired', NULL FROM run WHERE over IS NOT NULL
      UNION ALL SELECT note_path, holder, until, 'expired', NULL FROM (SELECT *, max(k) OVER (PARTITION BY note_path) AS last FROM run) WHERE k = last AND holder IS NOT NULL AND until < (SELECT max(ms) FROM req) - 3600000""",
    "header_fields": f"{_HEADED} SELECT path, lang || ',' || source AS tags, 'T ' || doc_id AS title, 'A' || doc_id || ',' || lang AS aliases, 'true' AS pinned, CAST(length(regexp_replace(body, '^\\s+', '')) AS INTEGER) AS chars, md5(regexp_replace(body, '^\\s+', '')) AS digest FROM headed",
    "listed_values": f"{_N} SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'a|b|c|' || title ELSE title END AS items FROM notes",
    "note_markup": rf"{_HEADED} SELECT path, array_to_string(list_transform(regexp_extract_all(body, '#[0-9A-Za-z_À-ſ\-]+'), lambda t: t[2:]), ',') AS tags, array_to_string(list_transform(regexp_extract_all(body, '\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]', 1), lambda t: trim(t)), ',') AS links FROM headed",
    "note_ids": f"{_N} SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'given' ELSE strftime(TIMESTAMP '2024-01-02 03:04:05' + to_minutes(CAST(doc_id AS INTEGER)), '%Y%m%d%H%M') END AS zettel_id FROM notes",
    "cue_layouts": rf"{_N} SELECT path, doc_id % 3 < 2 OR regexp_matches(body, '(?i)#{{2,3}}\s*(perguntas[- ]chave|cue|questões|keywords|resumo|summary|síntese)') AS formatted FROM notes",
    "concept_candidates": rf"{_N}, c AS (SELECT path, body || ' The NASA and X9b used DataFrame, HttpServer2 and IDs.' AS t FROM notes), f AS (SELECT path, regexp_extract_all(t, '\b[A-Z]{{2,}}[A-Za-z0-9]*\b') AS a, regexp_extract_all(t, '\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b') AS c FROM c) SELECT path, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS acronyms, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') AS camel FROM f",
    "language_guesses": f"{_N}, w AS (SELECT path, regexp_extract_all(lower(body), '[a-zà-ÿ]+') AS ws FROM notes), c AS (SELECT path, unnest([{_GUESS}]) AS x FROM w), r AS (SELECT path, x.lang AS lang, x.n AS n, sum(x.n) OVER (PARTITION BY path) AS total, CAST(row_number() OVER (PARTITION BY path ORDER BY x.n DESC, x.lang) AS INTEGER) AS rank FROM c WHERE x.n > 0) SELECT path, rank, lang, round(CAST(n AS DOUBLE) / total, 6) AS score FROM r WHERE rank <= 3",
    "byte_figures": f"{_N}, b AS (SELECT path, CAST(strlen(body) AS INTEGER) AS bytes FROM notes) SELECT path, bytes, CAST(round(bytes / 4.0) AS BIGINT) AS tokens, CASE WHEN bytes * 100 >= 1000000 THEN printf('%.1fM', bytes * 100 / 1e6) WHEN bytes * 100 >= 1000 THEN printf('%.1fk', bytes * 100 / 1e3) ELSE CAST(bytes * 100 AS VARCHAR) END AS shown FROM b",
    "versions": f"{_N} SELECT path, {_VERSION} || CAST(doc_id % 12 + 1 AS VARCHAR) AS next, doc_id % 3 > 1 OR (doc_id % 3 = 1 AND doc_id % 12 >= 9) AS enough FROM notes",
    "rolling_hashes": f"{_N} SELECT path, lpad(lower(to_hex(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(path, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295))), 8, '0') AS h FROM notes",
    "vault_files": f"{_PLACED} SELECT file AS path, lower(regexp_extract(file, '\\.([^.]*)$', 1)) AS ext, CAST(strlen(content) AS BIGINT) AS size FROM kept WHERE file NOT LIKE '%.txt'",
    "vault_notes": f"{_PLACED} SELECT file AS path, CAST(doc_id AS VARCHAR) AS title, CAST(least(3000, length(regexp_replace(body, '^\\s+', ''))) AS INTEGER) AS body_chars, md5(content) AS digest, sha256(content) AS sha FROM md WHERE strlen(content) <= 20000",
    "vault_content": f"{_PLACED} SELECT file AS path, md5(substring(content, 1, 500)) AS digest, CAST(length(content) AS INTEGER) AS full_chars, length(content) > 500 AS truncated, 'A' || doc_id || ',' || lang AS aliases FROM md WHERE file LIKE '%2.md' AND strlen(content) <= 200000",
    "valid_results": f"{_N} SELECT CASE doc_id % 4 WHEN 0 THEN '/' || path WHEN 1 THEN 'a/../' || path WHEN 2 THEN path || '.txt' ELSE path END AS path, doc_id % 4 = 3 AS valid FROM notes",
    "modal_readings": f"""{_N}, f AS (SELECT doc_id, body, CASE WHEN doc_id % 3 = 0 THEN 'png' WHEN doc_id % 5 = 0 THEN 'pdf' WHEN doc_id % 7 = 0 THEN 'm4a' ELSE 'md' END AS ext, path FROM notes),
      r AS (SELECT *, regexp_replace(path, 'md$', ext) AS file, doc_id % 9 = 0 AND ext IN ('png', 'pdf') AS known, ext <> 'md' AND doc_id % 2 = 0 AS seen, substring(body, 1, 40) AS ocr FROM f)
      SELECT file AS path, CASE ext WHEN 'md' THEN 'text' WHEN 'png' THEN 'image' WHEN 'pdf' THEN 'pdf' ELSE 'audio' END AS modality,
        md5(CASE WHEN known THEN 'known text' WHEN ext = 'md' THEN body WHEN NOT seen THEN NULL WHEN ext <> 'png' THEN ocr ELSE concat_ws(chr(10), regexp_extract(file, '[^/]*$'), CASE WHEN trim(ocr) <> '' THEN ocr END, 'labels: l' || CAST(doc_id % 4 AS VARCHAR), CASE WHEN doc_id % 3 > 0 THEN 'faces: ' || CAST(doc_id % 3 AS VARCHAR) END) END) AS digest, NOT known AS fresh FROM r""",
    "file_metadata": f"{_N} SELECT path, 'Image ' || CAST(doc_id AS VARCHAR) AS kind, CAST(doc_id * 10 AS VARCHAR) AS pixels, CAST(NULL AS VARCHAR) AS missing FROM notes",
    "stored_lines": "SELECT c_custkey AS key, CAST(c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS balance FROM customer WHERE c_custkey % 97 <> 0",
    "manifest_merge": f"{_N} SELECT path, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM notes WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0",
    "keyword_store": f"{_N} SELECT path, split_part(path, '/', 1) AS domain, CAST(CASE WHEN path LIKE 'src1/%' THEN 2 ELSE 1 END AS INTEGER) AS version FROM notes WHERE path NOT LIKE 'src2/%' AND (path NOT LIKE 'src1/%' OR path LIKE '%1.md')",
    "capture_log": f"WITH {_TALK}, p AS (SELECT task, ts, CASE WHEN ts % 2 = 0 THEN 'teacher' ELSE 'other' END AS provider FROM talk) SELECT task, provider, CAST(count(*) * CASE provider WHEN 'teacher' THEN 2 ELSE 1 END AS BIGINT) AS n, CAST(sum(ts) * CASE provider WHEN 'teacher' THEN 2 ELSE 1 END AS BIGINT) AS ts FROM p GROUP BY task, provider",
    "example_packs": f"WITH {_TALK} SELECT task, 'teacher' AS captured_from, md5(input) AS input, md5(output) AS output FROM talk WHERE input <> '' AND output <> ''",
    "queue_folder": "SELECT CAST(s_suppkey AS VARCHAR) || '.json' AS name, CAST(length(CAST(s_suppkey AS VARCHAR)) + 7 AS BIGINT) AS size FROM supplier WHERE s_suppkey % 10 <> 0",
    "vector_index": "SELECT vec_id AS path, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS sha, CAST(64 AS INTEGER) AS dims FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 3 = 0",
    "view_rows": f"{_CARDS} " + " UNION ALL ".join(f"SELECT '{name}' AS view, path, {shown} AS sorted_by FROM cards WHERE doc_id % 23 <> 0 AND {where}" for name, (where, shown) in _SHOWN.items()),
    "dense_view": f"{_CARDS} SELECT path, one_line_summary AS summary, domain, CAST(difficulty AS INTEGER) AS difficulty, note_type, CAST(neighbour_count AS INTEGER) AS neighbour_count, CAST(graph_node_count AS INTEGER) AS graph_node_count, round(size / 6, 6) AS density, CAST(1 + age AS INTEGER) AS freshness_days FROM cards WHERE doc_id % 23 <> 0",
    "view_groups": f"""{_CARDS}, k AS (SELECT domain AS "group", path, concat_ws('|', path, one_line_summary, array_to_string(concepts, ','), CAST(difficulty AS VARCHAR)) AS line, row_number() OVER (PARTITION BY domain ORDER BY path) AS r FROM cards WHERE doc_id % 23 <> 0)
      SELECT "group", count(*) AS n, md5(string_agg(line, chr(10) ORDER BY path) FILTER (r <= 20)) AS digest FROM k GROUP BY ALL""",
    "view_headers": f"{_CARDS}, s AS (SELECT {_STATS} FROM cards), h AS (" + " UNION ALL ".join(f"SELECT {i} AS n, '# {name}: ' || CAST({name} AS VARCHAR) AS line FROM s" for i, name in enumerate(_STAT_NAMES)) + ") SELECT CAST(n AS INTEGER) AS n, line FROM h UNION ALL " + " UNION ALL ".join(f"SELECT {len(_STAT_NAMES) + i}, '{line}'" for i, line in enumerate(_VIEW_LINES)),
    "view_stats": f"{_PASS} SELECT {_STATS} FROM passports",
    "type_histogram": f"{_CARDS} SELECT coalesce(note_type, 'none') AS note_type, count(*) AS n FROM cards GROUP BY 1",
    "domain_list": "SELECT DISTINCT source AS domain FROM documents",
    "bm25_lane": f"WITH {D.NOTES_SQL.replace('notes AS', 'allnotes AS')}, {D.QUERIES_SQL}, notes AS (SELECT path, substring(body, 1, 30000) AS body FROM allnotes ORDER BY path LIMIT 2000), {bm25_sql('r')} SELECT query_id, path, score, rank FROM r",
    "lexical_index_search": f"{_N}, {_WHOLE_SEARCH}",
    "lexical_index_stream": f"WITH {_KEPT_UP}, {_INDEX_SEARCH}",
    "passport_concepts": f"{_PASS} SELECT path FROM passports WHERE len(list_intersect(list_transform(concepts, lambda c: lower(c)), {[c.lower() for c in CONCEPTS]})) > 0",
    "keyword_average": f"""{_PASS}, k AS (SELECT list_append(concepts, domain) AS bag FROM passports), l AS (SELECT bag, list_transform(bag, lambda x: lower(x)) AS low FROM k)
      SELECT count(*) AS items, round(avg(least(25, len(list_filter(bag, lambda x, i: list_position(low, lower(x)) = i AND length(x) >= 2)))), 1) AS average FROM l""",
    "neighbours_of_type": f"WITH {_WHOLE_FOLDER}, s AS (SELECT src, dst, weight, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INTEGER) AS rank, 'folder_path:0.3:' || why AS edges FROM fe) SELECT src, dst, weight, rank, edges FROM s WHERE rank <= 5",
    "block_changes": f"{_N} SELECT path, CASE WHEN doc_id % 3 <> 0 THEN title END AS block, 'change' AS what FROM notes WHERE CASE WHEN doc_id % 3 <> 0 THEN doc_id % 4 = 0 OR doc_id % 5 = 0 ELSE doc_id % 4 <> 0 END UNION ALL SELECT path, NULL, 'clear' FROM notes WHERE doc_id % 4 <> 0",
    "label_edges": f"""{_N}, e AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '1' END AS src, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE CAST(length(body) AS VARCHAR) END AS dst, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE 't' END AS kind FROM notes)
      SELECT e.path, src, dst, kind, n.path AS note FROM e JOIN notes n ON CAST(n.doc_id AS VARCHAR) = e.src""",
    "community_changes": "SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS path, CAST(o_custkey % 20 AS INTEGER) AS community_id, CAST(0.5 AS DOUBLE) AS modularity FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0",
    "done_tasks": f"{_N} SELECT path, doc_id % 2 = 0 AND doc_id % 6 <> 0 AS done FROM notes",
    "lease_stats": f"{_N}, {_LEASES} SELECT device_id, count(*) AS total, CAST(count_if(expires_at < 2000) AS BIGINT) AS expired FROM leases GROUP BY device_id",
    "sweep_stats": f"{_N}, {_LEASES}, s AS (SELECT n.doc_id, device_id IS NULL OR device_id = 'd1' OR expires_at <= 2000 AS granted FROM notes n LEFT JOIN leases ON note_path = path WHERE doc_id % 5 <> 0) SELECT CAST(count_if(granted) AS BIGINT) AS claimed, CAST(count_if(NOT granted) AS BIGINT) AS skipped, CAST(count_if(granted AND doc_id % 7 <> 0) AS BIGINT) AS extracted, CAST(count_if(granted AND doc_id % 7 = 0) AS BIGINT) AS errors FROM s",
    "renamed_events": "WITH e AS (SELECT CASE event_type WHEN 'signup' THEN 'create' ELSE 'modify' END AS kind, CAST(user_id AS VARCHAR) AS path FROM events UNION ALL SELECT 'delete', 'old' || CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'signup') SELECT kind, path, count(*) AS n FROM e GROUP BY kind, path",
    "threshold_triggers": "SELECT CAST(user_id AS VARCHAR) AS key, CAST(unnest(range(1, count(*) // 10 + 1)) AS BIGINT) AS trigger FROM events GROUP BY user_id",
    "last_runs": "SELECT event_type AS key, CAST(round((100000000 - max(event_id) * 1000) / 1000) AS BIGINT) AS ago_s, CAST(arg_max(user_id, event_id) % 500 AS BIGINT) AS took_ms, CASE WHEN arg_max(user_id, event_id) % 4 = 0 THEN 'failed' END AS error FROM events GROUP BY event_type",
    "missed_paths": "SELECT CAST(event_id AS VARCHAR) AS path, CAST(ts AS VARCHAR) AS ts FROM (SELECT event_id, events.ts AS ts FROM events WHERE event_type <> 'error' ORDER BY events.ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 10)",
    "embedded_notes": f"""{_N}, tok AS (SELECT path, {TOKENS_SQL.format('substring(title || chr(10) || body, 1, 4000)')} AS ts FROM notes),
      slot AS (SELECT path, CAST('0x' || substring(md5(t), 1, 8) AS BIGINT) % 64 AS i, count(*) AS n FROM (SELECT path, unnest(ts) AS t FROM tok) GROUP BY ALL),
      filled AS (SELECT tok.path, r.i, coalesce(n, 0) AS n FROM tok CROSS JOIN range(64) r(i) LEFT JOIN slot ON slot.path = tok.path AND slot.i = r.i)
      SELECT path, CAST(64 AS INTEGER) AS dims, CASE WHEN sum(n) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm, string_agg(CAST(i AS VARCHAR), ',' ORDER BY n DESC, i) AS slots FROM filled GROUP BY path""",
    "embedded_parts": f"{_N} SELECT path, CAST(CASE WHEN doc_id % 4 <> 0 THEN 64 ELSE -1 END AS INTEGER) AS title, CAST(CASE WHEN trim(body) <> '' THEN 64 ELSE -1 END AS INTEGER) AS body, CAST(CASE WHEN doc_id % 3 = 0 THEN 64 ELSE -1 END AS INTEGER) AS summary FROM notes",
    "expanded_queries": f"WITH {D.QUERIES_SQL} SELECT query_id, query, CASE WHEN query_id = 1 THEN 'known answer' WHEN length(query) > 14 THEN 'about ' || query ELSE query END AS text, query_id <> 1 AS fresh FROM queries",
    "classified_notes": f"{_N} SELECT path, CASE WHEN length(body) > 2000 THEN 'Long' WHEN length(body) < 500 THEN 'short' END AS label FROM notes",
    "prompted_notes": f"{_N}, d AS (SELECT path, length(body) AS n, CASE WHEN (length(body) + 12) % 3 = 0 THEN NULL ELSE 's' || CAST(length(body) + 12 AS VARCHAR) END AS draft FROM notes) SELECT path, CASE WHEN n % 2 = 0 AND draft IS NOT NULL THEN draft || '+' ELSE draft END AS answer FROM d",
    "parsed_answers": f"{_N} SELECT path, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'a' || CAST(doc_id AS VARCHAR) END AS links, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_tags FROM notes",
    "sentiments": "WITH p AS (SELECT CAST(user_id AS VARCHAR) AS path, round(avg((event_id % 21 - 10) / 10.0::DOUBLE), 6) AS score FROM events GROUP BY 1) SELECT path, score, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM p",
    "annotated_notes": f"{_N}, a AS (SELECT path, doc_id, doc_id % 2 = 0 AND doc_id % 10 <> 0 AS known, (doc_id % 5 - 2) / 4.0::DOUBLE AS s FROM notes) SELECT path, CASE WHEN known THEN 'xx' END AS language, CASE WHEN known THEN s END AS sentiment, CASE WHEN known THEN CASE WHEN s > 0.2 THEN 'positive' WHEN s < -0.2 THEN 'negative' ELSE 'neutral' END END AS sentiment_label FROM a",
    "transcripts": f"{_N} SELECT path, CAST((doc_id % 8) / 2.0 AS DOUBLE) AS seconds, CASE WHEN doc_id % 3 = 0 THEN 'said ' || CAST(doc_id AS VARCHAR) END AS text FROM notes WHERE doc_id % 8 >= 6",
    "routed_profiles": f"{_N} SELECT path, CASE WHEN doc_id % 6 = 3 THEN 'model' ELSE 'rule' END AS summary, CASE WHEN doc_id % 6 = 3 THEN 'model' ELSE 'local' END AS source FROM notes",
    "rendered_prompts": f"WITH {_EXAMPLES}, b AS (SELECT * FROM ring WHERE quality >= 0.7 QUALIFY row_number() OVER (PARTITION BY task ORDER BY quality DESC, ts DESC, key) <= 3) SELECT task, md5(string_agg('User: ' || input || chr(10) || 'Assistant: ' || output, chr(10) || chr(10) ORDER BY quality DESC, ts DESC, key)) AS digest FROM b GROUP BY task",
    "training_lines": f"WITH {_TALK}, l AS (SELECT * FROM talk WHERE ts > 5000) SELECT md5(input) AS input, md5(output) AS output, (SELECT count(*) >= 1000 OR date_diff('day', to_timestamp(5000)::TIMESTAMP, to_timestamp(max(ts))::TIMESTAMP) >= 7 FROM l) AS ready FROM l",
}
