"""SQL twins of the queries, in DuckDB's dialect. Written apart from the operators: other joins, other orders of work."""

W = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
CRIT = r"[Ø⌀∅Φφ±°×÷≤≥μµ²³′″−+\-.]"
CHANGE = r"[0-9Ø⌀∅Φφ±+\-−.,×x°²³⁰¹⁴⁵⁶⁷⁸⁹⁺⁻]"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"

# ------------------------------------------------------------ routing
METRICS = f"""
lines AS (SELECT doc_id, length(regexp_replace(unnest(string_split(text, chr(10))), '{W}', '', 'g')) AS ink FROM documents),
m AS (SELECT doc_id, count(*) AS p, count(*) FILTER (ink >= 40) AS t, CAST(sum(ink) AS BIGINT) AS c FROM lines GROUP BY 1)"""


def routed(reason: str, extra: str = "") -> str:
    return f"""WITH {METRICS}, {extra}
r AS (SELECT doc_id, {reason} AS reason, p, t, c FROM m JOIN documents USING (doc_id)),
s AS (SELECT doc_id, CASE WHEN reason IN ('forced_direct', 'text_pdf') THEN 'direct' ELSE 'ocr' END AS mode, reason,
  CASE WHEN reason IN ('not_docx', 'text_pdf', 'low_text_density') THEN p ELSE 0 END AS page_count,
  CASE WHEN reason IN ('not_docx', 'text_pdf', 'low_text_density') THEN t ELSE 0 END AS text_pages,
  CASE WHEN reason IN ('not_docx', 'text_pdf', 'low_text_density') THEN c ELSE 0 END AS total_text_chars FROM r),
e AS (SELECT *, CASE WHEN mode = 'ocr' AND reason <> 'not_pdf' THEN greatest(page_count - text_pages, 0) ELSE 0 END AS n FROM s)
SELECT doc_id, mode, reason, page_count, text_pages, total_text_chars, n AS estimated_ocr_pages, n > 0 AS is_scanned_pdf,
  CASE WHEN n = 0 THEN 'none' WHEN n >= 20 THEN 'very_long' WHEN n >= 6 THEN 'long' ELSE 'normal' END AS estimated_time_level,
  n <= 5 AS sync_recommended, 5::BIGINT AS max_sync_pages, 6::BIGINT AS warn_pages, 20::BIGINT AS long_task_pages,
  concat_ws(',', CASE WHEN n >= 6 THEN 'scan_pdf_long_task' END, CASE WHEN n >= 20 THEN 'scan_pdf_very_long_task' END, CASE WHEN n > 5 THEN 'sync_not_recommended' END) AS warnings
FROM e"""


DENSE = "CASE WHEN t / p >= 0.6 AND c / p >= 40 THEN 'text_pdf' ELSE 'low_text_density' END"
GUARDS = f"CASE WHEN doc_id % 5 = 0 THEN 'not_pdf' WHEN doc_id % 11 = 0 THEN 'not_docx' WHEN doc_id % 7 IN (1, 5) THEN 'forced_direct' WHEN doc_id % 7 IN (2, 6) THEN 'forced_ocr' ELSE {DENSE} END"

# ------------------------------------------------------------ regions
REGIONS = """regions AS (SELECT source AS scene, lang AS kind, doc_id AS id, quality = 1 AS exact, toxic = 1 AS needs_review, doc_id % 7 <> 0 AS found,
  n_chars % 13 AS edits, n_chars % 97 AS chars, doc_id % 3 AS errors, doc_id % 5 AS crit FROM documents JOIN labels USING (doc_id))"""
AGGREGATE = """count(*) AS regions, CAST(sum(edits) AS DOUBLE) / nullif(sum(chars), 0) AS cer,
  count(*) FILTER (exact AND NOT needs_review) / CAST(count(*) AS DOUBLE) AS annotation_accuracy,
  CASE WHEN sum(crit) > 0 THEN greatest(0.0, 1 - CAST(sum(CASE WHEN needs_review THEN greatest(errors, crit) ELSE errors END) AS DOUBLE) / sum(crit)) END AS critical_character_accuracy,
  count(*) FILTER (exact) / CAST(count(*) AS DOUBLE) AS raw_annotation_accuracy,
  CASE WHEN sum(crit) > 0 THEN greatest(0.0, 1 - CAST(sum(errors) AS DOUBLE) / sum(crit)) END AS raw_critical_character_accuracy,
  count(*) FILTER (NOT found) / CAST(count(*) AS DOUBLE) AS miss_rate, count(*) FILTER (needs_review) / CAST(count(*) AS DOUBLE) AS review_rate,
  CAST(sum(chars) AS BIGINT) AS reference_characters, CAST(sum(crit) AS BIGINT) AS critical_characters"""

# ------------------------------------------------------------ edits
PAIRS = """pairs AS (SELECT * FROM (SELECT conv_id, turn, text AS reference,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prediction FROM conversations) WHERE prediction IS NOT NULL)"""

# ------------------------------------------------------------ tables
CELLS = """cells{n} AS (SELECT l_orderkey AS table_id, l_linenumber AS pos, (l_linenumber - 1) // 2 AS row_, (l_linenumber - 1) % 2 AS col_,
  CASE WHEN l_partkey % 9 = {n} THEN 2 ELSE 1 END AS cs, trim(concat_ws(' ', l_returnflag, CASE WHEN l_suppkey % 7 = {n} THEN 'x' END, l_linestatus)) AS text FROM {src})"""
IN_ORDER = """in_order AS (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS l_linenumber) FROM lineitem)"""
TABLE_SCORE = f"""WITH {IN_ORDER}, {CELLS.format(n=0, src='in_order')}, {CELLS.format(n=1, src='in_order')}, p AS (SELECT * REPLACE (CASE WHEN pos = 3 THEN row_ + 500 ELSE row_ END AS row_) FROM cells1),
j AS (SELECT t.table_id, t.cs, t.text AS expected, coalesce(p.text, '') AS got, p.cs AS pcs FROM cells0 t LEFT JOIN p ON t.table_id = p.table_id AND t.row_ = p.row_ AND t.col_ = p.col_),
a AS (SELECT table_id, count(*) FILTER (expected = got) AS cell_exact, count(*) AS cell_total, CAST(sum(length(expected)) AS BIGINT) AS reference_characters,
  CAST(sum(levenshtein(expected, got)) AS BIGINT) AS character_edits, count(*) FILTER (cs = pcs) AS matching_cell_spans FROM j GROUP BY 1),
m AS (SELECT coalesce(t.table_id, p.table_id) AS table_id, count(*) FILTER (t.pos IS NOT NULL AND p.pos IS NOT NULL) AS tp, count(*) FILTER (t.pos IS NULL) AS fp, count(*) FILTER (p.pos IS NULL) AS fn
  FROM (SELECT * FROM cells0 WHERE cs > 1) t FULL JOIN (SELECT * FROM p WHERE cs > 1) p ON t.table_id = p.table_id AND t.pos = p.pos AND t.row_ = p.row_ GROUP BY 1),
n AS (SELECT table_id, count(*) AS k FROM p GROUP BY 1)
SELECT table_id, cell_exact, cell_total, reference_characters, character_edits, character_edits / CAST(reference_characters AS DOUBLE) AS cer, matching_cell_spans,
  coalesce(k, 0) AS predicted_cells, coalesce(tp, 0) AS true_positive, coalesce(fp, 0) AS false_positive, coalesce(fn, 0) AS false_negative
FROM a LEFT JOIN m USING (table_id) LEFT JOIN n USING (table_id)"""
TABLE_VALIDATE = f"""WITH {CELLS.format(n=0, src='lineitem')},
w AS (SELECT table_id, count(*) > count(DISTINCT pos) AS twins FROM cells0 GROUP BY 1),
o AS (SELECT a.table_id, bool_or(a.col_ + a.cs > 2) AS outside, bool_or(b.pos IS NOT NULL) AS overlap FROM cells0 a
  LEFT JOIN cells0 b ON a.table_id = b.table_id AND a.row_ = b.row_ AND a.pos < b.pos AND a.col_ + a.cs > b.col_ AND b.col_ + b.cs <= 2 AND a.col_ + a.cs <= 2 GROUP BY 1)
SELECT table_id, CASE WHEN outside THEN 'cell span outside table' WHEN twins THEN 'duplicate cell anchor' WHEN overlap THEN 'overlapping cell spans' END AS error FROM o JOIN w USING (table_id)"""
BOXES = """boxes AS (SELECT vec_id, [x, y, x + abs(CAST(embedding[3] AS DOUBLE) + 1) * 0 + abs((CAST(embedding[3] AS DOUBLE) + 1) * 400) / 2, y + abs((CAST(embedding[4] AS DOUBLE) + 1) * 400) / 2 - 40] AS b
  FROM (SELECT *, (CAST(embedding[1] AS DOUBLE) + 1) * 400 AS x, (CAST(embedding[2] AS DOUBLE) + 1) * 400 AS y FROM embeddings))"""
BOX_OK = "b[1] >= 0 AND b[1] < b[3] AND b[3] <= {w} AND b[2] >= 0 AND b[2] < b[4] AND b[4] <= {h}"
GEOMETRY = """WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS pos, (l_linenumber - 1) * 100.0 AS top,
  l_linenumber * 100.0 - CASE WHEN l_partkey % 11 = 0 THEN 30.0 WHEN l_partkey % 7 = 0 THEN 1.0 ELSE 0.0 END AS bottom FROM lineitem),
t AS (SELECT table_id, max(pos) AS n, count(*) AS k, count(DISTINCT pos) AS places FROM c GROUP BY 1),
e AS (SELECT c.table_id, bool_or(abs(d.top - c.bottom) > n * 100.0 * 0.02) AS off FROM c JOIN t USING (table_id) LEFT JOIN c d ON c.table_id = d.table_id AND d.pos = c.pos + 1 GROUP BY 1)
SELECT table_id, NOT coalesce(off, false) AND n = k AND n = places AS topology_valid FROM t JOIN e USING (table_id)"""

# ------------------------------------------------------------ policy
PRIORITY = """CASE WHEN event_id % 64 // 8 % 2 = 1 THEN 0 WHEN event_id % 64 // 4 % 2 = 1 OR event_id % 4 = 3 THEN 1 WHEN event_id % 64 // 16 % 2 = 1 THEN 2 END"""
OUTPUTS = """o AS (SELECT conv_id, turn, (turn + conv_id) AS k, text AS t FROM conversations),
u AS (SELECT *, CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN 'Here is it' WHEN 2 THEN '```' || t WHEN 3 THEN '{' || t || '}' WHEN 4 THEN '}{' || t ELSE t END AS text FROM o)"""
VERDICT = """CASE WHEN k % 13 = 0 THEN 'timeout' WHEN k % 17 = 0 THEN 'invalid_response' WHEN k % 19 = 0 OR k % 23 = 0 THEN 'truncated' WHEN trim(text) = '' THEN 'empty_output'
  WHEN k % 9 IN (1, 2) THEN 'nonliteral_output' WHEN k % 2 = 1 AND contains(trim(text, chr(10) || ' '), chr(10)) THEN 'multiple_annotation_output'
  WHEN k % 2 = 0 AND (k % 9 = 4 OR length(replace(text, '{', '')) <> length(replace(text, '}', ''))) THEN 'invalid_formula_structure' ELSE 'ok' END"""

# ------------------------------------------------------------ evidence
SEEN = """seen AS (SELECT conv_id * 3 % 10 AS report_id, CAST(turn AS INT) AS pos, conv_id * 3 AS region_id,
  CASE WHEN turn % 3 = 0 THEN '+' ELSE '' END || CAST(conv_id % 50 + turn // 2 AS VARCHAR) AS text, CASE WHEN turn % 5 = 4 THEN 'timeout' ELSE 'ok' END AS status FROM conversations),
regions AS (SELECT doc_id % 10 AS report_id, doc_id AS region_id, doc_id % 4 = 0 AS needs_review FROM documents),
had AS (SELECT doc_id % 10 AS report_id, doc_id AS region_id, CAST(doc_id % 90 AS VARCHAR) || '.5' AS text FROM documents WHERE doc_id % 3 = 0),
new AS (SELECT region_id, text, status, min(s.pos) AS pos FROM seen s JOIN regions r USING (region_id) GROUP BY 1, 2, 3),
cand AS (SELECT region_id, text, 'ok' AS status, 'ocr' AS source, 0 AS late, 0 AS pos FROM had UNION ALL SELECT region_id, text, status, 'vlm', 1, pos FROM new),
ranked AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY late, pos) - 1 AS n FROM cand)"""
STATE = "needs_review OR region_id IN (SELECT region_id FROM new) AS needs_review, CASE WHEN region_id IN (SELECT region_id FROM new) THEN 'vlm_candidate_requires_review' ELSE 'open' END AS resolution"
COMPOSE = f"""WITH {SEEN},
options AS (SELECT region_id, text, 0 AS late, n FROM ranked WHERE status = 'ok' UNION ALL SELECT region_id, CAST(region_id % 7 AS VARCHAR) || '.0', 1, 0 FROM regions UNION ALL SELECT region_id, '1', 1, 1 FROM regions),
once AS (SELECT region_id, text, min(late * 1000 + n) AS o FROM options GROUP BY 1, 2),
opt AS (SELECT region_id, text, row_number() OVER (PARTITION BY region_id ORDER BY o) AS i FROM once),
parts AS (SELECT region_id // 3 AS group_id, region_id % 3 AS part, region_id, i, text FROM opt),
combos AS (SELECT a.group_id, concat_ws(' ', a.text, b.text, c.text) AS t, row_number() OVER (PARTITION BY a.group_id ORDER BY a.i, b.i NULLS FIRST, c.i NULLS FIRST) AS k
  FROM (SELECT * FROM parts WHERE part = 0) a LEFT JOIN (SELECT * FROM parts WHERE part = 1) b ON a.group_id = b.group_id LEFT JOIN (SELECT * FROM parts WHERE part = 2) c ON a.group_id = c.group_id),
made AS (SELECT group_id, string_agg(t, ';' ORDER BY k) AS reviewed_candidates FROM combos WHERE k <= 8 GROUP BY 1),
miss AS (SELECT region_id // 3 AS group_id, string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY region_id) AS u FROM regions WHERE region_id NOT IN (SELECT region_id FROM ranked WHERE status = 'ok') GROUP BY 1)
SELECT group_id, reviewed_candidates, coalesce(u, '') AS unreviewed, CASE WHEN u IS NULL THEN 'candidates_available' ELSE 'partial' END AS review_status FROM made LEFT JOIN miss USING (group_id)"""

# ------------------------------------------------------------ literals
TOKENS = """d AS (SELECT doc_id, text AS t, doc_id % 20 AS n FROM documents),
k AS (SELECT *, '__LITERAL_0_' || upper(substr(sha256(substr(t, 4, 4)), 1, 12)) || '__' AS t0, '__LITERAL_1_' || upper(substr(sha256(substr(t, 11, CAST(n AS INT))), 1, 12)) || '__' AS t1,
  n > 0 AND 10 + n <= length(t) AND length(t) >= 7 AS good FROM d)"""

# ------------------------------------------------------------ integrity
FILES = """actual AS (SELECT doc_id, source || '/' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha FROM documents),
listed AS (SELECT path, CASE WHEN doc_id % 9 = 1 THEN bytes + 1 ELSE bytes END AS bytes, CASE WHEN doc_id % 10 = 1 THEN upper(sha) ELSE sha END AS sha FROM actual WHERE doc_id % 4 <> 0
  UNION ALL SELECT 'gone/' || doc_id, 1, sha FROM actual WHERE doc_id % 50 = 0)"""
UNIT = "(CAST(length(regexp_replace({t}, '[^\\s]', '', 'g')) AS DOUBLE) * 0.28 + length(regexp_replace({t}, '[^A-Za-z0-9]', '', 'g')) * {l} + length(regexp_replace({t}, '[A-Za-z0-9\\s]', '', 'g')) * greatest(0.42, {l} * 0.8))"
FIT_TEXT = "concat_ws(' ', p_name, p_brand, p_type)"
FIT = f"""WITH b AS (SELECT p_partkey AS id, {FIT_TEXT} AS text, greatest(4.0, p_size * 6 - 0.5) AS w, CAST(10 + p_partkey % 40 AS DOUBLE) AS h, CAST(8 + p_partkey % 5 AS DOUBLE) AS size,
  {UNIT.format(t=FIT_TEXT, l="CAST(0.52 AS DOUBLE)")} * CAST(1.04 AS DOUBLE) AS unit FROM part),
g AS (SELECT id, text, w, size, s.i * 1000 + t.i * 100 + x.i AS o, size - s.v AS f, t.v AS tr, x.v AS sc, (unit * (size - s.v) + (length(text) - 1) * t.v) * x.v AS need
  FROM b, (VALUES (0, 0.0::DOUBLE), (1, 0.25), (2, 0.5)) s(i, v), (VALUES (0, 0.0::DOUBLE), (1, -0.1), (2, -0.2), (3, -0.25)) t(i, v), (SELECT k AS i, (100 - 2 * k) / 100.0::DOUBLE AS v FROM range(15) r(k)) x
  WHERE (size - s.v) * CAST(1.15 AS DOUBLE) <= h + 0.01),
f AS (SELECT id, arg_min({{'f': f, 'sc': sc, 'tr': tr, 'need': need}}, o) AS p FROM g WHERE need <= w + 1.25 GROUP BY 1),
z AS (SELECT id, arg_max(need, o) AS need FROM g GROUP BY 1)
SELECT b.id, text, coalesce(p.f, greatest(3.0, size - 0.5)) AS font_size, coalesce(p.sc, 0.72) AS width_scale, coalesce(p.tr, -0.25) AS tracking_pt, 1::BIGINT AS line_count,
  CASE WHEN p IS NOT NULL THEN p.need ELSE coalesce(z.need, 0.0) END AS required_width_pt, p IS NOT NULL AS fits FROM b LEFT JOIN f ON b.id = f.id LEFT JOIN z ON b.id = z.id"""
FRAGMENTS = """e AS (SELECT vec_id // 3 AS d, vec_id % 3 AS pos, vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS j FROM embeddings),
f AS (SELECT d, pos, vec_id, CASE WHEN vec_id % 13 = 7 THEN 90.0 ELSE 0.0 END AS angle,
  CASE pos WHEN 0 THEN 100.0 WHEN 1 THEN 205 + j ELSE 206 - j END AS x1, CASE pos WHEN 0 THEN 100.0 WHEN 1 THEN 93.0 ELSE 127 + j END AS y1,
  CASE pos WHEN 0 THEN 200.0 WHEN 1 THEN 255.0 ELSE 256.0 END AS x2, CASE pos WHEN 0 THEN 150.0 WHEN 1 THEN 115 + j ELSE 150.0 END AS y2,
  NOT (pos = 2 AND d % 8 = 0) AS numeric_ FROM e),
h AS (SELECT *, CASE WHEN d % 5 <> 0 THEN NULL WHEN (x1 + x2) / 2 BETWEEN 90 AND 202 AND (y1 + y2) / 2 BETWEEN 80 AND 160 THEN 0 ELSE 1 END AS cell FROM f)"""

SENTENCES = """s AS (SELECT conv_id, turn, role, text, unnest(string_split_regex(text, '\\. ')) AS t FROM conversations)"""

ORACLES = {
    "doc_routing": routed(DENSE, ""),
    "routing_guards": routed(GUARDS, ""),
    "mode_normalize": """WITH a AS (SELECT (['auto', ' Native ', 'PDF', 'pdf_to_word', 'pdf-to-word', 'ocr_word', 'OCR', '', '  ', 'other', 'text', 'direct'])[event_id % 12 + 1] AS asked FROM events)
SELECT CASE WHEN lower(trim(asked)) IN ('native', 'text', 'pdf', 'pdf_to_word', 'pdf-to-word', 'direct') THEN 'direct' WHEN lower(trim(asked)) IN ('ocr', 'ocr_word', 'ocr-word') THEN 'ocr' ELSE 'auto' END AS mode, asked, count(*) AS n FROM a GROUP BY ALL""",
    "settings_override": "SELECT CAST(CASE WHEN event_id % 4 = 1 THEN 12 ELSE 6 END AS INT) AS warn_pages, count(*) AS n FROM events GROUP BY 1",
    "text_metrics": f"""SELECT doc_id, length(regexp_replace(text, '{W}', '', 'g')) AS ink, length(trim(regexp_replace(text, '{W}', ' ', 'g'))) AS normal_length, md5(trim(regexp_replace(text, '{W}', ' ', 'g'))) AS normal_md5,
  len(regexp_extract_all(text, '{CRIT}')) AS critical, len(regexp_extract_all(text, '{HAN}')) AS han FROM documents""",
    "region_aggregate": f"WITH {REGIONS} SELECT scene, kind, {AGGREGATE} FROM regions GROUP BY 1, 2",
    "region_rollup": f"WITH {REGIONS} SELECT scene, kind, {AGGREGATE}, CAST(grouping(scene) * 2 + grouping(kind) AS BIGINT) AS level FROM regions GROUP BY ROLLUP (scene, kind)",
    "micro_cer": f"WITH {REGIONS} SELECT scene, count(*) FILTER (exact) AS exact, count(*) AS n, CAST(sum(edits) AS DOUBLE) / greatest(1, sum(chars)) AS cer FROM regions GROUP BY 1",
    "page_review_count": f"WITH {REGIONS} SELECT scene, count(*) FILTER (needs_review) AS page_needs_review_count FROM regions GROUP BY 1",
    "semantic_coverage": f"WITH {REGIONS} SELECT kind, count(*) FILTER (found) AS required, count(*) FILTER (found AND exact) AS preserved FROM regions GROUP BY 1",
    "frozen_baseline": f"""WITH {REGIONS}, a AS (SELECT scene, kind, {AGGREGATE} FROM regions GROUP BY 1, 2),
t AS (SELECT scene, kind, 'regions' AS field, CAST(regions AS DOUBLE) AS measured FROM a UNION ALL SELECT scene, kind, 'cer', cer FROM a UNION ALL SELECT scene, kind, 'miss_rate', miss_rate FROM a)
SELECT scene, kind, field, measured, CASE WHEN scene < 'src5' THEN measured END AS expected, scene < 'src5' OR measured IS NULL AS passed FROM t""",
    "scene_timing": "SELECT event_type, median(value) AS p50_seconds, quantile_disc(value, 0.95) AS p95_seconds, max(value) AS max_seconds, count(value) AS runs FROM events GROUP BY 1",
    "request_percentiles": "SELECT user_id, quantile_cont(value, 0.5) FILTER (event_type <> 'error') AS p50_seconds, quantile_cont(value, 0.95) FILTER (event_type <> 'error') AS p95_seconds, max(value) FILTER (event_type <> 'error') AS max_seconds, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events WHERE event_id % 10 <> 0 GROUP BY 1",
    "duplicate_guard": "SELECT md5(text) AS digest, source, count(*) AS copies FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "check_rollup": "SELECT page_id % 4 AS record, bool_and(contains(html, '<a href')) AS ok, count(*) FILTER (contains(html, '<a href')) AS checks_passed, count(*) FILTER (NOT contains(html, '<a href')) AS checks_failed FROM pages GROUP BY 1",
    "critical_count": f"SELECT conv_id, turn, len(regexp_extract_all(text, '{CRIT}')) AS critical FROM conversations",
    "table_validate": TABLE_VALIDATE,
    "table_score": TABLE_SCORE,
    "box_valid": f"WITH {BOXES} SELECT vec_id, {BOX_OK.format(w=640, h=600)} AS valid FROM boxes",
    "box_scale": f"WITH {BOXES} SELECT vec_id, CASE WHEN {BOX_OK.format(w=1000, h=1000)} THEN b[1] * 2000 / 1000 END AS x1, CASE WHEN {BOX_OK.format(w=1000, h=1000)} THEN b[4] * 1500 / 1000 END AS y2 FROM boxes",
    "table_geometry": GEOMETRY,
    "risk_priority": f"SELECT CAST({PRIORITY} AS INT) AS priority, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    "scheduled_topk": f"SELECT * FROM (SELECT user_id, event_id, priority, row_number() OVER (PARTITION BY user_id ORDER BY priority, event_id) AS rank FROM (SELECT user_id, event_id, CAST({PRIORITY} AS INT) AS priority FROM events) WHERE priority IS NOT NULL) WHERE rank <= 16",
    "output_valid": f"WITH {OUTPUTS} SELECT conv_id, turn, {VERDICT} AS verdict FROM u",
    "weight_identity": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN c_name || '@r1' WHEN 4 THEN c_name || '@r2' END AS identity FROM customer",
    "critical_change": f"WITH {PAIRS} SELECT conv_id, turn, turn % 5 = 0 OR regexp_extract_all(reference, '{CHANGE}') <> regexp_extract_all(prediction, '{CHANGE}') AS changed FROM pairs",
    "evidence_attach": f"WITH {SEEN}, l AS (SELECT region_id, string_agg(text || '/' || status || '/' || source, ';' ORDER BY n) AS candidates FROM ranked GROUP BY 1) SELECT report_id, region_id, {STATE}, candidates FROM regions LEFT JOIN l USING (region_id)",
    "evidence_propagate": f"WITH {SEEN}, s AS (SELECT region_id, {STATE} FROM regions) SELECT page_id % 10 AS report_id, page_id AS region_id, coalesce(needs_review, false) AS needs_review, coalesce(resolution, 'owner') AS resolution FROM pages LEFT JOIN s ON page_id = region_id",
    "evidence_rejected": f"WITH {SEEN} SELECT report_id, pos, region_id, 'unknown_region' AS reason FROM seen WHERE region_id NOT IN (SELECT region_id FROM regions)",
    "annotation_compose": COMPOSE,
    "candidate_upper_bound": f"WITH {SEEN} SELECT count(*) AS regions, count(*) FILTER (EXISTS (SELECT 1 FROM cand WHERE cand.region_id = doc_id AND cand.text = CAST(doc_id % 45 AS VARCHAR) || '.5')) AS reachable FROM documents",
    "paired_changes": f"WITH {REGIONS} SELECT kind, count(*) FILTER (NOT exact AND found) AS wrong_to_right, count(*) FILTER (exact AND NOT found) AS right_to_wrong, count(*) AS regions FROM regions GROUP BY 1",
    "budget_share": f"WITH {REGIONS} SELECT scene, greatest(count(*) - 16, 0) AS exhausted, greatest(count(*) - 16, 0) / CAST(count(*) AS DOUBLE) AS share FROM regions GROUP BY 1",
    "literal_protect": f"""WITH {TOKENS} SELECT doc_id, CASE WHEN good THEN substr(t, 1, 3) || t0 || substr(t, 8, 3) || t1 || substr(t, CAST(11 + n AS INT)) END AS request, CASE WHEN good THEN t0 || ',' || t1 END AS tokens,
  CASE WHEN NOT good THEN 'overlapping or invalid span' END AS error FROM k""",
    "literal_restore": f"WITH {TOKENS} SELECT doc_id, '<' || t || '>' AS restored, true AS ok, true AS whole FROM k WHERE good",
    "literal_restore_fail": f"WITH {TOKENS} SELECT doc_id, false AS strict, doc_id % 4 = 2 AS any_order FROM k WHERE good",
    "char_width": f"SELECT p_partkey, 10.0::DOUBLE * {UNIT.format(t='p_name', l='0.52::DOUBLE')} AS width, 10.0::DOUBLE * {UNIT.format(t='p_name', l='0.5::DOUBLE')} * 1.04::DOUBLE AS allowed FROM part",
    "wrapped_lines": f"SELECT p_partkey, CAST(greatest(1, ceil(11.0::DOUBLE * {UNIT.format(t='p_name', l='0.52::DOUBLE')} / greatest(p_size, 1))) AS BIGINT) AS lines FROM part",
    "copy_fit_single": FIT,
    "tolerance_pairs": f"""WITH {FRAGMENTS} SELECT n.d AS drawing_id, CAST(n.pos AS INT) AS nominal, CAST(o.pos AS INT) AS neighbour FROM h n JOIN h o ON n.d = o.d AND n.pos = 0 AND o.pos > 0
WHERE n.angle = 0 AND o.numeric_ AND o.angle = 0 AND n.cell IS NOT DISTINCT FROM o.cell AND o.y2 - o.y1 BETWEEN 10 AND 55 AND o.x1 - n.x2 BETWEEN -25 AND 55 AND (o.y1 + o.y2) / 2 BETWEEN 60 AND 190""",
    "manifest_missing": f"WITH {FILES} SELECT path FROM listed WHERE path NOT IN (SELECT path FROM actual)",
    "manifest_changed": f"WITH {FILES} SELECT path, l.bytes, l.sha AS sha256, a.bytes AS actual_bytes, a.sha AS actual_sha256 FROM listed l JOIN actual a USING (path) WHERE l.bytes <> a.bytes OR l.sha <> a.sha",
    "unlisted": f"WITH {FILES} SELECT path FROM actual EXCEPT SELECT path FROM listed",
    "file_checks": f"""WITH {FILES}, c AS (SELECT path, CASE WHEN l.sha <> lower(l.sha) THEN 'expected a lowercase sha-256 digest' WHEN a.path IS NULL THEN 'missing evidence file' WHEN l.bytes <> a.bytes OR l.sha <> a.sha THEN 'recorded bytes/hash differ' END AS error
  FROM listed l LEFT JOIN actual a USING (path)) SELECT 'file_hash:' || path AS check_id, error IS NULL AS passed, error FROM c""".replace("a.path IS NULL", "a.bytes IS NULL"),
    "provenance_mismatch": f"WITH {FILES}, a AS (SELECT path, CASE WHEN length(path) % 5 = 0 THEN reverse(sha) ELSE sha END AS actual_sha256 FROM actual) SELECT path, lower(sha) AS sha256, actual_sha256 FROM listed JOIN a USING (path) WHERE lower(sha) <> actual_sha256",
    "secret_scan": "SELECT doc_id, doc_id % 6 = 0 OR regexp_matches(text, '\\bgh[pousr]_[A-Za-z0-9]{30,}\\b|\\bgithub_pat_[A-Za-z0-9_]{40,}\\b|\\bAKIA[A-Z0-9]{16}\\b|-----BEGIN (RSA |OPENSSH |EC )?PRIVATE KEY-----') AS secret, doc_id % 2 = 0 AS digest FROM documents",
    "path_safety": """SELECT page_id, CASE page_id % 10 WHEN 0 THEN true WHEN 9 THEN true ELSE false END AS canonical,
  CASE page_id % 10 WHEN 0 THEN true WHEN 3 THEN true WHEN 4 THEN true WHEN 8 THEN true WHEN 9 THEN true ELSE false END AS relative FROM pages""",
    "link_check": """WITH n AS (SELECT max(page_id) AS top FROM pages), p AS (SELECT page_id, 'p/' || page_id || '.md' AS path FROM pages)
SELECT path, 'ftp://y' AS target, 'unsupported/non-public link' AS error FROM p UNION ALL SELECT path, '../../up', 'missing or private relative link' FROM p
UNION ALL SELECT path, '../p/' || (page_id + 1) || '.md', 'missing or private relative link' FROM p WHERE page_id + 1 NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT path, (page_id + 10) || '.md', 'missing or private relative link' FROM p WHERE page_id + 10 NOT IN (SELECT page_id FROM pages)""",
    "set_ops": f"WITH {FILES} SELECT 'self' AS kind, true AS same UNION ALL SELECT 'manifest', NOT EXISTS ((SELECT path FROM actual EXCEPT SELECT path FROM listed) UNION ALL (SELECT path FROM listed EXCEPT SELECT path FROM actual))",
    "line_counts": f"WITH {SENTENCES} SELECT conv_id AS doc_id, count(*) AS lines FROM s GROUP BY 1",
    "translation_coverage": f"""WITH {SENTENCES}, q AS (SELECT conv_id, turn, role, length(t) AS n, t, row_number() OVER (PARTITION BY conv_id, turn ORDER BY 1) AS k FROM s),
f AS (SELECT conv_id, turn, role, string_split_regex(text, '\\. ')[1] AS t, text || CASE WHEN turn % 4 = 1 THEN '字' ELSE '' END AS cell FROM conversations),
l AS (SELECT conv_id, count(*) AS n FROM s WHERE length(t) % 3 = 0 GROUP BY 1),
o AS (SELECT conv_id, count(*) FILTER (role = 'user' AND length(t) % 3 = 0) AS n, count(*) FILTER (role <> 'user' AND turn % 2 = 1) AS raw, count(*) FILTER (role <> 'user' AND regexp_matches(cell, '{HAN}')) AS cells, count(*) AS pages FROM f GROUP BY 1)
SELECT conv_id AS doc_id, pages AS page_count, coalesce(l.n, 0) + o.n + raw AS nonempty_translated_entries, coalesce(l.n, 0) + o.n + raw AS translated_entries_with_script, cells AS current_cells_with_script FROM o LEFT JOIN l USING (conv_id)""",
    "response_log": """WITH r AS (SELECT conv_id, turn % 2 = 0 OR conv_id % 7 <> 3 AS t_ok, turn % 2 = 0 AS one, CASE WHEN turn % 2 = 0 THEN trim(text) <> '' ELSE trim(substr(text, 1, 4)) <> '' AND trim(substr(text, 5)) <> '' END AS q_ok FROM conversations),
c AS (SELECT conv_id, count(*) AS request_count, CAST(coalesce(sum(CASE WHEN one THEN 1 ELSE 2 END) FILTER (t_ok AND q_ok), 0) AS BIGINT) AS response_entries, count(*) FILTER (t_ok AND q_ok) AS response_entries_with_script, bool_and(t_ok AND q_ok) AS fine FROM r GROUP BY 1)
SELECT conv_id AS log_id, request_count, response_entries, response_entries_with_script, CASE WHEN conv_id % 11 = 5 THEN 'wrong direction' WHEN NOT fine THEN 'one nonempty string per input is required' WHEN response_entries_with_script = 0 THEN 'no translation in the target script' END AS error FROM c""",
    "model_page_parse": """SELECT event_id AS page_id, event_id % 8 IN (0, 1, 3, 4) AS ok, CASE WHEN event_id % 8 IN (0, 1, 3, 4) THEN 1 ELSE 0 END::BIGINT AS lines, CASE WHEN event_id % 8 IN (0, 1, 3, 4) THEN 1 ELSE 0 END::BIGINT AS tables,
  CASE WHEN event_id % 8 IN (3, 4) THEN 1 ELSE 0 END::BIGINT AS issues FROM events""",
    "bundle_decode": """WITH l AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 8 < 4 THEN 'paddle' ELSE 'mix' END AS stage, CASE WHEN l_orderkey % 3 = 0 THEN 'pid' ELSE 'mechanical' END AS kind, l_quantity > 25 AS exact, CAST(l_quantity AS INT) % 7 AS e, CAST(l_quantity AS INT) AS c FROM lineitem),
g AS (SELECT *, 'diagnostics/c1/v' AS grp FROM l WHERE k % 4 = 0 UNION ALL SELECT *, 'diagnostics/' || kind || '/v' FROM l WHERE k % 4 = 0 UNION ALL SELECT *, 'controls/synthetic' FROM l WHERE k % 4 = 1
  UNION ALL SELECT *, 'regions/' || kind FROM l WHERE k % 4 = 2 UNION ALL SELECT *, 'pages/' || CASE WHEN stage = 'paddle' THEN kind ELSE 'general/' || kind END FROM l WHERE k % 4 = 3)
SELECT stage, grp AS "group", count(*) FILTER (exact) AS exact, count(*) AS n, CAST(sum(e) AS DOUBLE) / greatest(1, sum(c)) AS cer FROM g GROUP BY 1, 2""",
    "map_flatten": "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2",
    "training_gate": """WITH a AS (SELECT l_orderkey AS region_id, l_orderkey % 100 AS family, l_returnflag AS text, count(DISTINCT l_linenumber) AS reviewers FROM lineitem GROUP BY 1, 2, 3 HAVING count(DISTINCT l_linenumber) >= 2)
SELECT * FROM a WHERE region_id IN (SELECT region_id FROM a GROUP BY 1 HAVING count(*) = 1) AND family NOT IN (SELECT n_nationkey FROM nation)""",
    "timestamp_labels": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS label, event_id % 3 = 0 AS is_date FROM events",
    "pixel_boxes": f"WITH {BOXES} SELECT vec_id, CAST(round_even(b[1] * 2.5::DOUBLE, 0) AS BIGINT) AS px1, CAST(round_even(b[4] * 2.5::DOUBLE, 0) AS BIGINT) AS py2 FROM boxes",
}
