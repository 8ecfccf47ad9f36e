"""SQL for the queries that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, keep_id, group_size,
  d.doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY text_sha256, d.doc_id ORDER BY d.doc_id) = 1 AS kept,
  text_sha256
FROM d JOIN g USING (text_sha256)
"""

#: Expects a relation docs(doc_id, source, text); gives doc_id, size, source_size, target, copies.
MIX = f"""
sized AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS skey, CAST({WORDS} AS BIGINT) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS salt FROM docs),
per AS (SELECT none, skey, CAST(sum(size) AS BIGINT) AS total,
  CAST([5, 2, 1][(row_number() OVER (ORDER BY none, skey) - 1) % 3 + 1] AS DOUBLE) AS w FROM sized GROUP BY 1, 2),
line AS (SELECT *, CAST(sum(total) OVER () AS DOUBLE) AS everything,
  CAST(coalesce(sum(total * 3) OVER (ORDER BY total * 3 / w, none, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS filled,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY total * 3 / w, none, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM per),
lev AS (SELECT min_by((everything - filled) / remaining, filled) AS v FROM line WHERE (everything - filled) / remaining * w <= total * 3),
targets AS (SELECT none, skey, total, coalesce(least(v * w, CAST(total * 3 AS DOUBLE)), 0) AS target FROM line, lev),
rates AS (SELECT *, CASE WHEN total > 0 AND target > 0 THEN least(floor(target / total * 1e9 + 0.5) / 1e9, 3.0) ELSE 0.0 END AS rate FROM targets),
ranked AS (SELECT s.*, total, target, floor(rate) AS base, rate - floor(rate) AS part,
  row_number() OVER (PARTITION BY s.none, s.skey ORDER BY size DESC, salt, CAST(doc_id AS VARCHAR)) AS r
  FROM sized s JOIN rates t ON s.none = t.none AND s.skey = t.skey),
tries AS (SELECT none, skey, k, abs(sum(size * (floor(r * part + k / 16.0) - floor((r - 1) * part + k / 16.0))) - max(target - total * base)) AS e
  FROM ranked, (SELECT CAST(unnest(range(16)) AS DOUBLE) AS k) GROUP BY 1, 2, 3),
best AS (SELECT none, skey, arg_min(k, e * 16 + k / 1e6) / 16.0 AS st FROM tries GROUP BY 1, 2),
mixed AS (SELECT doc_id, size, total AS source_size, target,
  CAST(base + floor(r * part + st) - floor((r - 1) * part + st) AS BIGINT) AS copies
  FROM ranked r JOIN best b ON r.none = b.none AND r.skey = b.skey)
"""

MIXING = f"WITH docs AS (SELECT * FROM documents), {MIX} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
again AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM again, range(20) AS r(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Expects links(a, b) in both directions and nodes(id); gives the least id that each reaches.
REACH = """reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
parts AS (SELECT id, min(r) AS component FROM reach GROUP BY 1)"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE rows_ AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nodes AS (SELECT vec_id AS id, list_transform(v, lambda x: coalesce(x, 0)) AS v FROM rows_ WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id <> y.id WHERE CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) END >= 0.95),
{REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM rows_ LEFT JOIN n ON vec_id = a LEFT JOIN parts ON vec_id = id
"""

MINHASH_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS id FROM d),
{REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, d.doc_id = component AS kept FROM d LEFT JOIN sizes USING (doc_id) JOIN parts ON d.doc_id = id
"""

#: Bytes as pairs of hexadecimal digits.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
again AS (SELECT doc_id, p FROM starts QUALIFY count(*) OVER (PARTITION BY h) > 1),
marked AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 400 AS fresh FROM again),
numbered AS (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS lo, max(p) + 400 AS hi FROM numbered GROUP BY 1, 2),
gaps AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS since FROM spans),
cut AS (SELECT doc_id, count(*) AS k, CAST(sum(hi - lo) AS BIGINT) AS removed, max(hi) AS last, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS t FROM gaps JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(t, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""

ORACLES = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op2_substring_dedup": SUBSTRING_DEDUP,
    "op5_embedding_dedup": EMBEDDING_DEDUP,
    "op7_minhash_dedup": MINHASH_DEDUP,
    "op8_suffix_dedup": SUFFIX_DEDUP,
    "op9_mixing": MIXING,
}
