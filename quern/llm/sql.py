"""SQL that the results of this subpackage's queries are held against."""

P1_PAIRS = r"""
WITH rows_ AS (
  SELECT finding_key AS k, lower(regexp_replace(category, '^\s+|\s+$', '', 'g')) AS grp,
         list_distinct(regexp_extract_all(lower(description || ' ' || coalesce(evidence.snippet, '')), '[a-z0-9_]+')) AS toks
  FROM findings WHERE description IS NOT NULL AND category IS NOT NULL),
t AS (SELECT k, grp, len(toks) AS n, unnest(toks) AS tok FROM rows_),
p AS (
  SELECT a.k AS ka, b.k AS kb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM t a JOIN t b ON a.grp = b.grp AND a.tok = b.tok AND a.k < b.k GROUP BY a.k, b.k)
"""

P7_PAIRS = r"""
WITH f AS (
  SELECT item_id, unnest([question, answer]) AS text FROM eval_items),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM f WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, list_aggregate(w[i:i+11], 'string_agg', ' ') AS g FROM iw, range(1, len(w) - 10) r(i)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, list_aggregate(w[i:i+11], 'string_agg', ' ') AS g FROM dw, range(1, len(w) - 10) r(i))
"""

P8_SOURCES = r"""
WITH d AS (
  SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS k, len(regexp_extract_all(text, '[^\s\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS n
  FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
s AS (SELECT k, sum(n) AS size FROM d GROUP BY k),
t AS (SELECT sum(n) AS total FROM d)
"""

SQL = {
    "p1_found": P1_PAIRS + "SELECT ka AS finding_key_a, kb AS finding_key_b FROM p WHERE 10 * shared >= 6 * (na + nb - shared)",
    "p2_found": r"""
SELECT p.file_id FROM parse_results p JOIN split_limits l ON lower(regexp_extract(p.relpath, '(\.[^./\\]+)$', 1)) = l.extension
WHERE p.lines IS NOT NULL AND length(array_to_string(p.lines, chr(10))) > l.max_chars""",
    "p3_found": r"""
WITH f AS (
  SELECT finding_key, batch_no, lower(regexp_replace(finding_id, '^\s+|\s+$', '', 'g')) AS fid, status,
         CASE WHEN description IS NULL THEN NULL ELSE list_distinct(regexp_extract_all(lower(description), '[a-z0-9_]+')) END AS toks
  FROM findings),
t AS (SELECT finding_key AS k, batch_no AS b, status, len(toks) AS n, unnest(toks) AS tok FROM f WHERE toks IS NOT NULL),
p AS (
  SELECT a.k AS k, h.k AS hk, any_value(a.n) AS na, any_value(h.n) AS nh, count(*) AS shared
  FROM t a JOIN t h ON a.tok = h.tok AND h.b < a.b AND h.status IN ('fixed', 'issue-opened', 'failed', 'permanently_failed') GROUP BY a.k, h.k)
SELECT finding_key FROM f WHERE EXISTS (SELECT 1 FROM f g WHERE g.fid = f.fid AND g.batch_no < f.batch_no)
UNION SELECT k FROM p WHERE 10 * shared >= 6 * (na + nh - shared)""",
    "p7_found": P7_PAIRS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p8_found": P8_SOURCES + "SELECT m.source FROM mix_targets m CROSS JOIN t LEFT JOIN s ON s.k = lower(trim(m.source)) WHERE coalesce(s.size, 0) * m.max_repeats < m.target_share * t.total",
}
