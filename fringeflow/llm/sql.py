"""DuckDB statements that give the same rows as the operators SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
s AS (SELECT doc_id, unnest(sh) AS t FROM g),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT m.a, m.b FROM met m JOIN g x ON x.doc_id = m.a JOIN g y ON y.doc_id = m.b
  WHERE 100 * m.c >= 75 * (len(x.sh) + len(y.sh) - m.c)),
ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b)
SELECT g.doc_id, CAST(len(g.sh) AS BIGINT) AS n_shingles, least(g.doc_id, coalesce(min(r.b), g.doc_id)) AS component_id
FROM g LEFT JOIN reach r ON r.a = g.doc_id GROUP BY g.doc_id, len(g.sh)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'n' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) || ':mix'), 1, 8) AS BIGINT) AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ()) * 150.0::DOUBLE / 100 AS budget FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM f),
l AS (
  SELECT *, (budget - filled) / open AS level FROM o),
t AS (
  SELECT source, source_size, least(cap, weight * coalesce(
    arg_min(CASE WHEN level * weight <= cap THEN level END, CASE WHEN level * weight <= cap THEN cap / weight END) OVER (), 1e300)) AS target FROM l),
w AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole,
    CAST(floor(target) AS BIGINT) AS want FROM t),
r AS (
  SELECT d.*, w.source_size, w.target, w.whole, w.want - w.whole * w.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""
