"""SQL, in DuckDB's dialect, for the queries that SQL can express; each over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NGRAM_JACCARD = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [list_aggregate(w[i:i + 3], 'string_agg', ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(r.root AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM reach GROUP BY 1) r ON r.node = d.doc_id
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
a AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, source_size * 2.0::DOUBLE AS most FROM s),
b AS (SELECT *, most / weight AS ratio FROM a),
c AS (SELECT *, row_number() OVER o AS place,
        (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM b WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
f AS (SELECT arg_min(level, place) AS level FROM c WHERE level <= ratio),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM f) * weight, most)) AS target FROM c),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM e
"""

NEAR_VECTORS = """
WITH RECURSIVE
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.root AS component_id, vec_id = r.root AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN (SELECT node, min(root) AS root FROM reach GROUP BY 1) r ON r.node = vec_id
"""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, p, list_aggregate(w[p:p + 34], 'string_agg', ' ') AS h FROM p),
r AS (SELECT doc_id, p FROM h WHERE h IN (SELECT h FROM h GROUP BY 1 HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS p FROM c GROUP BY 1),
k AS (SELECT w.doc_id, len(w.w) AS n, coalesce(len(g.p), 0) AS gone, CASE WHEN g.p IS NULL THEN w.w ELSE list_transform(list_filter(list_zip(w.w, range(1, len(w.w) + 1)), lambda x: NOT list_contains(g.p, x[2])), lambda x: x[1]) END AS kept FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256 FROM k
"""
