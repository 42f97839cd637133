"""SQL that gives the rows of a query on small tables, in DuckDB's dialect."""

import string

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

# The smallest id that links (a, b) lead to from each id; for small groups.
REACHED = """
reached(id, c) AS (
  SELECT DISTINCT a, a FROM links
  UNION SELECT l.b, r.c FROM reached r JOIN links l ON l.a = r.id
), least AS (SELECT id, min(c) AS c FROM reached GROUP BY id)"""

EMBEDDING_JOIN = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9
), {REACHED}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id,
       coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN least ON id = vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), seen AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i
  FROM seen CROSS JOIN (SELECT unnest(range(50)) AS j) WHERE first < doc_id
), word AS (
  SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWERED)} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 85 * (na.n + nb.n - k)
), {REACHED}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
       coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON id = d.doc_id"""

TERMS = WORDS.replace(r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = TERMS.replace("coalesce(text, '')", LOWERED)

LEXICAL_SEARCH = f"""
WITH t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents
), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d
), q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM p CROSS JOIN c GROUP BY term, docs
), s AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id) CROSS JOIN c
  GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
       doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT a, b, score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.a = p.a AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""
