"""Oracle SQL of the queries whose results plain SQL over whole tables can give."""

from __future__ import annotations

#: Sets of two-word shingles; pairs that share one of their rarest shingles (a pair from 80 % on must) are
#: compared on whole sets, and components are all texts that links reach.
MINHASH_NEAR_DEDUP = r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(
    CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s
  FROM worded),
sets AS MATERIALIZED (SELECT row_number() OVER () AS node, min(doc_id) AS id, s, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
terms AS MATERIALIZED (SELECT node, n, unnest(s) AS term FROM sets),
spread AS (SELECT term, count(*) AS texts FROM terms GROUP BY term),
placed AS (
  SELECT node, n, term, row_number() OVER (PARTITION BY node ORDER BY texts, term) AS place
  FROM terms JOIN spread USING (term)),
rarest AS MATERIALIZED (SELECT node, n, term FROM placed WHERE place <= n - (80 * n + 99) // 100 + 1),
candidates AS MATERIALIZED (
  SELECT DISTINCT a.node AS a, b.node AS b FROM rarest a JOIN rarest b
  ON a.term = b.term AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
counted AS (
  SELECT a, b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS common
  FROM candidates JOIN sets x ON x.node = a JOIN sets y ON y.node = b),
links AS MATERIALIZED (SELECT a, b FROM counted WHERE 100 * common >= 80 * (total - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT node, id AS root FROM sets
  UNION SELECT edges.b, reached.root FROM reached JOIN edges ON edges.a = reached.node),
named AS (SELECT node, min(root) AS component FROM reached GROUP BY node)
SELECT doc_id, CAST(len(shingled.s) AS BIGINT) AS n_shingles,
  CASE WHEN doc_id IS NOT NULL THEN coalesce(component, doc_id) END AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM shingled LEFT JOIN sets ON sets.s = shingled.s LEFT JOIN named USING (node)
"""

#: All products of the queries with all other vectors; sums of whole numbers under 2^53 are exact in doubles.
EXACT_TOP_K = """
WITH whole AS MATERIALIZED (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""


def centroid_clustering(k: int = 8, rounds: int = 10) -> str:
    """Rounds of assigning and moving, one pair of table expressions each; whole numbers under 2^53 are exact in doubles."""
    distance = "CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT)"
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept)
  QUALIFY c < {k})"""]
    near = "near{0} AS MATERIALIZED (SELECT x.r, min({1} * {2} + c.c) AS best FROM kept x JOIN c{0} c ON true GROUP BY x.r)"
    for i in range(rounds):
        steps.append(near.format(i, distance, k))
        steps.append(f"""
sums{i} AS (
  SELECT c, p, sum(CAST(value AS BIGINT)) AS total, count(*) AS n
  FROM (SELECT best % {k} AS c, unnest(v) AS value, unnest(range(64)) AS p FROM near{i} JOIN kept USING (r)) GROUP BY c, p),
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS v FROM sums{i} GROUP BY c) m ON m.c = c{i}.c)""")
    steps.append(near.format(rounds, distance, k))
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, best // {k} AS distance,
  CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM near{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.c = best % {k}
"""


#: All windows of items and the word sequences of the same lengths in documents, joined as text.
DECONTAMINATION = r"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
placed AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM placed),
sizes AS (SELECT DISTINCT k FROM windows),
starts AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc JOIN sizes ON len(w) >= k),
hits AS MATERIALIZED (
  SELECT r, i, k, item_id FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM starts) JOIN windows USING (k, g)),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
