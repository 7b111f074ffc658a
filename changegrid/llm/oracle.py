"""The same results in plain SQL, where SQL can state them."""

from __future__ import annotations

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

# Water filling as in the operator: sources in order of cap per weight, the first that fits sets the level.
TARGETS = f"""
sized AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS k FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM sources),
left_over AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0) AS BIGINT) AS rest,
        CAST(sum(w) OVER () - coalesce(sum(w) OVER earlier, 0) AS BIGINT) AS rest_w,
        row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place
    FROM weighed WINDOW earlier AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT place, rest, rest_w FROM left_over WHERE rest * w <= cap * rest_w ORDER BY place LIMIT 1),
targets AS (
    SELECT l.source, l.source_size,
        CASE WHEN v.place IS NULL OR l.place < v.place THEN CAST(l.cap AS DOUBLE)
             ELSE CAST(v.rest * l.w AS DOUBLE) / CAST(v.rest_w AS DOUBLE) END AS target
    FROM left_over l LEFT JOIN level v ON true)
"""

SQL: dict[str, str] = {
    "op2_mixing": f"""
WITH {TARGETS},
placed AS (
    SELECT s.*, t.source_size, t.target, CAST(floor(target) AS BIGINT) AS budget,
        CAST(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0
         ELSE budget // source_size * size + least(size, greatest(0, budget % source_size - before)) END AS taken
FROM placed
""",
    "op7_top_k": """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
    FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
    "op13_hard_negatives": """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
liked AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM liked JOIN scored USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
""",
}
