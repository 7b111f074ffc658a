"""The same queries as plain SQL, for checking results with another engine.

Written from the definitions, not from the Spark plans: brute-force joins and recursive
closure where the library uses sketches, prefix sums or block merges.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SCENES = """
scenes AS (
  SELECT CAST(s AS INT) AS scene_id, CAST(least(50, m + 1 - s * 50) AS INT) AS scene_rows
  FROM (SELECT max(user_id) AS m FROM events) t, range(0, (SELECT max(user_id) // 50 + 1 FROM events)) r(s)
)"""

META = SCENES + """,
meta AS (
  SELECT scene_id, 24 AS width, scene_rows AS height, 5 AS band_count, 10.0::DOUBLE AS a, 0.0::DOUBLE AS b,
    500000.0::DOUBLE + scene_id * 10000 AS c, 0.0::DOUBLE AS d, (-10.0)::DOUBLE AS e, 4600000.0::DOUBLE AS f,
    32633 AS epsg, '2024-01-01' AS t_a, '2024-01-16' AS t_b
  FROM scenes
)"""

RASTER = META + """,
ev AS (
  SELECT user_id // 50 AS scene_id, user_id % 50 AS row, hour(ts) AS col,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS band,
    CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'A' ELSE 'B' END AS t, value
  FROM events
),
cells AS (SELECT scene_id, t, band, row, col, round(sum(value), 6) AS v FROM ev GROUP BY ALL),
grid AS (
  SELECT s.scene_id, r.row, c.col, b.band, d.t
  FROM scenes s, range(0, 50) r(row), range(0, 24) c(col), range(0, 5) b(band), (VALUES ('A'), ('B')) d(t)
  WHERE r.row < s.scene_rows
),
raster AS MATERIALIZED (
  SELECT g.scene_id, g.t, CAST(g.band AS INT) AS band, CAST(g.row AS INT) AS row, CAST(g.col AS INT) AS col, coalesce(c.v, 0.0)::DOUBLE AS value
  FROM grid g LEFT JOIN cells c ON c.scene_id = g.scene_id AND c.t = g.t AND c.band = g.band AND c.row = g.row AND c.col = g.col
)"""

PROB = RASTER + """,
ab AS (
  SELECT scene_id, band, row, col, max(value) FILTER (t = 'A') AS value_a, max(value) FILTER (t = 'B') AS value_b
  FROM raster GROUP BY ALL
),
d AS (SELECT scene_id, row, col, avg(abs(value_b - value_a)) AS d FROM ab GROUP BY ALL),
q AS (SELECT scene_id, quantile_cont(d, 0.02) AS lo, quantile_cont(d, 0.98) AS hi, max(d) AS mx FROM d GROUP BY ALL),
prob AS MATERIALIZED (
  SELECT d.scene_id, d.row, d.col,
    CASE WHEN hi > lo THEN least(greatest((d - lo) / (hi - lo), 0), 1) ELSE least(greatest(d / greatest(mx, 1e-6), 0), 1) END AS p
  FROM d JOIN q USING (scene_id)
),
mask AS MATERIALIZED (SELECT scene_id, row, col, row::BIGINT * 2147483648 + col AS k FROM prob WHERE p > 0.5)"""


# Date B on the grid of date A: every third scene stays as it is.
WARPED = """
pos AS (
  SELECT r.scene_id, r.band, r.row, r.col, r.value AS value_a, m.height, m.width,
    CASE WHEN r.scene_id % 3 = 1 THEN r.col ELSE ((r.col - 1.5) - 0.01 * (r.row - 0.5)) / 1.0002 END::DOUBLE AS x,
    CASE WHEN r.scene_id % 3 = 1 THEN r.row ELSE ((r.row - 0.5) + 0.02 * (r.col - 1.5)) / 1.0002 END::DOUBLE AS y
  FROM raster r JOIN meta m USING (scene_id) WHERE t = 'A'
),
cl AS (SELECT *, least(greatest(x, 0), width - 1) AS sx, least(greatest(y, 0), height - 1) AS sy FROM pos)"""

# The blending window is zero on its rim: pixels that only rims of tiles cover score 0.
PROB_FULL = RASTER + "," + WARPED + """,
warped AS (
  SELECT c.scene_id, c.band, c.row, c.col, any_value(c.value_a) AS value_a, sum((1 - abs(sx - b.col)) * (1 - abs(sy - b.row)) * b.value) AS value_b
  FROM cl c JOIN raster b ON b.t = 'B' AND b.scene_id = c.scene_id AND b.band = c.band AND b.row IN (floor(sy), floor(sy) + 1) AND b.col IN (floor(sx), floor(sx) + 1) GROUP BY ALL
),
prob AS MATERIALIZED (
  SELECT scene_id, row, col, CASE WHEN row = 0 OR col = 0 OR (row = height - 1 AND (height - 16) % 12 = 0) OR (col = width - 1 AND (width - 16) % 12 = 0) THEN 0
    ELSE avg(abs(value_b - value_a) / (1 + abs(value_b - value_a))) END AS p
  FROM warped JOIN meta USING (scene_id) GROUP BY scene_id, row, col, height, width),
mask AS MATERIALIZED (SELECT scene_id, row, col, row::BIGINT * 2147483648 + col AS k FROM prob WHERE p > 0.5)"""


# The same with nodata: taps without a value share their weight, a pixel needs all bands of both dates.
SEEN = """,
seen AS (
  SELECT * FROM raster WHERE NOT (scene_id % 2 = 1 AND ((t = 'B' AND col < 2) OR (t = 'A' AND band = 2 AND col = 20 AND row % 7 = 3)))
)"""
PROB_NODATA = RASTER + SEEN + "," + WARPED.replace("FROM raster r", "FROM seen r") + """,
taps AS (
  SELECT c.scene_id, c.band, c.row, c.col, c.value_a, b.value, (1 - abs(sx - b.col)) * (1 - abs(sy - b.row)) AS w
  FROM cl c JOIN seen b ON b.t = 'B' AND b.scene_id = c.scene_id AND b.band = c.band AND b.row IN (floor(sy), floor(sy) + 1) AND b.col IN (floor(sx), floor(sx) + 1)
),
warped AS (
  SELECT scene_id, band, row, col, any_value(value_a) AS value_a, sum(w * value) / sum(w) AS value_b FROM taps WHERE w > 0 GROUP BY ALL
),
prob AS MATERIALIZED (
  SELECT scene_id, row, col, CASE WHEN row = 0 OR col = 0 OR (row = height - 1 AND (height - 16) % 12 = 0) OR (col = width - 1 AND (width - 16) % 12 = 0) THEN 0
    ELSE avg(abs(value_b - value_a) / (1 + abs(value_b - value_a))) END AS p
  FROM warped JOIN meta USING (scene_id) GROUP BY scene_id, row, col, height, width HAVING count(*) = 5),
mask AS MATERIALIZED (SELECT scene_id, row, col, row::BIGINT * 2147483648 + col AS k FROM prob WHERE p > 0.5)"""


def _labels(connectivity: int, prob: str = PROB) -> str:
    extra = "AND abs(m.row - r.row) + abs(m.col - r.col) = 1" if connectivity == 4 else ""
    body = prob.replace("\nscenes AS", "RECURSIVE scenes AS", 1)
    return body + f""",
reach AS (
  SELECT scene_id, row, col, k, k AS lab FROM mask
  UNION
  SELECT m.scene_id, m.row, m.col, m.k, r.lab FROM reach r JOIN mask m
    ON m.scene_id = r.scene_id AND m.row BETWEEN r.row - 1 AND r.row + 1 AND m.col BETWEEN r.col - 1 AND r.col + 1 {extra} AND r.lab < m.k
),
lab AS (SELECT scene_id, row, col, min(lab) AS region_id FROM reach GROUP BY scene_id, row, col),
sides AS (
  SELECT l.*,
    (SELECT count(*) FROM mask m WHERE m.scene_id = l.scene_id AND m.col = l.col AND m.row IN (l.row - 1, l.row + 1)) AS nv,
    (SELECT count(*) FROM mask m WHERE m.scene_id = l.scene_id AND m.row = l.row AND m.col IN (l.col - 1, l.col + 1)) AS nh
  FROM lab l
),
reg AS MATERIALIZED (
  SELECT scene_id, region_id, min(row) AS row_min, min(col) AS col_min, max(row) AS row_max, max(col) AS col_max,
    count(*) AS pixel_count, avg(row) AS centroid_row, avg(col) AS centroid_col,
    CAST(sum(2 - nv) AS BIGINT) AS h_edges, CAST(sum(2 - nh) AS BIGINT) AS v_edges
  FROM sides GROUP BY scene_id, region_id HAVING count(*) >= 4
)"""


REG4, REG8 = _labels(4), _labels(8)

CONF = """,
conf AS (
  SELECT r.scene_id, r.region_id, avg(p.p) AS mean_confidence
  FROM reg r JOIN meta m USING (scene_id) JOIN prob p ON p.scene_id = r.scene_id
    AND p.row BETWEEN r.row_min AND least(r.row_max + 1, m.height - 1) AND p.col BETWEEN r.col_min AND least(r.col_max + 1, m.width - 1)
  GROUP BY ALL
)"""

DETECTED = CONF + """,
det AS MATERIALIZED (
  SELECT sha256(concat_ws(':', r.scene_id, r.region_id, m.t_a, m.t_b)) AS detection_id, r.scene_id, r.region_id, r.pixel_count,
    r.pixel_count * 100.0::DOUBLE AS area_m2,
    round(m.a * (r.centroid_col + 0.5) + m.c, 6) + 0.0 AS centroid_x, round(m.e * (r.centroid_row + 0.5) + m.f, 6) + 0.0 AS centroid_y,
    m.a * r.col_min + m.c AS bbox_minx, m.e * (r.row_max + 1) + m.f AS bbox_miny,
    m.a * (r.col_max + 1) + m.c AS bbox_maxx, m.e * r.row_min + m.f AS bbox_maxy,
    (r.h_edges + r.v_edges) * 10.0::DOUBLE AS perimeter_m, round(c.mean_confidence, 6) + 0.0 AS mean_confidence, m.t_a AS timestamp_a, m.t_b AS timestamp_b
  FROM reg r JOIN meta m USING (scene_id) JOIN conf c USING (scene_id, region_id)
)"""
DET = REG4 + DETECTED


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def add(name: str, ctes: str, body: str) -> None:
    SQL[name] = (f"WITH {ctes.strip()}\n" if ctes else "") + body.strip()


DET_COLS = "detection_id, scene_id, region_id, pixel_count, area_m2, centroid_x, centroid_y, bbox_minx, bbox_miny, bbox_maxx, bbox_maxy, perimeter_m, mean_confidence, timestamp_a, timestamp_b"

# --- sources --------------------------------------------------------------------------------
add("raster_scan", RASTER, """
SELECT r.scene_id, r.t, r.band, r.row // 25 AS block_row, m.width, m.height, m.epsg, m.a AS resolution_m, TRUE AS has_geo, round(sum(value), 6) + 0.0 AS total
FROM raster r JOIN meta m USING (scene_id) GROUP BY ALL""")
MIXED = """, mixed AS (SELECT scene_id, CASE WHEN scene_id % 2 = 1 THEN 1 ELSE 5 END AS band_count, CASE WHEN scene_id % 2 = 1 THEN 0.0 END AS nodata FROM meta)"""
add("rgb_bands", RASTER + MIXED, """
SELECT scene_id, t, band, row, col, round(value, 6) + 0.0 AS value FROM raster JOIN mixed USING (scene_id) WHERE band_count >= 3 AND band < 3
UNION ALL
SELECT scene_id, t, CAST(k AS INT) AS band, row, col, round(value, 6) + 0.0 FROM raster JOIN mixed USING (scene_id), range(0, 3) x(k) WHERE band_count < 3 AND band = 0""")
add("missing_assets", "", """
SELECT DISTINCT e.dataset, e.rel_dir FROM (
  SELECT DISTINCT source || '-' || lang AS dataset, s || '/' || k AS rel_dir
  FROM documents, (VALUES ('train'), ('val'), ('test')) a(s), (VALUES ('A'), ('B'), ('label')) b(k)) e
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source || '-' || d.lang = e.dataset
  AND CASE d.doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END || '/' || CASE d.n_chars % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'label' ELSE 'A' END = e.rel_dir)""")
add("sha_prefix", "", "SELECT doc_id, substr(sha256(text), 1, 8) AS digest FROM documents")
add("change_map", PROB, """
SELECT scene_id, 1 AS band, row, col, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM prob
UNION ALL SELECT scene_id, 2, row, col, round(p, 6) + 0.0 FROM prob""")
add("change_map_cli", PROB, """
SELECT scene_id, 2 AS band, row, col, CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM prob
UNION ALL SELECT scene_id, 1, row, col, round(p, 6) + 0.0 FROM prob""")
add("prob_uint8", PROB, "SELECT scene_id, row, col, CAST(least(greatest(floor(p * 255), 0), 255) AS INT) AS byte FROM prob")
add("detections_insert", DET, f"""
SELECT {DET_COLS.replace('perimeter_m', 'NULL::DOUBLE AS perimeter_m')}, 32633 AS epsg, NULL::VARCHAR AS note FROM det WHERE region_id % 2 = 0
UNION ALL SELECT {DET_COLS}, 32633, 'rerun' FROM det WHERE region_id % 2 <> 0""")
add("detections_two_dates", DET, f"""
SELECT {DET_COLS}, 32633 AS epsg FROM det
UNION ALL SELECT {DET_COLS.replace('detection_id', "sha256(concat_ws(':', scene_id, region_id, timestamp_a, '2024-02-01')) AS detection_id").replace('timestamp_b', "'2024-02-01' AS timestamp_b")}, 32633 FROM det""")
add("detections_all", DET, f"SELECT {DET_COLS} FROM det")

MATCHES = """
m0 AS (
  SELECT o_orderkey // 100 AS pair_id, o_orderkey AS match_id, (o_custkey % 97)::DOUBLE AS x_b, (o_orderkey % 89)::DOUBLE AS y_b,
    CASE WHEN o_orderkey % 10 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS off,
    CASE WHEN (o_orderkey // 100) % 11 = 0 THEN 4.0 WHEN (o_orderkey // 100) % 7 = 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS g
  FROM orders
),
matches AS (
  SELECT *, g * (x_b + y_b * 0.01::DOUBLE) + 10 + off * 40 AS x_a, g * (x_b * (-0.02)::DOUBLE + y_b) + 5 - off * 25 AS y_a FROM m0
),
err AS (SELECT *, sqrt((g * x_b + g * 0.01::DOUBLE * y_b + 10 - x_a) ** 2 + (g * (-0.02)::DOUBLE * x_b + g * y_b + 5 - y_a) ** 2) AS e FROM matches),
rep AS (SELECT pair_id, max(g) AS g, count(*) FILTER (e < 3) AS n_inliers, coalesce(avg(e) FILTER (e < 3), 'infinity'::DOUBLE) AS error_px FROM err GROUP BY pair_id)"""
add("scene_summary", DET + "," + MATCHES, """
SELECT CAST(r.pair_id AS INT) AS scene_id, coalesce(n, 0) AS n_changes, round(error_px, 2) + 0.0 AS registration_error_px, n_inliers
FROM rep r LEFT JOIN (SELECT scene_id, count(*) AS n FROM det GROUP BY 1) d ON d.scene_id = r.pair_id""")

PRED = """pred AS (
  SELECT d.doc_id, d.source AS sample_id, d.lang AS config, (d.n_chars % 1000) / 1000.0::DOUBLE AS prob, l.quality AS target
  FROM documents d JOIN labels l USING (doc_id)
)"""


def confusion(by: str, thr: str = "0.5", src: str = "pred") -> str:
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {head}count(*) FILTER (prob > {thr} AND target = 1) AS tp, count(*) FILTER (prob > {thr} AND target = 0) AS fp,
  count(*) FILTER (NOT prob > {thr} AND target = 1) AS fn, count(*) FILTER (NOT prob > {thr} AND target = 0) AS tn FROM {src}{group}"""


SIX = """coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp::DOUBLE / nullif(tp + fp + fn, 0), 0) AS iou,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0) AS accuracy,
  ((tp + tn)::DOUBLE / nullif(n, 0) - pe) / nullif(1 - pe, 0) AS kappa"""
NPE = """SELECT *, (tp + fp + fn + tn)::DOUBLE AS n, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / nullif((tp + fp + fn + tn)::DOUBLE * (tp + fp + fn + tn), 0) AS pe FROM cm"""
SIX_R = "round(f1, 6) + 0.0 AS f1, round(iou, 6) + 0.0 AS iou, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(accuracy, 6) + 0.0 AS accuracy, round(kappa, 6) + 0.0 AS kappa"


def six(by: str = "", thr: str = "0.5", src: str = "pred") -> str:
    head = f"{by}, " if by else ""
    return f"cm AS ({confusion(by, thr, src)}), sc AS (SELECT {head}tp, fp, fn, tn, {SIX} FROM ({NPE}))"


add("evaluation_rows", PRED + "," + six(), f"""
SELECT {SIX_R}, 'checkpoints/best.pt' AS checkpoint, 'test' AS split, 0.5::DOUBLE AS threshold, (SELECT count(*) FROM labels) AS n_samples, 'resnet18' AS encoder FROM sc""")

RUNS = """runs AS (
  SELECT run_id, CAST(epoch AS INT) AS epoch, val_f1, round(1 - val_f1, 6) + 0.0 AS val_loss FROM (
    SELECT l_suppkey AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS epoch,
      round(l_discount * 5 + l_tax, 6) + 0.0 AS val_f1 FROM lineitem)
)"""
add("history_explode", RUNS, "SELECT run_id, epoch, val_f1, val_loss FROM runs")

# --- projections ----------------------------------------------------------------------------
U8 = "CAST(floor(least(greatest({}, 0), 1) * 255) AS INT)"
UNIT = RASTER + ", u AS (SELECT scene_id, t, band, row, col, value / 500 AS value FROM raster)"
add("to_uint8", UNIT, f"SELECT scene_id, t, band, row, col, {U8.format('value')} AS byte FROM u")
add("rgb_composite", UNIT + MIXED, f"""
SELECT u.scene_id, t, channel, row, col, {U8.format('value')} AS byte
FROM u JOIN mixed m USING (scene_id) JOIN (VALUES (0, 3), (1, 1), (2, 0)) w(channel, b) ON u.band = least(b, m.band_count - 1)""")
BANDQ = RASTER + """, bq AS (SELECT scene_id, t, band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi, max(value) AS mx FROM raster GROUP BY ALL),
st AS (SELECT r.*, lo, hi, mx FROM raster r JOIN bq USING (scene_id, t, band))"""
add("percentile_stretch", BANDQ, f"""
SELECT scene_id, t, band, row, col, {r6('CASE WHEN hi > lo THEN least(greatest((value - lo) / (hi - lo), 0), 1) ELSE least(greatest(value / greatest(mx, 1e-6), 0), 1) END')} AS value FROM st""")
add("percentile_stretch_255", BANDQ, """
SELECT scene_id, t, band, row, col, CAST(floor(CASE WHEN hi > lo THEN least(greatest((value - lo) / (hi - lo) * 255, 0), 255) ELSE least(greatest(value / greatest(mx, 1) * 255, 0), 255) END) AS INT) AS byte FROM st""")
MEAN = "CASE band WHEN 0 THEN 0.485 WHEN 1 THEN 0.456 ELSE 0.406 END::DOUBLE"
STD = "CASE band WHEN 0 THEN 0.229 WHEN 1 THEN 0.224 ELSE 0.225 END::DOUBLE"
add("normalize_bands", UNIT, f"SELECT scene_id, t, band, row, col, {r6(f'(value - {MEAN}) / {STD}')} AS value FROM u WHERE band < 3")
add("denormalize_bands", UNIT, f"""
SELECT scene_id, t, band, row, col, CAST(floor(least(greatest((((value - {MEAN}) / {STD}) * {STD} + {MEAN}) * 255, 0), 255)) AS INT) AS byte FROM u WHERE band < 3""")
add("label_binarize", RASTER, """
SELECT scene_id, t, band, row, col, CASE WHEN value > 128 THEN 1 ELSE 0 END AS label, CASE WHEN value > 128 THEN 255 ELSE 0 END AS byte FROM raster""")
add("threshold_mask", PROB, "SELECT scene_id, row, col, CAST(p > 0.5 AS INT) AS strict, CAST(p >= 1 AS INT) AS inclusive FROM prob")
add("pixel_to_world", RASTER, f"""
SELECT DISTINCT scene_id, row, col, {r6('a * (col + 0.5) + c')} AS x, {r6('e * (row + 0.5) + f')} AS y FROM raster JOIN meta USING (scene_id)""")
add("world_to_pixel", RASTER, """
SELECT DISTINCT scene_id, row, col, CAST(floor((a * (col + 0.5) + 13.25) / a) AS INT) AS to_col, CAST(floor((e * (row + 0.5) + 8.5) / e) AS INT) AS to_row
FROM raster JOIN meta USING (scene_id)""")
add("pixel_area", META, """
SELECT scene_id, CASE WHEN scene_id % 2 = 1 THEN 6.25::DOUBLE WHEN scene_id % 3 = 2 THEN NULL ELSE 100.0::DOUBLE END AS pixel_area,
  CASE WHEN scene_id % 2 = 0 THEN NULL WHEN scene_id % 3 = 2 THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS pixel_size FROM meta""")
add("crs_classify", "", """
SELECT s_suppkey, epsg, coalesce(epsg IN (4326, 4269), FALSE) AS is_geographic, coalesce(epsg IN (32633, 3857, 2154), FALSE) AS is_projected,
  coalesce(epsg <> 9999, FALSE) AS crs_valid
FROM (SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 4326 WHEN 1 THEN 32633 WHEN 2 THEN 3857 WHEN 3 THEN 4269 WHEN 4 THEN 2154 WHEN 5 THEN 9999 END AS epsg FROM supplier)""")
add("crs_systems", """
s AS (SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN 32633 WHEN 1 THEN 4326 ELSE 3030 + s_nationkey * 2 END AS INT) AS epsg FROM supplier),
k AS (SELECT s.*, n_regionkey % 2 = 0 AS g FROM s LEFT JOIN nation ON epsg = 3030 + n_nationkey)""", """
SELECT s_suppkey, epsg, coalesce(g, epsg = 4326) AS is_geographic, coalesce(NOT g, epsg = 32633) AS is_projected,
  g IS NOT NULL OR epsg IN (4326, 32633) AS crs_valid FROM k""")
add("rgb_to_gray", RASTER, f"""
SELECT scene_id, t, row, col, {r6('sum(value * CASE band WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END::DOUBLE)')} AS gray FROM raster WHERE band < 3 GROUP BY scene_id, t, row, col""")
add("patch_ids", "", """
SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR || '_' || CASE WHEN l_partkey * 7 < 10000 THEN lpad((l_partkey * 7)::VARCHAR, 4, '0') ELSE (l_partkey * 7)::VARCHAR END AS patch_id,
  l_orderkey::VARCHAR AS image_id FROM lineitem""")
COLOUR = "CASE WHEN {0} IS NULL THEN '#94a3b8' WHEN {0} >= 0.85 THEN '#ef4444' WHEN {0} >= 0.7 THEN '#f97316' WHEN {0} >= 0.55 THEN '#eab308' ELSE '#84cc16' END"
add("confidence_band", DET, f"""
SELECT detection_id, {COLOUR.format('k')} AS colour FROM (
  SELECT detection_id, CASE WHEN region_id % 2 = 1 THEN 0.9 WHEN region_id % 5 = 0 THEN NULL ELSE mean_confidence END AS k FROM det)""")
add("diff_concat", PROB, """
SELECT scene_id, band, row, col, round(value_a, 6) + 0.0 AS value_a, round(value_b, 6) + 0.0 AS value_b, round(abs(value_a - value_b), 6) + 0.0 AS diff FROM ab""")

add("geojson_features", DET, """
SELECT detection_id, 'Feature' AS type, 'Polygon' AS geometry_type, area_m2, bbox_minx AS minx, bbox_maxy AS maxy, TRUE AS closed FROM det""")
add("detection_result", DET, """
SELECT detection_id, area_m2, bbox_minx AS minx, bbox_maxy AS maxy, mean_confidence, timestamp_a, '' AS created_at FROM det""")

# --- filters --------------------------------------------------------------------------------
add("area_filter", DET, f"SELECT {DET_COLS} FROM det WHERE area_m2 >= 700")
add("detection_by_id", DET, f"SELECT {DET_COLS} FROM det WHERE detection_id = (SELECT min(detection_id) FROM det)")
add("bbox_query", DET, """
SELECT detection_id FROM det WHERE bbox_minx <= 510150 AND bbox_maxx >= 500050 AND bbox_miny <= 4599900 AND bbox_maxy >= 4599600""")
add("bbox_query_exact", DET, """
SELECT DISTINCT detection_id FROM det JOIN lab USING (scene_id, region_id) JOIN meta m USING (scene_id)
WHERE m.c + 10 * lab.col <= 510147 AND m.c + 10 * (lab.col + 1) >= 500063 AND m.f - 10 * (lab.row + 1) <= 4599887 AND m.f - 10 * lab.row >= 4599603""")
add("valid_pixels", RASTER, "SELECT scene_id, t, band, row, col, round(value, 6) + 0.0 AS value FROM raster WHERE scene_id % 2 = 0 OR value <> 0")
add("rejected_pairs", "", """
SELECT o_orderkey AS pair_id, 'A/' || o_custkey AS img_a, 'B/' || o_custkey AS img_b, CASE WHEN a.c_custkey IS NULL THEN 'img_a' ELSE 'img_b' END AS missing
FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND a.c_acctbal >= 0 LEFT JOIN customer b ON b.c_custkey = o_custkey AND b.c_nationkey % 2 = 0
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL""")
add("subset_n", "", """
(SELECT doc_id AS image_id, 'train' AS part FROM documents ORDER BY doc_id LIMIT 100) UNION ALL (SELECT doc_id, 'val' FROM documents ORDER BY doc_id LIMIT 25)""")

# --- joins ----------------------------------------------------------------------------------
add("pair_triplets", "", """
SELECT d.doc_id AS image_id, n_chars AS size_a, lang AS lang_b, quality FROM documents d JOIN labels USING (doc_id) WHERE n_chars % 5 <> 0""")
add("incomplete_triplets", "", """
SELECT d.doc_id AS image_id, TRUE AS has_a, n_chars % 5 <> 0 AS has_b, l.doc_id IS NOT NULL AS has_label
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE n_chars % 5 = 0 OR l.doc_id IS NULL""")


def padded(tile: int, stride: int, rule: str = "cover") -> str:
    if rule == "cover":
        pad = lambda n: f"CASE WHEN {n} < {tile} THEN {tile} - {n} ELSE ({stride} - ({n} - {tile}) % {stride}) % {stride} END"
    elif rule == "cli":
        pad = lambda n: f"CASE WHEN {n} % {stride} = 0 THEN 0 ELSE greatest(0, {tile} - {n} % {stride}) END"
    else:
        pad = lambda n: f"({tile} - {n} % {tile}) % {tile}"
    return f"padded AS (SELECT scene_id, height, width, height + {pad('height')} AS ph, width + {pad('width')} AS pw FROM meta)"


MIRROR = """CASE WHEN {n} = 1 THEN 0 WHEN {i} % greatest(2 * ({n} - 1), 1) < {n} THEN {i} % greatest(2 * ({n} - 1), 1) ELSE 2 * ({n} - 1) - {i} % greatest(2 * ({n} - 1), 1) END"""


def padded_raster(src: str = "raster") -> str:
    return f"""pr AS (
  SELECT r.scene_id, r.t, r.band, CAST(y AS INT) AS row, CAST(x AS INT) AS col, r.value
  FROM padded p, range(0, (SELECT max(ph) FROM padded)) yy(y), range(0, (SELECT max(pw) FROM padded)) xx(x), {src} r
  WHERE y < p.ph AND x < p.pw AND r.scene_id = p.scene_id AND r.row = {MIRROR.format(i='y', n='p.height')} AND r.col = {MIRROR.format(i='x', n='p.width')}
)"""


def tiles(tile: int, stride: int) -> str:
    return f"""tl AS (
  SELECT pr.scene_id, pr.t, pr.band, CAST(tr AS INT) AS tile_row, CAST(tc AS INT) AS tile_col,
    CAST(pr.row - tr * {stride} AS INT) AS i, CAST(pr.col - tc * {stride} AS INT) AS j, pr.value
  FROM pr JOIN padded p USING (scene_id), range(0, 100) a(tr), range(0, 100) b(tc)
  WHERE tr * {stride} + {tile} <= p.ph AND tc * {stride} + {tile} <= p.pw
    AND pr.row BETWEEN tr * {stride} AND tr * {stride} + {tile} - 1 AND pr.col BETWEEN tc * {stride} AND tc * {stride} + {tile} - 1
)"""


TILED = RASTER + ", " + padded(16, 12) + ", " + padded_raster() + ", " + tiles(16, 12)
add("tile_pairs", TILED, f"""
SELECT a.scene_id, a.band, a.tile_row, a.tile_col, {r6('sum(abs(a.value - b.value))')} AS total_diff
FROM tl a JOIN tl b ON a.scene_id = b.scene_id AND a.band = b.band AND a.tile_row = b.tile_row AND a.tile_col = b.tile_col AND a.i = b.i AND a.j = b.j
WHERE a.t = 'A' AND b.t = 'B' GROUP BY ALL""")
PARTS = """parts AS (SELECT CAST(p_partkey AS INT) AS scene_id, CAST(1 + p_partkey * 13 % 1500 AS INT) AS height, CAST(1 + p_partkey * p_size % 1100 AS INT) AS width FROM part)"""
add("shape_mismatches", PARTS, """
SELECT scene_id, height AS height_a, width AS width_a, CASE WHEN scene_id % 14 <> 0 THEN height + CAST(scene_id % 9 = 0 AS INT) END AS height_b,
  CASE WHEN scene_id % 14 <> 0 THEN width END AS width_b FROM parts WHERE scene_id % 14 = 0 OR scene_id % 9 = 0""")
add("neighbour_edges", PROB, """
SELECT a.scene_id, a.row, a.col, b.row AS n_row, b.col AS n_col FROM mask a JOIN mask b ON a.scene_id = b.scene_id
  AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND b.k > a.k""")
add("zonal_mean", REG4 + CONF, "SELECT scene_id, region_id, round(mean_confidence, 6) + 0.0 AS mean_confidence, 'window' AS confidence_source FROM conf")


SQL["zonal_mean_blocked"] = SQL["zonal_mean"]
add("zonal_mean_plain", REG4 + CONF + ", means AS (SELECT scene_id, avg(p) AS scene_mean FROM prob GROUP BY scene_id)", """
SELECT scene_id, region_id, round(CASE WHEN scene_id % 2 = 1 THEN scene_mean ELSE mean_confidence END, 6) + 0.0 AS mean_confidence,
  CASE WHEN scene_id % 2 = 1 THEN 'scene' ELSE 'window' END AS confidence_source FROM conf JOIN means USING (scene_id)""")


def knn(src: str) -> str:
    return f"""nn AS (
  SELECT a.pair_id, a.kp_id, b.kp_id AS t_id, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) ** 2))) AS dist
  FROM {src} a JOIN {src} b ON a.pair_id = b.pair_id AND a.side = 'A' AND b.side = 'B'
),
nr AS (SELECT *, row_number() OVER (PARTITION BY pair_id, kp_id ORDER BY dist, t_id) AS rank FROM nn QUALIFY rank <= 2)"""


DESC = """desc_a AS (SELECT CAST(vec_id // 500 AS INT) AS pair_id, 'A' AS side, vec_id AS kp_id, embedding::DOUBLE[] AS vec FROM embeddings),
descs AS MATERIALIZED (
  SELECT * FROM desc_a
  UNION ALL SELECT pair_id, 'B', kp_id, list_transform(vec, lambda x, i: x + 0.002::DOUBLE * ((kp_id * 31 + i * 17) % 11 - 5)) FROM desc_a WHERE kp_id % 3 <> 0
)"""
GOOD = """gm AS (
  SELECT pair_id, kp_id, max(t_id) FILTER (rank = 1) AS t_id, max(dist) FILTER (rank = 1) AS d1, max(dist) FILTER (rank = 2) AS d2 FROM nr GROUP BY ALL
  HAVING d1 < 0.75 * d2
)"""
add("knn2", DESC + "," + knn("descs"), f"SELECT pair_id, kp_id, t_id, {r6('dist')} AS dist, CAST(rank AS INT) AS rank FROM nr")
add("ratio_matches", DESC + "," + knn("descs") + "," + GOOD, f"SELECT pair_id, kp_id, t_id, {r6('d1')} AS d1, {r6('d2')} AS d2 FROM gm")
add("aoi_join", DET + """, aoi AS (
  SELECT s_suppkey AS aoi_id, 500000.0 + (s_suppkey * 37) % 40000 AS x, 4599500.0 + (s_suppkey * 13) % 500 AS y,
    CASE WHEN s_suppkey % 7 = 0 THEN 15000.0 ELSE 40.0 + (s_suppkey % 11) * 90 END AS r FROM supplier
)""", """
SELECT aoi_id, detection_id FROM det, aoi WHERE bbox_minx <= x + r AND bbox_maxx >= x - r AND bbox_miny <= y + r AND bbox_maxy >= y - r""")

# --- metrics --------------------------------------------------------------------------------
add("cd_metrics", PRED + "," + six(), f"SELECT tp, fp, fn, tn, {SIX_R} FROM sc")
add("cd_metrics_by_config", PRED + "," + six("config"), f"SELECT config, tp, fp, fn, tn, {SIX_R} FROM sc")
SAMPLE = PRED + f", cm AS ({confusion('sample_id')}), sf AS (SELECT sample_id, tp, fp, fn, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 1) AS f1 FROM cm)"
add("sample_f1", SAMPLE, f"SELECT sample_id, tp, fp, fn, {r6('f1')} AS f1 FROM sf")
DICE = "(1 - (2 * sum(prob * target) + 1) / (sum(prob) + sum(target) + 1))"
add("dice_loss", PRED, f"SELECT config, {r6(DICE)} AS dice_loss FROM pred GROUP BY config")
LOG = "CASE WHEN {0} <= 0 THEN -100 ELSE greatest(ln(CASE WHEN {0} <= 0 THEN 1 ELSE {0} END), -100) END"
BCE = f"avg(-(target * {LOG.format('prob')} + (1 - target) * {LOG.format('(1 - prob)')}))"
add("bce_dice_loss", PRED, f"SELECT config, {r6(BCE)} AS bce, {r6(DICE)} AS dice_loss, {r6(f'0.5 * {BCE} + 0.5 * {DICE}')} AS loss FROM pred GROUP BY config")
Q = "least(greatest(prob, 1e-6), 1 - 1e-6)"
FOCAL = f"avg((0.25 * target + 0.75 * (1 - target)) * (-(target * ln({Q}) + (1 - target) * ln(1 - {Q}))) * (1 - (prob * target + (1 - prob) * (1 - target))) ** 2)"
add("focal_dice_loss", PRED, f"SELECT config, {r6(FOCAL)} AS focal, {r6(DICE)} AS dice_loss, {r6(f'0.5 * {FOCAL} + 0.5 * {DICE}')} AS loss FROM pred GROUP BY config")
add("target_verdict", PRED + "," + six(), f"SELECT {r6('f1')} AS f1, {r6('iou')} AS iou, f1 >= 0.88 AS f1_met, iou >= 0.8 AS iou_met, f1 >= 0.88 AND iou >= 0.8 AS success FROM sc")
add("split_counts", "", """
SELECT split, count(o_orderkey) AS n_patches FROM (VALUES ('train'), ('val'), ('test')) s(split)
LEFT JOIN orders ON split = CASE WHEN o_orderpriority LIKE '1%' THEN 'train' ELSE 'test' END GROUP BY split""")
add("change_pct", PROB, f"SELECT scene_id, {r6('avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) * 100')} AS change_pct FROM prob GROUP BY scene_id")
add("detection_stats", DET, f"SELECT count(*) AS total, {r6('sum(area_m2)')} AS total_area, {r6('avg(nullif(mean_confidence, 0))')} AS avg_confidence FROM det")
SQL["detection_stats"] = SQL["detection_stats"].replace("round(c.mean_confidence, 6) + 0.0 AS mean_confidence", "c.mean_confidence AS mean_confidence")
add("detections_extent", DET, "SELECT min(bbox_minx) AS minx, min(bbox_miny) AS miny, max(bbox_maxx) AS maxx, max(bbox_maxy) AS maxy FROM det")
add("f1_summary", SAMPLE, f"SELECT count(*) AS n_samples, {r6('coalesce(avg(f1), 0)')} AS mean_f1, {r6('coalesce(min(f1), 0)')} AS worst_f1, {r6('coalesce(max(f1), 0)')} AS best_f1 FROM sf")
add("epoch_loss", "", f"SELECT l_suppkey AS run_id, CAST(year(l_shipdate) AS INT) AS epoch, {r6('avg(1 - l_discount * 5 - l_tax)')} AS epoch_loss FROM lineitem GROUP BY ALL")
add("status_counts", "", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, count(*) AS n_jobs FROM orders GROUP BY 1""")

# --- windows --------------------------------------------------------------------------------
add("crop_patches", RASTER, """
SELECT scene_id, scene_id::VARCHAR || '_' || lpad(((row // 7) * (width // 7) + col // 7)::VARCHAR, 4, '0') AS patch_id, row % 7 AS row, col % 7 AS col, t, band, round(value, 6) + 0.0 AS value
FROM raster JOIN meta USING (scene_id) WHERE row < (height // 7) * 7 AND col < (width // 7) * 7""")
add("image_split", "", """
SELECT image_id, CASE WHEN r < nt THEN 'train' WHEN r < nt + nv THEN 'val' ELSE 'test' END AS split FROM (
  SELECT o_orderkey AS image_id, row_number() OVER (ORDER BY sha256('42:' || o_orderkey::VARCHAR), o_orderkey) - 1 AS r,
    floor(count(*) OVER () * 0.7::DOUBLE) AS nt, floor(count(*) OVER () * 0.15::DOUBLE) AS nv FROM orders)""")
add("image_split_hashed", "", """
SELECT image_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split FROM (
  SELECT o_orderkey AS image_id, ('0x' || substr(sha256('42:' || o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders)""")
add("best_epoch", RUNS, """
SELECT run_id, epoch AS best_epoch, round(val_f1, 6) + 0.0 AS best_score, n AS n_epochs FROM (
  SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY val_f1 DESC, epoch) = 1)""")
add("topk_checkpoints", RUNS, """
SELECT run_id, epoch, val_f1, CAST(row_number() OVER (PARTITION BY run_id ORDER BY val_f1 DESC, epoch) AS INT) AS rank FROM runs QUALIFY rank <= 3""")
add("early_stop", "RECURSIVE " + RUNS + """,
walk AS (
  SELECT run_id, 0 AS epoch, '-infinity'::DOUBLE AS best, 0 AS waited, NULL::INT AS stop FROM runs GROUP BY run_id
  UNION ALL
  SELECT w.run_id, r.epoch, CASE WHEN w.stop IS NULL AND r.val_f1 > w.best + 1e-4 THEN r.val_f1 ELSE w.best END,
    CASE WHEN w.stop IS NOT NULL THEN w.waited WHEN r.val_f1 > w.best + 1e-4 THEN 0 ELSE w.waited + 1 END,
    CASE WHEN w.stop IS NOT NULL THEN w.stop WHEN r.val_f1 > w.best + 1e-4 THEN NULL WHEN w.waited + 1 >= 15 THEN r.epoch END
  FROM walk w JOIN runs r ON r.run_id = w.run_id AND r.epoch = w.epoch + 1
)""", """
SELECT run_id, stop AS stop_epoch, round(best, 6) + 0.0 AS accepted_best, waited FROM walk QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) = 1""")
add("regions", REG8, f"""
SELECT scene_id, region_id, row_min, col_min, row_max, col_max, pixel_count, {r6('centroid_row')} AS centroid_row, {r6('centroid_col')} AS centroid_col FROM reg""")
SQL["regions_blocked"] = SQL["regions"]
add("empty_mask", REG4, "SELECT scene_id, region_id, pixel_count FROM reg WHERE false")
add("worst_samples", SAMPLE, f"SELECT sample_id, tp, fp, fn, {r6('f1')} AS f1 FROM (SELECT * FROM sf ORDER BY f1, sample_id LIMIT 10)")
add("detection_list", DET, f"""
SELECT substr(detection_id, 1, 8) AS short_id, area_m2, coalesce(mean_confidence, 0) AS confidence, {COLOUR.format('mean_confidence')} AS colour
FROM (SELECT * FROM det ORDER BY scene_id, region_id LIMIT 100)""")
add("run_comparison", PRED + "," + six("config, sample_id"), f"""
SELECT s.config, s.sample_id, {r6('s.f1')} AS f1, {r6('s.iou')} AS iou, {r6('b.f1')} AS base_f1, {r6('(b.f1 - s.f1) / nullif(b.f1, 0)')} AS drop,
  coalesce((b.f1 - s.f1) / nullif(b.f1, 0) > 0.1, FALSE) AS degraded,
  row_number() OVER (PARTITION BY s.sample_id ORDER BY s.f1 DESC, s.config DESC) = 1 AS is_best
FROM sc s LEFT JOIN (SELECT config, f1 FROM sc WHERE sample_id = 'src0') b ON b.config = s.config""")
add("threshold_sweep", PRED + ", th AS (SELECT k / 20.0::DOUBLE AS threshold FROM range(1, 20) r(k)), pt AS (SELECT p.*, threshold FROM pred p, th)," + six("threshold", "threshold", "pt"), f"SELECT threshold, tp, fp, fn, tn, {SIX_R} FROM sc")
add("leakage_check", "", """
SELECT image_id, string_agg(split, ',' ORDER BY split) AS splits, count(*) AS n_splits FROM (
  SELECT DISTINCT o_orderkey // 4 AS image_id, CASE WHEN o_orderkey % 20 < 14 THEN 'train' WHEN o_orderkey % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM orders)
GROUP BY image_id HAVING count(*) > 1""")

# --- tiling ---------------------------------------------------------------------------------
PAD = "CASE WHEN {0} < {1} THEN {1} - {0} ELSE ({2} - ({0} - {1}) % {2}) % {2} END"
PADC = "CASE WHEN {0} % {2} = 0 THEN 0 ELSE greatest(0, {1} - {0} % {2}) END"
add("compute_pad", PARTS, f"""
SELECT scene_id, {PAD.format('height', 256, 224)} AS pad_h, {PAD.format('width', 256, 224)} AS pad_w, {PADC.format('height', 256, 192)} AS cli_pad_h, {PADC.format('width', 256, 192)} AS cli_pad_w FROM parts""")
add("grid_shape", PARTS, f"""
SELECT scene_id, (height + {PAD.format('height', 256, 224)} - 256) // 224 + 1 AS n_rows, (width + {PAD.format('width', 256, 224)} - 256) // 224 + 1 AS n_cols FROM parts""")
add("route_scenes", PARTS, "SELECT scene_id, height, width, CASE WHEN height <= 640 AND width <= 640 THEN 'single' ELSE 'tiled' END AS route FROM parts")
PR_OUT = "SELECT scene_id, t, band, row, col, round(value, 6) + 0.0 AS value FROM pr"
add("pad_reflect", RASTER + ", " + padded(16, 12) + ", " + padded_raster(), PR_OUT)
add("pad_multiple", RASTER + ", " + padded(32, 0, "multiple") + ", " + padded_raster(), PR_OUT)
add("split_tiles", TILED, "SELECT scene_id, t, band, tile_row, tile_col, i, j, round(value, 6) + 0.0 AS value FROM tl")
SCORE_SRC = ", score AS (SELECT scene_id, 'A' AS t, 0 AS band, row, col, p AS value FROM prob)"


def stitched(rule: str) -> str:
    hann = "(0.5 - 0.5 * cos(2 * pi() * {} / 15))"
    return PROB + SCORE_SRC + ", " + padded(16, 12, rule) + ", " + padded_raster("score") + ", " + tiles(16, 12) + f""",
acc AS (
  SELECT scene_id, tile_row * 12 + i AS row, tile_col * 12 + j AS col, sum(value * {hann.format('i')} * {hann.format('j')}) AS s, sum({hann.format('i')} * {hann.format('j')}) AS w
  FROM tl GROUP BY ALL
)"""


add("stitch_tiles", stitched("cover"), """
SELECT p.scene_id, p.row, p.col, round(least(greatest(a.s / CASE WHEN a.w > 1e-9 THEN a.w ELSE 1 END, 0), 1), 6) + 0.0 AS p FROM prob p JOIN acc a USING (scene_id, row, col)""")
add("stitch_tiles_cli", stitched("cli"), """
SELECT p.scene_id, p.row, p.col, round(coalesce(a.s / greatest(a.w, 1e-8), 0), 6) + 0.0 AS p FROM prob p LEFT JOIN acc a USING (scene_id, row, col)""")
PATCH_SCENES = """ps AS (
  SELECT CAST(vec_id // 25 AS INT) AS scene_id, (vec_id % 25 + 24) % 25 AS p, i, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(0, 64) x(i)
),
b AS (SELECT scene_id, (p // 5) * 8 + i // 8 AS row, (p % 5) * 8 + i % 8 AS col, value FROM ps)"""
add("resize_bilinear", PATCH_SCENES + """,
og AS (
  SELECT scene_id, oy, ox, least(greatest((oy + 0.5) * 40 / 56 - 0.5, 0), 39)::DOUBLE AS sy, least(greatest((ox + 0.5) * 40 / 64 - 0.5, 0), 39)::DOUBLE AS sx
  FROM (SELECT DISTINCT scene_id FROM b), range(0, 56) y(oy), range(0, 64) x(ox)
)""", f"""
SELECT o.scene_id, 'B' AS t, CAST(oy AS INT) AS row, CAST(ox AS INT) AS col, {r6('sum((1 - abs(sy - b.row)) * (1 - abs(sx - b.col)) * value)')} AS value
FROM og o JOIN b ON b.scene_id = o.scene_id AND b.row IN (floor(sy), floor(sy) + 1) AND b.col IN (floor(sx), floor(sx) + 1) GROUP BY ALL""")
add("explode_pixels", RASTER, "SELECT scene_id, t, band, row, col, round(value, 6) + 0.0 AS value FROM raster")
add("pack_blocks", RASTER, f"""
SELECT scene_id, t, band, row // 16 AS block_row, col // 16 AS block_col, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS w, CAST(count(*) AS INT) AS n,
  {r6('sum(value * k)')} AS checksum
FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, t, band, row // 16, col // 16 ORDER BY row, col) AS k FROM raster) GROUP BY ALL""")

# --- scoring, regions -----------------------------------------------------------------------
add("change_score", PROB, "SELECT scene_id, row, col, round(p, 6) + 0.0 AS p FROM prob")
add("score_tiles", TILED, """
SELECT a.scene_id, a.band, a.tile_row, a.tile_col, round(avg(abs(a.value - b.value) / (1 + abs(a.value - b.value))), 3) AS mean_prob
FROM tl a JOIN tl b ON a.scene_id = b.scene_id AND a.band = b.band AND a.tile_row = b.tile_row AND a.tile_col = b.tile_col AND a.i = b.i AND a.j = b.j
WHERE a.t = 'A' AND b.t = 'B' GROUP BY ALL""")
add("detect_changes", DET, f"SELECT {DET_COLS} FROM det")
FULL_COLS = ", ".join(c for c in DET_COLS.split(", ") if c != "pixel_count")
add("detect_changes_nodata", _labels(4, PROB_NODATA) + DETECTED, f"SELECT {DET_COLS} FROM det")
add("detect_changes_full", _labels(4, PROB_FULL) + DETECTED, f"SELECT {FULL_COLS}, pixel_count, 32633 AS epsg FROM det")
add("detect_changes_geometry", DET, """
SELECT detection_id, scene_id, region_id, area_m2 AS outline_area, bbox_minx AS minx, bbox_maxy AS maxy, TRUE AS is_polygon FROM det""")
add("region_attributes", DET, f"""
SELECT {DET_COLS.replace('detection_id, ', '').replace('mean_confidence, ', '').replace('area_m2', 'area_m2 * 100 AS area_m2').replace('perimeter_m', 'perimeter_m * 10 AS perimeter_m')} FROM det""")
add("polygonize", REG4, "SELECT scene_id, region_id, pixel_count AS area_px, h_edges + v_edges AS perimeter_px FROM reg")
SQL["polygonize_blocked"], SQL["detect_changes_blocked"] = SQL["polygonize"], SQL["detect_changes"]
add("ring_validity", REG8, "SELECT scene_id, region_id, pixel_count AS area_px, TRUE AS simple, TRUE AS closed FROM reg")
add("simplify_rings", REG4, "SELECT scene_id, region_id, TRUE AS closed, TRUE AS subset, TRUE AS fewer, TRUE AS same_rings FROM reg")
# A hull needs pixels that are not on one line: the determinant of their scatter is not zero.
add("region_hull", REG4, """
SELECT scene_id, region_id, CAST(count(*) AS BIGINT) AS pixel_count, TRUE AS inside, TRUE AS corners_are_pixels FROM lab
GROUP BY scene_id, region_id HAVING count(*) >= 4 AND
  (count(*) * sum(row * row) - sum(row) * sum(row)) * (count(*) * sum(col * col) - sum(col) * sum(col)) - (count(*) * sum(row * col) - sum(row) * sum(col)) ** 2 <> 0""")
add("learned_scorer", PROB, """
SELECT CASE WHEN (scene_id + row) % 5 = 0 THEN 'held_out' ELSE 'train' END AS split, count(*) AS n, CAST(sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS changed,
  TRUE AS accurate, TRUE AS finds_changes FROM prob GROUP BY 1""")

# --- file listings --------------------------------------------------------------------------
LISTING = """listing AS (
  SELECT doc_id, '/data/' || source || '/' || ['train', 'val', 'test'][doc_id % 3 + 1] || '/' || ['A', 'B', 'label'][n_chars % 3 + 1] || '/' || doc_id
    || CASE WHEN doc_id % 2 = 0 THEN '_A' ELSE '_B' END || ['.tif', '.JP2', '.png', '.jpeg', '.txt', '.img', '.png'][doc_id % 7 + 1] AS path,
    lower(['.tif', '.JP2', '.png', '.jpeg', '.txt', '.img', '.png'][doc_id % 7 + 1]) AS suffix, n_chars FROM documents
)"""
add("route_files", LISTING, """
SELECT path, suffix, CASE WHEN suffix IN ('.tif', '.jp2', '.img') THEN 'raster' WHEN suffix IN ('.png', '.jpeg') THEN 'plain' ELSE 'unsupported' END AS reader FROM listing""")
add("image_ids", LISTING, "SELECT DISTINCT doc_id || CASE WHEN doc_id % 2 = 0 THEN '_A' ELSE '_B' END AS image_id FROM listing WHERE n_chars % 3 = 1 AND suffix = '.png'")
add("split_layout", LISTING, """
SELECT CASE WHEN count(DISTINCT doc_id % 3) FILTER (n_chars % 3 = 0) = 3 THEN 'presplit' WHEN count(*) FILTER (n_chars % 3 = 0) > 0 THEN 'flat' ELSE 'unknown' END AS layout FROM listing""")
add("suffix_pairs", LISTING, "SELECT path, CAST(doc_id AS VARCHAR) AS image_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM listing")
add("wrap_features", "", """
SELECT 'Feature' AS type, '[' || doc_id % 180 || ',' || n_chars % 90 || ']' AS coordinates, doc_id, lang FROM documents WHERE doc_id % 3 <> 0""")

# --- registration ---------------------------------------------------------------------------
add("pair_match_status", f"""d0 AS (
  SELECT CAST(kp_id // 25 AS INT) AS pair_id, side, kp_id, vec FROM descs
  WHERE NOT (side = 'B' AND (kp_id // 25) % 5 = 4 AND kp_id % 25 > 9)
),
noisy AS (
  SELECT pair_id, side, kp_id, CASE WHEN side = 'B' AND pair_id % 2 = 1 THEN list_transform(vec, lambda x, i: x + 0.2::DOUBLE * ((kp_id * 7 + (i - 1) * 5) % 13 - 6)) ELSE vec END AS vec FROM d0
),
{knn('noisy')}, {GOOD},
{knn('d0').replace('nn AS', 'fnn AS').replace('nr AS', 'fnr AS').replace('FROM nn', 'FROM fnn')}, {GOOD.replace('gm AS', 'fgm AS').replace('FROM nr', 'FROM fnr')},
kp AS (SELECT pair_id, count(*) FILTER (side = 'A') AS ka, count(*) FILTER (side = 'B') AS kb FROM d0 GROUP BY ALL),
c AS (SELECT pair_id, ka, kb, (SELECT count(*) FROM gm WHERE gm.pair_id = kp.pair_id) AS g, (SELECT count(*) FROM fgm WHERE fgm.pair_id = kp.pair_id) AS fg FROM kp)""".replace("d0 AS", DESC + ", d0 AS", 1), """
SELECT pair_id, g AS primary_matches, fg AS fallback_matches,
  CASE WHEN ka >= 4 AND kb >= 4 AND g >= 10 THEN 'primary' WHEN ka >= 4 AND kb >= 4 AND fg >= 10 THEN 'fallback' ELSE 'failed' END AS status FROM c""")
add("fit_homography", MATCHES, """
SELECT pair_id, max(g) AS h0, round(max(g) * 0.01, 3) AS h1, 10.0::DOUBLE AS h2, round(max(g) * -0.02, 3) AS h3, max(g) AS h4, 5.0::DOUBLE AS h5, 0.0::DOUBLE AS h6, 0.0::DOUBLE AS h7, 1.0::DOUBLE AS h8,
  count(*) AS n_matches, count(*) FILTER (off = 0) AS n_inliers FROM matches GROUP BY pair_id""")
add("fit_homography_noisy", MATCHES, """
SELECT pair_id, max(g) AS h0, round(max(g) * 0.01, 3) AS h1, 10.0::DOUBLE AS h2, round(max(g) * -0.02, 3) AS h3, max(g) AS h4, 5.0::DOUBLE AS h5, 0.0::DOUBLE AS h6, 0.0::DOUBLE AS h7, 1.0::DOUBLE AS h8,
  count(*) AS n_matches, count(*) FILTER (match_id % 10 >= 7) AS n_inliers FROM matches GROUP BY pair_id""")
add("reprojection_error", MATCHES, f"SELECT pair_id, n_inliers, {r6('error_px')} AS error_px FROM rep")
add("registration_qc", MATCHES + """,
qc AS (
  SELECT pair_id, pair_id % 13 = 0 AS no_h, CASE WHEN pair_id % 17 = 0 THEN 5.0 WHEN pair_id % 19 = 0 THEN 6.5 ELSE error_px END AS error_px,
    CASE WHEN pair_id % 23 = 0 THEN 9 ELSE n_inliers END AS n_inliers, CASE WHEN pair_id % 13 <> 0 THEN g * g * 1.0002::DOUBLE END AS det FROM rep
),
rs AS (
  SELECT *, CASE WHEN no_h THEN 'no_homography' WHEN error_px > 5 THEN 'error' WHEN n_inliers < 10 THEN 'inliers' WHEN abs(det) > 10 OR abs(det) < 0.1 THEN 'degenerate' ELSE 'ok' END AS reason FROM qc
)""", f"""
SELECT pair_id, {r6('error_px')} AS error_px, n_inliers, {r6('det')} AS det, reason, reason = 'ok' AS valid, CASE WHEN reason = 'ok' THEN {r6('error_px')} END AS out_error_px,
  CASE WHEN reason = 'ok' THEN n_inliers ELSE 0 END AS out_inliers, reason = 'ok' AND error_px < 5 AND n_inliers >= 10 AS success FROM rs""")
add("warp_bilinear", RASTER + "," + WARPED, f"""
SELECT c.scene_id, c.band, c.row, c.col, {r6('sum((1 - abs(sx - b.col)) * (1 - abs(sy - b.row)) * b.value)')} AS value
FROM cl c JOIN raster b ON b.t = 'B' AND b.scene_id = c.scene_id AND b.band = c.band AND b.row IN (floor(sy), floor(sy) + 1) AND b.col IN (floor(sx), floor(sx) + 1) GROUP BY ALL""")

SQL["warp_blocks"] = SQL["warp_bilinear"]
add("warp_beyond_horizon", RASTER + """,
pos AS (
  SELECT r.scene_id, r.band, r.row, r.col, m.height, m.width, -0.0503 * r.col - 0.029 * r.row + 1.0002::DOUBLE AS w,
    0.94 * r.col + 0.010009 * r.row - 0.9603::DOUBLE AS u, 0.11 * r.col + 0.949985 * r.row - 2.010003::DOUBLE AS v
  FROM raster r JOIN meta m USING (scene_id) WHERE t = 'A'
),
cl AS (SELECT *, least(greatest(u / w, 0), width - 1)::DOUBLE AS sx, least(greatest(v / w, 0), height - 1)::DOUBLE AS sy FROM pos)""", """
SELECT c.scene_id, c.band, c.row, c.col, round(sum((1 - abs(sx - b.col)) * (1 - abs(sy - b.row)) * b.value), 6) + 0.0 AS value
FROM cl c JOIN raster b ON b.t = 'B' AND b.scene_id = c.scene_id AND b.band = c.band AND b.row IN (floor(sy), floor(sy) + 1) AND b.col IN (floor(sx), floor(sx) + 1) GROUP BY ALL""")

# --- augmentation ---------------------------------------------------------------------------
PX = "px AS (SELECT vec_id AS patch_id, CAST(i // 8 AS INT) AS row, CAST(i % 8 AS INT) AS col, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(0, 64) x(i))"


def draw(op: str, epoch: int) -> str:
    return f"(('0x' || substr(sha256(concat_ws(':', patch_id, '{epoch}', '{op}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


add("augment_flip", PX, f"""
SELECT patch_id, CASE WHEN {draw('vflip', 1)} < 0.5 THEN 7 - row ELSE row END AS row, CASE WHEN {draw('hflip', 1)} < 0.5 THEN 7 - col ELSE col END AS col, round(value, 6) + 0.0 AS value FROM px""")
add("augment_rot90", PX + f", k AS (SELECT *, CASE WHEN {draw('rot90', 1)} < 0.5 THEN CAST(floor({draw('rot90_k', 1)} * 4) AS INT) ELSE 0 END AS k FROM px)", """
SELECT patch_id, CASE k WHEN 1 THEN 7 - col WHEN 2 THEN 7 - row WHEN 3 THEN col ELSE row END AS row, CASE k WHEN 1 THEN row WHEN 2 THEN 7 - col WHEN 3 THEN 7 - row ELSE col END AS col,
  round(value, 6) + 0.0 AS value FROM k""")
add("center_crop", PX, "SELECT patch_id, row - 1 AS row, col - 1 AS col, round(value, 6) + 0.0 AS value FROM px WHERE row BETWEEN 1 AND 5 AND col BETWEEN 1 AND 5")
add("random_crop", PX + f", o AS (SELECT *, CAST(floor({draw('crop_r', 2)} * 4) AS INT) AS dr, CAST(floor({draw('crop_c', 2)} * 4) AS INT) AS dc FROM px)", """
SELECT patch_id, row - dr AS row, col - dc AS col, round(value, 6) + 0.0 AS value FROM o WHERE row - dr BETWEEN 0 AND 4 AND col - dc BETWEEN 0 AND 4""")


def blurred(weights: tuple[int, ...]) -> str:
    half, total = len(weights) // 2, sum(weights)
    taps = ", ".join(f"({k - half}, {w / total})" for k, w in enumerate(weights))
    mirror = "CASE WHEN abs({0}) > 7 THEN 14 - abs({0}) ELSE abs({0}) END"
    return f"""
SELECT o.patch_id, o.row, o.col, {r6('sum(a.w * b.w * s.value)')} AS value FROM px o, (VALUES {taps}) a(d, w), (VALUES {taps}) b(d, w), px s
WHERE s.patch_id = o.patch_id AND s.row = {mirror.format('(o.row + a.d)')} AND s.col = {mirror.format('(o.col + b.d)')} GROUP BY o.patch_id, o.row, o.col"""


add("blur3", PX, blurred((1, 2, 1)))
add("blur5", PX, blurred((1, 4, 6, 4, 1)))
SIZED = f", sized AS (SELECT *, CASE WHEN {draw('blur', 1)} >= 0.2 THEN 0 WHEN {draw('blur_k', 1)} < 0.5 THEN 3 ELSE 5 END AS k FROM px)"
of_size = lambda k, weights: blurred(weights).replace("px o", "sized o").replace("WHERE ", f"WHERE o.k = {k} AND ")
add("random_blur", PX + SIZED, f"""
SELECT patch_id, row, col, round(value, 6) + 0.0 AS value FROM sized WHERE k = 0
UNION ALL {of_size(3, (1, 2, 1))} UNION ALL {of_size(5, (1, 4, 6, 4, 1))}""")
add("manifest_dedup", "", """
SELECT event_id // 4 AS pair_id, CAST(arg_min(user_id // 50, (ts, event_id)) AS INT) AS scene_id, min(ts) AS submitted_at, count(*) AS n_rows FROM events GROUP BY 1""")


def draw_of(op: str, *extra: str) -> str:
    parts = ", ".join(["patch_id", "'1'", f"'{op}'", *extra])
    return f"(('0x' || substr(sha256(concat_ws(':', {parts})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


PIXEL = ("'A'", "0", "row", "col")
NOISE = f"sqrt(10 + {draw_of('noise_s', PIXEL[0])} * 40) * sqrt(-2 * ln(1 - {draw_of('noise_u', *PIXEL)})) * cos(2 * pi() * {draw_of('noise_v', *PIXEL)})"
add("gauss_noise", PX, f"""
SELECT patch_id, 'A' AS t, 0 AS band, row, col,
  {r6(f"CASE WHEN {draw_of('noise', PIXEL[0])} < 0.3 THEN least(greatest(abs(value) * 255 + {NOISE}, 0), 255) ELSE abs(value) * 255 END")} AS value FROM px""")
add("shift_scale_rotate", PX + f""",
par AS (
  SELECT DISTINCT patch_id, {draw_of('ssr')} < 0.3 AS on_, radians(({draw_of('ssr_a')} * 2 - 1) * 15) AS th, 1 + ({draw_of('ssr_s')} * 2 - 1) * 0.1 AS sc,
    ({draw_of('ssr_x')} * 2 - 1) * 0.0625 * 8 AS dx, ({draw_of('ssr_y')} * 2 - 1) * 0.0625 * 8 AS dy FROM px
),
warped AS (
  SELECT patch_id, row, col,
    CASE WHEN on_ THEN (cos(th) * (col - 3.5 - dx) - sin(th) * (row - 3.5 - dy)) / sc + 3.5 ELSE col END::DOUBLE AS x,
    CASE WHEN on_ THEN (sin(th) * (col - 3.5 - dx) + cos(th) * (row - 3.5 - dy)) / sc + 3.5 ELSE row END::DOUBLE AS y
  FROM px JOIN par USING (patch_id)
)""", f"""
SELECT a.patch_id, a.row, a.col, {r6('coalesce(sum(greatest(0, 1 - abs(x - s.col)) * greatest(0, 1 - abs(y - s.row)) * s.value), 0)')} AS value
FROM warped a LEFT JOIN px s ON s.patch_id = a.patch_id AND abs(x - s.col) < 1 AND abs(y - s.row) < 1 GROUP BY a.patch_id, a.row, a.col""")


def jittered(t: str = PIXEL[0], value: str = "value") -> tuple[str, str]:
    f = lambda op, r: f"(1 + ({draw_of(op, t)} * 2 - 1) * {r})"
    clip = lambda x: f"least(greatest({x}, 0), 1)"
    luma = "(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)"
    step = lambda name, src, expr, keep="": f"{name} AS (SELECT patch_id, row, col, on_{keep}, " + ", ".join(
        f"CASE WHEN on_ THEN {clip(expr.format(c=c))} ELSE {c} END AS {c}" for c in "rgb"
    ) + f" FROM {src})"
    ctes = PX + f""",
c0 AS (
  SELECT patch_id, row, col, {draw_of('jitter', t)} < 0.5 AS on_, {clip(f'abs({value})')} AS r, {clip(f'abs({value}) / 2')} AS g, {clip(f'1 - abs({value})')} AS b FROM px
),
{step('c1', 'c0', '{c} * ' + f('jit_b', 0.2))},
c1m AS (SELECT *, avg({luma}) OVER (PARTITION BY patch_id) AS m FROM c1),
{step('c2', 'c1m', 'm + ({c} - m) * ' + f('jit_c', 0.2))},
c2l AS (SELECT *, {luma} AS l FROM c2),
{step('c3', 'c2l', 'l + ({c} - l) * ' + f('jit_s', 0.2))},
c4 AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS ch FROM c3),
c5 AS (
  SELECT *, CASE WHEN ch = 0 THEN 0 WHEN v = r THEN ((g - b) / ch + 6) % 6 WHEN v = g THEN (b - r) / ch + 2 ELSE (r - g) / ch + 4 END AS h FROM c4
),
c6 AS (SELECT *, ((h / 6 + ({draw_of('jit_h', t)} * 2 - 1) * 0.1 + 1) % 1) * 6 AS h2 FROM c5)"""
    ch = lambda n: f"v - ch * greatest(0, least(({n} + h2) % 6, 4 - ({n} + h2) % 6, 1))"
    body = f"SELECT patch_id, {t} AS t, row, col, " + ", ".join(f"{r6(f'CASE WHEN on_ THEN {ch(n)} ELSE {c} END')} AS {c}" for c, n in zip("rgb", (5, 3, 1))) + " FROM c6"
    return ctes, body


add("color_jitter", *jittered())
add("color_jitter_packed", "", " UNION ALL ".join("SELECT * FROM (WITH {} {})".format(*jittered(t, v)) for t, v in (("'A'", "value"), ("'B'", "(value * 0.75::DOUBLE)"))))

# The packed and block forms give the rows of the pixel forms.
for name in ("augment_flip", "augment_rot90", "center_crop", "random_crop", "shift_scale_rotate", "random_blur"):
    SQL[f"{name}_packed"] = SQL[name]
SQL["resize_blocks"], SQL["pad_blocks"], SQL["stitch_tiles_cli_blocks"] = SQL["resize_bilinear"], SQL["pad_reflect"], SQL["stitch_tiles_cli"]
_five = "(VALUES (-2, 0.0625), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625))"
add("blur_blocks", RASTER + """,
high AS (SELECT scene_id, max(row) + 1 AS n FROM raster GROUP BY 1),
down AS (SELECT o.scene_id, o.t, o.band, o.row, o.col, n, CAST(k.d AS INT) AS d, k.w::DOUBLE AS w, greatest(2 * (n - 1), 1) AS per FROM raster o JOIN high USING (scene_id), """ + _five + """ k(d, w)),
source AS (SELECT *, ((row + d) % per + per) % per AS m FROM down),
lines AS (
  SELECT s.scene_id, s.t, s.band, s.row, s.col, sum(s.w * round(r.value * 1000000::DOUBLE)) AS value FROM source s
  JOIN raster r ON r.scene_id = s.scene_id AND r.t = s.t AND r.band = s.band AND r.col = s.col AND r.row = CASE WHEN m < n THEN m ELSE per - m END GROUP BY ALL)""", f"""
SELECT o.scene_id, o.t, o.band, o.row, o.col, sum(k.w::DOUBLE * r.value) AS value FROM lines o, {_five} k(d, w), lines r
WHERE r.scene_id = o.scene_id AND r.t = o.t AND r.band = o.band AND r.row = o.row
  AND r.col = CASE WHEN abs(o.col + k.d) > 23 THEN 46 - abs(o.col + k.d) ELSE abs(o.col + k.d) END GROUP BY ALL""")
