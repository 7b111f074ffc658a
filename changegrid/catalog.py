"""Named queries: every operator applied to the given tables.

Each query takes (spark, sf_dir) and returns a DataFrame over the whole table it reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import expr

from changegrid import fixtures as fx
from changegrid.functions import expr as X
from changegrid.functions import geometry as geo
from changegrid.functions.expr import r6
from changegrid.operators import augment, dataset, detections as det, metrics, packed, polygons, raster as ras
from changegrid.operators import regions as reg, registration as rgs, runlog, scoring, stencil, tiling
from changegrid.plans.change_detection import DETECTION_ID, detect_changes, detect_changes_aligned
from changegrid.plans.lineage import cut, shared_folder
from changegrid.sources import images
from changegrid.sources import detections as store
from changegrid.sources import rasters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Scene and tile sizes of the derived rasters.
BLOCK = dict(n_bands=fx.BANDS, block_h=fx.BLOCK_H, block_w=fx.COLS)
TILE, OVERLAP = 16, 4
STRIDE = TILE - OVERLAP
MIN_AREA = 4
_TABLES: dict[tuple, DataFrame] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _stored(spark: SparkSession, sf: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A product table, written once per session and read by the queries on it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _TABLES:
        _TABLES[key] = cut(build(spark, sf))
    return _TABLES[key]


def scene_meta(spark, sf):
    """The scene catalogue as a stored table, so joins on it are planned with its true size."""
    return _stored(spark, sf, "meta", fx.scene_meta)


def raster_blocks(spark, sf):
    """The image archive: the derived raster as a stored block table."""
    return _stored(spark, sf, "raster", fx.raster_blocks)


def raster(spark, sf):
    return ras.block_pixels(raster_blocks(spark, sf), fx.BLOCK_H, fx.COLS)


def score_map(spark, sf):
    return _stored(spark, sf, "scores", lambda s, d: scoring.score_blocks(raster_blocks(s, d), fx.BANDS))


def prob(spark, sf):
    return scoring.score_pixels(score_map(spark, sf), fx.BLOCK_H, fx.COLS)


def mask(spark, sf):
    return prob(spark, sf).where(X.threshold("p")).select("scene_id", "row", "col")


def labelled(spark, sf, connectivity=4):
    name = f"labelled{connectivity}"
    return _stored(spark, sf, name, lambda s, d: reg.label_components(mask(s, d), connectivity))


def detection_table(spark, sf):
    return _stored(spark, sf, "detections", detect)


def detect(spark, sf):
    return detect_changes(fx.raster_blocks(spark, sf), scene_meta(spark, sf), min_area_px=MIN_AREA, **BLOCK)


def unit_raster(spark, sf):
    """Raster values brought near [0,1]."""
    return raster(spark, sf).withColumn("value", expr("value / 500D"))


def mixed_meta(spark, sf):
    """Scene catalogue with single-band scenes and declared nodata on odd ids."""
    return scene_meta(spark, sf).withColumns(
        {"band_count": expr("if(scene_id % 2 = 1, 1, 5)"), "nodata": expr("if(scene_id % 2 = 1, 0D, null)")}
    )


def part_sizes(spark, sf):
    """Many image sizes, one per part."""
    return fx.table(spark, sf, "part").selectExpr(
        "int(p_partkey) as scene_id", "int(1 + p_partkey * 13 % 1500) as height", "int(1 + p_partkey * p_size % 1100) as width"
    )


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: expr(r6(c)) for c in cols})


DETECTION_DOUBLES = (
    "area_m2", "centroid_x", "centroid_y", "bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy", "perimeter_m", "mean_confidence"
)


# --- scans, sources, sinks ------------------------------------------------------------------

@query
def raster_scan(spark, sf):
    return rasters.raster_scan(raster_blocks(spark, sf), scene_meta(spark, sf)).selectExpr(
        "scene_id", "t", "band", "block_row", "width", "height", "epsg", "resolution_m", "has_geo",
        f"{r6('aggregate(data, 0D, (s, x) -> s + x)')} as total",
    )


@query
def rgb_bands(spark, sf):
    return _round(ras.rgb_bands(raster(spark, sf), mixed_meta(spark, sf)), "value")


@query
def missing_assets(spark, sf):
    docs = fx.table(spark, sf, "documents")
    split = "element_at(array('train', 'val', 'test'), int(doc_id % 3) + 1)"
    side = "case when n_chars % 4 = 0 then 'B' when n_chars % 4 = 1 then 'label' else 'A' end"
    listing = docs.selectExpr("concat(source, '-', lang) as dataset", f"concat({split}, '/', {side}) as rel_dir")
    expected = docs.selectExpr("concat(source, '-', lang) as dataset").distinct().selectExpr(
        "dataset", "explode(array('train', 'val', 'test')) as s"
    ).selectExpr("dataset", "explode(array(concat(s, '/A'), concat(s, '/B'), concat(s, '/label'))) as rel_dir")
    return dataset.missing_assets(expected, listing)


@query
def sha_prefix(spark, sf):
    return images.digest_prefix(fx.table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "digest")


@query
def change_map(spark, sf):
    return _round(rasters.change_map(prob(spark, sf)), "value")


@query
def change_map_cli(spark, sf):
    return _round(rasters.change_map(prob(spark, sf), layout="cli"), "value")


@query
def prob_uint8(spark, sf):
    return rasters.prob_bytes(prob(spark, sf))


@query
def geojson_features(spark, sf):
    """Features as GeoJSON text, with a few fields read back from the text."""
    shapes = polygons.polygonize(labelled(spark, sf), scene_meta(spark, sf), min_area_px=MIN_AREA)
    rows = detection_table(spark, sf).join(shapes.select("scene_id", "region_id", "polygons"), ["scene_id", "region_id"])
    ring = "from_json(get_json_object(feature, '$.geometry.coordinates'), 'array<array<array<double>>>')[0]"
    return det.geojson_features(rows).selectExpr("detection_id", "feature", f"{ring} as ring").selectExpr(
        "detection_id",
        "get_json_object(feature, '$.type') as type",
        "get_json_object(feature, '$.geometry.type') as geometry_type",
        "double(get_json_object(feature, '$.properties.area_m2')) as area_m2",
        "array_min(transform(ring, q -> q[0])) as minx",
        "array_max(transform(ring, q -> q[1])) as maxy",
        "ring[0] = ring[size(ring) - 1] as closed",
    )


@query
def detections_insert(spark, sf):
    """Old rows lack the perimeter, new rows carry a note; ids already stored are skipped."""
    d = _round(detection_table(spark, sf), *DETECTION_DOUBLES)
    old = store.complete(d.where("region_id % 2 = 0").drop("perimeter_m"), 32633)
    new = store.complete(d.selectExpr("*", "'rerun' as note"), 32633)
    return store.merge(old, new, dedup=True).drop("created_at")


@query
def detections_two_dates(spark, sf):
    """A later date pair of the same scenes adds its detections beside the earlier ones."""
    first = store.complete(_round(detection_table(spark, sf), *DETECTION_DOUBLES), 32633)
    later = first.withColumn("timestamp_b", expr("'2024-02-01'")).withColumn("detection_id", expr(DETECTION_ID))
    return store.merge(first, later, dedup=True).drop("created_at")


@query
def detections_all(spark, sf):
    return _round(detection_table(spark, sf), *DETECTION_DOUBLES)


@query
def scene_summary(spark, sf):
    errors = rgs.reprojection_error(fx.matches(spark, sf), fx.known_homographies(spark, sf))
    reg_table = errors.selectExpr("int(pair_id) as scene_id", "error_px", "n_inliers")
    return det.scene_summary(detection_table(spark, sf), reg_table).withColumn("registration_error_px", expr("registration_error_px + 0D"))


@query
def evaluation_rows(spark, sf):
    m = metrics.cd_metrics(fx.predictions(spark, sf))
    n = fx.table(spark, sf, "labels").agg(expr("count(1) as n_samples"))
    rows = metrics.evaluation_rows(m, "checkpoints/best.pt", "test", 0.5, n, "resnet18")
    return _round(rows, "f1", "iou", "precision", "recall", "accuracy", "kappa")


@query
def history_explode(spark, sf):
    runs = fx.runs(spark, sf).groupBy("run_id").agg(expr("array_sort(collect_list(struct(epoch, val_f1, val_loss))) as e"))
    hist = runs.selectExpr("run_id", "transform(e, x -> x.val_f1) as val_f1", "transform(e, x -> x.val_loss) as val_loss")
    return _round(runlog.explode_history(hist), "val_f1", "val_loss")


# --- projections ----------------------------------------------------------------------------

@query
def to_uint8(spark, sf):
    return unit_raster(spark, sf).selectExpr("scene_id", "t", "band", "row", "col", f"{X.to_uint8('value')} as byte")


@query
def rgb_composite(spark, sf):
    return ras.rgb_composite(unit_raster(spark, sf), mixed_meta(spark, sf), (3, 1, 0))


@query
def percentile_stretch(spark, sf):
    out = ras.stretch_blocks(raster_blocks(spark, sf), ["scene_id", "t", "band"])
    return _round(ras.block_pixels(out, fx.BLOCK_H, fx.COLS), "value")


@query
def percentile_stretch_255(spark, sf):
    out = ras.stretch(raster(spark, sf), ["scene_id", "t", "band"], scale=255.0, floor_max=1.0)
    return out.selectExpr("scene_id", "t", "band", "row", "col", "int(floor(stretched)) as byte")


@query
def normalize_bands(spark, sf):
    return unit_raster(spark, sf).where("band < 3").selectExpr(
        "scene_id", "t", "band", "row", "col", f"{r6(X.normalize('value', 'band'))} as value"
    )


@query
def denormalize_bands(spark, sf):
    n = unit_raster(spark, sf).where("band < 3").withColumn("value", expr(X.normalize("value", "band")))
    return n.selectExpr("scene_id", "t", "band", "row", "col", f"{X.denormalize('value', 'band')} as byte")


@query
def label_binarize(spark, sf):
    return raster(spark, sf).selectExpr(
        "scene_id", "t", "band", "row", "col", f"{X.binarize_label('value')} as label", f"{X.binarize_label('value', on=255)} as byte"
    )


@query
def threshold_mask(spark, sf):
    return prob(spark, sf).selectExpr("scene_id", "row", "col", f"int({X.threshold('p')}) as strict", f"int({X.threshold('p', 1.0, True)}) as inclusive")


@query
def pixel_to_world(spark, sf):
    x, y = X.pixel_to_world("row", "col")
    return ras.with_geo(prob(spark, sf), scene_meta(spark, sf)).selectExpr("scene_id", "row", "col", f"{r6(x)} as x", f"{r6(y)} as y")


@query
def world_to_pixel(spark, sf):
    x, y = X.pixel_to_world("row", "col")
    r, c = X.world_to_pixel("(x + 13.25D)", "(y + 8.5D)")
    geo = ras.with_geo(prob(spark, sf), scene_meta(spark, sf)).selectExpr("*", f"{x} as x", f"{y} as y")
    return geo.selectExpr("scene_id", "row", "col", f"{r} as to_row", f"{c} as to_col")


@query
def pixel_area(spark, sf):
    m = scene_meta(spark, sf).withColumns({"resolution_m": expr("if(scene_id % 2 = 1, 2.5D, null)"), "a": expr("if(scene_id % 3 = 2, 0D, a)")})
    m = ras.classify_crs(m.withColumn("epsg", expr("if(scene_id % 2 = 0, 4326, epsg)")))
    return m.selectExpr("scene_id", f"{X.pixel_area_m2()} as pixel_area", f"{X.pixel_size_m('is_geographic')} as pixel_size")


@query
def crs_classify(spark, sf):
    epsg = "element_at(array(4326, 32633, 3857, 4269, 2154, 9999, null), int(s_suppkey % 7) + 1)"
    return ras.classify_crs(fx.table(spark, sf, "supplier").selectExpr("s_suppkey", f"{epsg} as epsg"))


@query
def crs_systems(spark, sf):
    """Codes that a table of systems explains, beside common and unknown ones."""
    systems = fx.table(spark, sf, "nation").selectExpr("int(3030 + n_nationkey) as epsg", "if(n_regionkey % 2 = 0, 'geographic', 'projected') as kind")
    epsg = "case s_suppkey % 4 when 0 then 32633 when 1 then 4326 else int(3030 + s_nationkey * 2) end"
    return ras.classify_crs(fx.table(spark, sf, "supplier").selectExpr("s_suppkey", f"{epsg} as epsg"), systems=systems)


@query
def rgb_to_gray(spark, sf):
    return _round(ras.to_gray(raster(spark, sf)), "gray")


@query
def patch_ids(spark, sf):
    return (
        fx.table(spark, sf, "lineitem")
        .selectExpr("l_orderkey", "l_linenumber", f"{X.patch_id('l_orderkey', 'l_partkey * 7')} as patch_id")
        .selectExpr("*", f"{X.image_of_patch('patch_id')} as image_id")
    )


@query
def confidence_band(spark, sf):
    d = detection_table(spark, sf).selectExpr("detection_id", "if(region_id % 5 = 0, null, mean_confidence) as mean_confidence", "if(region_id % 2 = 0, 0D, 0.9D) as confidence")
    return det.with_confidence_colour(d).select("detection_id", "colour")


@query
def detection_result(spark, sf):
    """Nested result documents, with fields read back from the JSON text."""
    return det.result_json(detection_table(spark, sf)).selectExpr(
        "detection_id",
        "double(get_json_object(document, '$.area_m2')) as area_m2",
        f"{r6("double(get_json_object(document, '$.bbox.minx'))")} as minx",
        f"{r6("double(get_json_object(document, '$.bbox.maxy'))")} as maxy",
        f"{r6("double(get_json_object(document, '$.mean_confidence'))")} as mean_confidence",
        "get_json_object(document, '$.timestamp_a') as timestamp_a",
        "get_json_object(document, '$.created_at') as created_at",
    )


@query
def diff_concat(spark, sf):
    return _round(scoring.diff_features(raster(spark, sf)), "value_a", "value_b", "diff")


# --- file listings --------------------------------------------------------------------------

def _listing(spark, sf):
    """Paths of an image archive with one file per document."""
    suffix = "array('.tif', '.JP2', '.png', '.jpeg', '.txt', '.img', '.png')[doc_id % 7]"
    split = "array('train', 'val', 'test')[doc_id % 3]"
    side = "array('A', 'B', 'label')[n_chars % 3]"
    return fx.table(spark, sf, "documents").selectExpr("doc_id", f"concat('/data/', source, '/', {split}, '/', {side}, '/', doc_id, if(doc_id % 2 = 0, '_A', '_B'), {suffix}) as path")


@query
def route_files(spark, sf):
    return images.route_files(_listing(spark, sf))


@query
def image_ids(spark, sf):
    return images.image_ids(_listing(spark, sf), "B")


@query
def split_layout(spark, sf):
    return images.split_layout(_listing(spark, sf))


@query
def suffix_pairs(spark, sf):
    return images.suffix_pairs(_listing(spark, sf))


@query
def wrap_features(spark, sf):
    """Records with and without geometry; the feature is read back by path."""
    records = fx.table(spark, sf, "documents").selectExpr(
        "doc_id", "lang", "if(doc_id % 3 = 0, null, concat('{\"type\":\"Point\",\"coordinates\":[', doc_id % 180, ',', n_chars % 90, ']}')) as geometry"
    )
    part = lambda path, name: f"get_json_object(feature, '$.{path}') as {name}"
    return det.wrap_features(records).selectExpr(
        part("type", "type"), part("geometry.coordinates", "coordinates"), f"bigint(get_json_object(feature, '$.properties.doc_id')) as doc_id", part("properties.lang", "lang")
    )


# --- filters --------------------------------------------------------------------------------

@query
def area_filter(spark, sf):
    return _round(det.area_filter(detection_table(spark, sf), 700.0), *DETECTION_DOUBLES)


@query
def detection_by_id(spark, sf):
    d = detection_table(spark, sf)
    return _round(det.by_ids(d, d.agg(expr("min(detection_id) as detection_id"))), *DETECTION_DOUBLES)


@query
def bbox_query(spark, sf):
    return det.bbox_query(detection_table(spark, sf), 500050.0, 4599600.0, 510150.0, 4599900.0).select("detection_id")


@query
def bbox_query_exact(spark, sf):
    """Only regions whose envelope meets the box are outlined."""
    box = (500063.0, 4599603.0, 510147.0, 4599887.0)
    near = det.bbox_query(detection_table(spark, sf), *box)
    pixels = labelled(spark, sf).join(near.select("scene_id", "region_id"), ["scene_id", "region_id"], "left_semi")
    shapes = polygons.polygonize(pixels, scene_meta(spark, sf), min_area_px=MIN_AREA)
    rows = near.join(shapes.select("scene_id", "region_id", "polygons"), ["scene_id", "region_id"])
    return det.bbox_query(rows, *box).select("detection_id")


@query
def valid_pixels(spark, sf):
    return _round(ras.valid_pixels(raster(spark, sf), mixed_meta(spark, sf)), "value")


@query
def rejected_pairs(spark, sf):
    cust = fx.table(spark, sf, "customer")
    listing = cust.where("c_acctbal >= 0").selectExpr("concat('A/', c_custkey) as path").unionByName(
        cust.where("c_nationkey % 2 = 0").selectExpr("concat('B/', c_custkey) as path")
    )
    m = fx.table(spark, sf, "orders").selectExpr("o_orderkey as pair_id", "concat('A/', o_custkey) as img_a", "concat('B/', o_custkey) as img_b")
    return dataset.rejected_pairs(m, listing)


@query
def subset_n(spark, sf):
    ids = fx.table(spark, sf, "documents").selectExpr("doc_id as image_id")
    return dataset.first_n(ids, 100).selectExpr("image_id", "'train' as part").unionByName(
        dataset.first_n(ids, 100, quarter=True).selectExpr("image_id", "'val' as part")
    )


# --- joins ----------------------------------------------------------------------------------

@query
def pair_triplets(spark, sf):
    docs = fx.table(spark, sf, "documents")
    labels = fx.table(spark, sf, "labels").selectExpr("doc_id as image_id", "quality")
    return dataset.pair_triplets(
        docs.selectExpr("doc_id as image_id", "n_chars as size_a"), docs.where("n_chars % 5 <> 0").selectExpr("doc_id as image_id", "lang as lang_b"), labels
    )


@query
def incomplete_triplets(spark, sf):
    docs = fx.table(spark, sf, "documents")
    assets = (
        docs.selectExpr("doc_id as image_id", "'A' as side")
        .unionByName(docs.where("n_chars % 5 <> 0").selectExpr("doc_id as image_id", "'B' as side"))
        .unionByName(fx.table(spark, sf, "labels").selectExpr("doc_id as image_id", "'label' as side"))
    )
    return dataset.incomplete_triplets(assets)


@query
def tile_pairs(spark, sf):
    tiles = tiling.split_blocks(raster_blocks(spark, sf), scene_meta(spark, sf), fx.BLOCK_H, fx.COLS, TILE, OVERLAP)
    total = "aggregate(zip_with(data_a, data_b, (a, b) -> abs(a - b)), 0D, (s, x) -> s + x)"
    return tiling.tile_pairs(tiles).selectExpr("scene_id", "band", "tile_row", "tile_col", f"{r6(total)} as total_diff")


@query
def shape_mismatches(spark, sf):
    sizes = part_sizes(spark, sf).selectExpr(
        "scene_id", "explode(array(struct('A' as t, height as h, width as w), struct('B' as t, height + int(scene_id % 9 = 0) as h, width as w))) as s"
    ).selectExpr("scene_id", "s.t as t", "s.h as height", "s.w as width").where("not (t = 'B' and scene_id % 14 = 0)")
    return tiling.shape_mismatches(sizes)


@query
def neighbour_edges(spark, sf):
    return reg.neighbour_edges(mask(spark, sf), 8)


@query
def zonal_mean(spark, sf):
    regions = reg.summarize_regions(labelled(spark, sf), MIN_AREA)
    out = reg.region_confidence(regions, score_map(spark, sf), scene_meta(spark, sf), fx.BLOCK_H, fx.COLS)
    return _round(out, "mean_confidence")


@query
def zonal_mean_blocked(spark, sf):
    """Zones of eight pixels, so that windows have whole zones inside."""
    scores = ras.pack_blocks(score_raster(spark, sf), 8, 8)
    regions = reg.summarize_regions(labelled(spark, sf), MIN_AREA)
    return _round(reg.region_confidence(regions, scores, scene_meta(spark, sf), 8, 8, zone_side=8), "mean_confidence")


@query
def zonal_mean_plain(spark, sf):
    """Odd scenes have no geotransform and fall back on their mean."""
    meta = scene_meta(spark, sf).withColumn("a", expr("if(scene_id % 2 = 1, null, a)"))
    regions = reg.summarize_regions(labelled(spark, sf), MIN_AREA)
    return _round(reg.region_confidence(regions, score_map(spark, sf), meta, fx.BLOCK_H, fx.COLS), "mean_confidence")


@query
def knn2(spark, sf):
    return _round(rgs.knn2(fx.descriptors(spark, sf)), "dist")


@query
def ratio_matches(spark, sf):
    return _round(rgs.ratio_matches(rgs.knn2(fx.descriptors(spark, sf))), "d1", "d2")


@query
def aoi_join(spark, sf):
    """Areas of interest around the suppliers; every seventh one covers a few scenes."""
    aois = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey as aoi_id", "500000D + (s_suppkey * 37) % 40000 as x", "4599500D + (s_suppkey * 13) % 500 as y",
        "if(s_suppkey % 7 = 0, 15000D, 40D + (s_suppkey % 11) * 90D) as r",
    ).selectExpr("aoi_id", "x - r as minx", "y - r as miny", "x + r as maxx", "y + r as maxy")
    return det.aoi_join(detection_table(spark, sf), aois)


# --- aggregations ---------------------------------------------------------------------------

_SIX = ("f1", "iou", "precision", "recall", "accuracy", "kappa")


@query
def cd_metrics(spark, sf):
    return _round(metrics.cd_metrics(fx.predictions(spark, sf)), *_SIX)


@query
def cd_metrics_by_config(spark, sf):
    return _round(metrics.cd_metrics(fx.predictions(spark, sf), ["config"]), *_SIX)


@query
def sample_f1(spark, sf):
    return _round(metrics.sample_f1(fx.predictions(spark, sf)), "f1")


@query
def dice_loss(spark, sf):
    return _round(metrics.dice_loss(fx.predictions(spark, sf), ["config"]), "dice_loss")


@query
def bce_dice_loss(spark, sf):
    return _round(metrics.bce_dice_loss(fx.predictions(spark, sf), ["config"]), "bce", "dice_loss", "loss")


@query
def focal_dice_loss(spark, sf):
    return _round(metrics.focal_dice_loss(fx.predictions(spark, sf), ["config"]), "focal", "dice_loss", "loss")


@query
def target_verdict(spark, sf):
    return _round(metrics.target_verdict(metrics.cd_metrics(fx.predictions(spark, sf))), "f1", "iou")


@query
def split_counts(spark, sf):
    rows = fx.table(spark, sf, "orders").selectExpr("if(o_orderpriority like '1%', 'train', 'test') as split")
    return dataset.split_counts(rows)


@query
def change_pct(spark, sf):
    return _round(metrics.change_pct(prob(spark, sf).selectExpr("scene_id", f"double({X.threshold('p', 0.5, True)}) as changed")), "change_pct")


@query
def detection_stats(spark, sf):
    return _round(det.stats(detection_table(spark, sf)), "total_area", "avg_confidence")


@query
def detections_extent(spark, sf):
    return _round(det.extent(detection_table(spark, sf)), "minx", "miny", "maxx", "maxy")


@query
def f1_summary(spark, sf):
    return _round(metrics.f1_summary(metrics.sample_f1(fx.predictions(spark, sf))), "mean_f1", "worst_f1", "best_f1")


@query
def epoch_loss(spark, sf):
    steps = fx.table(spark, sf, "lineitem").selectExpr("l_suppkey as run_id", "year(l_shipdate) as epoch", "1 - l_discount * 5 - l_tax as loss")
    return _round(runlog.epoch_loss(steps), "epoch_loss")


@query
def status_counts(spark, sf):
    log = fx.table(spark, sf, "orders").selectExpr("case o_orderstatus when 'F' then 'complete' when 'O' then 'queued' else 'running' end as status")
    return det.status_counts(log)


# --- windows, sorting, top-k ----------------------------------------------------------------

@query
def crop_patches(spark, sf):
    return _round(tiling.crop_patches(raster(spark, sf), scene_meta(spark, sf), 7), "value")


@query
def image_split(spark, sf):
    return dataset.image_split(fx.table(spark, sf, "orders").selectExpr("o_orderkey as image_id"))


@query
def image_split_hashed(spark, sf):
    return dataset.image_split_hashed(fx.table(spark, sf, "orders").selectExpr("o_orderkey as image_id"))


@query
def best_epoch(spark, sf):
    return _round(runlog.best_epoch(fx.runs(spark, sf)), "best_score")


@query
def topk_checkpoints(spark, sf):
    return _round(runlog.topk_checkpoints(fx.runs(spark, sf)), "val_f1")


@query
def early_stop(spark, sf):
    return _round(runlog.early_stop(fx.runs(spark, sf)), "accepted_best")


@query
def regions(spark, sf):
    out = reg.extract_regions(mask(spark, sf), MIN_AREA, 8)
    return _round(out, "centroid_row", "centroid_col").drop("h_edges", "v_edges")


@query
def regions_blocked(spark, sf):
    """The same regions put together from blocks of eight pixels, two by two."""
    labels = reg.label_components(mask(spark, sf), 8, block=8, fan=2)
    return _round(reg.summarize_regions(labels, MIN_AREA), "centroid_row", "centroid_col").drop("h_edges", "v_edges")


@query
def empty_mask(spark, sf):
    """No pixel passes: no region."""
    none = prob(spark, sf).where(X.threshold("p", 2.0)).select("scene_id", "row", "col")
    return reg.extract_regions(none, MIN_AREA).select("scene_id", "region_id", "pixel_count")


@query
def worst_samples(spark, sf):
    return _round(metrics.worst_samples(metrics.sample_f1(fx.predictions(spark, sf))), "f1")


@query
def detection_list(spark, sf):
    return _round(det.listing(detection_table(spark, sf)), "area_m2", "confidence")


@query
def run_comparison(spark, sf):
    rows = fx.predictions(spark, sf)
    return _round(metrics.run_comparison(rows, "config", "sample_id", "src0"), "f1", "iou", "base_f1", "drop")


@query
def threshold_sweep(spark, sf):
    return _round(metrics.threshold_sweep(fx.predictions(spark, sf), [k / 20 for k in range(1, 20)]), *_SIX)


@query
def leakage_check(spark, sf):
    split = "case when o_orderkey % 20 < 14 then 'train' when o_orderkey % 20 < 17 then 'val' else 'test' end"
    return dataset.leakage(fx.table(spark, sf, "orders").selectExpr("o_orderkey div 4 as image_id", f"{split} as split"))


# --- tiling ---------------------------------------------------------------------------------

@query
def compute_pad(spark, sf):
    cover = tiling.compute_pad(part_sizes(spark, sf), 256, 224)
    cli = tiling.compute_pad(part_sizes(spark, sf), 256, 192, "cli").selectExpr("scene_id", "pad_h as cli_pad_h", "pad_w as cli_pad_w")
    return cover.join(cli, "scene_id")


@query
def grid_shape(spark, sf):
    return tiling.grid_shape(part_sizes(spark, sf), 256, 32)


@query
def route_scenes(spark, sf):
    return tiling.route_scenes(part_sizes(spark, sf))


@query
def pad_reflect(spark, sf):
    meta = scene_meta(spark, sf)
    sizes = meta.selectExpr("scene_id", "height", "width", f"{X.pad_amount('height', TILE, STRIDE)} as pad_h", f"{X.pad_amount('width', TILE, STRIDE)} as pad_w")
    return _round(tiling.pad_pixels(raster(spark, sf), sizes), "value")


@query
def pad_multiple(spark, sf):
    sizes = scene_meta(spark, sf).selectExpr("scene_id", "height", "width", f"{X.pad_to_multiple('height')} as pad_h", f"{X.pad_to_multiple('width')} as pad_w")
    return _round(tiling.pad_pixels(raster(spark, sf), sizes), "value")


@query
def split_tiles(spark, sf):
    return _round(tiling.split_tiles(raster(spark, sf), scene_meta(spark, sf), TILE, OVERLAP), "value")


def score_raster(spark, sf):
    return prob(spark, sf).selectExpr("scene_id", "'A' as t", "0 as band", "row", "col", "p as value")


@query
def stitch_tiles(spark, sf):
    """Block layout throughout: split the stored score blocks with halo, blend, unpack."""
    meta = scene_meta(spark, sf)
    blocks = score_map(spark, sf).selectExpr("scene_id", "'A' as t", "0 as band", "block_row", "block_col", "h", "w", "data")
    tiles = tiling.split_blocks(blocks, meta, fx.BLOCK_H, fx.COLS, TILE, OVERLAP)
    out = ras.block_pixels(tiling.stitch_blocks(tiles, meta, TILE, OVERLAP), STRIDE, STRIDE)
    return out.selectExpr("scene_id", "row", "col", f"{r6('value')} as p")


@query
def stitch_tiles_cli(spark, sf):
    meta = scene_meta(spark, sf)
    tiles = tiling.split_tiles(score_raster(spark, sf), meta, TILE, OVERLAP, rule="cli")
    return _round(tiling.stitch_tiles(tiles, meta, TILE, OVERLAP, "value", "cli", canvas=prob(spark, sf)), "p")


@query
def resize_bilinear(spark, sf):
    ids = fx.table(spark, sf, "embeddings").selectExpr("int(vec_id div 25) as scene_id").distinct()
    sizes = ids.selectExpr("scene_id", "40 as height", "40 as width", "56 as out_h", "64 as out_w")
    px = fx.patch_scenes(spark, sf).where("t = 'B'")
    return _round(tiling.resize_bilinear(px, sizes, ("scene_id", "t")), "value")


@query
def stitch_tiles_cli_blocks(spark, sf):
    """The command-line tiler in block layout throughout."""
    meta = scene_meta(spark, sf)
    blocks = score_map(spark, sf).selectExpr("scene_id", "'A' as t", "0 as band", "block_row", "block_col", "h", "w", "data")
    tiles = tiling.split_blocks(blocks, meta, fx.BLOCK_H, fx.COLS, TILE, OVERLAP, rule="cli")
    out = ras.block_pixels(tiling.stitch_blocks(tiles, meta, TILE, OVERLAP, rule="cli"), STRIDE, STRIDE)
    return out.selectExpr("scene_id", "row", "col", f"{r6('value')} as p")


@query
def resize_blocks(spark, sf):
    blocks = fx.patch_scene_blocks(spark, sf).where("t = 'B'")
    sizes = blocks.select("scene_id").distinct().selectExpr("scene_id", "40 as height", "40 as width", "56 as out_h", "64 as out_w")
    out = stencil.resize_blocks(blocks, sizes, 8, 8, ("scene_id", "t"))
    return _round(ras.block_pixels(out, 8, 8), "value")


@query
def pad_blocks(spark, sf):
    """`pad_reflect` in block layout."""
    meta = scene_meta(spark, sf)
    sizes = meta.selectExpr("scene_id", "height", "width", f"{X.pad_amount('height', TILE, STRIDE)} as pad_h", f"{X.pad_amount('width', TILE, STRIDE)} as pad_w")
    out = stencil.pad_blocks(raster_blocks(spark, sf), sizes, fx.BLOCK_H, fx.COLS)
    return _round(ras.block_pixels(out, fx.BLOCK_H, fx.COLS), "value")


@query
def blur_blocks(spark, sf):
    """Whole scenes blurred in block layout, rims exchanged; in millionths, so that sums are exact in any order."""
    blocks = raster_blocks(spark, sf).withColumn("data", expr("transform(data, v -> round(v * 1000000D))"))
    return ras.block_pixels(stencil.blur_blocks(blocks, scene_meta(spark, sf), fx.BLOCK_H, fx.COLS, 5), fx.BLOCK_H, fx.COLS)


@query
def explode_pixels(spark, sf):
    return _round(ras.block_pixels(raster_blocks(spark, sf), fx.BLOCK_H, fx.COLS), "value")


@query
def pack_blocks(spark, sf):
    out = ras.pack_blocks(raster(spark, sf), 16, 16)
    return out.selectExpr(
        "scene_id", "t", "band", "block_row", "block_col", "h", "w", "size(data) as n",
        f"{r6('aggregate(transform(data, (x, i) -> x * (i + 1)), 0D, (s, x) -> s + x)')} as checksum",
    )


# --- scoring --------------------------------------------------------------------------------

@query
def change_score(spark, sf):
    return _round(scoring.change_score(raster_blocks(spark, sf), **BLOCK), "p")


def _ratio_model():
    import numpy as np

    def predict(a, b):
        d = np.abs(a - b)
        return d / (1.0 + d)

    return predict


@query
def score_tiles(spark, sf):
    tiles = tiling.split_blocks(raster_blocks(spark, sf), scene_meta(spark, sf), fx.BLOCK_H, fx.COLS, TILE, OVERLAP)
    scored = scoring.score_tiles(tiling.tile_pairs(tiles), _ratio_model, TILE * TILE)
    return scored.selectExpr("scene_id", "band", "tile_row", "tile_col", "round(aggregate(prob, 0D, (s, x) -> s + double(x)) / size(prob), 3) as mean_prob")


@query
def learned_scorer(spark, sf):
    """Changed pixels of the region table as labels; every fifth line is held out."""
    changed = labelled(spark, sf).selectExpr("scene_id", "row", "col", "1 as label")
    bands = [f"max(if(band = {b}, diff, null)) as diff{b}" for b in range(fx.BANDS)]
    features = cut(
        scoring.diff_features(raster(spark, sf)).groupBy("scene_id", "row", "col").agg(*map(expr, bands))
        .join(changed, ["scene_id", "row", "col"], "left").fillna({"label": 0})
    )
    model = scoring.learned_scorer(features.where("(scene_id + row) % 5 <> 0"), columns=[f"diff{b}" for b in range(fx.BANDS)])
    judged = model.transform(features).selectExpr("if((scene_id + row) % 5 = 0, 'held_out', 'train') as split", "label", "int(prediction) as predicted")
    return judged.groupBy("split").agg(
        expr("count(1) as n"), expr("sum(label) as changed"), expr("avg(if(label = predicted, 1D, 0D)) > 0.8 as accurate"),
        expr("coalesce(avg(if(label = 1, double(predicted), null)), 1D) > 0.8 as finds_changes"),
    )


def _detect_query(spark, sf):
    return _round(detect(spark, sf), *DETECTION_DOUBLES)


QUERIES["detect_changes"] = _detect_query


@query
def detect_changes_blocked(spark, sf):
    """The end-to-end plan with regions put together from small blocks."""
    out = detect_changes(fx.raster_blocks(spark, sf), scene_meta(spark, sf), min_area_px=MIN_AREA, block=8, fan=2, **BLOCK)
    return _round(out, *DETECTION_DOUBLES)


@query
def detect_changes_full(spark, sf):
    """Aligned, tiled, scored by a model, stitched and stored: what a user runs on new scenes."""
    found = detect_changes_aligned(
        raster_blocks(spark, sf), scene_meta(spark, sf), _registrations(spark, sf), fx.BLOCK_H, fx.COLS, _ratio_model, TILE, OVERLAP, min_area_px=MIN_AREA
    )
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    store.insert(found, path, dedup=True, default_epsg=32633)
    return _round(store.read_detections(spark, path).drop("created_at"), *DETECTION_DOUBLES)


@query
def detect_changes_nodata(spark, sf):
    """The aligned plan on scenes with declared nodata: gaps are resampled, scored and blended around."""
    found = detect_changes_aligned(
        fx.bordered_blocks(spark, sf), fx.bordered_meta(spark, sf), _registrations(spark, sf), fx.BLOCK_H, fx.COLS, _ratio_model, TILE, OVERLAP, min_area_px=MIN_AREA
    )
    return _round(found, *DETECTION_DOUBLES)


@query
def detect_changes_geometry(spark, sf):
    """The end-to-end plan with outlines; area and extent are measured on the outlines."""
    out = detect_changes(
        fx.raster_blocks(spark, sf), scene_meta(spark, sf), min_area_px=MIN_AREA, geometry=True, **BLOCK
    )
    area = f"aggregate(flatten(polygons), 0D, (t, r) -> t + {geo.signed_area('r')})"
    return out.selectExpr(
        "detection_id", "scene_id", "region_id", f"{r6(f'abs({area})')} as outline_area",
        f"{r6('array_min(transform(flatten(flatten(polygons)), q -> q.x))')} as minx",
        f"{r6('array_max(transform(flatten(flatten(polygons)), q -> q.y))')} as maxy",
        "geometry_wkt like 'POLYGON %' as is_polygon",
    )


# --- regions and outlines -------------------------------------------------------------------

@query
def region_attributes(spark, sf):
    out = reg.region_attributes(reg.summarize_regions(labelled(spark, sf), MIN_AREA), scene_meta(spark, sf), compat_area=True)
    cols = [c for c in DETECTION_DOUBLES if c != "mean_confidence"]
    return _round(out, *cols).select("scene_id", "region_id", "pixel_count", *cols, "timestamp_a", "timestamp_b")


@query
def polygonize(spark, sf):
    out = polygons.polygonize(labelled(spark, sf), min_area_px=MIN_AREA)
    ring = "aggregate(sequence(0, size(r) - 2), 0D, (z, i) -> z + abs(r[i].x - r[i + 1].x) + abs(r[i].y - r[i + 1].y))"
    return out.selectExpr(
        "scene_id", "region_id", "bigint(area_px) as area_px", f"bigint(aggregate(flatten(polygons), 0D, (s, r) -> s + {ring})) as perimeter_px"
    )


@query
def polygonize_blocked(spark, sf):
    """Outlines traced in blocks of eight pixels and joined."""
    labels = reg.label_components(mask(spark, sf), 4, block=8, fan=2)
    ring = "aggregate(sequence(0, size(r) - 2), 0D, (z, i) -> z + abs(r[i].x - r[i + 1].x) + abs(r[i].y - r[i + 1].y))"
    return polygons.polygonize(labels, block=8, min_area_px=MIN_AREA).selectExpr(
        "scene_id", "region_id", "bigint(area_px) as area_px", f"bigint(aggregate(flatten(polygons), 0D, (s, r) -> s + {ring})) as perimeter_px"
    )


@query
def ring_validity(spark, sf):
    """Outlines of 8-connected regions: closed, and no corner twice in a ring."""
    out = polygons.polygonize(labelled(spark, sf, 8), min_area_px=MIN_AREA)
    simple = "forall(flatten(polygons), r -> size(array_distinct(r)) = size(r) - 1)"
    closed = "forall(flatten(polygons), r -> r[0] = r[size(r) - 1])"
    return out.selectExpr("scene_id", "region_id", "bigint(area_px) as area_px", f"{simple} as simple", f"{closed} as closed")


@query
def simplify_rings(spark, sf):
    """Simplified rings are closed, keep only corners of the outline, and add none."""
    shapes = polygons.polygonize(labelled(spark, sf), min_area_px=MIN_AREA)
    out = polygons.simplify_rings(shapes, 1.0).selectExpr("scene_id", "region_id", "polygons as simpler")
    closed = "forall(flatten(simpler), r -> r[0] = r[size(r) - 1])"
    points = "flatten(flatten({}))".format
    return shapes.join(out, ["scene_id", "region_id"]).selectExpr(
        "scene_id", "region_id", f"{closed} as closed", f"size(array_except({points('simpler')}, {points('polygons')})) = 0 as subset",
        f"size({points('simpler')}) <= size({points('polygons')}) as fewer", "size(flatten(simpler)) = size(flatten(polygons)) as same_rings",
    )


@query
def region_hull(spark, sf):
    """Hulls hold every pixel of their region and have only pixels as corners."""
    hulls = polygons.region_hull(labelled(spark, sf), min_area_px=MIN_AREA).select("scene_id", "region_id", "pixel_count", "ring")
    turn = "(ring[i + 1].x - ring[i].x) * (row - ring[i].y) - (ring[i + 1].y - ring[i].y) * (col - ring[i].x)"
    sides = f"transform(sequence(0, size(ring) - 2), i -> {turn})"
    pixels = labelled(spark, sf).join(hulls, ["scene_id", "region_id"]).selectExpr("scene_id", "region_id", "pixel_count", "row", "col", "ring", f"{sides} as turns")
    return pixels.groupBy("scene_id", "region_id", "pixel_count").agg(
        expr("bool_and(forall(turns, s -> s >= -1e-9)) or bool_and(forall(turns, s -> s <= 1e-9)) as inside"),
        expr("count_if(exists(ring, q -> q.x = col and q.y = row)) = max(size(array_distinct(ring))) as corners_are_pixels"),
    )


# --- registration ---------------------------------------------------------------------------

@query
def pair_match_status(spark, sf):
    """Primary descriptors of odd pairs are noisy, and every fifth pair has no usable B side."""
    d = fx.descriptors(spark, sf).withColumn("pair_id", expr("int(kp_id div 25)")).where("not (side = 'B' and pair_id % 5 = 4 and kp_id % 25 > 9)")
    noisy = d.withColumn("vec", expr("if(side = 'B' and pair_id % 2 = 1, transform(vec, (x, i) -> x + 0.2D * ((kp_id * 7 + i * 5) % 13 - 6)), vec)"))
    return rgs.pair_match_status(noisy, d)


@query
def fit_homography(spark, sf):
    out = rgs.fit_homography(fx.matches(spark, sf))
    return out.selectExpr("pair_id", *[f"round(h[{i}], 3) + 0D as h{i}" for i in range(9)], "n_matches", "n_inliers")


@query
def fit_homography_noisy(spark, sf):
    """Seven matches in ten are wrong; only a search over all of them finds the rest."""
    out = rgs.fit_homography(fx.noisy_matches(spark, sf))
    return out.selectExpr("pair_id", *[f"round(h[{i}], 3) + 0D as h{i}" for i in range(9)], "n_matches", "n_inliers")


@query
def reprojection_error(spark, sf):
    return _round(rgs.reprojection_error(fx.matches(spark, sf), fx.known_homographies(spark, sf)), "error_px")


@query
def registration_qc(spark, sf):
    h = fx.known_homographies(spark, sf)
    err = rgs.reprojection_error(fx.matches(spark, sf), h)
    res = err.join(h, "pair_id").selectExpr(
        "pair_id", "if(pair_id % 13 = 0, null, h) as h", "if(pair_id % 17 = 0, 5D, if(pair_id % 19 = 0, 6.5D, error_px)) as error_px",
        "if(pair_id % 23 = 0, 9L, n_inliers) as n_inliers",
    )
    out = rgs.registration_qc(res)
    return _round(out, "error_px", "det").withColumn("out_error_px", expr("if(valid, round(out_error_px, 6) + 0D, null)"))


def _registrations(spark, sf):
    """Small rotation and shift; every third scene was rejected and stays as it is."""
    h = "array(1D, 0.01D, 1.5D, -0.02D, 1D, 0.5D, 0D, 0D, 1D)"
    return scene_meta(spark, sf).selectExpr("scene_id", f"if(scene_id % 3 = 1, null, {h}) as h")


@query
def warp_bilinear(spark, sf):
    r = raster(spark, sf)
    out = rgs.warp_bilinear(r.where("t = 'A'"), r.where("t = 'B'"), _registrations(spark, sf), scene_meta(spark, sf))
    return _round(out, "value")


@query
def warp_blocks(spark, sf):
    b, size = raster_blocks(spark, sf), (fx.BLOCK_H, fx.COLS)
    out = rgs.warp_blocks(b.where("t = 'A' and band = 0"), b.where("t = 'B'"), _registrations(spark, sf), scene_meta(spark, sf), *size)
    return _round(ras.block_pixels(out, *size), "value")


@query
def warp_beyond_horizon(spark, sf):
    """A map whose horizon crosses the scenes: blocks name their taps, none asks for a scene."""
    h = "array(1D, 0.02D, 1.0003D, -0.01D, 1D, 2D, 0.05D, 0.03D, 1D)"
    regs, b, size = scene_meta(spark, sf).selectExpr("scene_id", f"{h} as h"), raster_blocks(spark, sf), (fx.BLOCK_H, fx.COLS)
    out = rgs.warp_blocks(b.where("t = 'A' and band = 0"), b.where("t = 'B'"), regs, scene_meta(spark, sf), *size)
    return ras.block_pixels(out, *size).selectExpr("scene_id", "band", "row", "col", f"{r6('value')} as value")


# --- augmentation ---------------------------------------------------------------------------

@query
def augment_flip(spark, sf):
    return _round(augment.flip(fx.patches(spark, sf), 8, 8, epoch=1), "value")


@query
def augment_rot90(spark, sf):
    return _round(augment.rotate90(fx.patches(spark, sf), 8, epoch=1), "value")


@query
def center_crop(spark, sf):
    return _round(augment.center_crop(fx.patches(spark, sf), 8, 8, 5), "value")


@query
def random_crop(spark, sf):
    return _round(augment.random_crop(fx.patches(spark, sf), 8, 8, 5, epoch=2), "value")


@query
def shift_scale_rotate(spark, sf):
    return _round(augment.shift_scale_rotate(fx.patches(spark, sf), 8, 8, epoch=1), "value")


@query
def color_jitter(spark, sf):
    rgb = fx.patches(spark, sf).selectExpr("patch_id", "'A' as t", "row", "col", f"{X.clip('abs(value)', 0, 1)} as r", f"{X.clip('abs(value) / 2', 0, 1)} as g", f"{X.clip('1 - abs(value)', 0, 1)} as b")
    return _round(augment.color_jitter(rgb, epoch=1), "r", "g", "b")


@query
def gauss_noise(spark, sf):
    px = fx.patches(spark, sf).selectExpr("patch_id", "'A' as t", "0 as band", "row", "col", "abs(value) * 255 as value")
    return _round(augment.gauss_noise(px, epoch=1), "value")


@query
def blur3(spark, sf):
    return _round(augment.blur(fx.patches(spark, sf), 8, 8), "value")


@query
def blur5(spark, sf):
    return _round(augment.blur(fx.patches(spark, sf), 8, 8, size=5), "value")


@query
def random_blur(spark, sf):
    return _round(augment.random_blur(fx.patches(spark, sf), 8, 8, epoch=1), "value")


def _unpacked(out):
    return _round(packed.unpack(out, 8), "value")


@query
def augment_flip_packed(spark, sf):
    return _unpacked(packed.flip(fx.packed_patches(spark, sf), 8, 8, epoch=1))


@query
def augment_rot90_packed(spark, sf):
    return _unpacked(packed.rotate90(fx.packed_patches(spark, sf), 8, epoch=1))


@query
def center_crop_packed(spark, sf):
    return _round(packed.unpack(packed.center_crop(fx.packed_patches(spark, sf), 8, 8, 5), 5), "value")


@query
def random_crop_packed(spark, sf):
    return _round(packed.unpack(packed.random_crop(fx.packed_patches(spark, sf), 8, 8, 5, epoch=2), 5), "value")


@query
def shift_scale_rotate_packed(spark, sf):
    return _unpacked(packed.shift_scale_rotate(fx.packed_patches(spark, sf), 8, 8, epoch=1))


@query
def random_blur_packed(spark, sf):
    return _unpacked(packed.random_blur(fx.packed_patches(spark, sf), 8, 8, epoch=1))


@query
def color_jitter_packed(spark, sf):
    """Both dates of each patch; date B is the patch at three quarters of its values."""
    channel = lambda e, name: f"transform(data, x -> {X.clip(e.format('x * k'), 0, 1)}) as {name}"
    rgb = fx.packed_patches(spark, sf).selectExpr("*", "explode(map('A', 1D, 'B', 0.75D)) as (t, k)")
    rgb = rgb.selectExpr("patch_id", "t", channel("abs({0})", "r"), channel("abs({0}) / 2", "g"), channel("1 - abs({0})", "b"))
    out = packed.color_jitter(rgb, 8, 8, epoch=1).selectExpr("patch_id", "t", "posexplode(arrays_zip(r, g, b)) as (i, c)")
    return _round(out.selectExpr("patch_id", "t", "int(i div 8) as row", "int(i % 8) as col", "c.r as r", "c.g as g", "c.b as b"), "r", "g", "b")


@query
def gauss_noise_packed(spark, sf):
    """Both dates with noise of their own; the samples are not SQL and are tested against the generator."""
    px = fx.packed_patches(spark, sf).selectExpr("patch_id", "explode(array('A', 'B')) as t", "0 as band", "transform(data, x -> abs(x) * 255) as data")
    return _round(packed.unpack(packed.gauss_noise(px, 8, 8, epoch=1), 8), "value")


# --- submissions ----------------------------------------------------------------------------

@query
def manifest_dedup(spark, sf):
    from changegrid.streaming.ingest import latest_submissions

    return latest_submissions(fx.manifest(spark, sf))
