"""The end-to-end plan: image pair in, detection rows out, for all scenes at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.functions import expr

from changegrid.functions import expr as X
from changegrid.operators.polygons import polygonize, simplify_rings
from changegrid.operators.raster import mask_blocks
from changegrid.operators.regions import label_components, region_attributes, region_confidence, summarize_regions
from changegrid.operators.registration import warp_blocks
from changegrid.operators.scoring import drop_gaps, fill_gaps, score_blocks, score_pixels, score_tiles
from changegrid.operators.tiling import split_blocks, stitch_blocks, tile_pairs
from changegrid.plans.lineage import cut

DETECTION_COLUMNS = (
    "detection_id", "scene_id", "region_id", "pixel_count", "area_m2", "centroid_x", "centroid_y",
    "bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy", "perimeter_m", "mean_confidence",
    "timestamp_a", "timestamp_b",
)


# Same region of the same date pair, same id: replayed work can be recognised, a later pair is new.
DETECTION_ID = "sha2(concat_ws(':', string(scene_id), string(region_id), timestamp_a, timestamp_b), 256)"


def detections_from_scores(
    scores: DataFrame,
    meta: DataFrame,
    block_h: int,
    block_w: int,
    thr: float = 0.5,
    inclusive: bool = False,
    min_area_px: int = 25,
    connectivity: int = 4,
    block: int = 1024,
    fan: int = 8,
    compat_area: bool = False,
    geometry: bool = False,
    simplify: float = 0.0,
) -> DataFrame:
    """Threshold -> regions -> attributes over a score map in block layout.

    Only changed pixels ever become rows, and the region table, which three steps read, is
    stored before it is used. `geometry` adds the outlines (`polygons`, `geometry_wkt`), if
    asked simplified by `simplify` CRS units; attributes always come from the unsimplified
    pixels.
    """
    changed = score_pixels(scores, block_h, block_w).where(X.threshold("p", thr, inclusive)).select("scene_id", "row", "col")
    labelled = label_components(changed, connectivity, block, fan)
    if geometry:
        labelled = cut(labelled)
    regions = cut(summarize_regions(labelled, min_area_px))
    attrs = region_attributes(regions, meta, compat_area)
    conf = region_confidence(regions, scores, meta, block_h, block_w)
    out = attrs.join(conf, ["scene_id", "region_id"], "left").selectExpr(f"{DETECTION_ID} as detection_id", *DETECTION_COLUMNS[1:])
    if not geometry:
        return out
    shapes = polygonize(labelled, meta, block, min_area_px)
    if simplify > 0:
        shapes = simplify_rings(shapes, simplify)
    return out.join(shapes.select("scene_id", "region_id", "polygons", "geometry_wkt"), ["scene_id", "region_id"])


def detect_changes(
    blocks: DataFrame,
    meta: DataFrame,
    n_bands: int,
    block_h: int,
    block_w: int,
    compat_nodata: bool = False,
    **options,
) -> DataFrame:
    """Score -> threshold -> regions -> attributes over every scene pair in `blocks`.

    Pixels that show the scene's declared nodata in any band or date have no score: they count
    neither towards the percentiles nor towards confidences, and are never changed.
    """
    if "nodata" in meta.columns:
        blocks = mask_blocks(blocks, meta, compat_nodata)
    return detections_from_scores(score_blocks(blocks, n_bands), meta, block_h, block_w, **options)


def detect_changes_aligned(
    blocks: DataFrame,
    meta: DataFrame,
    registrations: DataFrame,
    block_h: int,
    block_w: int,
    make_predict: Callable,
    tile: int = 256,
    overlap: int = 32,
    compat_nodata: bool = False,
    **options,
) -> DataFrame:
    """Align -> tile -> score by a model -> stitch -> threshold -> regions -> attributes.

    Date B is resampled by its scene's homography; a scene without one keeps B as it is. The
    model scores tile pairs band by band; a pixel's score is the mean over its bands.
    `make_predict` is as for `score_tiles`. Everything stays in arrays up to the score map,
    which is stored once. Declared nodata gives no weight to resampling, is filled from the other
    date before the model sees it, and has no score: a pixel that any band or date lacks is never
    changed and does not count towards confidences.
    """
    if "nodata" in meta.columns:
        blocks = mask_blocks(blocks, meta, compat_nodata)
    a, b = blocks.where("t = 'A'"), blocks.where("t = 'B'")
    grid = a.select("scene_id", "block_row", "block_col", "h", "w").distinct()
    moved = warp_blocks(grid, b, registrations, meta, block_h, block_w)
    aligned = a.unionByName(moved.selectExpr("scene_id", "'B' as t", "band", "block_row", "block_col", "h", "w", "data"))
    tiles = split_blocks(aligned, meta, block_h, block_w, tile, overlap)
    scored = drop_gaps(score_tiles(fill_gaps(tile_pairs(tiles)), make_predict, tile * tile))
    # A group holds one array per band.
    mean = "transform(aggregate(slice(d, 2, size(d)), d[0], (s, x) -> zip_with(s, x, (p, q) -> p + q)), v -> v / size(d))"
    merged = scored.groupBy("scene_id", "tile_row", "tile_col").agg(expr("array_sort(collect_list(struct(band, prob))) as d")).selectExpr(
        "scene_id", "tile_row", "tile_col", "transform(d, x -> x.prob) as d"
    ).selectExpr("scene_id", "tile_row", "tile_col", f"{mean} as data")
    stride = tile - overlap
    return detections_from_scores(cut(stitch_blocks(merged, meta, tile, overlap)), meta, stride, stride, **options)
