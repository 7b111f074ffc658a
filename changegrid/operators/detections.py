"""Queries over detection rows: lookup, filters, statistics, spatial join, export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.functions import col, expr, lit

from changegrid.functions import expr as X
from changegrid.functions import geometry as G
from changegrid.functions.expr import num

BOX = ("bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy")


def by_id(detections: DataFrame, detection_id: str) -> DataFrame:
    """The id is a literal value, never part of SQL text."""
    return detections.where(col("detection_id") == lit(detection_id))


def by_ids(detections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Detections whose id is in the one-column table `wanted`."""
    return detections.join(wanted.select("detection_id"), "detection_id", "left_semi")


def area_filter(detections: DataFrame, min_area: float) -> DataFrame:
    return detections.where(f"coalesce(area_m2, 0) >= {num(min_area)}")


def _overlaps(a: tuple, b: tuple) -> str:
    """Closed boxes (minx, miny, maxx, maxy): touching counts."""
    return f"{a[0]} <= {b[2]} and {a[2]} >= {b[0]} and {a[1]} <= {b[3]} and {a[3]} >= {b[1]}"


def bbox_query(detections: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Detections that intersect the box.

    The envelope test is four plain comparisons and reaches the file statistics; rows with
    `polygons` are then tested exactly.
    """
    box = tuple(map(num, (xmin, ymin, xmax, ymax)))
    near = detections.where(_overlaps(BOX, box))
    if "polygons" in detections.columns:
        near = near.where(f"polygons is null or {G.polygons_hit_box('polygons', *box)}")
    return near


# Cell sides of the spatial join: four-fold steps from one base cell.
LEVELS, STEP = 12, 4.0


def aoi_join(detections: DataFrame, aois: DataFrame, cell: float = 1000.0) -> DataFrame:
    """Detections x areas of interest whose boxes touch: (aoi_id, detection_id).

    Every box has a native level at which it covers at most four cells. Two boxes meet at the
    coarser of their native levels, so of each pair one box is looked up by its native cells and
    the other is listed at that coarser level: one equi join for detections that are at least as
    coarse as the area, one for areas that are coarser. No cell meets all boxes with all boxes. A
    pair is reported only in the cell of the lower-left corner of its overlap, which makes a
    distinct unnecessary. A box is listed only at levels that boxes of the other table have; these
    levels, at most LEVELS numbers, are read first. Lists of cells look as small as their boxes to
    the optimiser, so they are never broadcast.
    """

    def native_level(minx: str, miny: str, maxx: str, maxy: str) -> str:
        size = f"greatest({maxx} - {minx}, {maxy} - {miny})"
        return f"least({LEVELS - 1}, int(ceil(greatest(0D, log({num(STEP)}, greatest({size} / {num(cell)}, 1D))) - 1e-9D)))"

    def cells(minx: str, miny: str, maxx: str, maxy: str, own: bool, coarser: bool, met: list[int]) -> str:
        native = native_level(minx, miny, maxx, maxy)
        side = f"({num(cell)} * pow({num(STEP)}, l))"
        span = lambda lo, hi: f"sequence(bigint(floor({lo} / {side})), bigint(floor({hi} / {side})))"
        grid = f"flatten(transform({span(minx, maxx)}, gx -> transform({span(miny, maxy)}, gy -> struct(l, gx, gy))))"
        there = f"cast(array({', '.join(map(str, met))}) as array<int>)"
        levels = f"filter({there}, l -> l {'>=' if own else '>'} {native})" if coarser else f"array({native})"
        return f"explode(flatten(transform({levels}, l -> {grid})))"

    boxes = (
        detections.selectExpr("detection_id", *[f"{c} as d{i}" for i, c in enumerate(BOX)]),
        aois.selectExpr("aoi_id", "minx as a0", "miny as a1", "maxx as a2", "maxy as a3"),
    )
    sides = [[f"{chr(100 - 3 * k)}{i}" for i in range(4)] for k in (0, 1)]
    native = [[r[0] for r in boxes[k].selectExpr(f"{native_level(*sides[k])} as l").where("l is not null").distinct().collect()] for k in (0, 1)]
    listed = lambda k, own, coarser: boxes[k].selectExpr("*", f"{cells(*sides[k], own, coarser, native[1 - k])} as k").selectExpr(
        *boxes[k].columns, "k.l as _l", "k.gx as _x", "k.gy as _y"
    )
    cell_key = ["_l", "_x", "_y"]
    met = listed(0, True, False).join(listed(1, True, True).hint("merge"), cell_key).unionByName(
        listed(1, True, False).join(listed(0, False, True).hint("merge"), cell_key)
    )
    side = f"({num(cell)} * pow({num(STEP)}, _l))"
    return (
        met.where(_overlaps(("d0", "d1", "d2", "d3"), ("a0", "a1", "a2", "a3")))
        .where(f"_x = bigint(floor(greatest(d0, a0) / {side})) and _y = bigint(floor(greatest(d1, a1) / {side}))")
        .select("aoi_id", "detection_id")
    )


def _confidence(df: DataFrame) -> str:
    return X.first_confidence("confidence", "mean_confidence") if "confidence" in df.columns else "mean_confidence"


def with_confidence_colour(detections: DataFrame) -> DataFrame:
    return detections.withColumn("colour", expr(X.confidence_colour(_confidence(detections))))


def stats(detections: DataFrame, by: tuple = ()) -> DataFrame:
    """Count, total area, mean of the non-zero confidences."""
    return detections.groupBy(*by).agg(
        expr("count(1) as total"),
        expr("coalesce(sum(coalesce(area_m2, 0D)), 0D) as total_area"),
        expr(f"avg(nullif({_confidence(detections)}, 0D)) as avg_confidence"),
    )


def extent(detections: DataFrame) -> DataFrame:
    return detections.agg(
        expr("min(bbox_minx) as minx"), expr("min(bbox_miny) as miny"), expr("max(bbox_maxx) as maxx"), expr("max(bbox_maxy) as maxy")
    )


def listing(detections: DataFrame, n: int = 100) -> DataFrame:
    """First n rows for display, by take-ordered."""
    return detections.orderBy("scene_id", "region_id").limit(n).selectExpr(
        "substring(detection_id, 1, 8) as short_id", "area_m2", f"coalesce({_confidence(detections)}, 0D) as confidence",
        f"{X.confidence_colour(_confidence(detections))} as colour",
    )


def result_rows(detections: DataFrame, geometry: str = "'{}'") -> DataFrame:
    """Nested result document per detection; missing numbers read 0 and missing text ''."""
    number = lambda c: f"coalesce({c}, 0D)" if c in detections.columns else "0D"
    text = lambda c: f"coalesce(string({c}), '')" if c in detections.columns else "''"
    box = ", ".join(f"{number(b)} as {b[5:]}" for b in BOX)
    return detections.selectExpr(
        f"{text('detection_id')} as detection_id", f"{geometry} as geometry_geojson", f"{number('area_m2')} as area_m2",
        f"{number('centroid_x')} as centroid_x", f"{number('centroid_y')} as centroid_y", f"struct({box}) as bbox",
        f"{number('mean_confidence')} as mean_confidence", f"{text('timestamp_a')} as timestamp_a",
        f"{text('timestamp_b')} as timestamp_b", f"{text('created_at')} as created_at",
    )


def result_json(detections: DataFrame, geometry: str = "'{}'") -> DataFrame:
    rows = result_rows(detections, geometry)
    return rows.selectExpr("detection_id", f"to_json(struct({', '.join(rows.columns)})) as document")


def geojson_features(detections: DataFrame) -> DataFrame:
    """One GeoJSON feature per detection, with every plain column as a property."""
    props = ", ".join(c for c in detections.columns if c not in ("polygons", "geometry_wkt"))
    geometry = G.geojson_geometry("polygons")
    return detections.where("polygons is not null").selectExpr(
        "detection_id", f"concat('{{\"type\":\"Feature\",\"geometry\":', {geometry}, ',\"properties\":', to_json(struct({props}), map('ignoreNullFields', 'false')), '}}') as feature"
    )


def wrap_features(records: DataFrame) -> DataFrame:
    """Bare records with JSON geometry text become features; records without geometry drop out."""
    return records.where("geometry is not null and get_json_object(geometry, '$.type') is not null").selectExpr(
        "concat('{\"type\":\"Feature\",\"geometry\":', geometry, ',\"properties\":', to_json(struct(*), map('ignoreNullFields', 'false')), '}') as feature"
    )


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(expr("count(1) as n_jobs"))


def scene_summary(detections: DataFrame, registrations: DataFrame) -> DataFrame:
    """Changes per registered scene, error to 2 decimals, inliers; scenes without changes stay."""
    n = detections.groupBy("scene_id").agg(expr("count(1) as n_changes"))
    return registrations.join(n, "scene_id", "left").selectExpr(
        "scene_id", "coalesce(n_changes, 0) as n_changes", "round(error_px, 2) as registration_error_px", "n_inliers"
    )
