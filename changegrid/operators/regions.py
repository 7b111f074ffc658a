"""Connected regions of a sparse change mask, and their attributes.

Labelling is spatial divide and conquer. Each block of the scene is labelled on its own;
then blocks are merged `fan` x `fan` at a time, and a merge step sees only the pixels lying
on the borders of its children. A merge group therefore grows with the side of the area it
covers, never with its pixels, and the number of steps is log_fan(side / block): no
convergence loop, no all-pairs edges, no single task holding a scene.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import expr

from changegrid.functions import expr as X
from changegrid.plans.groups import map_each_group, map_groups
from changegrid.plans.joins import salted_join
from changegrid.plans.lineage import cut

# Label of a region: row * ROW_STRIDE + col of its first pixel in row-major order.
ROW_STRIDE = 2**31

# Open sides of a pixel, as bits.
NORTH, EAST, SOUTH, WEST = 1, 2, 4, 8

FORWARD_4 = ((0, 1), (1, 0))
FORWARD_8 = ((0, 1), (1, 0), (1, 1), (1, -1))


def forward_offsets(connectivity: int) -> tuple[tuple[int, int], ...]:
    if connectivity not in (4, 8):
        raise ValueError(f"connectivity must be 4 or 8, got {connectivity}")
    return FORWARD_8 if connectivity == 8 else FORWARD_4


def neighbour_edges(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """Adjacent changed pixels, each unordered pair once: exploded offsets + equi join."""
    steps = ", ".join(f"struct(row + {dr} as r, col + {dc} as c)" for dr, dc in forward_offsets(connectivity))
    probe = mask.selectExpr("scene_id", "row", "col", f"explode(array({steps})) as s").selectExpr(
        "scene_id", "row", "col", "s.r as n_row", "s.c as n_col"
    )
    there = mask.selectExpr("scene_id", "row as n_row", "col as n_col")
    return probe.join(there, ["scene_id", "n_row", "n_col"]).select("scene_id", "row", "col", "n_row", "n_col")


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable index per node: hook to the smaller root, then halve the paths."""
    root = np.arange(n)
    while len(u):
        lo, hi = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if np.array_equal(lo, hi):
            break
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _neighbour_pairs(group: np.ndarray, row: np.ndarray, col: np.ndarray, steps, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of adjacent points of a group; points are sorted by (group, row, col), and rows
    and columns lie in 0 .. side - 1."""
    line = side + 2  # a free column and row on each side keeps steps inside their group
    key = (group * line + row + 1) * line + col + 1
    us, vs = [], []
    for dr, dc in steps:
        there = key + dr * line + dc
        at = np.minimum(np.searchsorted(key, there), len(key) - 1)
        hit = key[at] == there
        us.append(np.flatnonzero(hit))
        vs.append(at[hit])
    return np.concatenate(us), np.concatenate(vs)


def _label_blocks(pdf: pd.DataFrame, group: np.ndarray, steps, carry: Sequence[str], block: int) -> pd.DataFrame:
    """Label each block on its own. Halo rows only tell whether a side of an own pixel is open."""
    order = np.lexsort((pdf["col"], pdf["row"], group))
    pdf, group = pdf.iloc[order], group[order]
    row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
    # Places in the block with its halo.
    r, c = row - pdf["_br"].to_numpy(np.int64) * block + 1, col - pdf["_bc"].to_numpy(np.int64) * block + 1
    own = pdf["_own"].to_numpy(bool)
    sides = np.full(len(pdf), NORTH | EAST | SOUTH | WEST, np.int32)
    right, below = (_neighbour_pairs(group, r, c, [s], block + 2) for s in FORWARD_4)
    sides[right[0]] &= ~EAST
    sides[right[1]] &= ~WEST
    sides[below[0]] &= ~SOUTH
    sides[below[1]] &= ~NORTH
    mine = np.flatnonzero(own)
    row, col = row[mine], col[mine]
    if len(mine):
        u, v = _neighbour_pairs(group[mine], r[mine], c[mine], steps, block + 2)
        root = _roots(len(mine), u, v)
        label = row[root] * ROW_STRIDE + col[root]
    else:
        label = np.empty(0, np.int64)
    out = pdf.iloc[mine][["scene_id", "row", "col", *carry]].copy()
    out["label"] = label
    out["sides"] = sides[mine]
    return out


def _merge_blocks(pdf: pd.DataFrame, group: np.ndarray, steps, span: int) -> pd.DataFrame:
    """Unite labels across child borders of span x span areas.

    Emits a row per label that changed (row = NULL) and a row per pixel on the outer border.
    """
    order = np.lexsort((pdf["col"], pdf["row"], group))
    pdf, group = pdf.iloc[order], group[order]
    row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
    # Names of an area lie together and rise, so the smallest index is its smallest label.
    names, at = np.unique(np.stack([group, pdf["label"].to_numpy(np.int64)], 1), axis=0, return_inverse=True)
    at = at.ravel()
    u, v = _neighbour_pairs(group, row % span, col % span, steps, span)
    root = _roots(len(names), at[u], at[v])
    label, last = names[:, 1], names[root, 1]
    scene = pdf["scene_id"].to_numpy()[np.searchsorted(group, names[:, 0])]
    changed = np.flatnonzero(root != np.arange(len(names)))
    rim = np.flatnonzero(
        (row % span == 0) | (row % span == span - 1) | (col % span == 0) | (col % span == span - 1)
    )
    return pd.concat(
        [
            pd.DataFrame({"scene_id": scene[changed], "row": None, "col": None, "label": label[changed], "root": last[changed]}),
            pd.DataFrame({"scene_id": scene[at[rim]], "row": row[rim], "col": col[rim], "label": label[at[rim]], "root": last[at[rim]]}),
        ]
    ).astype({"row": "Int32", "col": "Int32"})[["scene_id", "row", "col", "label", "root"]]


def _labeller(steps, carry, block: int):
    return lambda pdf, group: _label_blocks(pdf, group, steps, carry, block)


def _merger(steps, span: int):
    return lambda pdf, group: _merge_blocks(pdf, group, steps, span)


def label_components(
    mask: DataFrame,
    connectivity: int = 8,
    block: int = 1024,
    fan: int = 8,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Region id per changed pixel: (scene_id, row, col, carry..., region_id, sides).

    `mask` holds the changed pixels only; its farthest pixel sets how many merge steps there are.
    `sides` has one bit per side that faces an unchanged pixel, so outlines and perimeters need
    no further join.
    """
    steps = forward_offsets(connectivity)
    carry = list(carry)
    last = block - 1
    # Border pixels are copied to the block they touch.
    spots = [
        "struct(true as own, _br as r, _bc as c)",
        f"if(row % {block} = 0 and _br > 0, struct(false as own, _br - 1 as r, _bc as c), null)",
        f"if(row % {block} = {last}, struct(false as own, _br + 1 as r, _bc as c), null)",
        f"if(col % {block} = 0 and _bc > 0, struct(false as own, _br as r, _bc - 1 as c), null)",
        f"if(col % {block} = {last}, struct(false as own, _br as r, _bc + 1 as c), null)",
    ]
    placed = (
        mask.selectExpr("scene_id", "row", "col", *carry, f"int(row div {block}) as _br", f"int(col div {block}) as _bc")
        .selectExpr("scene_id", "row", "col", *carry, f"explode(filter(array({', '.join(spots)}), s -> s is not null)) as _s")
        .selectExpr("scene_id", "row", "col", *carry, "_s.own as _own", "_s.r as _br", "_s.c as _bc")
    )
    kept = [mask.schema[c] for c in ("scene_id", "row", "col", *carry)]
    long, int_ = T.LongType(), T.IntegerType()
    schema = T.StructType([*kept, T.StructField("label", long), T.StructField("sides", int_)])
    local = cut(map_groups(placed, ["scene_id", "_br", "_bc"], _labeller(steps, carry, block), schema))
    side = 1 + (local.agg(expr("max(greatest(row, col))")).first()[0] or 0)
    if side <= block:
        return local.withColumnRenamed("label", "region_id")
    rim = local.where(f"row % {block} in (0, {last}) or col % {block} in (0, {last})").select("scene_id", "row", "col", "label")
    merge_schema = T.StructType(
        [kept[0], T.StructField("row", int_), T.StructField("col", int_), T.StructField("label", long), T.StructField("root", long)]
    )
    moves = []
    span = block
    while span < side:
        span *= fan
        step = cut(
            map_groups(
                rim.selectExpr("*", f"row div {span} as _br", f"col div {span} as _bc"), ["scene_id", "_br", "_bc"], _merger(steps, span), merge_schema
            )
        )
        moves.append(step.where("row is null").select("scene_id", "label", "root"))
        rim = step.where("row is not null").selectExpr("scene_id", "row", "col", "root as label")
    # Resolve from the top: a label moves at one step at most, to a root that may move later.
    final = moves[-1]
    for step in reversed(moves[:-1]):
        later = final.selectExpr("scene_id", "label as root", "root as _last")
        moved = step.join(later, ["scene_id", "root"], "left").selectExpr("scene_id", "label", "coalesce(_last, root) as root")
        final = moved.unionByName(final)
    return local.join(final, ["scene_id", "label"], "left").selectExpr(
        "scene_id", "row", "col", *carry, "coalesce(root, label) as region_id", "sides"
    )


def summarize_regions(labelled: DataFrame, min_area_px: int = 50, prob: str | None = None) -> DataFrame:
    """Inclusive bbox, pixel count, centroid and open-side counts per region.

    Pure sums and extremes, so map-side aggregation shrinks any region before the shuffle.
    """
    aggs = [
        "min(row) as row_min", "min(col) as col_min", "max(row) as row_max", "max(col) as col_max",
        "count(1) as pixel_count", "avg(row) as centroid_row", "avg(col) as centroid_col",
        f"sum(bit_count(sides & {NORTH | SOUTH})) as h_edges", f"sum(bit_count(sides & {EAST | WEST})) as v_edges",
    ]
    if prob:
        aggs.append(f"avg({prob}) as region_confidence")
    return labelled.groupBy("scene_id", "region_id").agg(*map(expr, aggs)).where(f"pixel_count >= {int(min_area_px)}")


def extract_regions(mask: DataFrame, min_area_px: int = 50, connectivity: int = 8, block: int = 1024) -> DataFrame:
    """Regions of at least `min_area_px`, largest first within each scene."""
    labelled = label_components(mask, connectivity, block)
    return summarize_regions(labelled, min_area_px).orderBy("scene_id", expr("pixel_count").desc(), "region_id")


def confidence_windows(regions: DataFrame, meta: DataFrame) -> DataFrame:
    """Pixel window read for a region's confidence, clamped to the image.

    The far edge of the outline is mapped back to a pixel and one more line is added, so the
    window may run one row and one column past the region.
    """
    r = salted_join(regions, meta.select("scene_id", "width", "height", *"abcdef"), ["scene_id"], ["region_id"])
    x0, y0, x1, y1 = X.outline_bounds()
    top, left = X.world_to_pixel(x0, y1)
    bottom, right = X.world_to_pixel(x1, y0)
    return r.selectExpr(
        "scene_id", "region_id",
        f"greatest(0, least({top}, height - 1)) as w_row0",
        f"greatest(0, least({bottom} + 1, height)) - 1 as w_row1",
        f"greatest(0, least({left}, width - 1)) as w_col0",
        f"greatest(0, least({right} + 1, width)) - 1 as w_col1",
    )


# Side of the areas whose pixels one zonal task holds; small stored blocks are put together.
ZONE_SIDE = 1024


def _zone_sums(block_h: int, block_w: int, zone_h: int, zone_w: int):
    """Sums of windows inside one zone, by one local prefix table for all of them."""

    def run(zone):
        is_window = np.array([d is None for d in zone["data"]])
        windows, blocks = ({c: v[which] for c, v in zone.items()} for which in (is_window, ~is_window))
        if not len(windows["data"]) or not len(blocks["data"]):
            return []
        top, left = int(zone["_br"][0]) * zone_h, int(zone["_bc"][0]) * zone_w
        rows, cols = blocks["block_row"] * block_h - top, blocks["block_col"] * block_w - left
        n_rows, n_cols = int((rows + blocks["h"]).max()), int((cols + blocks["w"]).max())
        # Values and the number of pixels that have one, as prefix tables.
        pre = np.zeros((2, n_rows + 1, n_cols + 1))
        for r, c, h, w, data in zip(rows, cols, blocks["h"], blocks["w"], blocks["data"]):
            data = np.reshape(np.asarray(data, float), (h, w))
            there = ~np.isnan(data)
            pre[:, r + 1 : r + h + 1, c + 1 : c + w + 1] = np.where(there, data, 0.0), there
        pre = pre.cumsum(1).cumsum(2)
        r0 = np.clip(windows["w_row0"] - top, 0, n_rows)
        r1 = np.clip(windows["w_row1"] + 1 - top, 0, n_rows)
        c0 = np.clip(windows["w_col0"] - left, 0, n_cols)
        c1 = np.clip(windows["w_col1"] + 1 - left, 0, n_cols)
        s, n = pre[:, r1, c1] - pre[:, r0, c1] - pre[:, r1, c0] + pre[:, r0, c0]
        return zip(windows["scene_id"], windows["region_id"], s, n.astype(np.int64))

    return run


def zonal_means(windows: DataFrame, scores: DataFrame, block_h: int, block_w: int, zone_side: int = ZONE_SIDE) -> DataFrame:
    """Mean score inside each window: (scene_id, region_id, window_mean). Null pixels do not count.

    A window visits only the zones on its own rim; whole zones inside it come from a prefix
    table over zone totals, four lookups per window. So neither large nor overlapping windows
    are expanded to their pixels, and pixels never become rows. Zones that no rim touches are not
    opened.
    """
    per_row, per_col = max(1, zone_side // block_h), max(1, zone_side // block_w)
    zone_h, zone_w = per_row * block_h, per_col * block_w
    scene = scores.schema["scene_id"].dataType.simpleString()
    w = windows.where("w_row1 >= w_row0 and w_col1 >= w_col0").selectExpr(
        "*", f"w_row0 div {zone_h} as _r0", f"w_row1 div {zone_h} as _r1", f"w_col0 div {zone_w} as _c0", f"w_col1 div {zone_w} as _c1"
    )
    # Rim: first and last zone line in full, the first and last zone of the lines between.
    cols = "if(r in (_r0, _r1), sequence(_c0, _c1), array_distinct(array(_c0, _c1)))"
    rim = w.selectExpr("*", "explode(sequence(_r0, _r1)) as r").selectExpr(
        "scene_id", "region_id", "w_row0", "w_row1", "w_col0", "w_col1", "r as _zr", f"explode({cols}) as _zc"
    )
    zones = scores.selectExpr(
        "scene_id as _bs", f"bigint(block_row div {per_row}) as _br", f"bigint(block_col div {per_col}) as _bc", "block_row", "block_col", "h", "w", "data"
    )
    touched = rim.selectExpr("scene_id as _bs", "bigint(_zr) as _br", "bigint(_zc) as _bc").distinct()
    # Windows and blocks of a zone in one table; what a row lacks is 0, so that ids stay integers.
    edges, shape = ("region_id", "w_row0", "w_row1", "w_col0", "w_col1"), ("block_row", "block_col", "h", "w")
    both = rim.selectExpr(
        "scene_id", "bigint(_zr) as _br", "bigint(_zc) as _bc", *[f"bigint({c}) as {c}" for c in edges], *[f"0 as {c}" for c in shape], "cast(null as array<double>) as data"
    ).unionByName(
        zones.join(touched, ["_bs", "_br", "_bc"], "left_semi").selectExpr(
            "_bs as scene_id", "_br", "_bc", *[f"0L as {c}" for c in edges], *shape, "data"
        )
    )
    partial = map_each_group(
        both, ["scene_id", "_br", "_bc"], _zone_sums(block_h, block_w, zone_h, zone_w), f"scene_id {scene}, region_id bigint, s double, n bigint",
        ["block_row", "block_col"],
    )
    totals = zones.groupBy("_bs", "_br", "_bc").agg(
        expr("sum(aggregate(data, 0D, (s, x) -> s + coalesce(x, 0D))) as v"), expr("sum(size(filter(data, x -> x is not null))) as c")
    ).selectExpr("_bs as scene_id", "int(_br) as row", "int(_bc) as col", "v", "c")
    over = "over (partition by scene_id, {} order by {} rows unbounded preceding)"
    prefix = totals.selectExpr("scene_id", "row", "col", f"sum(v) {over.format('row', 'col')} as _r", f"sum(c) {over.format('row', 'col')} as _n").selectExpr(
        "scene_id", "row", "col", f"sum(_r) {over.format('col', 'row')} as prefix", f"sum(_n) {over.format('col', 'row')} as n"
    )
    corner = "struct(int({}) as row, int({}) as col, {}D as sign)".format
    corners = ", ".join(
        [corner("_r1 - 1", "_c1 - 1", 1), corner("_r0", "_c1 - 1", -1), corner("_r1 - 1", "_c0", -1), corner("_r0", "_c0", 1)]
    )
    inner = (
        w.where("_r1 - _r0 > 1 and _c1 - _c0 > 1")
        .selectExpr("scene_id", "region_id", f"explode(array({corners})) as k")
        .selectExpr("scene_id", "region_id", "k.row as row", "k.col as col", "k.sign as _sign")
        .join(prefix, ["scene_id", "row", "col"])
        .selectExpr("scene_id", "region_id", "_sign * prefix as s", "bigint(_sign) * n as n")
    )
    return _window_means(w, partial.unionByName(inner))


def _window_means(w: DataFrame, parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("scene_id", "region_id").agg(expr("sum(s) as s"), expr("sum(n) as n"))
    return w.join(sums, ["scene_id", "region_id"]).selectExpr("scene_id", "region_id", "s / nullif(n, 0) as window_mean")


def region_attributes(regions: DataFrame, meta: DataFrame, compat_area: bool = False) -> DataFrame:
    """World-unit attributes as plain expressions over the region sums.

    A scene without geotransform is measured in pixels. `compat_area` multiplies by the pixel
    area a second time, as a store filled from world-unit outlines would show.
    """
    geo = "(a is not null and epsg is not null)"
    m = meta.selectExpr(
        "scene_id", f"{geo} as has_geo", "t_a", "t_b", *[f"if({geo}, {k}, {v}) as {k}" for k, v in X.PIXEL_UNITS.items()]
    )
    area = f"pixel_count * {X.cell_area()}"
    length = "h_edges * hypot(a, d) + v_edges * hypot(b, e)"
    if compat_area:
        area, length = f"{area} * a * a", f"({length}) * abs(a)"
    cx, cy = X.pixel_to_world("centroid_row", "centroid_col")
    x0, y0, x1, y1 = X.outline_bounds()
    rest = [c for c in regions.columns if c not in ("scene_id", "region_id")]
    return salted_join(regions, m, ["scene_id"], ["region_id"]).selectExpr(
        "scene_id", "region_id", *rest, "has_geo",
        f"{area} as area_m2", f"{cx} as centroid_x", f"{cy} as centroid_y",
        f"{x0} as bbox_minx", f"{y0} as bbox_miny", f"{x1} as bbox_maxx", f"{y1} as bbox_maxy",
        f"{length} as perimeter_m", "t_a as timestamp_a", "t_b as timestamp_b",
    )


def region_confidence(
    regions: DataFrame, scores: DataFrame, meta: DataFrame, block_h: int, block_w: int, zone_side: int = ZONE_SIDE
) -> DataFrame:
    """Mean confidence per region: window mean with a geotransform, else the scene mean.

    `scores` is the score map in block layout. Null pixels do not count.
    """
    geo = meta.where("a is not null and epsg is not null")
    windows = confidence_windows(regions, geo)
    zonal = zonal_means(windows, scores, block_h, block_w, zone_side)
    plain = meta.where("a is null or epsg is null").select("scene_id")
    scene = scores.join(plain, "scene_id", "left_semi").groupBy("scene_id").agg(
        expr("sum(aggregate(data, 0D, (s, x) -> s + coalesce(x, 0D))) / sum(size(filter(data, x -> x is not null))) as scene_mean")
    )
    out = regions.select("scene_id", "region_id").join(zonal, ["scene_id", "region_id"], "left")
    return salted_join(out, scene, ["scene_id"], ["region_id"], "left").selectExpr(
        "scene_id", "region_id",
        "coalesce(window_mean, scene_mean) as mean_confidence",
        "if(window_mean is null, 'scene', 'window') as confidence_source",
    )
