"""Outlines of regions: tracing, holes, simplification, hulls, WKT.

Tracing runs in two steps. Inside a block the unit edges of all regions are chained into
closed rings and open paths, keeping corners only. Open paths then meet per region, so a
region group holds corner lists of the rings that cross block borders and nothing else.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import expr, pandas_udf

from changegrid.functions import geometry as G
from changegrid.operators.regions import EAST, NORTH, SOUTH, WEST
from changegrid.plans.groups import map_groups
from changegrid.plans.joins import salted_join
from changegrid.plans.lineage import cut

# Unit edges of a pixel, walked with the pixel on the right: direction 0=E, 1=S, 2=W, 3=N.
_EDGES = ((NORTH, 0, 0, 0), (EAST, 1, 0, 1), (SOUTH, 1, 1, 2), (WEST, 0, 1, 3))
_DX, _DY = np.array([1, 0, -1, 0]), np.array([0, 1, 0, -1])


def _chain(group, x0, y0, d0, x1, y1, d1, stop):
    """Order links into chains: returns (order, chain start flags, closed flags per chain).

    A link runs from (x0, y0) leaving in direction d0 to (x1, y1) arriving in direction d1.
    Where two links leave a corner the left turn is taken, which keeps the rings of a
    4-connected region apart. Links whose end has `stop` set are not continued.
    """
    n = len(x0)
    me = np.arange(n)
    by_start = np.lexsort((d0, y0, x0, group))
    starts = np.stack([group, x0, y0], 1)[by_start]
    ends = np.stack([group, x1, y1], 1)
    _, code = np.unique(np.concatenate([starts, ends]), axis=0, return_inverse=True)
    code = code.ravel()
    start_code, end_code = code[:n], code[n:]
    first = np.searchsorted(start_code, end_code, "left")
    last = np.searchsorted(start_code, end_code, "right") - 1
    found = (last >= first) & ~stop
    a, b = by_start[np.minimum(first, n - 1)], by_start[np.clip(last, 0, n - 1)]
    nxt = np.where(d0[b] == (d1 + 3) % 4, b, a)
    nxt = np.where(found, nxt, me)
    rounds = int(np.ceil(np.log2(n))) + 1 if n > 1 else 1
    # Which links run into an end, and the smallest link of every cycle.
    hop, low = nxt, me
    for _ in range(rounds):
        low = np.minimum(low, low[hop])
        hop = hop[hop]
    open_ = ~found[hop]
    chain = np.where(open_, hop, low)
    # Distance to the chain's last link, by doubling; cycles are cut before their smallest link.
    tail = np.where(open_, ~found, nxt == chain)
    hop, left = np.where(tail, me, nxt), np.where(tail, 0, 1)
    for _ in range(rounds):
        left = left + left[hop]
        hop = hop[hop]
    order = np.lexsort((-left, chain))
    head = np.r_[True, np.diff(chain[order]) != 0]
    return order, head, ~open_[order][head]


def _split_at_repeats(points: np.ndarray) -> list[np.ndarray]:
    """Cut a ring into simple rings wherever it visits a corner twice."""
    keys = [tuple(p) for p in points]
    if len(set(keys)) == len(keys):
        return [points]
    rings, path, seen = [], [], {}
    for k in keys:
        if k in seen:
            at = seen[k]
            rings.append(np.array(path[at:]))
            for p in path[at + 1 :]:
                seen.pop(p, None)
            del path[at + 1 :]
        else:
            seen[k] = len(path)
            path.append(k)
    rings.append(np.array(path))
    return [r for r in rings if len(r) >= 4]


_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_PATH_SCHEMA = T.StructType(
    [
        T.StructField("region_id", T.LongType()),
        T.StructField("closed", T.BooleanType()),
        T.StructField("d0", T.IntegerType()),
        T.StructField("d1", T.IntegerType()),
        T.StructField("xs", T.ArrayType(T.LongType())),
        T.StructField("ys", T.ArrayType(T.LongType())),
    ]
)


def _emit(scene, region, closed, d0, d1, pts):
    """Rows of a path; a ring becomes its simple rings."""
    parts = _split_at_repeats(pts) if closed else [pts]
    return [(scene, region, bool(closed), int(d0), int(d1), p[:, 0].tolist(), p[:, 1].tolist()) for p in parts]


def _trace_blocks(block: int):
    def run(pdf: pd.DataFrame, area: np.ndarray) -> pd.DataFrame:
        # Regions are traced block by block.
        _, code = np.unique(np.stack([area, pdf["region_id"].to_numpy()], 1), axis=0, return_inverse=True)
        code, sides = code.ravel(), pdf["sides"].to_numpy()
        row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        scene, region = pdf["scene_id"].to_numpy(), pdf["region_id"].to_numpy()
        parts = []
        for bit, dx, dy, d in _EDGES:
            hit = np.flatnonzero((sides & bit) > 0)
            parts.append((hit, col[hit] + dx, row[hit] + dy, np.full(len(hit), d)))
        pixel, x0, y0, d = (np.concatenate(p) for p in zip(*parts))
        rows = []
        if len(pixel):
            x1, y1 = x0 + _DX[d], y0 + _DY[d]
            # Nothing lies beyond the upper and left border of a scene, so paths run on along them.
            stop = ((x1 % block == 0) & (x1 > 0)) | ((y1 % block == 0) & (y1 > 0))
            order, head, closed = _chain(code[pixel], x0, y0, d, x1, y1, d, stop)
            bounds = np.r_[np.flatnonzero(head), len(order)]
            for k in range(len(closed)):
                e = order[bounds[k] : bounds[k + 1]]
                prev = np.roll(d[e], 1)
                turn = d[e] != prev
                if closed[k]:
                    pts = np.stack([x0[e][turn], y0[e][turn]], 1)
                else:
                    turn[0] = True
                    pts = np.concatenate([np.stack([x0[e][turn], y0[e][turn]], 1), [[x1[e[-1]], y1[e[-1]]]]])
                rows += _emit(scene[pixel[e[0]]], region[pixel[e[0]]], closed[k], d[e[0]], d[e[-1]], pts)
        return pd.DataFrame(rows, columns=["scene_id", *_PATH_SCHEMA.names])

    return run


def _join_paths(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
    """Link the open paths of each region into closed rings."""
    xs, ys = pdf["xs"].tolist(), pdf["ys"].tolist()
    x0, y0 = np.array([x[0] for x in xs]), np.array([y[0] for y in ys])
    x1, y1 = np.array([x[-1] for x in xs]), np.array([y[-1] for y in ys])
    d0, d1 = pdf["d0"].to_numpy(), pdf["d1"].to_numpy()
    order, head, _ = _chain(group, x0, y0, d0, x1, y1, d1, np.zeros(len(pdf), bool))
    bounds = np.r_[np.flatnonzero(head), len(order)]
    scene, region = pdf["scene_id"].to_numpy(), pdf["region_id"].to_numpy()
    rows = []
    for k in range(len(bounds) - 1):
        e = order[bounds[k] : bounds[k + 1]]
        pts = np.concatenate([np.stack([xs[i][:-1], ys[i][:-1]], 1) for i in e])
        back, ahead = np.roll(pts, 1, 0), np.roll(pts, -1, 0)
        turn = (pts[:, 0] - back[:, 0]) * (ahead[:, 1] - pts[:, 1]) != (pts[:, 1] - back[:, 1]) * (ahead[:, 0] - pts[:, 0])
        rows += _emit(scene[e[0]], region[e[0]], True, 0, 0, pts[turn])
    return pd.DataFrame(rows, columns=["scene_id", *_PATH_SCHEMA.names])


def outline_rings(labelled: DataFrame, block: int = 1024) -> DataFrame:
    """Closed simple rings in pixel corners: (scene_id, region_id, ring).

    Rings keep the region on their right in image view; holes run the other way round.
    """
    scene = labelled.schema["scene_id"]
    schema = T.StructType([scene, *_PATH_SCHEMA.fields])
    edges = labelled.where("sides > 0").selectExpr("scene_id", "region_id", "row", "col", "sides", f"row div {block} as _br", f"col div {block} as _bc")
    paths = cut(map_groups(edges, ["scene_id", "_br", "_bc"], _trace_blocks(block), schema))  # corner lists: small, and read twice
    joined = map_groups(paths.where("not closed"), ["scene_id", "region_id"], _join_paths, schema)
    corner = "struct(double(p.xs) as x, double(p.ys) as y)"
    return paths.where("closed").unionByName(joined).selectExpr("scene_id", "region_id", f"transform(arrays_zip(xs, ys), p -> {corner}) as r").selectExpr(
        "scene_id", "region_id", "concat(r, slice(r, 1, 1)) as ring"
    )


def polygonize(labelled: DataFrame, meta: DataFrame | None = None, block: int = 1024, min_area_px: int = 10) -> DataFrame:
    """One (multi)polygon per region: rings in pixel or world units, WKT, pixel area.

    Exterior rings come with their holes; a region of several corner-touching parts becomes a
    multipolygon.
    """
    rings = outline_rings(labelled, block).selectExpr("scene_id", "region_id", "ring", f"{G.signed_area('ring')} as _a")
    shapes = rings.groupBy("scene_id", "region_id").agg(
        expr("sum(_a) as area_px"),
        expr("array_sort(collect_list(if(_a > 0, struct(_a as a, ring), null))) as _outer"),
        expr("array_sort(collect_list(if(_a < 0, struct(_a as a, ring), null))) as _holes"),
    ).where(f"area_px >= {min_area_px}")
    # Exteriors are sorted by area: a hole belongs to the smallest exterior around it.
    # With one exterior, as every 4-connected region has, there is nothing to look for.
    search = f"array_position(transform(_outer, o -> {G.contains('o.ring', *G.inner_point('h.ring'))}), true)"
    owner = f"if(size(_outer) = 1, 1, {search})"
    shapes = shapes.selectExpr("*", f"transform(_holes, h -> struct({owner} as o, h.ring as ring)) as _h").selectExpr(
        "scene_id", "region_id", "area_px",
        "transform(_outer, (o, i) -> concat(array(o.ring), transform(filter(_h, h -> h.o = i + 1), h -> h.ring))) as polygons",
    )
    if meta is not None:
        geo = "(a is not null and epsg is not null)"
        m = meta.selectExpr("scene_id", *[f"if({geo}, {k}, {v}) as {k}" for k, v in dict(a="1D", b="0D", c="0D", d="0D", e="1D", f="0D").items()])
        world = "struct(a * q.x + b * q.y + c as x, d * q.x + e * q.y + f as y)"
        shapes = salted_join(shapes, m, ["scene_id"], ["region_id"]).selectExpr(
            "scene_id", "region_id", "area_px", f"transform(polygons, p -> transform(p, r -> transform(r, q -> {world}))) as polygons"
        )
    return shapes.selectExpr("*", f"{G.wkt('polygons')} as geometry_wkt")


def simplify_rings(polygons: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Douglas-Peucker per ring; a ring that would collapse is kept as it is."""

    @pandas_udf(T.ArrayType(_RING))
    def run(xs: pd.Series, ys: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for x, y, n in zip(xs, ys, sizes):
            cuts = np.cumsum(n)[:-1]
            out.append([G.simplify_ring(np.stack(r, 1), tolerance) for r in zip(np.split(x, cuts), np.split(y, cuts))])
        return pd.Series(out)

    rings = "flatten(polygons)"
    flat = polygons.selectExpr(
        "*",
        f"transform(flatten({rings}), q -> q.x) as _xs",
        f"transform(flatten({rings}), q -> q.y) as _ys",
        f"transform({rings}, r -> size(r)) as _n",
        "transform(polygons, p -> size(p)) as _k",
    ).withColumn("_rings", run("_xs", "_ys", "_n"))
    before = "aggregate(slice(_k, 1, i), 0, (s, k) -> s + k)"
    keep = [c for c in polygons.columns if c not in ("polygons", "geometry_wkt")]
    return flat.selectExpr(*keep, f"transform(_k, (k, i) -> slice(_rings, {before} + 1, k)) as polygons").selectExpr(
        "*", f"{G.wkt('polygons')} as geometry_wkt"
    )


def region_hull(labelled: DataFrame, meta: DataFrame | None = None, min_area_px: int = 10) -> DataFrame:
    """Convex hull of each region's pixel positions; degenerate hulls are dropped.

    Only the first and last pixel of each line can be on the hull, so lines are reduced before
    any region is brought together.
    """
    lines = labelled.groupBy("scene_id", "region_id", "row").agg(
        expr("min(col) as c0"), expr("max(col) as c1"), expr("count(1) as n")
    )
    regions = (
        lines.groupBy("scene_id", "region_id")
        .agg(expr("sum(n) as pixel_count"), expr("flatten(collect_list(array(struct(double(c0) as x, double(row) as y), struct(double(c1) as x, double(row) as y)))) as _pts"))
        .where(f"pixel_count >= {min_area_px}")
    )
    if meta is not None:
        geo = "(a is not null and epsg is not null)"
        regions = salted_join(regions, meta.selectExpr("scene_id", f"{geo} as _geo", *"abcdef"), ["scene_id"], ["region_id"])
        x, y = "a * (q.x + 0.5D) + b * (q.y + 0.5D) + c", "d * (q.x + 0.5D) + e * (q.y + 0.5D) + f"
        regions = regions.selectExpr(
            "scene_id", "region_id", "pixel_count", f"if(_geo, transform(_pts, q -> struct({x} as x, {y} as y)), _pts) as _pts"
        )

    @pandas_udf(_RING)
    def hull(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([G.convex_hull(np.stack(p, 1)) for p in zip(xs, ys)])

    return (
        regions.withColumns({"_xs": expr("transform(_pts, q -> q.x)"), "_ys": expr("transform(_pts, q -> q.y)")})
        .select("scene_id", "region_id", "pixel_count", hull("_xs", "_ys").alias("ring"))
        .where("ring is not null")
        .selectExpr("*", "array(array(ring)) as polygons")
        .selectExpr("scene_id", "region_id", "pixel_count", "ring", f"{G.wkt('polygons')} as geometry_wkt")
    )
