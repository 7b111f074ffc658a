"""Planar geometry: ring predicates as SQL over arrays of (x, y), and small ring helpers."""

from __future__ import annotations

import numpy as np


def signed_area(ring: str) -> str:
    """Shoelace area of a closed ring; positive when it turns from +x towards +y."""
    return (
        f"aggregate(sequence(0, size({ring}) - 2), 0D, (s, i) -> s + ({ring}[i].x * {ring}[i + 1].y - {ring}[i + 1].x * {ring}[i].y) / 2)"
    )


def contains(ring: str, x: str, y: str) -> str:
    """Even-odd test of a point against a closed ring (boundary points are undefined)."""
    p, q = f"{ring}[i]", f"{ring}[i + 1]"
    crosses = f"({p}.y > {y}) <> ({q}.y > {y}) and {x} < ({q}.x - {p}.x) * ({y} - {p}.y) / nullif({q}.y - {p}.y, 0D) + {p}.x"
    return f"(size(filter(sequence(0, size({ring}) - 2), i -> {crosses})) % 2 = 1)"


def inner_point(ring: str) -> tuple[str, str]:
    """Midpoint of the first unit step of a pixel ring: never a corner of another ring."""
    return (
        f"({ring}[0].x + 0.5D * signum({ring}[1].x - {ring}[0].x))",
        f"({ring}[0].y + 0.5D * signum({ring}[1].y - {ring}[0].y))",
    )


def segment_hits_box(p: str, q: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Closed segment against closed box: overlapping extents, and corners not all on one side."""
    side = f"(({q}.x - {p}.x) * ({{y}} - {p}.y) - ({q}.y - {p}.y) * ({{x}} - {p}.x))"
    s = [side.format(x=x, y=y) for x in (x0, x1) for y in (y0, y1)]
    lo, hi = f"least({', '.join(s)})", f"greatest({', '.join(s)})"
    return (
        f"(greatest({p}.x, {q}.x) >= {x0} and least({p}.x, {q}.x) <= {x1} and greatest({p}.y, {q}.y) >= {y0}"
        f" and least({p}.y, {q}.y) <= {y1} and {lo} <= 0 and {hi} >= 0)"
    )


def polygons_hit_box(polygons: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Closed intersection of polygons (arrays of rings, exterior first) with a box."""
    edge = segment_hits_box("r[k]", "r[k + 1]", x0, y0, x1, y1)
    touches = f"exists({polygons}, p -> exists(p, r -> exists(sequence(0, size(r) - 2), k -> {edge})))"
    inside = f"exists({polygons}, p -> size(filter(p, r -> {contains('r', x0, y0)})) % 2 = 1)"
    return f"({touches} or {inside})"


def wkt(polygons: str) -> str:
    pt = "concat(string(q.x), ' ', string(q.y))"
    ring = f"concat('(', array_join(transform(r, q -> {pt}), ', '), ')')"
    poly = f"transform({polygons}, p -> concat('(', array_join(transform(p, r -> {ring}), ', '), ')'))"
    return f"if(size({polygons}) = 1, concat('POLYGON ', {poly}[0]), concat('MULTIPOLYGON (', array_join({poly}, ', '), ')'))"


def geojson_geometry(polygons: str) -> str:
    """Geometry object as JSON text: exteriors counter-clockwise, holes clockwise."""
    turned = f"if(({signed_area('r')} < 0) = (n = 0), reverse(r), r)"
    rings = f"transform(p, (r, n) -> transform({turned}, q -> array(q.x, q.y)))"
    single = f"to_json(named_struct('type', 'Polygon', 'coordinates', transform({polygons}, p -> {rings})[0]))"
    multi = f"to_json(named_struct('type', 'MultiPolygon', 'coordinates', transform({polygons}, p -> {rings})))"
    return f"if(size({polygons}) = 1, {single}, {multi})"


def _records(xy: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def simplify_ring(xy: np.ndarray, tolerance: float) -> list[dict]:
    """Douglas-Peucker on a closed ring, split at its first and its farthest corner."""
    n = len(xy)
    if n < 5 or tolerance <= 0:
        return _records(xy)
    keep = np.zeros(n, bool)
    far = int(np.argmax(((xy - xy[0]) ** 2).sum(1)))
    keep[[0, far, n - 1]] = True
    todo = [(0, far), (far, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        mid, base = xy[a + 1 : b], xy[b] - xy[a]
        length = np.hypot(*base)
        off = mid - xy[a]
        dist = np.hypot(*off.T) if length == 0 else np.abs(base[0] * off[:, 1] - base[1] * off[:, 0]) / length
        k = int(np.argmax(dist))
        if dist[k] > tolerance:
            m = a + 1 + k
            keep[m] = True
            todo += [(a, m), (m, b)]
    return _records(xy[keep]) if keep.sum() >= 4 else _records(xy)


def convex_hull(xy: np.ndarray) -> list[dict] | None:
    """Closed hull ring, or None for fewer than three points or a zero-area hull."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return None

    def half(pts):
        out: list[np.ndarray] = []
        for p in pts:
            while len(out) > 1:
                u, v = out[-1] - out[-2], p - out[-1]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(xy) + half(xy[::-1])
    return _records(np.array([*hull, hull[0]])) if len(hull) >= 3 else None
