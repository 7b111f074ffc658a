"""Padding, tile splitting, seam-free stitching, cropping and resizing.

Long-layout operators are flat maps: a pixel knows which padded positions mirror it and which
tiles cover it, so padding and splitting generate no grid and need no join beyond the scene
size. Block-layout twins cut arrays into pieces and shuffle a few pieces per tile.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import expr

from changegrid.functions import expr as X
from changegrid.plans.groups import in_lots, map_each_group
from changegrid.plans.joins import salted_join

SINGLE_PASS_MAX_PX = 640  # fixed value: larger scenes are tiled


def check_overlap(tile: int, overlap: int) -> int:
    """Stride of a tile grid in which at most two tiles cover a line per axis."""
    if overlap >= tile // 2:
        raise ValueError(f"tiles of {tile} px with {overlap} px in common would cover a line three times; share less than half a tile")
    return tile - overlap


def _pad(side: str, tile: int, stride: int, rule: str) -> str:
    return {"cover": X.pad_amount, "cli": X.pad_amount_cli}[rule](side, tile, stride)


def compute_pad(meta: DataFrame, tile: int, stride: int, rule: str = "cover") -> DataFrame:
    return meta.selectExpr(
        "scene_id", f"{_pad('height', tile, stride, rule)} as pad_h", f"{_pad('width', tile, stride, rule)} as pad_w"
    )


def grid_shape(meta: DataFrame, tile: int, overlap: int, rule: str = "cover") -> DataFrame:
    stride = check_overlap(tile, overlap)
    return meta.selectExpr(
        "scene_id", "height", "width", f"{_pad('height', tile, stride, rule)} as pad_h", f"{_pad('width', tile, stride, rule)} as pad_w"
    ).selectExpr(
        "scene_id", f"{X.tile_count('height', 'pad_h', tile, stride)} as n_rows", f"{X.tile_count('width', 'pad_w', tile, stride)} as n_cols"
    )


def route_scenes(meta: DataFrame, limit: int = SINGLE_PASS_MAX_PX) -> DataFrame:
    """Single model pass for small scenes, tiling for the rest."""
    return meta.selectExpr("scene_id", "height", "width", f"if(greatest(height, width) <= {limit}, 'single', 'tiled') as route")


def pad_pixels(pixels: DataFrame, sizes: DataFrame, mode: str = "reflect") -> DataFrame:
    """Pad bottom/right. `sizes` holds (scene_id, height, width, pad_h, pad_w)."""
    targets = {"reflect": X.reflect_targets, "edge": X.edge_targets, "constant": X.edge_targets}[mode]
    rest = [c for c in pixels.columns if c not in ("row", "col", "value")]
    value = "if(_pr >= height or _pc >= width, 0, value)" if mode == "constant" else "value"
    j = salted_join(pixels, sizes.select("scene_id", "height", "width", "pad_h", "pad_w"), ["scene_id"], ["row", "col"])
    return (
        j.selectExpr("*", f"explode({targets('row', 'height', '(height + pad_h)')}) as _pr")
        .selectExpr("*", f"explode({targets('col', 'width', '(width + pad_w)')}) as _pc")
        .selectExpr(*rest, "_pr as row", "_pc as col", f"{value} as value")
    )


def strip_padding(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    j = salted_join(pixels, meta.select("scene_id", "height", "width"), ["scene_id"], ["row", "col"])
    return j.where("row < height and col < width").drop("height", "width")


def split_tiles(
    pixels: DataFrame, meta: DataFrame, tile: int = 256, overlap: int = 32, mode: str = "reflect", rule: str = "cover"
) -> DataFrame:
    """Overlapping tiles in long layout: tile_row, tile_col and the position (i, j) inside."""
    stride = check_overlap(tile, overlap)
    sizes = meta.selectExpr(
        "scene_id", "height", "width", f"{_pad('height', tile, stride, rule)} as pad_h", f"{_pad('width', tile, stride, rule)} as pad_w"
    )
    counts = sizes.selectExpr(
        "scene_id", "height", "width", "pad_h", "pad_w",
        f"{X.tile_count('height', 'pad_h', tile, stride)} as _nr", f"{X.tile_count('width', 'pad_w', tile, stride)} as _nc",
    )
    targets = {"reflect": X.reflect_targets, "edge": X.edge_targets, "constant": X.edge_targets}[mode]
    rest = [c for c in pixels.columns if c not in ("row", "col", "value")]
    value = "if(_pr >= height or _pc >= width, 0, value)" if mode == "constant" else "value"
    return (
        salted_join(pixels, counts, ["scene_id"], ["row", "col"])
        .selectExpr("*", f"explode({targets('row', 'height', '(height + pad_h)')}) as _pr")
        .selectExpr("*", f"explode({X.covering_tiles('_pr', '_nr', tile, stride)}) as tile_row")
        .selectExpr("*", f"explode({targets('col', 'width', '(width + pad_w)')}) as _pc")
        .selectExpr("*", f"explode({X.covering_tiles('_pc', '_nc', tile, stride)}) as tile_col")
        .selectExpr(
            *rest, "tile_row", "tile_col", f"_pr - tile_row * {stride} as i", f"_pc - tile_col * {stride} as j", f"{value} as value"
        )
    )


def stitch_tiles(
    tiles: DataFrame,
    meta: DataFrame,
    tile: int = 256,
    overlap: int = 32,
    value: str = "p",
    rule: str = "cover",
    canvas: DataFrame | None = None,
) -> DataFrame:
    """Hann-blended map from long-layout tiles: sums combine map-side, one shuffle.

    `rule="cli"` divides by max(weight, 1e-8) and does not clip. `canvas` (scene_id, row, col)
    lists pixels that must appear even where no tile reaches them; they read 0.
    """
    stride = check_overlap(tile, overlap)
    placed = tiles.selectExpr(
        "scene_id", f"tile_row * {stride} + i as row", f"tile_col * {stride} + j as col",
        f"{X.hann('i', tile)} * {X.hann('j', tile)} as _w", f"{value} as _p",
    )
    parts = strip_padding(placed, meta).selectExpr("scene_id", "row", "col", "_p * _w as _pw", "_w")
    if canvas is not None:
        parts = parts.unionByName(canvas.selectExpr("scene_id", "row", "col", "0D as _pw", "0D as _w"))
    sums = parts.groupBy("scene_id", "row", "col").agg(expr("sum(_pw) as _pw"), expr("sum(_w) as _w"))
    if rule == "cli":
        out = "_pw / greatest(_w, 1e-8D)"
    else:
        out = X.clip("_pw / if(_w > 1e-9D, _w, 1D)", 0, 1)
    return sums.selectExpr("scene_id", "row", "col", f"{out} as p")


# --- block layout ---------------------------------------------------------------------------

def _segments(pos: np.ndarray, cell: np.ndarray):
    """Group positions by cell: (cell, positions) pairs."""
    order = np.argsort(cell, kind="stable")
    cuts = np.flatnonzero(np.diff(cell[order])) + 1
    return [(int(cell[g[0]]), pos[g]) for g in np.split(order, cuts) if len(g)]


@lru_cache(256)
def _axis_pieces(first: int, n: int, side: int, total: int, tile: int, stride: int, mode: str = "reflect"):
    """(tile index, positions in tile, source positions) for source lines first..first+n-1."""
    # Direct lines plus the mirrored or repeated ones.
    period = max(2 * (side - 1), 1)
    src = np.arange(first, first + n)
    at, of = [src], [src]
    if total > side and (mode != "reflect" or side == 1):
        if first + n == side:
            at.append(np.arange(side, total))
            of.append(np.full(total - side, side - 1))
    elif total > side:
        for k in range(1, total // period + 2):
            for sign in (-1, 1):
                p = k * period + sign * src
                ok = (p >= side) & (p < total)
                at.append(p[ok])
                of.append(src[ok])
    at, of = np.concatenate(at), np.concatenate(of)
    at, keep = np.unique(at, return_index=True)
    of = of[keep] - first
    n_tiles = max(0, (total - tile) // stride + 1)
    out = []
    for back in (0, 1):
        t = at // stride - back
        ok = (t >= 0) & (t < n_tiles) & (at - t * stride < tile)
        idx = np.flatnonzero(ok)
        out += [(ti, at[idx[g]] - ti * stride, of[idx[g]]) for ti, g in _segments(np.arange(len(idx)), t[idx])]
    return out


# A task sends its pieces on in lots, so that it never holds those of a whole batch of blocks.
PIECES_AT_ONCE = 512
PIECE_SCHEMA = (
    "scene_id int, t string, band int, tile_row int, tile_col int, ii array<int>, jj array<int>, data array<double>"
)


def split_blocks(
    blocks: DataFrame, meta: DataFrame, block_h: int, block_w: int, tile: int = 256, overlap: int = 32, mode: str = "reflect", rule: str = "cover"
) -> DataFrame:
    """Tile arrays from raster blocks: (scene_id, t, band, tile_row, tile_col, data).

    Each block is cut into the few pieces its tiles need, halo and padding (`reflect`, `edge` or
    `constant` 0) included; a tile is then assembled from its pieces. Pixels never become rows.
    Null pixels and pixels of missing blocks are null. `rule` is the padding rule of `split_tiles`.
    """
    stride = check_overlap(tile, overlap)
    sizes = meta.selectExpr(
        "scene_id", "height", "width", f"height + {_pad('height', tile, stride, rule)} as _th", f"width + {_pad('width', tile, stride, rule)} as _tw"
    )

    columns = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def cut_pieces(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                img = np.asarray(b.data, float).reshape(b.h, b.w)
                down = _axis_pieces(b.block_row * block_h, b.h, b.height, b.padded_h, tile, stride, mode)
                across = _axis_pieces(b.block_col * block_w, b.w, b.width, b.padded_w, tile, stride, mode)
                for tr, ii, si in down:
                    for tc, jj, sj in across:
                        piece = img[np.ix_(si, sj)]
                        if mode == "constant":
                            piece[tr * stride + ii >= b.height, :] = 0.0
                            piece[:, tc * stride + jj >= b.width] = 0.0
                        yield b.scene_id, b.t, b.band, tr, tc, ii, jj, piece.ravel()

    def assemble(rows):
        """All dates and bands of one tile; a few pieces each."""
        tiles: dict[tuple, np.ndarray] = {}
        for t, band, ii, jj, data in zip(rows["t"], rows["band"], rows["ii"], rows["jj"], rows["data"]):
            if (t, band) not in tiles:
                tiles[t, band] = np.full((tile, tile), np.nan)
            tiles[t, band][np.ix_(ii, jj)] = np.reshape(data, (len(ii), len(jj)))
        place = rows["scene_id"][0], rows["tile_row"][0], rows["tile_col"][0]
        return [(place[0], *which, *place[1:], out.ravel()) for which, out in tiles.items()]

    j = salted_join(blocks, sizes, ["scene_id"], ["t", "band", "block_row", "block_col"]).selectExpr(
        "scene_id", "t", "band", "block_row", "block_col", "h", "w", "data", "height", "width", "_th as padded_h", "_tw as padded_w"
    )
    pieces = j.mapInPandas(lambda batches: in_lots(cut_pieces(batches), columns, PIECES_AT_ONCE), PIECE_SCHEMA)
    return map_each_group(
        pieces, ["scene_id", "tile_row", "tile_col"], assemble, "scene_id int, t string, band int, tile_row int, tile_col int, data array<double>"
    ).withColumn("data", expr(X.nan_to_null("data")))


def stitch_blocks(tiles: DataFrame, meta: DataFrame, tile: int = 256, overlap: int = 32, data: str = "data", rule: str = "cover") -> DataFrame:
    """Hann-blended raster blocks of stride x stride from tile arrays.

    A tile falls into at most four output cells, so the shuffle moves four arrays per tile and
    a cell sums at most four pieces. Null scores carry no weight; a pixel without any score is null.
    `rule="cli"` divides by max(weight, 1e-8), does not clip, and pixels that no tile reaches are 0.
    """
    stride = check_overlap(tile, overlap)
    schema = "scene_id int, block_row int, block_col int, down int, across int, data array<double>"
    columns = ["scene_id", "block_row", "block_col", "down", "across", "data"]
    window = np.hanning(tile)
    spans = {0: (0, stride), 1: (stride, tile)}

    def cut_pieces(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                img = np.asarray(b.data, float).reshape(tile, tile)
                for dr, (r0, r1) in spans.items():
                    for dc, (c0, c1) in spans.items():
                        if r1 > r0 and c1 > c0:
                            yield b.scene_id, b.tile_row + dr, b.tile_col + dc, dr, dc, img[r0:r1, c0:c1].ravel()

    def blend(rows):
        total, weight, seen = np.zeros((stride, stride)), np.zeros((stride, stride)), np.zeros((stride, stride), bool)
        reached = np.zeros((stride, stride), bool)
        for down, across, data in zip(rows["down"], rows["across"], rows["data"]):
            (r0, r1), (c0, c1) = spans[down], spans[across]
            part = np.asarray(data, float).reshape(r1 - r0, c1 - c0)
            there = ~np.isnan(part)
            k = np.outer(window[r0:r1], window[c0:c1]) * there
            total[: r1 - r0, : c1 - c0] += np.where(there, part, 0.0) * k
            weight[: r1 - r0, : c1 - c0] += k
            seen[: r1 - r0, : c1 - c0] |= there
            reached[: r1 - r0, : c1 - c0] = True
        if rule == "cli":
            blended = total / np.maximum(weight, 1e-8)
        else:
            blended = np.clip(total / np.where(weight > 1e-9, weight, 1.0), 0.0, 1.0)
        out = np.where(seen | ~reached, blended, np.nan) if rule == "cli" else np.where(seen, blended, np.nan)
        return [(rows["scene_id"][0], rows["block_row"][0], rows["block_col"][0], out.ravel())]

    pieces = tiles.selectExpr("scene_id", "tile_row", "tile_col", f"{data} as data").mapInPandas(
        lambda batches: in_lots(cut_pieces(batches), columns, PIECES_AT_ONCE), schema
    )
    cells = map_each_group(
        pieces, ["scene_id", "block_row", "block_col"], blend, "scene_id int, block_row int, block_col int, data array<double>", ["down", "across"]
    )
    # Trim cells that stick out of the scene.
    if rule == "cli":
        grid = meta.selectExpr("scene_id", "height", "width", f"explode(sequence(0, (height - 1) div {stride})) as block_row").selectExpr(
            "*", f"explode(sequence(0, (width - 1) div {stride})) as block_col"
        )
        j = grid.join(cells, ["scene_id", "block_row", "block_col"], "left").withColumn("data", expr(f"coalesce(data, array_repeat(0D, {stride * stride}))"))
    else:
        j = salted_join(cells, meta.select("scene_id", "height", "width"), ["scene_id"], ["block_row", "block_col"])
    return (
        j.selectExpr("*", f"least({stride}, height - block_row * {stride}) as h", f"least({stride}, width - block_col * {stride}) as w")
        .where("h > 0 and w > 0")
        .selectExpr(
            "scene_id", "block_row", "block_col", "h", "w",
            f"flatten(transform(sequence(0, greatest(h, 1) - 1), r -> slice(data, r * {stride} + 1, greatest(w, 0)))) as data",
        )
        .withColumn("data", expr(X.nan_to_null("data")))
    )


# --- pairs, crops, sizes --------------------------------------------------------------------

def tile_pairs(tiles: DataFrame, data: str = "data") -> DataFrame:
    """A and B of the same tile side by side; one shuffle, two rows per group."""
    keys = [c for c in tiles.columns if c not in ("t", data)]
    return (
        tiles.groupBy(*keys)
        .agg(expr(f"max(if(t = 'A', {data}, null)) as data_a"), expr(f"max(if(t = 'B', {data}, null)) as data_b"))
        .where("data_a is not null and data_b is not null")
    )


def shape_mismatches(sizes: DataFrame) -> DataFrame:
    """Scenes whose two dates differ in size or lack one date; (scene_id, t, height, width)."""
    return (
        sizes.groupBy("scene_id")
        .agg(*[expr(f"max(if(t = '{t}', {c}, null)) as {c}_{t.lower()}") for t in "AB" for c in ("height", "width")])
        .where("not (height_a <=> height_b and width_a <=> width_b)")
    )


def crop_patches(pixels: DataFrame, meta: DataFrame, crop: int = 256) -> DataFrame:
    """Non-overlapping patches, remainder dropped; the index is row-major and closed-form."""
    rest = [c for c in pixels.columns if c not in ("scene_id", "row", "col")]
    j = salted_join(pixels, meta.select("scene_id", "height", "width"), ["scene_id"], ["row", "col"])
    index = f"(row div {crop}) * (width div {crop}) + col div {crop}"
    return j.where(f"row < (height div {crop}) * {crop} and col < (width div {crop}) * {crop}").selectExpr(
        "scene_id", f"{X.patch_id('scene_id', index)} as patch_id", f"row % {crop} as row", f"col % {crop} as col", *rest
    )


def resize_bilinear(pixels: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("scene_id", "t", "band")) -> DataFrame:
    """Bilinear enlargement with half-pixel centres.

    `sizes` holds (scene_id, height, width, out_h, out_w). Each source pixel pushes its share
    to the output pixels it touches; shares are summed map-side, and no output grid is made.
    """

    def shares(i: str, n: str, m: str) -> str:
        lo = f"if({i} = 0, 0, greatest(0, int(floor(({i} - 0.5D) * {m} / {n} - 0.5D))))"
        hi = f"if({i} = {n} - 1, {m} - 1, least({m} - 1, int(ceil(({i} + 1.5D) * {m} / {n} - 0.5D))))"
        at = f"least(greatest((o + 0.5D) * {n} / {m} - 0.5D, 0D), {n} - 1D)"
        return f"filter(transform(sequence({lo}, {hi}), o -> struct(o as o, 1D - abs({at} - {i}) as w)), s -> s.w > 0)"

    j = salted_join(pixels, sizes.select("scene_id", "height", "width", "out_h", "out_w"), ["scene_id"], ["row", "col"])
    return (
        j.selectExpr("*", f"explode({shares('row', 'height', 'out_h')}) as _r")
        .selectExpr("*", f"explode({shares('col', 'width', 'out_w')}) as _c")
        .selectExpr(*keys, "_r.o as row", "_c.o as col", "_r.w * _c.w * value as _v")
        .groupBy(*keys, "row", "col")
        .agg(expr("sum(_v) as value"))
    )
