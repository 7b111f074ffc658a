"""Operators that look around a pixel, on raster blocks.

One exchange serves all of them. An output block reads a window of source lines and columns; each
source block knows, per axis, which output blocks read from it, cuts those lines out and sends
them. A group is one output block: its own pixels and the rims of its neighbours. Pixels never
become rows, and no group grows with the scene.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changegrid.functions import expr as X
from changegrid.operators.augment import BLUR
from changegrid.plans.joins import salted_join

KEYS = ("scene_id", "t", "band")


def reflected(i: np.ndarray, n: int) -> np.ndarray:
    """Source index of each index under mirror padding that does not repeat the edge."""
    m = np.mod(i, max(2 * (n - 1), 1))
    return np.where(m < n, m, 2 * (n - 1) - m) if n > 1 else np.zeros_like(i)


def _readers(first: str, n: str, o_lo: str, o_hi: str, lo: str, hi: str) -> str:
    """Output blocks o_lo..o_hi that read lines of a block (first, n): array of (o, lo, hi), absolute lines."""
    spans = f"transform(sequence(int({o_lo}), int({o_hi})), o -> struct(o as o, int(greatest({lo}, {first})) as lo, int(least({hi}, {first} + {n} - 1)) as hi))"
    return f"if({o_hi} < {o_lo}, array(), filter({spans}, s -> s.lo <= s.hi))"


def exchange(
    blocks: DataFrame, sizes: DataFrame, block_h: int, block_w: int, down: str, across: str, kernel: Callable, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Blocks of `kernel(window, first line, first column, block)`: (*keys, block_row, block_col, h, w, data).

    `sizes` holds (scene_id, height, width, out_h, out_w). `down` and `across` are SQL arrays of
    (o, lo, hi), as `_readers` gives them. The kernel sees NaN for null and missing source pixels;
    NaN it returns becomes null. Scenes without a size and null blocks give no rows; output
    blocks none of whose source blocks exist are missing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    wanted = blocks.where("data is not null").select(*keys, "block_row", "block_col", "h", "w", "data")
    j = salted_join(wanted, sizes.select("scene_id", "height", "width", "out_h", "out_w"), ["scene_id"], [*(k for k in keys if k != "scene_id"), "block_row", "block_col"])
    top, left = f"block_row * {block_h}", f"block_col * {block_w}"
    lines = f"transform(sequence(_r.lo - {top}, _r.hi - {top}), r -> slice(data, int(r * w + _c.lo - {left} + 1), _c.hi - _c.lo + 1))"
    pieces = (
        j.selectExpr("*", f"explode({down}) as _r")
        .selectExpr("*", f"explode({across}) as _c")
        .selectExpr(
            *keys, "_r.o as block_row", "_c.o as block_col", "height", "width", "out_h", "out_w",
            "_r.lo as _r0", "_r.hi as _r1", "_c.lo as _c0", "_c.hi as _c1", f"cast(flatten({lines}) as array<double>) as _data",
        )
    )

    def assemble(table: pa.Table) -> pa.Table:
        r0, r1, c0, c1 = (table[c].to_numpy() for c in ("_r0", "_r1", "_c0", "_c1"))
        window = np.full((r1.max() - r0.min() + 1, c1.max() - c0.min() + 1), np.nan)
        for k, a, b, c, d in zip(range(len(r0)), r0 - r0.min(), r1 - r0.min() + 1, c0 - c0.min(), c1 - c0.min() + 1):
            part = table["_data"][k].values
            window[a:b, c:d] = part.to_numpy(zero_copy_only=False).reshape(b - a, d - c)
        head = table.slice(0, 1)
        one = {c: head[c][0].as_py() for c in ("block_row", "block_col", "height", "width", "out_h", "out_w")}
        one["h"] = min(block_h, one["out_h"] - one["block_row"] * block_h)
        one["w"] = min(block_w, one["out_w"] - one["block_col"] * block_w)
        out = kernel(window, int(r0.min()), int(c0.min()), one)
        data = pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), pa.array(out.ravel(), pa.float64(), from_pandas=True))
        extra = {"h": pa.array([one["h"]], pa.int32()), "w": pa.array([one["w"]], pa.int32()), "data": data}
        return pa.table({**{c: head[c] for c in (*keys, "block_row", "block_col")}, **extra})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "block_row int, block_col int, h int, w int, data array<double>"])
    return pieces.groupBy(*keys, "block_row", "block_col").applyInArrow(assemble, schema)


def blur_blocks(blocks: DataFrame, meta: DataFrame, block_h: int, block_w: int, size: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Binomial blur with mirrored border, as `augment.blur` on pixels.

    Null and missing pixels add nothing; a pixel that sees no other is null.
    """
    half, weights = size // 2, np.array(BLUR[size]) / sum(BLUR[size])

    def axis(at: str, n: str, block: int, side: str) -> str:
        first = f"({at} * {block})"
        return _readers(
            first, n, f"greatest(0, ({first} - {half}) div {block})", f"least(({side} - 1) div {block}, ({first} + {n} - 1 + {half}) div {block})",
            f"o * {block} - {half}", f"least((o + 1) * {block}, {side}) - 1 + {half}",
        )

    def kernel(window: np.ndarray, row: int, col: int, one: dict) -> np.ndarray:
        r = reflected(np.arange(-half, one["h"] + half) + one["block_row"] * block_h, one["height"]) - row
        c = reflected(np.arange(-half, one["w"] + half) + one["block_col"] * block_w, one["width"]) - col
        # Lines of missing blocks at the window's rim.
        inside = np.ix_((r >= 0) & (r < len(window)), (c >= 0) & (c < window.shape[1]))
        padded = np.full((len(r), len(c)), np.nan)
        padded[inside] = window[np.ix_(r[inside[0].ravel()], c[inside[1].ravel()])]
        seen = ~np.isnan(padded)

        def smooth(img: np.ndarray) -> np.ndarray:
            rows = sum(w * img[k : k + one["h"]] for k, w in enumerate(weights))
            return sum(w * rows[:, k : k + one["w"]] for k, w in enumerate(weights))

        return np.where(smooth(seen.astype(float)) > 0, smooth(np.where(seen, padded, 0.0)), np.nan)

    sizes = meta.selectExpr("scene_id", "height", "width", "height as out_h", "width as out_w")
    down, across = axis("block_row", "h", block_h, "height"), axis("block_col", "w", block_w, "width")
    return exchange(blocks, sizes, block_h, block_w, down, across, kernel, keys)


def resize_blocks(blocks: DataFrame, sizes: DataFrame, block_h: int, block_w: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bilinear resize with half-pixel centres, as `tiling.resize_bilinear` on pixels; output blocks
    have the same sides. `sizes` holds (scene_id, height, width, out_h, out_w).

    Null and missing pixels add nothing; a pixel that reads no other is null. Windows are the
    block scaled to the source, so shrinking by a large factor makes them large.
    """

    def axis(at: str, n: str, block: int, side: str, out: str) -> str:
        first, last = f"({at} * {block})", f"(({out} - 1) div {block})"
        place = lambda i: f"least(greatest((({i}) + 0.5D) * {side} / {out} - 0.5D, 0D), {side} - 1D)"
        return _readers(
            first, n,
            f"if({first} = 0, 0, greatest(0, int(floor(({first} - 0.5D) * {out} / {side} - 0.5D)) div {block}))",
            f"if({first} + {n} >= {side}, {last}, least({last}, int(ceil(({first} + {n} + 0.5D) * {out} / {side} - 0.5D)) div {block}))",
            f"floor({place(f'o * {block}')})", f"least(floor({place(f'least((o + 1) * {block}, {out}) - 1')}) + 1, {side} - 1)",
        )

    def kernel(window: np.ndarray, row: int, col: int, one: dict) -> np.ndarray:
        def taps(first: int, n: int, side: int, out: int, offset: int, length: int):
            at = np.clip((np.arange(first, first + n) + 0.5) * side / out - 0.5, 0, side - 1)
            low = np.floor(at).astype(int)
            for i, w in ((low, 1 - (at - low)), (np.minimum(low + 1, side - 1), at - low)):
                there = (i >= offset) & (i < offset + length)
                yield np.where(there, i - offset, 0), np.where(there, w, 0.0)

        total, weight = np.zeros((one["h"], one["w"])), np.zeros((one["h"], one["w"]))
        for r, wr in taps(one["block_row"] * block_h, one["h"], one["height"], one["out_h"], row, len(window)):
            for c, wc in taps(one["block_col"] * block_w, one["w"], one["width"], one["out_w"], col, window.shape[1]):
                value, share = window[np.ix_(r, c)], np.outer(wr, wc)
                share = np.where(np.isnan(value), 0.0, share)
                total += share * np.nan_to_num(value)
                weight += share
        return np.where(weight > 0, total, np.nan)

    down, across = axis("block_row", "h", block_h, "height", "out_h"), axis("block_col", "w", block_w, "width", "out_w")
    return exchange(blocks, sizes, block_h, block_w, down, across, kernel, keys)


def pad_blocks(blocks: DataFrame, sizes: DataFrame, block_h: int, block_w: int, mode: str = "reflect", keys: Sequence[str] = KEYS) -> DataFrame:
    """Pad bottom/right by `reflect`, `edge` or `constant` (0), as `tiling.pad_pixels` on pixels.

    `sizes` holds (scene_id, height, width, pad_h, pad_w). The padded scene has blocks of the same
    sides. A block of padding reads the lines it mirrors or repeats; one of constant padding reads
    one line, to exist.
    """

    def axis(at: str, n: str, block: int, side: str, out: str) -> str:
        first = f"({at} * {block})"
        begin, end = f"(o * {block})", f"(least((o + 1) * {block}, {out}) - 1)"
        # Lines a block reads: its own part of the scene, and what its padded part reads of it.
        if mode == "reflect":
            period = f"greatest(2 * ({side} - 1), 1)"
            turns = f"{begin} div {period} <> {end} div {period} or ({begin} % {period} < {side} - 1 and {end} % {period} > {side} - 1)"
            low, high = (f"{f}({X.reflect_index(begin, side)}, {X.reflect_index(end, side)})" for f in ("least", "greatest"))
            lo = f"if({begin} div {period} <> {end} div {period}, 0, {low})"
            hi = f"if({turns}, {side} - 1, {high})"
        else:
            lo, hi = f"least({begin}, {side} - 1)", f"least({end}, {side} - 1)"
        return _readers(first, n, at, f"(({out} - 1) div {block})", lo, hi)

    def kernel(window: np.ndarray, row: int, col: int, one: dict) -> np.ndarray:
        r = np.arange(one["h"]) + one["block_row"] * block_h
        c = np.arange(one["w"]) + one["block_col"] * block_w
        if mode == "reflect":
            sr, sc = reflected(r, one["height"]), reflected(c, one["width"])
        else:
            sr, sc = np.minimum(r, one["height"] - 1), np.minimum(c, one["width"] - 1)
        there = np.ix_((sr >= row) & (sr < row + len(window)), (sc >= col) & (sc < col + window.shape[1]))
        out = np.full((one["h"], one["w"]), np.nan)
        out[there] = window[np.ix_(sr[there[0].ravel()] - row, sc[there[1].ravel()] - col)]
        if mode == "constant":
            out[r >= one["height"], :] = 0.0
            out[:, c >= one["width"]] = 0.0
        return out

    grown = sizes.selectExpr("scene_id", "height", "width", "height + pad_h as out_h", "width + pad_w as out_w")
    down, across = axis("block_row", "h", block_h, "height", "out_h"), axis("block_col", "w", block_w, "width", "out_w")
    return exchange(blocks, grown, block_h, block_w, down, across, kernel, keys)
