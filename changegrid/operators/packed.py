"""Paired augmentation of packed patches: one row per patch (and date, band), `data` row-major.

Draws are those of `augment`, taken once per row in SQL; whole arrays are then flipped, turned,
cropped or resampled in numpy, a batch of patches at a time. Nothing is shuffled and no pixel
becomes a row, so any operator can follow another in one stage. Null rows stay null, null pixels
stay null; a row of another length than height x width is an error. Other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import expr

from changegrid.operators.augment import BLUR, _draw
from changegrid.operators.stencil import reflected

ARRAY = T.ArrayType(T.DoubleType())


def unpack(patches: DataFrame, width: int, data: str = "data", value: str = "value") -> DataFrame:
    """Packed patches as pixel rows: row, col and `value`."""
    rest = [c for c in patches.columns if c != data]
    return patches.selectExpr(*rest, f"posexplode({data}) as (_i, {value})").selectExpr(*rest, f"int(_i div {width}) as row", f"int(_i % {width}) as col", value)


def _on_arrays(
    patches: DataFrame, height: int, width: int, draws: dict[str, str], run: Callable[..., list[np.ndarray]], columns: Sequence[str] = ("data",)
) -> DataFrame:
    """Map `run(images, draws)` over batches; images are (n, height, width) arrays, one per column."""
    schema = T.StructType([T.StructField(f.name, ARRAY if f.name in columns else f.dataType, True) for f in patches.schema])
    drawn = patches.withColumns(
        {**{c: expr(f"cast({c} as array<double>)") for c in columns}, "_draws": expr(f"struct({', '.join(f'{e} as {n}' for n, e in draws.items())})")}
    )

    def images(column: pa.ListArray, there: np.ndarray) -> np.ndarray:
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)[there]
        if (lengths != height * width).any():
            raise ValueError(f"a patch of {height} x {width} px has {height * width} values, found one with {int(lengths[lengths != height * width][0])}")
        return column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, height, width)

    def packed(found: np.ndarray, there: np.ndarray) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(there * (found[0].size if len(found) else 0))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ravel(), pa.float64(), from_pandas=True), mask=pa.array(~there))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.logical_and.reduce([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns])
            kept = batch.filter(pa.array(there))
            struct = kept.column("_draws")
            found = run(
                [images(kept.column(c), np.ones(len(kept), bool)) for c in columns],
                {n: struct.field(n).to_numpy(zero_copy_only=False) for n in draws},
            )
            new = {c: packed(img, there) for c, img in zip(columns, found)}
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(f.name)) for f in schema], names=schema.names)

    return drawn.mapInArrow(mapped, schema)


def flip(patches: DataFrame, height: int, width: int, epoch: int = 0, p: float = 0.5) -> DataFrame:
    """`augment.flip` of packed patches."""

    def run(images, d):
        img = np.where((d["v"] < p)[:, None, None], images[0][:, ::-1], images[0])
        return [np.where((d["h"] < p)[:, None, None], img[:, :, ::-1], img)]

    return _on_arrays(patches, height, width, {"h": _draw("hflip", epoch), "v": _draw("vflip", epoch)}, run)


def rotate90(patches: DataFrame, side: int, epoch: int = 0, p: float = 0.5) -> DataFrame:
    """`augment.rotate90` of packed patches."""

    def run(images, d):
        turns = np.where(d["on"] < p, np.floor(d["k"] * 4), 0)
        out = images[0].copy()
        for k in (1, 2, 3):
            out[turns == k] = np.rot90(images[0][turns == k], k, axes=(1, 2))
        return [out]

    return _on_arrays(patches, side, side, {"on": _draw("rot90", epoch), "k": _draw("rot90_k", epoch)}, run)


def center_crop(patches: DataFrame, height: int, width: int, crop: int) -> DataFrame:
    """`augment.center_crop` of packed patches: their middle, crop x crop."""
    top, left = (height - crop) // 2, (width - crop) // 2
    return _on_arrays(patches, height, width, {"none": "0"}, lambda images, d: [images[0][:, top : top + crop, left : left + crop]])


def random_crop(patches: DataFrame, height: int, width: int, crop: int, epoch: int = 0) -> DataFrame:
    """`augment.random_crop` of packed patches."""

    def run(images, d):
        r = np.floor(d["r"] * (height - crop + 1)).astype(int)[:, None] + np.arange(crop)
        c = np.floor(d["c"] * (width - crop + 1)).astype(int)[:, None] + np.arange(crop)
        return [images[0][np.arange(len(r))[:, None, None], r[:, :, None], c[:, None, :]]]

    return _on_arrays(patches, height, width, {"r": _draw("crop_r", epoch), "c": _draw("crop_c", epoch)}, run)


def shift_scale_rotate(
    patches: DataFrame, height: int, width: int, epoch: int = 0, p: float = 0.3, shift: float = 0.0625, scale: float = 0.1, angle: float = 15.0
) -> DataFrame:
    """`augment.shift_scale_rotate` of packed patches: bilinear, zeros outside; null pixels read as 0."""
    cy, cx = (height - 1) / 2, (width - 1) / 2

    def run(images, d):
        on = d["on"] < p
        t, s, dx, dy = (
            x[on, None, None] for x in (np.radians((d["a"] * 2 - 1) * angle), 1 + (d["s"] * 2 - 1) * scale, (d["x"] * 2 - 1) * shift * width, (d["y"] * 2 - 1) * shift * height)
        )
        row, col = np.mgrid[0:height, 0:width]
        x = (np.cos(t) * (col - cx - dx) - np.sin(t) * (row - cy - dy)) / s + cx
        y = (np.sin(t) * (col - cx - dx) + np.cos(t) * (row - cy - dy)) / s + cy
        src, which = np.nan_to_num(images[0][on]), np.arange(int(on.sum()))[:, None, None]
        moved = np.zeros_like(src)
        for dr in (0, 1):
            for dc in (0, 1):
                r, c = np.floor(y).astype(int) + dr, np.floor(x).astype(int) + dc
                inside = (r >= 0) & (r < height) & (c >= 0) & (c < width)
                w = np.abs(1 - dr - (y - np.floor(y))) * np.abs(1 - dc - (x - np.floor(x)))
                moved += np.where(inside, w * src[which, np.clip(r, 0, height - 1), np.clip(c, 0, width - 1)], 0.0)
        out = images[0].copy()
        out[on] = moved
        return [out]

    draws = {n: _draw(op, epoch) for n, op in (("on", "ssr"), ("a", "ssr_a"), ("s", "ssr_s"), ("x", "ssr_x"), ("y", "ssr_y"))}
    return _on_arrays(patches, height, width, draws, run)


def color_jitter(
    rgb: DataFrame, height: int, width: int, epoch: int = 0, p: float = 0.5, brightness: float = 0.2, contrast: float = 0.2, saturation: float = 0.2, hue: float = 0.1
) -> DataFrame:
    """`augment.color_jitter` of packed images (patch_id, t, r, g, b), an array per channel."""
    luma = lambda c: 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]

    def run(images, d):
        on = d["on"] < p
        b, c, s = (1 + (d[n][on, None, None] * 2 - 1) * r for n, r in (("b", brightness), ("c", contrast), ("s", saturation)))
        x = np.clip(np.stack([img[on] for img in images]) * b, 0, 1)
        mean = np.nanmean(luma(x), axis=(1, 2), keepdims=True) if on.any() else 0.0
        x = np.clip(mean + (x - mean) * c, 0, 1)
        grey = luma(x)
        x = np.clip(grey + (x - grey) * s, 0, 1)
        # Hue turns in HSV: value and chroma stay, the sector moves.
        v, chroma = x.max(0), x.max(0) - x.min(0)
        safe = np.where(chroma == 0, 1.0, chroma)
        sector = np.where(
            v == x[0], np.mod((x[1] - x[2]) / safe, 6), np.where(v == x[1], (x[2] - x[0]) / safe + 2, (x[0] - x[1]) / safe + 4)
        )
        sector = np.where(chroma == 0, 0.0, sector)
        turned = np.mod(sector / 6 + (d["h"][on, None, None] * 2 - 1) * hue, 1) * 6
        out = [img.copy() for img in images]
        for img, n in zip(out, (5, 3, 1)):
            k = np.mod(n + turned, 6)
            img[on] = v - chroma * np.clip(np.minimum(k, 4 - k), 0, 1)
        return out

    draws = {n: _draw(op, epoch, "t") for n, op in (("on", "jitter"), ("b", "jit_b"), ("c", "jit_c"), ("s", "jit_s"), ("h", "jit_h"))}
    return _on_arrays(rgb, height, width, draws, run, ("r", "g", "b"))


def gauss_noise(patches: DataFrame, height: int, width: int, epoch: int = 0, p: float = 0.3, var: tuple[float, float] = (10.0, 50.0)) -> DataFrame:
    """Additive normal noise on byte-scale values of (patch_id, t, band, data).

    Whether and how strong is drawn as in `augment.gauss_noise`; the samples come from one
    counter-based generator per array, keyed by patch, date, band and epoch, instead of a hash per
    pixel. So they differ from the pixel form's and are the same on any partition and any retry.
    """

    def run(images, d):
        out = images[0].copy()
        for k in np.flatnonzero(d["on"] < p):
            z = np.random.Generator(np.random.Philox(key=int(d["key"][k]) & (2**64 - 1))).standard_normal((height, width))
            out[k] = np.clip(out[k] + math.sqrt(var[0] + d["s"][k] * (var[1] - var[0])) * z, 0, 255)
        return [out]

    draws = {"on": _draw("noise", epoch, "t"), "s": _draw("noise_s", epoch, "t"), "key": f"xxhash64(patch_id, t, band, {epoch})"}
    return _on_arrays(patches, height, width, draws, run)


def random_blur(patches: DataFrame, height: int, width: int, epoch: int = 0, p: float = 0.2, sizes: tuple[int, ...] = (3, 5)) -> DataFrame:
    """`augment.random_blur` of packed patches; null pixels add nothing."""

    def blurred(img: np.ndarray, size: int) -> np.ndarray:
        half, weights = size // 2, np.array(BLUR[size]) / sum(BLUR[size])
        r, c = (reflected(np.arange(-half, n + half), n) for n in (height, width))
        padded = img[:, r][:, :, c]
        down = lambda x: sum(w * x[:, k : k + height] for k, w in enumerate(weights))
        across = lambda x: sum(w * x[:, :, k : k + width] for k, w in enumerate(weights))
        return np.where(across(down((~np.isnan(padded)).astype(float))) > 0, across(down(np.nan_to_num(padded))), np.nan)

    def run(images, d):
        size = np.where(d["on"] < p, np.array(sizes)[np.floor(d["k"] * len(sizes)).astype(int)], 0)
        out = images[0].copy()
        for s in sizes:
            out[size == s] = blurred(images[0][size == s], s)
        return [out]

    return _on_arrays(patches, height, width, {"on": _draw("blur", epoch), "k": _draw("blur_k", epoch)}, run)
