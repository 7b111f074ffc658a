"""Raster layouts and band-level operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.functions import expr

from changegrid.functions import expr as X
from changegrid.operators.quantiles import group_quantiles
from changegrid.plans.joins import salted_join


def block_pixels(blocks: DataFrame, block_h: int, block_w: int) -> DataFrame:
    """Block layout to one row per pixel (row-major data of h x w)."""
    rest = [c for c in blocks.columns if c not in ("block_row", "block_col", "h", "w", "data")]
    return blocks.selectExpr(*rest, "block_row", "block_col", "w", "posexplode(data) as (_i, value)").selectExpr(
        *rest,
        f"int(block_row * {block_h} + floor(_i / w)) as row",
        f"int(block_col * {block_w} + pmod(_i, w)) as col",
        "value",
    )


def pack_blocks(
    pixels: DataFrame, block_h: int, block_w: int, keys: Sequence[str] = ("scene_id", "t", "band"), value: str = "value", fill: str = "null"
) -> DataFrame:
    """One row per block; a group holds one block. Pixels are placed by position, absent ones are `fill`."""
    place = f"int(pmod(row, {block_h}) * {block_w} + pmod(col, {block_w}))"
    placed = pixels.selectExpr(
        *keys, f"int(floor(row / {block_h})) as block_row", f"int(floor(col / {block_w})) as block_col", "row", "col", f"struct({place} as i, {value} as v) as _px"
    )
    return (
        placed.groupBy(*keys, "block_row", "block_col")
        .agg(
            expr(f"int(max(pmod(row, {block_h})) + 1) as h"),
            expr(f"int(max(pmod(col, {block_w})) + 1) as w"),
            expr("map_from_entries(collect_list(_px)) as _px"),
        )
        .selectExpr(
            *keys, "block_row", "block_col", "h", "w",
            f"transform(sequence(0, h * w - 1), i -> coalesce(try_element_at(_px, int(i div w * {block_w} + i % w)), {fill})) as data",
        )
    )


def rgb_bands(raster: DataFrame, meta: DataFrame, channels: int = 3) -> DataFrame:
    """First `channels` bands; an image with fewer shows its first band in every channel."""
    j = salted_join(raster.where(f"band < {channels}"), meta.select("scene_id", "band_count"), ["scene_id"], ["row", "col"])
    wanted = f"case when band_count >= {channels} then array(band) when band = 0 then sequence(0, {channels - 1}) end"
    return j.selectExpr("scene_id", "t", f"explode({wanted}) as band", "row", "col", "value")


def rgb_composite(raster: DataFrame, meta: DataFrame, bands: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Bytes of the chosen bands, wanted indexes clamped to the last band.

    Each pixel row knows its own band, so the pick is an array filter and joins no pixels.
    """
    j = salted_join(raster, meta.select("scene_id", "band_count"), ["scene_id"], ["row", "col"])
    slots = ", ".join(f"if(least({b}, band_count - 1) = band, {i}, null)" for i, b in enumerate(bands))
    return j.selectExpr(
        "scene_id", "t", "row", "col", f"{X.to_uint8('value')} as byte",
        f"explode(filter(array({slots}), s -> s is not null)) as channel",
    )


def valid_pixels(raster: DataFrame, meta: DataFrame, compat_nodata: bool = False) -> DataFrame:
    """Drop nodata pixels. `compat_nodata` treats nodata = 0 as "none declared"."""
    unset = "nodata is null or nodata = 0" if compat_nodata else "nodata is null"
    j = salted_join(raster, meta.select("scene_id", "nodata"), ["scene_id"], ["row", "col"])
    return j.where(f"{unset} or value <> nodata").drop("nodata")


def mask_blocks(blocks: DataFrame, meta: DataFrame, compat_nodata: bool = False) -> DataFrame:
    """`valid_pixels` on packed blocks: nodata pixels become null, in place."""
    nodata = "nullif(nodata, 0)" if compat_nodata else "nodata"
    j = salted_join(blocks, meta.selectExpr("scene_id", f"{nodata} as _nodata"), ["scene_id"], ["t", "band", "block_row", "block_col"], "left")
    return j.withColumn("data", expr("if(_nodata is null, data, transform(data, v -> nullif(v, _nodata)))")).drop("_nodata")


def stretch(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    low: float = 0.02,
    high: float = 0.98,
    scale: float = 1.0,
    floor_max: float = 1e-6,
    spread: Sequence[str] = ("row", "col"),
    valid: DataFrame | None = None,
) -> DataFrame:
    """Percentile stretch per group, clipped to [0, scale]; flat groups divide by their max.

    Adds column `stretched`. `valid` may give the rows that count towards the percentiles
    (nodata removed); a group without any keeps its values.
    """
    keys = list(keys)
    q = group_quantiles(df if valid is None else valid, keys, value, [low, high], ["_lo", "_hi"], spread)
    if valid is not None:
        q = q.drop("vmax").join(df.groupBy(*keys).agg(expr(f"max({value}) as vmax")), keys)
    out = f"if(_hi > _lo, ({value} - _lo) / nullif(_hi - _lo, 0D), {value} / greatest(vmax, {X.num(floor_max)}))"
    if scale != 1.0:
        out += f" * {X.num(scale)}"
    return (
        salted_join(df, q, keys, spread, "left")
        .withColumn("stretched", expr(f"if(_lo is null, {value}, {X.clip(out, 0, scale)})"))
        .drop("_lo", "_hi", "vmax")
    )


def stretch_blocks(
    blocks: DataFrame,
    keys: Sequence[str],
    low: float = 0.02,
    high: float = 0.98,
    scale: float = 1.0,
    floor_max: float = 1e-6,
) -> DataFrame:
    """`stretch` on packed blocks: percentiles join once per block, not once per pixel.

    Null pixels (see `mask_blocks`) do not count and stay null.
    """
    keys = list(keys)
    spread = [c for c in ("t", "band", "block_row", "block_col") if c in blocks.columns]
    q = group_quantiles(blocks, keys, "data", [low, high], ["_lo", "_hi"], spread, packed=True)
    wide = X.clip(f"(v - _lo) / nullif(_hi - _lo, 0D) * {X.num(scale)}", 0, scale)
    flat = X.clip(f"v / greatest(vmax, {X.num(floor_max)}) * {X.num(scale)}", 0, scale)
    out = f"case when _lo is null then data when _hi > _lo then transform(data, v -> if(v is null, null, {wide})) else transform(data, v -> if(v is null, null, {flat})) end"
    return salted_join(blocks, q, keys, spread, "left").withColumn("data", expr(out)).drop("_lo", "_hi", "vmax")


def to_gray(raster: DataFrame) -> DataFrame:
    """Weighted sum of the first three bands per pixel."""
    return (
        raster.where("band < 3").groupBy("scene_id", "t", "row", "col").agg(expr(f"sum(value * {X.by_band('band', X.LUMA)}) as gray"))
    )


def with_geo(df: DataFrame, meta: DataFrame, spread: Sequence[str] = ("row", "col")) -> DataFrame:
    """Attach the geotransform of the scene."""
    return salted_join(df, meta.select("scene_id", *"abcdef"), ["scene_id"], spread, "left")


# EPSG codes of common geographic and projected systems; UTM zones by range.
GEOGRAPHIC_CODES = "4326, 4258, 4269, 4979"
PROJECTED_CODES = "3857, 3395, 2154, 27700"
UTM_RANGES = ((32601, 32660), (32701, 32760), (25828, 25838))


def classify_crs(df: DataFrame, epsg: str = "epsg", systems: DataFrame | None = None) -> DataFrame:
    """Known / geographic / projected flags; a missing or unknown code is neither.

    `systems` (epsg, kind), one row per code, kind 'geographic' or 'projected', says what further
    codes are, and goes before the common ones.
    """
    if systems is not None:
        kinds = systems.selectExpr("epsg as _code", "kind as _kind")
        known = classify_crs(df, epsg).join(kinds, expr(f"{epsg} = _code"), "left")
        for flag in ("geographic", "projected"):
            known = known.withColumn(f"is_{flag}", expr(f"if(_kind is null, is_{flag}, _kind = '{flag}')"))
        return known.withColumn("crs_valid", expr("is_geographic or is_projected")).drop("_code", "_kind")
    utm = " or ".join(f"{epsg} between {lo} and {hi}" for lo, hi in UTM_RANGES)
    return df.selectExpr(
        "*",
        f"coalesce({epsg} in ({GEOGRAPHIC_CODES}), false) as is_geographic",
        f"coalesce({epsg} in ({PROJECTED_CODES}) or {utm}, false) as is_projected",
    ).selectExpr("*", "is_geographic or is_projected as crs_valid")
