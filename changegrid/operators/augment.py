"""Paired augmentation on long-layout patches.

A draw is a hash of (patch, epoch, operation), so images A, B and the mask of a patch share
every geometric draw on any partition and any retry, with no random state to carry around.
Photometric draws also hash the date, because A and B change colour independently.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql.functions import expr

from changegrid.functions import expr as X


def _draw(op: str, epoch: int, *extra: str) -> str:
    return X.unit_draw("patch_id", f"'{epoch}'", f"'{op}'", *extra)


def flip(px: DataFrame, height: int, width: int, epoch: int = 0, p: float = 0.5) -> DataFrame:
    """Horizontal and vertical flips, each with probability p."""
    h, v = f"{_draw('hflip', epoch)} < {p}D", f"{_draw('vflip', epoch)} < {p}D"
    return px.withColumns({"row": expr(f"if({v}, {height - 1} - row, row)"), "col": expr(f"if({h}, {width - 1} - col, col)")})


def rotate90(px: DataFrame, side: int, epoch: int = 0, p: float = 0.5) -> DataFrame:
    """Quarter turns counter-clockwise of a square patch; the number of turns is drawn too."""
    last = side - 1
    turns = f"if({_draw('rot90', epoch)} < {p}D, int(floor({_draw('rot90_k', epoch)} * 4)), 0)"
    k = px.withColumn("_k", expr(turns))
    row = f"case _k when 1 then {last} - col when 2 then {last} - row when 3 then col else row end"
    col = f"case _k when 1 then row when 2 then {last} - col when 3 then {last} - row else col end"
    return k.withColumns({"row": expr(row), "col": expr(col)}).drop("_k")


def center_crop(px: DataFrame, height: int, width: int, crop: int) -> DataFrame:
    return _crop(px, str((height - crop) // 2), str((width - crop) // 2), crop)


def random_crop(px: DataFrame, height: int, width: int, crop: int, epoch: int = 0) -> DataFrame:
    top = f"int(floor({_draw('crop_r', epoch)} * {height - crop + 1}))"
    left = f"int(floor({_draw('crop_c', epoch)} * {width - crop + 1}))"
    return _crop(px, top, left, crop)


def _crop(px: DataFrame, top: str, left: str, crop: int) -> DataFrame:
    moved = px.withColumns({"row": expr(f"row - {top}"), "col": expr(f"col - {left}")})
    return moved.where(f"row >= 0 and row < {crop} and col >= 0 and col < {crop}")


def shift_scale_rotate(
    px: DataFrame, height: int, width: int, keys=("patch_id",), epoch: int = 0, p: float = 0.3, shift: float = 0.0625, scale: float = 0.1, angle: float = 15.0
) -> DataFrame:
    """Random similarity about the centre, bilinear, zeros outside.

    A patch keeps its pixel grid, so the output grid is the patch itself; each output pixel
    reads up to four source pixels by equi join.
    """
    between = lambda op, r: f"(({_draw(op, epoch)} * 2D - 1D) * {r}D)"
    cy, cx = (height - 1) / 2, (width - 1) / 2
    g = px.selectExpr(
        *keys, "row", "col",
        f"{_draw('ssr', epoch)} < {p}D as _on",
        f"radians({between('ssr_a', angle)}) as _t", f"1D + {between('ssr_s', scale)} as _s",
        f"{between('ssr_x', shift)} * {width} as _dx", f"{between('ssr_y', shift)} * {height} as _dy",
    ).selectExpr(
        *keys, "row", "col",
        f"if(_on, (cos(_t) * (col - {cx}D - _dx) - sin(_t) * (row - {cy}D - _dy)) / _s + {cx}D, double(col)) as _x",
        f"if(_on, (sin(_t) * (col - {cx}D - _dx) + cos(_t) * (row - {cy}D - _dy)) / _s + {cy}D, double(row)) as _y",
    )
    taps = ", ".join(
        f"struct(int(floor(_y)) + {dr} as r, int(floor(_x)) + {dc} as c, abs({1 - dr} - (_y - floor(_y))) * abs({1 - dc} - (_x - floor(_x))) as w)"
        for dr in (0, 1) for dc in (0, 1)
    )
    probe = g.selectExpr(*keys, "row", "col", f"explode(array({taps})) as k").selectExpr(
        *keys, "row", "col", "k.r as _sr", "k.c as _sc", "k.w as _w"
    )
    src = px.selectExpr(*keys, "row as _sr", "col as _sc", "value as _v")
    return probe.join(src, [*keys, "_sr", "_sc"], "left").groupBy(*keys, "row", "col").agg(
        expr("sum(_w * coalesce(_v, 0D)) as value")
    )


def color_jitter(
    rgb: DataFrame, epoch: int = 0, p: float = 0.5, brightness: float = 0.2, contrast: float = 0.2, saturation: float = 0.2, hue: float = 0.1
) -> DataFrame:
    """Brightness, contrast, saturation and hue on (patch_id, t, row, col, r, g, b) in [0,1].

    Contrast mixes with the mean grey of the image, an aggregate joined back per image.
    """
    factor = lambda op, r: f"(1D + ({_draw(op, epoch, 't')} * 2D - 1D) * {r}D)"
    luma = "({0} * 0.299D + {1} * 0.587D + {2} * 0.114D)".format
    on = rgb.selectExpr("*", f"{_draw('jitter', epoch, 't')} < {p}D as _on")
    lit = on.selectExpr(
        "patch_id", "t", "row", "col", "_on", *[f"if(_on, {X.clip(f'{c} * ' + factor('jit_b', brightness), 0, 1)}, {c}) as {c}" for c in "rgb"]
    )
    mean = lit.groupBy("patch_id", "t").agg(expr(f"avg({luma('r', 'g', 'b')}) as _m"))
    mixed = lit.join(mean, ["patch_id", "t"]).selectExpr("*", f"{factor('jit_c', contrast)} as _k").selectExpr(
        "patch_id", "t", "row", "col", "_on", *[f"if(_on, {X.clip(f'_m + ({c} - _m) * _k', 0, 1)}, {c}) as {c}" for c in "rgb"]
    )
    sat = mixed.selectExpr("*", f"{luma('r', 'g', 'b')} as _l", f"{factor('jit_s', saturation)} as _k").selectExpr(
        "patch_id", "t", "row", "col", "_on", *[f"if(_on, {X.clip(f'_l + ({c} - _l) * _k', 0, 1)}, {c}) as {c}" for c in "rgb"]
    )
    # Hue turns in HSV: value and chroma stay, the sector moves.
    hsv = sat.selectExpr("*", "greatest(r, g, b) as _v", "greatest(r, g, b) - least(r, g, b) as _c").selectExpr(
        "*",
        "case when _c = 0 then 0D when _v = r then pmod((g - b) / nullif(_c, 0D), 6D)"
        " when _v = g then (b - r) / nullif(_c, 0D) + 2D else (r - g) / nullif(_c, 0D) + 4D end as _h",
    ).selectExpr("*", f"pmod(_h / 6D + ({_draw('jit_h', epoch, 't')} * 2D - 1D) * {hue}D, 1D) * 6D as _h2")
    channel = lambda n: f"_v - _c * greatest(0D, least(pmod({n}D + _h2, 6D), 4D - pmod({n}D + _h2, 6D), 1D))"
    return hsv.selectExpr(
        "patch_id", "t", "row", "col", *[f"if(_on, {channel(n)}, {c}) as {c}" for c, n in zip("rgb", (5, 3, 1))]
    )


def gauss_noise(px: DataFrame, epoch: int = 0, p: float = 0.3, var: tuple[float, float] = (10.0, 50.0)) -> DataFrame:
    """Additive normal noise on byte-scale values, from two hashed uniforms per pixel."""
    u1, u2 = _draw("noise_u", epoch, "t", "band", "row", "col"), _draw("noise_v", epoch, "t", "band", "row", "col")
    sigma = f"sqrt({var[0]}D + {_draw('noise_s', epoch, 't')} * {var[1] - var[0]}D)"
    z = f"sqrt(-2D * ln(1D - {u1})) * cos({2 * math.pi}D * {u2})"
    return px.withColumn("value", expr(f"if({_draw('noise', epoch, 't')} < {p}D, {X.clip(f'value + {sigma} * {z}', 0, 255)}, value)"))


# Binomial blur weights by kernel size.
BLUR = {3: (1, 2, 1), 5: (1, 4, 6, 4, 1)}


def random_blur(
    px: DataFrame, height: int, width: int, keys=("patch_id",), epoch: int = 0, p: float = 0.2, sizes: tuple[int, ...] = (3, 5)
) -> DataFrame:
    """`blur` with probability p, its size drawn too, once per patch: both dates share the draw.

    Patches that stay as they are need no shuffle.
    """
    pick = f"element_at(array({', '.join(map(str, sizes))}), int(floor({_draw('blur_k', epoch)} * {len(sizes)})) + 1)"
    drawn = px.select(*keys, "row", "col", "value").withColumn("_size", expr(f"if({_draw('blur', epoch)} < {p}D, {pick}, 0)"))
    out = drawn.where("_size = 0").drop("_size")
    for size in sizes:
        out = out.unionByName(blur(drawn.where(f"_size = {size}"), height, width, keys, size))
    return out


def blur(px: DataFrame, height: int, width: int, keys=("patch_id",), size: int = 3) -> DataFrame:
    """Binomial blur with mirrored border; every pixel pushes its weighted shares.

    Shares combine map-side, so the shuffle carries about one row per pixel.
    """
    taps, half, total = BLUR[size], size // 2, sum(BLUR[size])

    def shares(i: str, n: int) -> str:
        spots = ", ".join(f"struct(s - ({k - half}) as o, {w / total}D as w)" for k, w in enumerate(taps))
        near = f"array_union(sequence({i}, {i}), filter(concat(sequence(-{half}, -1), sequence({n}, {n - 1 + half})), s -> {X.reflect_index('s', str(n))} = {i}))"
        return f"filter(flatten(transform({near}, s -> array({spots}))), q -> q.o >= 0 and q.o < {n})"

    return (
        px.selectExpr(*keys, "row", "col", "value", f"explode({shares('row', height)}) as _r")
        .selectExpr(*keys, "col", "value", "_r", f"explode({shares('col', width)}) as _c")
        .selectExpr(*keys, "_r.o as row", "_c.o as col", "_r.w * _c.w * value as _v")
        .groupBy(*keys, "row", "col")
        .agg(expr("sum(_v) as value"))
    )
