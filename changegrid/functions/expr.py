"""Value scaling, affine maps, padding, blend weights, names. Arguments and results are SQL.

Everything here compiles into whole-stage code or plain array functions; there are no UDFs.
"""

from __future__ import annotations

import math

# Per-channel statistics of the ImageNet training set.
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)

# Luma weights of the RGB -> grey conversion.
LUMA = (0.299, 0.587, 0.114)

# Colour ramp of the viewer, by lower confidence bound.
CONFIDENCE_COLOURS = ((0.85, "#ef4444"), (0.70, "#f97316"), (0.55, "#eab308"))
CONFIDENCE_LOW = "#84cc16"
CONFIDENCE_MISSING = "#94a3b8"

# Identity geotransform: pixel units.
PIXEL_UNITS = dict(a="1D", b="0D", c="0D", d="0D", e="1D", f="0D")


def num(x: float) -> str:
    return f"{float(x)!r}D"


def r6(x: str) -> str:
    """Round to 6 decimals and drop negative zero."""
    return f"(round({x}, 6) + 0D)"


def clip(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {num(lo)}), {num(hi)})"


def nan_to_null(data: str) -> str:
    """An array whose NaN, as numpy marks gaps, are null."""
    return f"transform({data}, v -> if(isnan(v), null, v))"


def to_uint8(x: str) -> str:
    """[0,1] float to byte, truncating."""
    return f"int(floor({clip(x, 0, 1)} * 255))"


def prob_to_uint8(p: str) -> str:
    """Probability to byte: scale first, clip after."""
    return f"int(least(greatest(floor({p} * 255), 0), 255))"


def threshold(p: str, thr: float = 0.5, inclusive: bool = False) -> str:
    return f"({p} {'>=' if inclusive else '>'} {num(thr)})"


def binarize_label(value: str, cut: float = 128, on: int = 1) -> str:
    return f"if({value} > {num(cut)}, {on}, 0)"


def by_band(band: str, values: tuple[float, ...]) -> str:
    cases = " ".join(f"when {i} then {num(v)}" for i, v in enumerate(values))
    return f"(case {band} {cases} end)"


def normalize(value: str, band: str, mean=IMAGENET_MEAN, std=IMAGENET_STD) -> str:
    return f"(({value} - {by_band(band, mean)}) / {by_band(band, std)})"


def denormalize(value: str, band: str, mean=IMAGENET_MEAN, std=IMAGENET_STD) -> str:
    x = f"({value} * {by_band(band, std)} + {by_band(band, mean)})"
    return f"int(floor({clip(x + ' * 255', 0, 255)}))"


# --- geotransform: x = a*col + b*row + c, y = d*col + e*row + f ----------------------------

def corner_to_world(row: str, col: str) -> tuple[str, str]:
    return f"(a * {col} + b * {row} + c)", f"(d * {col} + e * {row} + f)"


def pixel_to_world(row: str, col: str) -> tuple[str, str]:
    """Centre of the pixel."""
    return corner_to_world(f"({row} + 0.5D)", f"({col} + 0.5D)")


def world_to_pixel(x: str, y: str) -> tuple[str, str]:
    """Inverse affine, floored -> (row, col); the answer may lie outside the image."""
    det = "(a * e - b * d)"
    col = f"((e * ({x} - c) - b * ({y} - f)) / {det})"
    row = f"((a * ({y} - f) - d * ({x} - c)) / {det})"
    return f"int(floor({row}))", f"int(floor({col}))"


def cell_area() -> str:
    """Area of one pixel in squared CRS units, also for sheared grids."""
    return "abs(a * e - b * d)"


def pixel_area_m2() -> str:
    """A known resolution wins, else the squared pixel width, else NULL."""
    return "coalesce(resolution_m * resolution_m, if(abs(a) > 0, a * a, null))"


def pixel_size_m(geographic: str) -> str:
    """Ground sampling distance; NULL for geographic systems, whose unit is the degree."""
    return f"if({geographic}, null, abs(a))"


def outline_bounds() -> tuple[str, str, str, str]:
    """World (minx, miny, maxx, maxy) of an inclusive row/col box."""
    corners = [corner_to_world(r, c) for r in ("row_min", "(row_max + 1)") for c in ("col_min", "(col_max + 1)")]
    xs, ys = ", ".join(k[0] for k in corners), ", ".join(k[1] for k in corners)
    return f"least({xs})", f"least({ys})", f"greatest({xs})", f"greatest({ys})"


# --- padding --------------------------------------------------------------------------------

def pad_amount(side: str, tile: int, stride: int) -> str:
    """Bottom/right padding so that tiles at `stride` cover the side completely."""
    return f"int(if({side} < {tile}, {tile} - {side}, pmod({stride} - pmod({side} - {tile}, {stride}), {stride})))"


def pad_amount_cli(side: str, tile: int, stride: int) -> str:
    """Rule of the command-line tiler: nothing to add when the side is a stride multiple."""
    rest = f"pmod({side}, {stride})"
    return f"int(if({rest} = 0, 0, greatest(0, {tile} - {rest})))"


def pad_to_multiple(side: str, multiple: int = 32) -> str:
    return f"int(pmod({multiple} - pmod({side}, {multiple}), {multiple}))"


def tile_count(side: str, pad: str, tile: int, stride: int) -> str:
    """Whole tiles that fit; none when the padded side is shorter than a tile."""
    return f"int(greatest(0, floor(({side} + {pad} - {tile}) / {stride}) + 1))"


def reflect_index(i: str, n: str) -> str:
    """Source index of padded index `i` under mirror padding that does not repeat the edge."""
    period = f"greatest(2 * ({n} - 1), 1)"
    m = f"pmod({i}, {period})"
    return f"int(case when {n} = 1 then 0 when {m} < {n} then {m} else {period} - {m} end)"


def reflect_targets(i: str, n: str, total: str) -> str:
    """All padded positions in [0, total) that read source index `i`.

    The inverse of `reflect_index`: it turns mirror padding into an explode, so no padded
    grid is generated and nothing is joined.
    """
    period = f"greatest(2 * ({n} - 1), 1)"
    spots = f"flatten(transform(sequence(0, int(({total} - 1) / {period}) + 1), k -> array(int(k * {period} - {i}), int(k * {period} + {i}))))"
    return f"if({n} = 1, sequence(0, {total} - 1), array_distinct(filter({spots}, p -> p >= 0 and p < {total})))"


def edge_targets(i: str, n: str, total: str) -> str:
    """Padded positions reading source index `i` when the last line is repeated."""
    return f"if({i} = {n} - 1, sequence({i}, {total} - 1), array({i}))"


def covering_tiles(at: str, count: str, tile: int, stride: int) -> str:
    """Indexes of the tiles that contain padded position `at`."""
    first = f"greatest(0, int(floor(({at} - {tile}) / {stride})) + 1)"
    last = f"least({count} - 1, int(floor({at} / {stride})))"
    return f"if({last} >= {first}, sequence({first}, {last}), cast(array() as array<int>))"


def hann(k: str, n: int) -> str:
    """Symmetric Hann weight of sample k in a window of n."""
    if n == 1:
        return "1D"
    return f"(0.5D - 0.5D * cos({k} * {num(2.0 * math.pi / (n - 1))}))"


# --- names, labels, draws -------------------------------------------------------------------

def patch_id(image_id: str, index: str) -> str:
    """`<image>_<NNNN>`; indexes beyond four digits keep all their digits."""
    text = f"string({index})"
    return f"concat_ws('_', string({image_id}), lpad({text}, greatest(4, length({text})), '0'))"


def image_of_patch(pid: str) -> str:
    return f"regexp_replace({pid}, '_[^_]*$', '')"


def first_confidence(conf: str, mean_conf: str) -> str:
    """First truthy of the two confidence columns."""
    return f"coalesce(nullif({conf}, 0D), {mean_conf})"


def confidence_colour(conf: str) -> str:
    steps = " ".join(f"when {conf} >= {num(low)} then '{colour}'" for low, colour in CONFIDENCE_COLOURS)
    return f"(case when {conf} is null then '{CONFIDENCE_MISSING}' {steps} else '{CONFIDENCE_LOW}' end)"


def unit_draw(*parts: str) -> str:
    """Repeatable draw in [0,1) from the joined parts; equal parts give equal draws."""
    joined = ", ".join(f"string({p})" for p in parts)
    return f"(double(conv(substring(sha2(concat_ws(':', {joined}), 256), 1, 8), 16, 10)) / {num(2**32)})"
