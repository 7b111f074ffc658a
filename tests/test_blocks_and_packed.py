"""Block and packed forms against the pixel forms and plain numpy."""

import re

import numpy as np
import pandas as pd
import pytest

from changegrid.catalog import QUERIES
from changegrid.operators import augment, packed, raster, stencil, tiling

BLOCK_H, BLOCK_W = 7, 5
FORMS = ["augment_flip_packed", "augment_rot90_packed", "center_crop_packed", "random_crop_packed", "shift_scale_rotate_packed", "random_blur_packed", "color_jitter_packed", "gauss_noise_packed"]


@pytest.fixture()
def blocks_of(spark):
    def make(img, drop=()):
        img, rows = np.asarray(img, float), []
        for r in range(0, img.shape[0], BLOCK_H):
            for c in range(0, img.shape[1], BLOCK_W):
                part = img[r : r + BLOCK_H, c : c + BLOCK_W]
                if (r // BLOCK_H, c // BLOCK_W) not in drop:
                    data = [None if np.isnan(v) else float(v) for v in part.ravel()]
                    rows.append((0, "A", 0, r // BLOCK_H, c // BLOCK_W, *part.shape, data))
        return spark.createDataFrame(rows, "scene_id int, t string, band int, block_row int, block_col int, h int, w int, data array<double>")

    return make


def image(blocks, shape):
    out = np.full(shape, np.nan)
    for b in blocks.collect():
        part = np.array([np.nan if v is None else v for v in b.data]).reshape(b.h, b.w)
        out[b.block_row * BLOCK_H : b.block_row * BLOCK_H + b.h, b.block_col * BLOCK_W : b.block_col * BLOCK_W + b.w] = part
    return out


def random_image(shape, seed=5):
    return np.random.default_rng(seed).random(shape)


def binomial(img, size):
    k = np.array({3: [1, 2, 1], 5: [1, 4, 6, 4, 1]}[size]) / {3: 4, 5: 16}[size]
    pad = np.pad(img, size // 2, mode="reflect")
    rows = sum(w * pad[i : i + img.shape[0]] for i, w in enumerate(k))
    return sum(w * rows[:, i : i + img.shape[1]] for i, w in enumerate(k))


# 15 leaves a last block of one line, whose mirror lies in the block before; 3 is smaller than a block.
@pytest.mark.parametrize("shape", [(15, 11), (21, 10), (3, 4)])
@pytest.mark.parametrize("size", [3, 5])
def test_blur_exchanges_rims(blocks_of, meta_of, shape, size):
    img = random_image(shape)
    got = image(stencil.blur_blocks(blocks_of(img), meta_of([(0, *shape)]), BLOCK_H, BLOCK_W, size), shape)
    assert np.allclose(got, binomial(img, size))


def test_blur_of_null_and_missing_pixels(blocks_of, meta_of):
    img = random_image((15, 11))
    img[0, 0], img[7:14, 5:10] = np.nan, np.nan
    want = binomial(np.nan_to_num(img), 3)
    want[binomial((~np.isnan(img)).astype(float), 3) == 0] = np.nan
    meta = meta_of([(0, 15, 11)])
    got = image(stencil.blur_blocks(blocks_of(img), meta, BLOCK_H, BLOCK_W), img.shape)
    assert np.allclose(got, want, equal_nan=True) and np.isnan(got[8:13, 6:9]).all()
    assert np.allclose(image(stencil.blur_blocks(blocks_of(img, {(1, 1)}), meta, BLOCK_H, BLOCK_W), img.shape), want, equal_nan=True)
    assert stencil.blur_blocks(blocks_of(img).where("false"), meta, BLOCK_H, BLOCK_W).count() == 0


@pytest.mark.parametrize("shape,out", [((15, 11), (33, 29)), ((15, 11), (15, 11)), ((1, 3), (9, 8)), ((20, 20), (9, 13))])
def test_resize_reads_the_blocks_it_needs(spark, blocks_of, shape, out):
    img = random_image(shape)

    def lines(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        return np.maximum(0, 1 - abs(at[:, None] - np.arange(n)))

    sizes = spark.createDataFrame([(0, *shape, *out)], "scene_id int, height int, width int, out_h int, out_w int")
    got = image(stencil.resize_blocks(blocks_of(img), sizes, BLOCK_H, BLOCK_W), out)
    assert np.allclose(got, lines(shape[0], out[0]) @ img @ lines(shape[1], out[1]).T)


@pytest.mark.parametrize("mode", ["reflect", "edge", "constant"])
@pytest.mark.parametrize("shape,pad", [((15, 11), (6, 9)), ((3, 4), (20, 11)), ((1, 6), (8, 0)), ((21, 10), (0, 0)), ((15, 11), (50, 40))])
def test_padding_modes_on_blocks(spark, blocks_of, mode, shape, pad):
    img = random_image(shape)
    sizes = spark.createDataFrame([(0, *shape, *pad)], "scene_id int, height int, width int, pad_h int, pad_w int")
    want = np.pad(img, ((0, pad[0]), (0, pad[1])), mode=mode) if mode != "reflect" or min(shape) > 1 else np.pad(np.pad(img, ((0, pad[0]), (0, 0)), mode="edge"), ((0, 0), (0, pad[1])), mode="reflect")
    got = image(stencil.pad_blocks(blocks_of(img), sizes, BLOCK_H, BLOCK_W, mode), want.shape)
    assert np.allclose(got, want)


@pytest.mark.parametrize("mode", ["reflect", "edge", "constant"])
@pytest.mark.parametrize("rule", ["cover", "cli"])
def test_tiles_of_blocks_are_those_of_pixels(blocks_of, meta_of, mode, rule):
    meta, blocks = meta_of([(0, 15, 11)]), blocks_of(random_image((15, 11)))
    px = raster.block_pixels(blocks, BLOCK_H, BLOCK_W)
    want = tiling.split_tiles(px, meta, 8, 2, mode, rule).toPandas()
    got = tiling.split_blocks(blocks, meta, BLOCK_H, BLOCK_W, 8, 2, mode, rule)
    got = got.selectExpr("tile_row", "tile_col", "posexplode(data) as (k, value)").selectExpr("tile_row", "tile_col", "int(k div 8) as i", "int(k % 8) as j", "value").toPandas()
    both = pd.merge(want, got, on=["tile_row", "tile_col", "i", "j"], how="outer")
    assert len(both) == len(want) == len(got) and np.allclose(both.value_x, both.value_y)


def test_cli_blend_on_blocks_covers_the_canvas(blocks_of, meta_of):
    meta, blocks = meta_of([(0, 15, 11)]), blocks_of(random_image((15, 11)) * 3)
    px = raster.block_pixels(blocks, BLOCK_H, BLOCK_W)
    want = tiling.stitch_tiles(tiling.split_tiles(px, meta, 8, 2, rule="cli"), meta, 8, 2, "value", "cli", canvas=px).toPandas()
    out = tiling.stitch_blocks(tiling.split_blocks(blocks, meta, BLOCK_H, BLOCK_W, 8, 2, rule="cli"), meta, 8, 2, rule="cli")
    both = pd.merge(want, raster.block_pixels(out, 6, 6).toPandas(), on=["row", "col"], how="outer")
    assert len(both) == 15 * 11 and np.allclose(both.p, both.value) and both.p.max() > 1


@pytest.fixture()
def rows_of(spark):
    return lambda rows: spark.createDataFrame(rows, "patch_id int, t string, band int, data array<double>, _k string")


def test_null_rows_and_pixels_stay_and_other_columns_are_kept(rows_of):
    rows = [(p, "A", 0, None if p % 5 == 0 else [None if p == 7 and k == 3 else float(k + p) for k in range(12)], str(p)) for p in range(40)]
    for op in (packed.flip, packed.random_blur, packed.gauss_noise):
        got = {r.patch_id: r for r in op(rows_of(rows), 3, 4).collect()}
        assert len(got) == 40 and all((got[p].data is None) == (p % 5 == 0) and got[p]._k == str(p) for p in got)
    assert packed.flip(rows_of(rows), 3, 4).where("patch_id = 7").first().data.count(None) == 1
    assert packed.flip(rows_of([]), 3, 4).count() == 0
    with pytest.raises(Exception, match="has 16 values"):
        packed.flip(rows_of(rows), 4, 4).collect()


def test_packed_noise_is_drawn_per_array(rows_of):
    df = rows_of([(p, t, 0, [100.0] * 64, "") for p in range(200) for t in "AB"])
    got = {(r.patch_id, r.t): np.array(r.data) for r in packed.gauss_noise(df, 8, 8, epoch=2).collect()}
    again = {(r.patch_id, r.t): np.array(r.data) for r in packed.gauss_noise(df.repartition(7), 8, 8, epoch=2).collect()}
    assert all(np.array_equal(got[k], again[k]) for k in got)
    # The pixel form draws the same arrays.
    noisy = {k for k, v in got.items() if (v != 100).any()}
    px = augment.gauss_noise(packed.unpack(df, 8), epoch=2).where("value <> 100").select("patch_id", "t").distinct()
    assert noisy == {(r.patch_id, r.t) for r in px.collect()} and 0.2 < len(noisy) / 400 < 0.4
    z = np.concatenate([got[k] - 100 for k in noisy])
    assert abs(z.mean()) < 0.3 and 10 < z.var() < 50 and len(np.unique(z)) == len(z)


@pytest.mark.parametrize("name", FORMS)
def test_packed_forms_move_nothing(spark, sf, name):
    assert "Exchange" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["resize_blocks", "blur_blocks", "pad_blocks", "stitch_tiles_cli_blocks"])
def test_block_forms_exchange_no_pixels(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*\b(row|col)#", plan)
