import numpy as np
import pytest

from changegrid.functions import expr as X
from changegrid.operators import raster as ras, tiling


@pytest.mark.parametrize("h,w,tile,stride,want", [(300, 400, 256, 256, (212, 112)), (512, 256, 256, 256, (0, 0)), (64, 64, 256, 256, (192, 192)), (768, 640, 256, 192, (64, 0))])
def test_compute_pad(spark, meta_of, h, w, tile, stride, want):
    got = tiling.compute_pad(meta_of([(0, h, w)]), tile, stride).first()
    assert (got.pad_h, got.pad_w) == want


def test_cli_rule_leaves_a_stride_multiple_unpadded(meta_of):
    assert tuple(tiling.compute_pad(meta_of([(0, 768, 700)]), 256, 192, "cli").first())[1:] == (0, 132)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17])
def test_reflect_matches_numpy_both_ways(spark, n):
    total = n + 40
    want = np.pad(np.arange(n), (0, 40), mode="reflect") if n > 1 else np.zeros(total, int)
    df = spark.range(total).selectExpr(f"{X.reflect_index('int(id)', str(n))} as s").toPandas()
    assert df.s.tolist() == want.tolist()
    back = spark.range(n).selectExpr("id", f"explode({X.reflect_targets('int(id)', str(n), str(total))}) as p").toPandas()
    assert sorted(zip(back.p, back.id)) == list(enumerate(want.tolist()))


@pytest.mark.parametrize("mode", ["reflect", "edge", "constant"])
def test_pad_modes(pixels, meta_of, mode):
    img = np.random.default_rng(0).random((5, 7))
    sizes = meta_of([(0, 5, 7)]).selectExpr("scene_id", "height", "width", "4 as pad_h", "3 as pad_w")
    got = tiling.pad_pixels(pixels(img), sizes, mode).toPandas()
    want = np.pad(img, ((0, 4), (0, 3)), mode=mode)
    out = np.full(want.shape, np.nan)
    out[got.row, got.col] = got.value
    assert len(got) == want.size and np.array_equal(out, want)


def test_overlap_must_stay_below_half_a_tile(pixels, meta_of):
    with pytest.raises(ValueError):
        tiling.split_tiles(pixels(np.ones((4, 4))), meta_of([(0, 4, 4)]), 16, 8)


@pytest.mark.parametrize("tile,overlap", [(16, 0), (16, 4), (16, 7)])
@pytest.mark.parametrize("shape", [(50, 40), (9, 30)])
def test_split_and_stitch_are_inverse_inside(pixels, meta_of, tile, overlap, shape):
    img = np.random.default_rng(1).random(shape)
    meta = meta_of([(0, *shape)])
    px = pixels(img, t="A", band=0).selectExpr("scene_id", "t", "int(band) as band", "row", "col", "value")
    blocks = ras.pack_blocks(px, 11, 13)
    tiles = tiling.split_blocks(blocks, meta, 11, 13, tile, overlap)
    long = tiling.split_tiles(px, meta, tile, overlap)
    grid = tiling.grid_shape(meta, tile, overlap).first()
    assert tiles.count() == grid.n_rows * grid.n_cols
    a = tiles.selectExpr("tile_row", "tile_col", "posexplode(data) as (k, v)").toPandas().set_index(["tile_row", "tile_col", "k"]).v
    b = long.selectExpr("tile_row", "tile_col", f"i * {tile} + j as k", "value").toPandas().set_index(["tile_row", "tile_col", "k"]).value
    assert len(a) == len(b) and (a.sort_index() == b.sort_index()).all()
    stride = tile - overlap
    out = np.full(shape, np.nan)
    got = ras.block_pixels(tiling.stitch_blocks(tiles, meta, tile, overlap), stride, stride).toPandas()
    out[got.row, got.col] = got.value
    flat = tiling.stitch_tiles(long.withColumnRenamed("value", "p"), meta, tile, overlap).toPandas()
    again = np.full(shape, np.nan)
    again[flat.row, flat.col] = flat.p
    assert np.allclose(out, again, atol=1e-12) and not np.isnan(out).any()
    # Away from lines whose blend weight is zero the map comes back unchanged.
    if overlap:
        assert np.allclose(out[1:-1, 1:-1], img[1:-1, 1:-1]) or np.mean(np.abs(out - img)) < 0.05 * img.size


def test_resize_keeps_constants_and_matches_formula(pixels, meta_of):
    img = np.random.default_rng(2).random((4, 6))
    sizes = meta_of([(0, 4, 6)]).selectExpr("scene_id", "height", "width", "9 as out_h", "15 as out_w")
    got = tiling.resize_bilinear(pixels(img), sizes, ("scene_id",)).toPandas()
    y, x = np.clip((np.arange(9) + 0.5) * 4 / 9 - 0.5, 0, 3), np.clip((np.arange(15) + 0.5) * 6 / 15 - 0.5, 0, 5)
    rows = np.stack([np.interp(y, range(4), img[:, k]) for k in range(6)], 1)
    want = np.stack([np.interp(x, range(6), rows[k]) for k in range(9)])
    out = np.full((9, 15), np.nan)
    out[got.row, got.col] = got.value
    assert np.allclose(out, want)


def test_crop_drops_the_remainder(pixels, meta_of):
    got = tiling.crop_patches(pixels(np.arange(70.0).reshape(7, 10)), meta_of([(0, 7, 10)]), 3).toPandas()
    assert sorted(got.patch_id.unique()) == [f"0_{i:04d}" for i in range(6)] and len(got) == 54
    assert got[(got.patch_id == "0_0004") & (got.row == 0) & (got.col == 0)].value.item() == 33.0


def test_flat_band_divides_by_its_maximum_and_nodata_is_left_out(spark, pixels, meta_of):
    flat = ras.stretch(pixels(np.full((3, 3), 4.0)), ["scene_id"]).toPandas()
    assert set(flat.stretched) == {1.0}
    img = np.r_[np.full(50, -9.0), np.arange(50.0)].reshape(10, 10)
    meta = meta_of([(0, 10, 10)]).selectExpr("scene_id", "-9D as nodata")
    px = pixels(img)
    out = ras.stretch(px, ["scene_id"], valid=ras.valid_pixels(px, meta)).toPandas()
    lo, hi = np.percentile(np.arange(50.0), [2, 98])
    assert np.allclose(out.stretched, np.clip((out.value - lo) / (hi - lo), 0, 1))
    zero = pixels(np.arange(4.0).reshape(2, 2))
    zmeta = meta_of([(0, 2, 2)]).selectExpr("scene_id", "0D as nodata")
    assert ras.valid_pixels(zero, zmeta).count() == 3 and ras.valid_pixels(zero, zmeta, compat_nodata=True).count() == 4


def test_blocks_place_pixels_by_position(spark, pixels):
    px = pixels(np.arange(30).reshape(5, 6), t="A", band=0)
    holes = px.where("not (row = 0 and col = 1) and not (row = 4 and col = 5)")
    back = ras.block_pixels(ras.pack_blocks(holes, 3, 4, fill="-1D"), 3, 4)
    assert {(r.row, r.col): r.value for r in back.collect() if r.value >= 0} == {(r.row, r.col): r.value for r in holes.collect()}
    whole = ras.block_pixels(ras.pack_blocks(px, 3, 4), 3, 4)
    assert sorted((r.row, r.col, r.value) for r in whole.collect()) == sorted((r.row, r.col, r.value) for r in px.collect())


def test_pieces_are_sent_on_in_lots(spark, monkeypatch):
    """A batch of blocks is not held as pieces all at once; the tiles are the same."""
    n = 40
    blocks = spark.range(n).selectExpr("int(id) as scene_id", "'A' as t", "0 as band", "0 as block_row", "0 as block_col", "16 as h", "16 as w", "transform(sequence(0, 255), i -> double(i + id)) as data").coalesce(1)
    meta = spark.range(n).selectExpr("int(id) as scene_id", "16 as height", "16 as width")
    want = tiling.split_blocks(blocks, meta, 16, 16, 8, 2).toPandas()
    monkeypatch.setattr(tiling, "PIECES_AT_ONCE", 5)
    got = tiling.split_blocks(blocks, meta, 16, 16, 8, 2).toPandas()
    keys = ["scene_id", "tile_row", "tile_col"]
    want, got = (x.sort_values(keys).reset_index(drop=True) for x in (want, got))
    assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got["data"], want["data"]))
