import numpy as np
import pytest

from changegrid.operators import registration as rgs


@pytest.fixture(scope="module")
def descriptors(spark):
    rng = np.random.default_rng(42)
    a = rng.normal(size=(60, 8))
    b = a[:45] + rng.normal(scale=0.01, size=(45, 8))
    rows = [(1, "A", i, v.tolist()) for i, v in enumerate(a)] + [(1, "B", i, v.tolist()) for i, v in enumerate(b)]
    rows += [(2, "A", i, v.tolist()) for i, v in enumerate(a[:3])] + [(2, "B", 0, b[0].tolist())]
    return spark.createDataFrame(rows, "pair_id int, side string, kp_id bigint, vec array<double>"), a, b


@pytest.mark.parametrize("chunk", [2048, 7])
def test_two_nearest_equal_brute_force_however_the_pair_is_cut(descriptors, chunk):
    df, a, b = descriptors
    got = rgs.knn2(df, chunk=chunk).where("pair_id = 1").toPandas()
    dist = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    want = np.argsort(dist, 1)[:, :2]
    assert len(got) == 120
    for r in got.itertuples():
        assert r.t_id == want[r.kp_id, r.rank - 1] and r.dist == pytest.approx(dist[r.kp_id, r.t_id])


def test_ratio_needs_a_second_neighbour(descriptors):
    df, _, _ = descriptors
    good = rgs.ratio_matches(rgs.knn2(df)).toPandas()
    assert set(good.pair_id) == {1} and (good.kp_id == good.t_id)[good.kp_id < 45].all()


def test_hamming_distance(spark):
    rows = [(1, "A", 0, [0b1010, 0])] + [(1, "B", i, [v, w]) for i, (v, w) in enumerate([(0b1011, 0), (0b0101, 3), (0b1010, 1)])]
    df = spark.createDataFrame(rows, "pair_id int, side string, kp_id bigint, vec array<bigint>")
    got = rgs.knn2(df, "hamming").orderBy("rank").collect()
    assert [(r.t_id, r.dist) for r in got] == [(0, 1.0), (2, 1.0)]


def test_status_falls_back_then_fails(spark, descriptors):
    df, _, _ = descriptors
    none = df.where("side = 'A' or kp_id < 3")
    status = {r.pair_id: r.status for r in rgs.pair_match_status(none, df).collect()}
    assert status == {1: "fallback", 2: "failed"}


def _points(n, h, rng, noise=0.0, outliers=0):
    b = rng.uniform(0, 500, size=(n, 2))
    p = np.c_[b, np.ones(n)] @ np.asarray(h).T
    a = p[:, :2] / p[:, 2:] + rng.normal(scale=noise, size=(n, 2)) if noise else p[:, :2] / p[:, 2:]
    a[:outliers] += [60.0, -45.0]
    return a, b


@pytest.mark.parametrize("chunk", [4096, 50])
def test_homography_is_recovered_despite_outliers_and_chunking(spark, chunk):
    rng = np.random.default_rng(0)
    h = np.array([[1.0, 0.02, 15.0], [-0.01, 1.0, 8.0], [1e-5, -2e-5, 1.0]])
    rows = []
    for pair, n, out in ((1, 400, 80), (2, 3, 0)):
        a, b = _points(n, h, rng, outliers=out)
        rows += [(pair, i, *map(float, (*b[i], *a[i]))) for i in range(n)]
    m = spark.createDataFrame(rows, "pair_id int, match_id bigint, x_b double, y_b double, x_a double, y_a double")
    got = {r.pair_id: r for r in rgs.fit_homography(m, chunk=chunk).collect()}
    assert np.allclose(np.reshape(got[1].h, (3, 3)), h, atol=1e-6) and (got[1].n_inliers, got[1].n_matches) == (320, 400)
    assert got[2].h is None and got[2].n_inliers == 0


def test_quality_gate_reasons(spark):
    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    big = [4.0, 0, 0, 0, 4.0, 0, 0, 0, 1.0]
    rows = [(1, eye, 1.0, 30), (2, None, 1.0, 30), (3, eye, 5.1, 30), (4, eye, 1.0, 9), (5, big, 1.0, 30), (6, eye, 5.0, 10)]
    df = spark.createDataFrame([(p, None if h is None else [float(x) for x in h], e, n) for p, h, e, n in rows], "pair_id int, h array<double>, error_px double, n_inliers bigint")
    got = {r.pair_id: r for r in rgs.registration_qc(df).collect()}
    assert {p: r.reason for p, r in got.items()} == {1: "ok", 2: "no_homography", 3: "error", 4: "inliers", 5: "degenerate", 6: "ok"}
    assert got[6].valid and not got[6].success and got[1].success
    assert got[3].out_error_px == float("inf") and got[3].out_inliers == 0


@pytest.mark.parametrize("shape,block", [((20, 26), 8), ((9, 9), 32)])
def test_warp_forms_agree_with_direct_resampling(spark, pixels, meta_of, shape, block):
    from changegrid.operators.raster import block_pixels, pack_blocks

    img = np.random.default_rng(9).random(shape)
    h = np.array([[1.05, 0.1, 2.5], [-0.08, 0.95, 1.25], [1e-4, 2e-4, 1.0]])
    px = pixels(img).selectExpr("scene_id", "0 as band", "row", "col", "value")
    regs = spark.createDataFrame([(0, h.ravel().tolist())], "scene_id int, h array<double>")
    meta = meta_of([(0, *shape)])
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    g = np.linalg.inv(h)
    w = g[2, 0] * x + g[2, 1] * y + g[2, 2]
    sx = np.clip((g[0, 0] * x + g[0, 1] * y + g[0, 2]) / w, 0, shape[1] - 1)
    sy = np.clip((g[1, 0] * x + g[1, 1] * y + g[1, 2]) / w, 0, shape[0] - 1)
    c, r = np.floor(sx).astype(int), np.floor(sy).astype(int)
    c1, r1 = np.minimum(c + 1, shape[1] - 1), np.minimum(r + 1, shape[0] - 1)
    want = (img[r, c] * (1 - sx + c) + img[r, c1] * (sx - c)) * (1 - sy + r) + (img[r1, c] * (1 - sx + c) + img[r1, c1] * (sx - c)) * (sy - r)
    blocks = pack_blocks(px, block, block, keys=("scene_id", "band"))
    for got in (rgs.warp_bilinear(px, px, regs, meta), block_pixels(rgs.warp_blocks(blocks, blocks, regs, meta, block, block), block, block)):
        got = got.toPandas()
        out = np.full(shape, np.nan)
        out[got.row, got.col] = got.value
        assert np.allclose(out, want)


def _direct(img, h):
    """Weighted taps of each output pixel; NaN taps give their weight to the others."""
    height, width = img.shape
    y, x = np.mgrid[0:height, 0:width]
    g = np.linalg.inv(h)
    w = g[2, 0] * x + g[2, 1] * y + g[2, 2]
    sx = np.clip((g[0, 0] * x + g[0, 1] * y + g[0, 2]) / w, 0, width - 1)
    sy = np.clip((g[1, 0] * x + g[1, 1] * y + g[1, 2]) / w, 0, height - 1)
    c, r = np.floor(sx).astype(int), np.floor(sy).astype(int)
    value, weight = np.zeros(img.shape), np.zeros(img.shape)
    for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)):
        k = np.where(dr, sy - r, 1 - sy + r) * np.where(dc, sx - c, 1 - sx + c)
        tap = img[np.minimum(r + dr, height - 1), np.minimum(c + dc, width - 1)]
        k = np.where(np.isnan(tap), 0, k)
        value, weight = value + np.nan_to_num(tap) * k, weight + k
    return np.where(weight > 0, value / np.where(weight > 0, weight, 1), np.nan)


AFFINE = np.array([[1.05, 0.1, 2.5], [-0.08, 0.95, 1.25], [0, 0, 1.0]])
HORIZON = np.array([[1, 0.02, 1.0003], [-0.01, 1, 2], [0.05, 0.03, 1]])


@pytest.mark.parametrize("h,most", [(AFFINE, 16), (AFFINE, 0), (HORIZON, 16)])
def test_warped_blocks_leave_gaps_out_and_ask_for_bounded_parts(spark, pixels, meta_of, h, most):
    from pyspark.sql.functions import expr

    from changegrid.operators.raster import block_pixels, pack_blocks

    img = np.random.default_rng(4).random((37, 29)) + 1
    img[5:9, 4:20] = img[:, 28] = img[30, ::3] = np.nan
    px = pixels(np.nan_to_num(img, nan=-1)).selectExpr("scene_id", "0 as band", "row", "col", "value")
    blocks = pack_blocks(px, 8, 8, keys=("scene_id", "band")).withColumn("data", expr("transform(data, v -> nullif(v, -1D))"))
    regs = spark.createDataFrame([(0, h.ravel().tolist())], "scene_id int, h array<double>")
    meta, want = meta_of([(0, *img.shape)]), _direct(img, h)
    assert np.isnan(want).any()
    got = block_pixels(rgs.warp_blocks(blocks, blocks, regs, meta, 8, 8, most), 8, 8).toPandas()
    assert len(got) == img.size
    out = np.full(img.shape, np.inf)
    out[got.row, got.col] = got.value.astype(float)
    assert np.allclose(out, want, equal_nan=True)
    rows = rgs.warp_bilinear(px, px.where("value <> -1"), regs, meta).toPandas()
    out = np.full(img.shape, np.nan)
    out[rows.row, rows.col] = rows.value
    assert np.allclose(out, want, equal_nan=True)
    asks = rgs.warp_requests(blocks, regs, meta, 8, 8, most).groupBy("block_row", "block_col", "h", "w").agg(
        expr("count(1) as n"), expr("count_if(_at is null) as whole"), expr("sum(coalesce(size(_at), 0)) as taps")
    ).toPandas()
    assert len(asks) == 20 and ((asks.whole == 0) | (asks.whole == asks.n)).all()
    assert (asks.whole <= most).all() and (asks.taps <= 4 * asks.h * asks.w).all()
    assert (asks.whole == 0).any() == (most == 0 or h is HORIZON)


def test_points_on_the_horizon_land_on_the_edge(spark, pixels, meta_of):
    from changegrid.operators.raster import pack_blocks

    img = np.arange(12.0).reshape(3, 4)
    px = pixels(img).selectExpr("scene_id", "0 as band", "row", "col", "value")
    # The inverse has denominator col - 1.
    h = np.linalg.inv(np.array([[1.0, 0, 0], [0, 1, 0], [1, 0, -1]]))
    regs, meta = spark.createDataFrame([(0, h.ravel().tolist())], "scene_id int, h array<double>"), meta_of([(0, 3, 4)])
    blocks = pack_blocks(px, 8, 8, keys=("scene_id", "band"))
    data = np.reshape(rgs.warp_blocks(blocks, blocks, regs, meta, 8, 8).first().data, (3, 4))
    rows = {(r.row, r.col): r.value for r in rgs.warp_bilinear(px, px, regs, meta).collect()}
    assert np.isfinite(data).all() and all(np.isclose(data[k], v) for k, v in rows.items()) and len(rows) == 12


def test_draws_are_those_of_the_spread_form(spark):
    got = spark.sql("select id, xxhash64(id) as seed from values (0L), (7L), (-5L), (123456789012L) as t(id)").collect()
    for r in got:
        want = spark.range(200).selectExpr(f"array(0, 1, 2, 3) as k", "int(id) as _t").selectExpr("_t", f"transform(k, x -> pmod(xxhash64({r.id}L, _t, x), 9L)) as d").orderBy("_t").collect()
        want = [w.d for w in want if len(set(w.d)) == 4]
        assert rgs._draws(r.seed, 9, 0, 200).tolist() == want and len(want) > 50


def test_pairs_of_one_chunk_are_searched_where_they_are(spark, monkeypatch):
    """The same fits as with draws, matrices and votes joined, and none of these in a table."""
    rng = np.random.default_rng(4)
    h = np.array([[1.0, 0.02, 15.0], [-0.01, 1.0, 8.0], [1e-5, -2e-5, 1.0]])
    rows = []
    for pair, n, out in ((1, 90, 60), (2, 3, 0), (3, 5, 0), (4, 40, 40), (-5, 60, 10)):
        a, b = _points(n, h, rng, noise=0.2, outliers=0)
        a[:out] += rng.uniform(30, 300, size=(out, 2))
        rows += [(pair, i, *map(float, (*b[i], *a[i]))) for i in range(n)]
    rows += [(None, 1, 0.0, 0.0, 0.0, 0.0), (1, 1000, None, 1.0, 2.0, 3.0)]
    m = spark.createDataFrame(rows, "pair_id bigint, match_id bigint, x_b double, y_b double, x_a double, y_a double")
    sizes = m.groupBy("pair_id").agg({"*": "count"}).selectExpr("pair_id", "`count(1)` as n_matches", "1 as _n")
    sized = m.join(sizes.drop("n_matches"), "pair_id")
    want = {r.pair_id: r for r in rgs._fit_chunked(sized, sizes, 3.0, rgs.MAX_TRIALS).collect()}
    whole = {r.pair_id: r for r in rgs._fit_whole(sized, 3.0, rgs.MAX_TRIALS).collect()}
    assert set(whole) == set(want) == {1, 3, 4, -5}
    for k, r in whole.items():
        assert r._h0 == want[k]._h0 and r.n_inliers == want[k].n_inliers and np.allclose(r.s, want[k].s, rtol=1e-9)
    monkeypatch.setattr(rgs, "_samples", None)  # no rows of draws
    got = {r.pair_id: r for r in rgs.fit_homography(m).collect()}
    assert {k: (r.n_matches, r.n_inliers) for k, r in got.items()} == {
        k: (sum(x[0] == k for x in rows), whole[k].n_inliers if k in whole else 0) for k in (1, 2, 3, 4, -5, None)
    }
    assert got[2].h is None and got[None].h is None and got[1].n_inliers >= 30
