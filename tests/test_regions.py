import numpy as np
import pytest

from changegrid.operators import polygons, regions as reg

GEO = (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0)


@pytest.fixture(scope="module")
def three_squares():
    img = np.zeros((256, 256), bool)
    img[10:50, 10:50] = img[100:120, 100:120] = img[200:203, 200:203] = True
    return img


def test_small_regions_are_dropped_and_order_is_by_size(mask_of, three_squares):
    got = reg.extract_regions(mask_of(three_squares), 50).toPandas()
    assert got.pixel_count.tolist() == [1600, 400]
    assert got.iloc[0][["row_min", "col_min", "row_max", "col_max"]].tolist() == [10, 10, 49, 49]
    assert got.iloc[0].centroid_row == 29.5
    assert reg.extract_regions(mask_of(three_squares), 1000).count() == 1


def test_empty_and_full_masks(mask_of):
    assert reg.extract_regions(mask_of(np.zeros((64, 64))), 0).count() == 0
    assert reg.extract_regions(mask_of(np.ones((64, 64))), 0).toPandas().pixel_count.tolist() == [4096]


def test_unknown_connectivity_is_refused(mask_of):
    with pytest.raises(ValueError):
        reg.label_components(mask_of(np.ones((2, 2))), connectivity=6)


def _flood(img, connectivity):
    """Brute-force labels: smallest row-major position in each component."""
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    label = {}
    for r, c in zip(*np.nonzero(img)):
        if (r, c) in label:
            continue
        todo, name = [(r, c)], r * reg.ROW_STRIDE + c
        label[(r, c)] = name
        while todo:
            y, x = todo.pop()
            for dy, dx in near:
                p = (y + dy, x + dx)
                if 0 <= p[0] < img.shape[0] and 0 <= p[1] < img.shape[1] and img[p] and p not in label:
                    label[p] = name
                    todo.append(p)
    return label


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("block,fan", [(1024, 8), (8, 2), (5, 3)])
def test_labels_do_not_depend_on_block_size(mask_of, connectivity, block, fan):
    img = np.random.default_rng(3).random((37, 41)) < 0.55
    img[0, :] = img[:, 20] = True  # one region crosses every block line
    want = _flood(img, connectivity)
    got = reg.label_components(mask_of(img), connectivity, block, fan).toPandas()
    assert {(r, c): k for r, c, k in zip(got.row, got.col, got.region_id)} == want
    padded = np.pad(img, 1)
    for r, c, sides in zip(got.row, got.col, got.sides):
        y, x = r + 1, c + 1
        open_ = (not padded[y - 1, x]) * reg.NORTH + (not padded[y, x + 1]) * reg.EAST + (not padded[y + 1, x]) * reg.SOUTH + (not padded[y, x - 1]) * reg.WEST
        assert sides == open_


def test_attributes_in_metres_and_in_pixels(mask_of, meta_of):
    img = np.zeros((40, 40), bool)
    img[5:10, 20:30] = True
    regions = reg.summarize_regions(reg.label_components(mask_of(img)), 1)
    geo = reg.region_attributes(regions, meta_of([(0, 40, 40, GEO, 32633)])).first()
    assert (geo.area_m2, geo.perimeter_m) == (50 * 100.0, 30 * 10.0)
    assert (geo.bbox_minx, geo.bbox_maxx, geo.bbox_miny, geo.bbox_maxy) == (500200.0, 500300.0, 4599900.0, 4599950.0)
    assert (geo.centroid_x, geo.centroid_y) == (500250.0, 4599925.0)
    twice = reg.region_attributes(regions, meta_of([(0, 40, 40, GEO, 32633)]), compat_area=True).first()
    assert (twice.area_m2, twice.perimeter_m) == (50 * 100.0 * 100.0, 30 * 10.0 * 10.0)
    plain = reg.region_attributes(regions, meta_of([(0, 40, 40)])).first()
    assert (plain.area_m2, plain.perimeter_m, plain.has_geo, plain.bbox_miny) == (50.0, 30.0, False, 5.0)


def test_non_square_pixels(mask_of, meta_of):
    img = np.zeros((8, 8), bool)
    img[2:4, 1:4] = True
    regions = reg.summarize_regions(reg.label_components(mask_of(img)), 1)
    row = reg.region_attributes(regions, meta_of([(0, 8, 8, (2.0, 0.0, 0.0, 0.0, -5.0, 0.0), 32633)])).first()
    assert (row.area_m2, row.perimeter_m) == (6 * 10.0, 6 * 2.0 + 4 * 5.0)


@pytest.mark.parametrize("zone", [1024, 8])
def test_zonal_mean_with_and_without_whole_zones_inside(spark, pixels, monkeypatch, zone):
    from changegrid.operators.raster import pack_blocks

    monkeypatch.setattr(reg, "ZONE_SIDE", zone)
    img = np.random.default_rng(5).random((45, 52))
    scores = pack_blocks(pixels(img), 4, 4, keys=("scene_id",))
    boxes = [(0, 0, 44, 51), (3, 2, 40, 49), (7, 9, 7, 9), (8, 8, 23, 23), (0, 50, 44, 51), (10, 0, 12, 51)]
    w = spark.createDataFrame(
        [(0, i, *b) for i, b in enumerate(boxes)], "scene_id int, region_id bigint, w_row0 int, w_col0 int, w_row1 int, w_col1 int"
    )
    got = {r.region_id: r.window_mean for r in reg.zonal_means(w, scores, 4, 4).collect()}
    for i, (r0, c0, r1, c1) in enumerate(boxes):
        assert got[i] == pytest.approx(img[r0 : r1 + 1, c0 : c1 + 1].mean(), abs=1e-12)


def test_confidence_falls_back_to_the_scene_mean(mask_of, meta_of, pixels):
    from changegrid.operators.raster import pack_blocks

    img = np.full((10, 10), 0.25)
    img[2:4, 2:4] = 1.0
    regions = reg.summarize_regions(reg.label_components(mask_of(img > 0.5)), 1)
    scores = pack_blocks(pixels(img), 5, 5, keys=("scene_id",))
    row = reg.region_confidence(regions, scores, meta_of([(0, 10, 10)]), 5, 5).first()
    assert row.confidence_source == "scene" and row.mean_confidence == pytest.approx(img.mean())
    row = reg.region_confidence(regions, scores, meta_of([(0, 10, 10, GEO, 32633)]), 5, 5).first()
    assert row.confidence_source == "window" and row.mean_confidence == pytest.approx(img[2:5, 2:5].mean())


def _shapes(df):
    return {
        r.region_id: [[[(q.x, q.y) for q in ring] for ring in poly] for poly in r.polygons]
        for r in df.select("region_id", "polygons").collect()
    }


def test_ring_with_hole(mask_of):
    img = np.zeros((20, 20), bool)
    img[2:10, 3:12] = True
    img[4:6, 5:8] = False
    (polys,) = _shapes(polygons.polygonize(reg.label_components(mask_of(img), 4), min_area_px=1)).values()
    assert len(polys) == 1 and len(polys[0]) == 2
    assert set(polys[0][0]) == {(3, 2), (12, 2), (12, 10), (3, 10)}
    assert set(polys[0][1]) == {(5, 4), (8, 4), (8, 6), (5, 6)}


def test_corner_touching_parts_become_a_multipolygon(mask_of):
    img = np.eye(4, dtype=bool)
    eight = polygons.polygonize(reg.label_components(mask_of(img), 8), min_area_px=1).first()
    assert eight.geometry_wkt.startswith("MULTIPOLYGON") and len(eight.polygons) == 4
    assert polygons.polygonize(reg.label_components(mask_of(img), 4), min_area_px=1).count() == 4


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("block", [1024, 7])
def test_outlines_enclose_exactly_the_region(mask_of, connectivity, block):
    img = np.random.default_rng(11).random((30, 33)) < 0.6
    lab = reg.label_components(mask_of(img), connectivity, block, 4)
    regions = {r.region_id: r for r in reg.summarize_regions(lab, 1).collect()}
    for region, polys in _shapes(polygons.polygonize(lab, block=block, min_area_px=1)).items():
        area = sum(_area(r) for p in polys for r in p)
        assert area == regions[region].pixel_count
        for p in polys:
            assert _area(p[0]) > 0 and all(_area(h) < 0 for h in p[1:])
            for ring in p:
                assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1  # simple
        steps = sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for p in polys for r in p for a, b in zip(r, r[1:]))
        assert steps == regions[region].h_edges + regions[region].v_edges


def _area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def test_world_units_follow_the_geotransform(mask_of, meta_of):
    img = np.zeros((256, 256), bool)
    img[0:50, 0:50] = True
    t = (100 / 256, 0.0, 100.0, 0.0, -100 / 256, 150.0)
    row = polygons.polygonize(reg.label_components(mask_of(img)), meta_of([(0, 256, 256, t, 4326)])).first()
    xs, ys = zip(*[(q.x, q.y) for q in row.polygons[0][0]])
    assert min(xs) == 100.0 and max(ys) == 150.0 and max(xs) == pytest.approx(100 + 50 * 100 / 256)


def test_simplify_keeps_rings_valid(mask_of):
    img = np.tril(np.ones((20, 20), bool))
    shapes = polygons.polygonize(reg.label_components(mask_of(img), 4), min_area_px=1)
    before = len(shapes.first().polygons[0][0])
    after = polygons.simplify_rings(shapes, 1.0).first().polygons[0][0]
    assert 4 <= len(after) < before and after[0] == after[-1]
    assert len(polygons.simplify_rings(shapes, 0.0).first().polygons[0][0]) == before


def test_hull_of_a_region_and_no_hull_of_a_line(mask_of, meta_of):
    img = np.zeros((20, 20), bool)
    img[2:7, 2:9] = True
    img[12, 1:15] = True
    hull = polygons.region_hull(reg.label_components(mask_of(img), 4), min_area_px=3).collect()
    assert len(hull) == 1
    assert {(q.x, q.y) for q in hull[0].ring} == {(2.0, 2.0), (8.0, 2.0), (8.0, 6.0), (2.0, 6.0)}


def test_groups_share_calls_and_stay_whole(spark):
    """Every call sees whole groups, and many of them."""
    from changegrid.plans.groups import map_groups

    df = spark.range(3000).selectExpr("int(id % 100) as a", "id % 2 as b", "id as v")

    def run(pdf, group):
        assert (group[1:] >= group[:-1]).all()
        return pdf.assign(g=group, calls=len(set(group)), n=pdf.groupby(["a", "b"]).v.transform("size"))

    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")  # groups of 30 rows straddle batches
        got = map_groups(df, ["a", "b"], run, "a int, b bigint, v bigint, g bigint, calls bigint, n bigint").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    assert sorted(got.v) == list(range(3000)) and (got.n == 30).all() and got.calls.max() > 1


def test_no_open_path_at_the_upper_and_left_border():
    import pandas as pd

    from changegrid.operators import polygons

    pdf = pd.DataFrame({"scene_id": 0, "region_id": [0, 0], "row": [0, 1], "col": [0, 0], "sides": [1 | 2 | 8, 2 | 4 | 8]})
    out = polygons._trace_blocks(1024)(pdf, np.zeros(2, int))
    assert len(out) == 1 and out.closed.all()
