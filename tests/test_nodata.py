"""Declared nodata stays out of scores, percentiles and confidences of the block plan."""

import pytest
from pyspark.sql.functions import expr

from changegrid import catalog
from changegrid import fixtures as fx
from changegrid.operators import raster as ras
from changegrid.operators import scoring
from changegrid.oracle import SQL
from changegrid.plans.change_detection import detect_changes
from tools.check_oracle import compare, connect

# The two left columns of odd scenes are a nodata border, of date B only.
BORDER = "if(scene_id % 2 = 1 and t = 'B', transform(data, (v, i) -> if(i % w < 2, -9999D, v)), data)"


def _sql(name):
    ab = "FROM ab GROUP BY ALL)"
    assert ab in SQL[name]
    return SQL[name].replace(ab, "FROM ab WHERE NOT (scene_id % 2 = 1 AND col < 2) GROUP BY ALL)")


@pytest.fixture(scope="module")
def bordered(spark):
    def make(sf):
        blocks = fx.raster_blocks(spark, sf).withColumn("data", expr(BORDER))
        return blocks, fx.scene_meta(spark, sf).withColumn("nodata", expr("if(scene_id % 2 = 1, -9999D, null)"))

    return make


def test_detections_match_sql(bordered, sf):
    blocks, meta = bordered(sf)
    got = detect_changes(blocks, meta, min_area_px=catalog.MIN_AREA, **catalog.BLOCK)
    got = catalog._round(got, *catalog.DETECTION_DOUBLES).toPandas()
    want = connect(sf).execute(_sql("detect_changes")).fetchdf()
    assert len(want) > 0 and compare(got, want) == ""


def test_scores_match_sql(bordered, sf):
    blocks, meta = bordered(sf)
    got = scoring.change_score(ras.mask_blocks(blocks, meta), fx.BANDS, fx.BLOCK_H, fx.COLS)
    assert compare(catalog._round(got, "p").toPandas(), connect(sf).execute(_sql("change_score")).fetchdf()) == ""


def test_aligned_detections_match_sql(spark, sf):
    got = catalog.QUERIES["detect_changes_nodata"](spark, sf).toPandas()
    want = connect(sf).execute(SQL["detect_changes_nodata"]).fetchdf()
    assert len(want) > 0 and compare(got, want) == ""


def test_models_see_no_gap(spark):
    rows = [(0, [1.0, None, 3.0, None], [5.0, 6.0, None, None]), (1, [1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0])]
    pairs = scoring.fill_gaps(spark.createDataFrame(rows, "k int, data_a array<double>, data_b array<double>"))
    got = {r.k: r for r in pairs.collect()}
    assert (got[0].data_a, got[0].data_b) == ([1, 6, 3, 0], [5, 6, 3, 0]) and (got[1].data_a, got[1].data_b) == rows[1][1:]
    scored = scoring.drop_gaps(pairs.withColumn("prob", expr("transform(data_a, x -> x / 10)")))
    assert {r.k: r.prob for r in scored.collect()} == {0: [0.1, None, None, None], 1: [0.1, 0.2, 0.3, 0.4]}
