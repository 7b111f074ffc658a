"""Physical plans of all queries: no nested loops, no unbounded single-task steps."""

import re

import pytest

from changegrid.catalog import QUERIES

# Global windows over a fixed number of rows: hash-prefix bins and threshold bins.
BOUNDED_WINDOWS = {"image_split", "threshold_sweep"}
# One row of metrics beside one row with the sample count.
ONE_ROW_JOINS = {"evaluation_rows"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    if name not in ONE_ROW_JOINS:
        assert not re.search("NestedLoop|Cartesian", plan)
    if name not in BOUNDED_WINDOWS:
        assert not re.search(r"Window[^\n]*\n(?:[^\n]*\n){0,3}[^\n]*SinglePartition", plan)


def test_hot_key_is_spread_by_the_salt(spark):
    from changegrid.plans.joins import salted_join

    big = spark.range(32_000).selectExpr("0 as k", "id as r")
    small = spark.sql("select 0 as k, 7 as v union all select 1, 8")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = salted_join(big, small, ["k"], ["r"])
        sizes = [r["n"] for r in out.selectExpr("spark_partition_id() as p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    assert sum(sizes) == 32_000 and max(sizes) < 16_000


def _broadcast_sides(df) -> list[str]:
    """Plan text below each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+|-]*", x)[0]) for x in lines]
    found = []
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


def test_warp_broadcasts_no_pixels(spark, sf):
    """Pixels unpacked from blocks look as small as the blocks' files."""
    sides = _broadcast_sides(QUERIES["warp_bilinear"](spark, sf))
    assert sides and not any("Generate" in x or "posexplode" in x or "col(_k" in x for x in sides)
    assert not any("band" in x for x in sides)


def test_trial_draws_are_spread_and_not_broadcast(spark, sf):
    from changegrid.fixtures import matches
    from changegrid.operators import registration as rgs
    from changegrid.plans.lineage import cut

    cols = ["pair_id", "match_id", "x_b", "y_b", "x_a", "y_a"]
    numbered = cut(matches(spark, sf).selectExpr(*cols, "int(row_number() over (partition by pair_id order by match_id) - 1) as _i"))
    wanted = cut(numbered.groupBy("pair_id").count().selectExpr("pair_id", "count as n", "0 as _from", "64 as _to"))
    found = rgs._samples(numbered, wanted)
    assert not _broadcast_sides(found)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["warp_blocks", "stitch_tiles_cli_blocks", "zonal_mean_blocked"])
def test_small_groups_of_blocks_share_calls(spark, sf, name):
    """No Python call per block, tile or zone."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "GroupsInPandas" not in plan


def test_each_group_comes_whole_and_in_order(spark, monkeypatch):
    from changegrid.plans import groups

    df = spark.range(3000).selectExpr("int(id % 100) as a", "id % 2 as b", "2999 - id as v", "array(double(id)) as data")

    def run(rows):
        assert (rows["v"][1:] > rows["v"][:-1]).all()
        return [(rows["a"][0], rows["b"][0], len(rows["v"]), sum(d[0] for d in rows["data"]))]

    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")  # groups of 30 rows straddle batches
        got = groups.map_each_group(df, ["a", "b"], run, "a int, b bigint, n bigint, total double", ["v"]).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    assert len(got) == 100 and (got.n == 30).all() and got.total.sum() == sum(range(3000))


def test_lots_are_bounded_by_rows_and_array_values(monkeypatch):
    import numpy as np

    from changegrid.plans import groups

    monkeypatch.setattr(groups, "VALUES_AT_ONCE", 100)
    rows = [(i, np.zeros(30)) for i in range(10)]
    assert [len(x) for x in groups.in_lots(rows, ["i", "data"])] == [4, 4, 2]
    assert [len(x) for x in groups.in_lots(rows, ["i", "data"], 3)] == [3, 3, 3, 1]
    assert list(groups.in_lots([], ["i"])) == []


def test_area_join_lists_only_levels_that_meet_and_broadcasts_nothing(spark, sf):
    from changegrid.operators import detections as det

    assert not _broadcast_sides(QUERIES["aoi_join"](spark, sf))
    d = spark.range(50).selectExpr("id as detection_id", "id * 3D as bbox_minx", "0D as bbox_miny", "id * 3D + 1 as bbox_maxx", "1D as bbox_maxy")
    a = spark.range(50).selectExpr("id as aoi_id", "id * 3D as minx", "0D as miny", "id * 3D + if(id = 7, 100D, 1D) as maxx", "1D as maxy")
    plan = det.aoi_join(d, a, cell=10.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "[0]" in plan and "[0,2]" in plan.replace("[2,0]", "[0,2]") and "sequence(0, 11" not in plan
    got = {(r.aoi_id, r.detection_id) for r in det.aoi_join(d, a, cell=10.0).collect()}
    assert got == {(i, i) for i in range(50)} | {(7, i) for i in range(7, 41) if 3 * i <= 121}
    assert det.aoi_join(d.where("false"), a).count() == 0 and det.aoi_join(d, a.where("false")).count() == 0
