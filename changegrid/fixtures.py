"""Raster, tile, match and run tables derived from the star-schema tables.

The given tables hold no images, so each derived table below re-reads one of them as the
image data it stands for. Every derivation is a plain DataFrame over the whole table and
grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import expr

ROWS, COLS, BANDS = 50, 24, 5
CELLS = 2 * BANDS * COLS
BLOCK_H = 25

# Event types in band order, and the first day of date B.
BAND_EVENTS = "'click', 'error', 'purchase', 'signup', 'view'"
DATE_B = "timestamp_ntz'2024-01-16'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Scene ids with their line counts; the last scene may be short."""
    return (
        table(spark, sf, "events")
        .agg(expr("max(user_id) as last"))
        .selectExpr("last", f"explode(sequence(0, int(last div {ROWS}))) as scene_id")
        .selectExpr("scene_id", f"int(least({ROWS}, last + 1 - scene_id * {ROWS})) as scene_rows")
    )


def raster_rows(spark: SparkSession, sf: str) -> DataFrame:
    """D1, one row per image line: `data` in (t, band, col) order, absent cells 0."""
    late = f"if(ts < {DATE_B}, 0, 1)"
    band = f"array_position(array({BAND_EVENTS}), event_type) - 1"
    cells = (
        table(spark, sf, "events")
        .where(f"event_type in ({BAND_EVENTS})")
        .selectExpr(
            f"int(user_id div {ROWS}) as scene_id",
            f"int(user_id % {ROWS}) as row",
            f"int(({late} * {BANDS} + {band}) * {COLS} + hour(ts)) as cell",
            "value",
        )
        .groupBy("scene_id", "row", "cell")
        .agg(expr("round(sum(value), 6) as value"))
    )
    # At most CELLS entries per line are left after the pre-aggregation above.
    found = cells.groupBy("scene_id", "row").agg(expr("map_from_entries(collect_list(struct(cell, value))) as found"))
    lines = scenes(spark, sf).repartition("scene_id").selectExpr("scene_id", "explode(sequence(0, scene_rows - 1)) as row")
    return lines.join(found, ["scene_id", "row"], "left").selectExpr(
        "scene_id", "row", f"transform(sequence(0, {CELLS - 1}), i -> coalesce(try_element_at(found, i), 0D)) as data"
    )


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """D1: (scene_id, t, band, row, col, value), dense."""
    return raster_rows(spark, sf).selectExpr("scene_id", "row", "posexplode(data) as (i, value)").selectExpr(
        "scene_id",
        f"if(i < {BANDS * COLS}, 'A', 'B') as t",
        f"int((i div {COLS}) % {BANDS}) as band",
        "row",
        f"int(i % {COLS}) as col",
        "value",
    )


def raster_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """D1 as `raster_block` rows of up to BLOCK_H lines: (scene_id, t, band, block_row, block_col, h, w, data)."""
    packed = (
        raster_rows(spark, sf)
        .groupBy("scene_id", expr(f"row div {BLOCK_H} as b"))
        .agg(expr("array_sort(collect_list(struct(row, data))) as lines"))
    )
    return packed.selectExpr("scene_id", "b", "lines", f"explode(sequence(0, {2 * BANDS - 1})) as part").selectExpr(
        "scene_id",
        f"if(part < {BANDS}, 'A', 'B') as t",
        f"int(part % {BANDS}) as band",
        "int(b) as block_row",
        "0 as block_col",
        "size(lines) as h",
        f"{COLS} as w",
        f"flatten(transform(lines, l -> slice(l.data, part * {COLS} + 1, {COLS}))) as data",
    )


def bordered_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """D1 blocks with nodata in odd scenes: the two left columns of date B, and single pixels of
    column 20 in one band of date A."""
    hole = "(t = 'B' and i % w < 2) or (t = 'A' and band = 2 and i % w = 20 and (block_row * {0} + i div w) % 7 = 3)".format(BLOCK_H)
    data = f"if(scene_id % 2 = 1, transform(data, (v, i) -> if({hole}, -9999D, v)), data)"
    return raster_blocks(spark, sf).withColumn("data", expr(data))


def bordered_meta(spark: SparkSession, sf: str) -> DataFrame:
    return scene_meta(spark, sf).withColumn("nodata", expr("if(scene_id % 2 = 1, -9999D, null)"))


def scene_meta(spark: SparkSession, sf: str) -> DataFrame:
    """D3: one row per scene."""
    return scenes(spark, sf).selectExpr(
        "scene_id", f"{COLS} as width", "scene_rows as height", f"{BANDS} as band_count",
        "10D as a", "0D as b", "500000D + scene_id * 10000 as c", "0D as d", "-10D as e", "4600000D as f",
        "32633 as epsg", "cast(null as double) as nodata", "cast(null as double) as resolution_m",
        "'2024-01-01' as t_a", "'2024-01-16' as t_b",
    )


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """D4 patches: (patch_id, row, col, value), 8x8, one per vector."""
    return table(spark, sf, "embeddings").selectExpr("vec_id as patch_id", "posexplode(embedding) as (i, x)").selectExpr(
        "patch_id", "int(i div 8) as row", "int(i % 8) as col", "double(x) as value"
    )


def packed_patches(spark: SparkSession, sf: str) -> DataFrame:
    """D4 patches packed: (patch_id, data), 8x8 row-major, one per vector."""
    return table(spark, sf, "embeddings").selectExpr("vec_id as patch_id", "cast(embedding as array<double>) as data")


def patch_scene_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """D4 scenes in blocks of 8x8: a vector is a block."""
    uses = "array(struct('A' as t, vec_id % 25 as p), struct('B' as t, (vec_id % 25 + 24) % 25 as p))"
    return (
        table(spark, sf, "embeddings")
        .selectExpr("int(vec_id div 25) as scene_id", "cast(embedding as array<double>) as data", f"explode({uses}) as u")
        .selectExpr("scene_id", "u.t as t", "int(u.p div 5) as block_row", "int(u.p % 5) as block_col", "8 as h", "8 as w", "data")
    )


def patch_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """D4 laid out 5x5 per group of 25 vectors; date B shows the next vector of the group.

    Each vector serves its own place at date A and its predecessor's at date B, so the
    pairing is an explode and needs no self join.
    """
    uses = "array(struct('A' as t, vec_id % 25 as p), struct('B' as t, (vec_id % 25 + 24) % 25 as p))"
    return (
        table(spark, sf, "embeddings")
        .selectExpr("int(vec_id div 25) as scene_id", "embedding", f"explode({uses}) as u")
        .selectExpr("scene_id", "u.t as t", "u.p as p", "posexplode(embedding) as (i, x)")
        .selectExpr(
            "scene_id", "t", "int((p div 5) * 8 + i div 8) as row", "int((p % 5) * 8 + i % 8) as col", "double(x) as value"
        )
    )


def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """D5: (pair_id, side, kp_id, vec); 500 key points per image pair."""
    side_a = table(spark, sf, "embeddings").selectExpr(
        "int(vec_id div 500) as pair_id", "'A' as side", "vec_id as kp_id", "cast(embedding as array<double>) as vec"
    )
    side_b = side_a.where("kp_id % 3 <> 0").selectExpr(
        "pair_id", "'B' as side", "kp_id",
        "transform(vec, (x, i) -> x + 0.002D * ((kp_id * 31 + (i + 1) * 17) % 11 - 5)) as vec",
    )
    return side_a.unionByName(side_b)


GAIN = "(case when pair_id % 11 = 0 then 4D when pair_id % 7 = 0 then 3D else 1D end)"


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """D6: matched points under a known homography with one outlier in ten."""
    return (
        table(spark, sf, "orders")
        .selectExpr(
            "o_orderkey div 100 as pair_id", "o_orderkey as match_id",
            "double(o_custkey % 97) as x_b", "double(o_orderkey % 89) as y_b", "if(o_orderkey % 10 = 0, 1D, 0D) as off",
        )
        .selectExpr(
            "pair_id", "match_id", "x_b", "y_b",
            f"{GAIN} * (x_b + y_b * 0.01D) + 10D + off * 40D as x_a",
            f"{GAIN} * (x_b * -0.02D + y_b) + 5D - off * 25D as y_a",
        )
    )


def noisy_matches(spark: SparkSession, sf: str) -> DataFrame:
    """D6 with seven outliers in ten, each shifted its own way."""
    shift = lambda base, step, span: f"off * ({base} + o_key * {step} % {span})"
    return (
        table(spark, sf, "orders")
        .selectExpr(
            "o_orderkey div 100 as pair_id", "o_orderkey as match_id", "o_orderkey as o_key",
            "double(o_custkey % 97) as x_b", "double(o_orderkey % 89) as y_b", "if(o_orderkey % 10 < 7, 1D, 0D) as off",
        )
        .selectExpr(
            "pair_id", "match_id", "x_b", "y_b",
            f"{GAIN} * (x_b + y_b * 0.01D) + 10D + {shift(40, 7919, 211)} as x_a",
            f"{GAIN} * (x_b * -0.02D + y_b) + 5D - {shift(25, 104729, 173)} as y_a",
        )
    )


def known_homographies(spark: SparkSession, sf: str) -> DataFrame:
    """The matrices behind D6, one per pair, as row-major arrays of nine."""
    pairs = table(spark, sf, "orders").selectExpr("o_orderkey div 100 as pair_id").distinct()
    return pairs.selectExpr("pair_id", f"array({GAIN}, {GAIN} * 0.01D, 10D, {GAIN} * -0.02D, {GAIN}, 5D, 0D, 0D, 1D) as h")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """D7: (doc_id, sample_id, config, prob, target)."""
    labels = table(spark, sf, "labels").selectExpr("doc_id", "quality as target")
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id", "source as sample_id", "lang as config", "(n_chars % 1000) / 1000D as prob"
    )
    return docs.join(labels, "doc_id")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """D9: (run_id, epoch, val_f1, val_loss), one epoch per line."""
    return (
        table(spark, sf, "lineitem")
        .selectExpr(
            "l_suppkey as run_id",
            "row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) as epoch",
            "round(l_discount * 5 + l_tax, 6) as val_f1",
        )
        .selectExpr("*", "round(1 - val_f1, 6) as val_loss")
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """D10: scene-pair arrivals, several rows per pair."""
    return table(spark, sf, "events").selectExpr(
        "event_id div 4 as pair_id", f"int(user_id div {ROWS}) as scene_id", "ts as submitted_at", "event_id"
    )
