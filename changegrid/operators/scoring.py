"""Change scores: pluggable tile model, default band-difference score, learned scorer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import col, expr

from changegrid.operators.raster import block_pixels, stretch_blocks
from changegrid.plans.lineage import cut


def diff_features(raster: DataFrame) -> DataFrame:
    """|A-B|, A and B per pixel and band: one conditional aggregation, no self join."""
    return (
        raster.groupBy("scene_id", "band", "row", "col")
        .agg(expr("max(if(t = 'A', value, null)) as value_a"), expr("max(if(t = 'B', value, null)) as value_b"))
        .where("value_a is not null and value_b is not null")
        .selectExpr("*", "abs(value_a - value_b) as diff")
    )


def band_difference(blocks: DataFrame, n_bands: int) -> DataFrame:
    """Mean over bands of |B-A| per pixel, block in, block out.

    The shuffle moves one array per (block, date, band) instead of one row per pixel and
    band; a group holds at most 2 * n_bands arrays. A pixel that is null in any band or date is null.
    """
    keys = ["scene_id", "block_row", "block_col", "h", "w"]
    grouped = (
        blocks.where(f"band < {n_bands}")
        .selectExpr(*keys, "struct(concat(t, band) as k, data as v) as kv")
        .groupBy(*keys)
        .agg(expr("map_from_entries(collect_list(kv)) as m"))
    )
    total = ""
    for k in range(n_bands):
        d = f"zip_with(m['B{k}'], m['A{k}'], (y, x) -> abs(y - x))"
        total = d if not total else f"zip_with({total}, {d}, (s, y) -> s + y)"
    return grouped.selectExpr(*keys, f"transform({total}, s -> double(s) / {n_bands}) as data").where("data is not null")


def score_blocks(blocks: DataFrame, n_bands: int) -> DataFrame:
    """Default scorer: band difference stretched to [0,1] per scene, as blocks.

    The raw bands are read once. Their difference, one value per pixel, is stored; the
    percentile passes and every later reader of the score start from there.
    """
    return stretch_blocks(cut(band_difference(blocks, n_bands)), ["scene_id"])


def change_score(blocks: DataFrame, n_bands: int, block_h: int, block_w: int) -> DataFrame:
    """The default score per pixel: (scene_id, row, col, p)."""
    return score_pixels(score_blocks(blocks, n_bands), block_h, block_w)


def score_pixels(scores: DataFrame, block_h: int, block_w: int) -> DataFrame:
    """Scored pixels as rows; null ones have no score and give no row."""
    return block_pixels(scores, block_h, block_w).selectExpr("scene_id", "row", "col", "value as p").where("p is not null")


def score_tiles(
    pairs: DataFrame,
    make_predict: Callable,
    tile_px: int,
    inputs: Sequence[str] = ("data_a", "data_b"),
    batch_size: int = 64,
) -> DataFrame:
    """Score tile pairs with a user model, in Arrow batches -> array column `prob`.

    `make_predict` builds the model once per Python worker and returns a function from the
    batched input arrays to an (n, tile_px) array.
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[tile_px]] * len(inputs),
    )
    return pairs.withColumn("prob", predict(*[col(c) for c in inputs]))


def fill_gaps(pairs: DataFrame) -> DataFrame:
    """Tile pairs without nulls, for models: a pixel that one date lacks shows the other date's value
    at both, one that both lack shows 0, so that no change appears there. `gaps` marks them; it is
    null in tiles without any."""
    lacks = "zip_with(data_a, data_b, (x, y) -> x is null or y is null)"
    marked = pairs.withColumn("gaps", expr(f"if(exists(data_a, x -> x is null) or exists(data_b, x -> x is null), {lacks}, null)"))
    fill = "if(gaps is null, {0}, zip_with({0}, {1}, (x, y) -> coalesce(x, y, 0)))".format
    return marked.withColumns({"data_a": expr(fill("data_a", "data_b")), "data_b": expr(fill("data_b", "data_a"))})


def drop_gaps(scored: DataFrame) -> DataFrame:
    """Scores of `fill_gaps` tiles: null where a date lacked the pixel."""
    return scored.withColumn("prob", expr("if(gaps is null, prob, zip_with(prob, gaps, (p, g) -> if(g, null, p)))")).drop("gaps")


def learned_scorer(features: DataFrame, label: str = "label", columns: Sequence[str] = ("diff", "value_a", "value_b")):
    """Fit a logistic pixel scorer on distributed rows, weighting classes against imbalance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    share = features.agg(expr(f"avg({label}) as s")).first()["s"] or 0.5
    share = min(max(float(share), 1e-6), 1 - 1e-6)
    weighted = features.selectExpr("*", f"if({label} = 1, {0.5 / share}D, {0.5 / (1 - share)}D) as _w")
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="features"),
        LogisticRegression(labelCol=label, weightCol="_w", standardization=True),
    ]
    return Pipeline(stages=stages).fit(weighted)
