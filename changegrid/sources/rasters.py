"""Raster tables: scans with metadata, change-map output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changegrid.functions import expr as X
from changegrid.operators.raster import pack_blocks
from changegrid.plans.joins import salted_join

# Band descriptions of a change map.
MASK_TAGS = "map('DESCRIPTION', 'binary_change_mask', 'VALUES', '0=no_change,1=change')"
PROB_TAGS = "map('DESCRIPTION', 'change_probability', 'VALUES', '[0,1]')"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def raster_scan(blocks: DataFrame, meta: DataFrame, spread=("t", "band", "block_row", "block_col")) -> DataFrame:
    """Blocks with their scene's metadata, and whether the scene is georeferenced."""
    m = meta.selectExpr(
        "scene_id", "width", "height", "band_count", "epsg", *"abcdef", "nodata",
        "coalesce(resolution_m, abs(a)) as resolution_m", "epsg is not null and a is not null as has_geo",
    )
    return salted_join(blocks, m, ["scene_id"], list(spread), "left")


def change_map(prob: DataFrame, thr: float = 0.5, layout: str = "service") -> DataFrame:
    """Two-band change map in long layout.

    Service layout: band 1 mask, band 2 probability, threshold exclusive. CLI layout: band 1
    probability, band 2 mask, threshold inclusive.
    """
    mask = f"double({X.threshold('p', thr, inclusive=layout == 'cli')})"
    first, second = (mask, "double(p)") if layout == "service" else ("double(p)", mask)
    return prob.selectExpr(
        "scene_id", "row", "col", f"explode(array(struct(1 as band, {first} as value), struct(2 as band, {second} as value))) as b"
    ).selectExpr("scene_id", "b.band as band", "row", "col", "b.value as value")


def write_change_map(prob: DataFrame, meta: DataFrame, path: str, block: int = 256, thr: float = 0.5, layout: str = "service", compression: str = "zstd") -> None:
    """Packed change map plus a scene table carrying geotransform, CRS and band tags."""
    packed = pack_blocks(change_map(prob, thr, layout), block, block, keys=("scene_id", "band"))
    packed.write.mode("append").option("compression", compression).parquet(f"{path}/blocks")
    tags = (MASK_TAGS, PROB_TAGS) if layout == "service" else (PROB_TAGS, MASK_TAGS)
    meta.selectExpr("scene_id", "width", "height", "epsg", *"abcdef", f"map('1', {tags[0]}, '2', {tags[1]}) as band_tags").write.mode(
        "append"
    ).parquet(f"{path}/scenes")


def prob_bytes(prob: DataFrame) -> DataFrame:
    """Eight-bit probability picture."""
    return prob.selectExpr("scene_id", "row", "col", f"{X.prob_to_uint8('p')} as byte")
