"""The detection table: schema, insert, scan, GeoJSON and summary output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import current_timestamp, expr
from pyspark.sql.utils import AnalysisException

from changegrid.operators.detections import geojson_features

_D, _S = T.DoubleType(), T.StringType()
SCHEMA = T.StructType(
    [
        T.StructField("detection_id", _S),
        T.StructField("scene_id", T.IntegerType()),
        T.StructField("region_id", T.LongType()),
        T.StructField("geometry_wkt", _S),
        T.StructField("area_m2", _D),
        T.StructField("centroid_x", _D),
        T.StructField("centroid_y", _D),
        T.StructField("bbox_minx", _D),
        T.StructField("bbox_miny", _D),
        T.StructField("bbox_maxx", _D),
        T.StructField("bbox_maxy", _D),
        T.StructField("perimeter_m", _D),
        T.StructField("mean_confidence", _D),
        T.StructField("timestamp_a", _S),
        T.StructField("timestamp_b", _S),
        T.StructField("epsg", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
DEFAULT_EPSG = 4326
BUCKETS = 64


def read_detections(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    """All stored detections; an absent or empty store reads as an empty frame with the schema.

    `merge_schema` shows columns that only some inserts brought; large stores with one schema
    switch it off and skip reading every footer.
    """
    try:
        df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], SCHEMA)
        raise
    return df.drop("bucket", "batch_id")


def complete(rows: DataFrame, default_epsg: int = DEFAULT_EPSG) -> DataFrame:
    """Fill what an insert may leave out: id, time, CRS."""
    if "detection_id" not in rows.columns:
        rows = rows.withColumn("detection_id", expr("uuid()"))
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", current_timestamp())
    if "epsg" not in rows.columns:
        return rows.withColumn("epsg", expr(f"{default_epsg}"))
    return rows.withColumn("epsg", expr(f"coalesce(epsg, {default_epsg})"))


def merge(existing: DataFrame, rows: DataFrame, dedup: bool = False) -> DataFrame:
    """Existing plus new rows with the union of their columns."""
    if dedup:
        rows = rows.join(existing.select("detection_id"), "detection_id", "left_anti")
    return existing.unionByName(rows, allowMissingColumns=True)


def insert(rows: DataFrame, path: str, dedup: bool = False, default_epsg: int = DEFAULT_EPSG) -> None:
    """Append to the table. Old files are not rewritten; extra columns join the schema on read.

    Rows are laid out by bucket and sorted by box, so box filters skip row groups; ids carry
    Bloom filters, so id lookups do too. The bucket hashes scene and kilometre cell, so one busy
    scene fills many files, and the rebalance lets adaptive execution size them.
    """
    rows = complete(rows, default_epsg)
    if dedup:
        stored = read_detections(rows.sparkSession, path).select("detection_id")
        rows = rows.join(stored, "detection_id", "left_anti").dropDuplicates(["detection_id"])
    (
        rows.withColumn("bucket", expr(f"int(pmod(xxhash64(scene_id, floor(bbox_minx / 1000), floor(bbox_miny / 1000)), {BUCKETS}))"))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "bbox_minx", "bbox_miny")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#detection_id", "true")
        .option("parquet.bloom.filter.expected.ndv#detection_id", "1000000")
        .partitionBy("bucket")
        .parquet(path)
    )


def write_geojson(detections: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features, written in parallel; no rows, no feature lines."""
    geojson_features(detections).select("feature").write.mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
