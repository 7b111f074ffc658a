"""Image folders: pixels, ids, layout, digests, routing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import expr

# File suffixes per reader.
RASTER_SUFFIXES = (".tif", ".tiff", ".jp2", ".img")
PLAIN_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp")

STEM = "regexp_extract(path, '([^/]+)\\\\.[^./]+$', 1)"
SUFFIX = "lower(regexp_extract(path, '(\\\\.[^./]+)$', 1))"


def file_listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Paths, sizes and times of the files below `root`; contents are pruned from the scan."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "modificationTime", "length")
    )


def route_files(listing: DataFrame) -> DataFrame:
    raster = ", ".join(repr(s) for s in RASTER_SUFFIXES)
    plain = ", ".join(repr(s) for s in PLAIN_SUFFIXES)
    return listing.selectExpr(
        "path", f"{SUFFIX} as suffix", f"case when {SUFFIX} in ({raster}) then 'raster' when {SUFFIX} in ({plain}) then 'plain' else 'unsupported' end as reader"
    )


def _unpack_images(batches):
    """Decoded bytes to one float array per band; a few images per Arrow batch."""
    for pdf in batches:
        rows = []
        for path, h, w, n, data in zip(pdf["path"], pdf["h"], pdf["w"], pdf["n"], pdf["data"]):
            px = np.frombuffer(data, np.uint8).reshape(h, w, n) / 255.0
            for band in range(3):
                rows.append((path, band, h, w, px[:, :, 2 - band if n >= 3 else 0].ravel()))
        yield pd.DataFrame(rows, columns=["path", "band", "h", "w", "data"])


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Plain images as blocks: (path, image_id, band, h, w, data in [0,1]), bands R, G, B.

    Spark decodes to bytes in B, G, R order, top-left first; grey images feed all three bands.
    One array per band, so pixels stay packed.
    """
    img = (
        spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
        .selectExpr("image.origin as path", "image.height as h", "image.width as w", "image.nChannels as n", "image.data as data")
    )
    bands = img.mapInPandas(_unpack_images, "path string, band int, h int, w int, data array<double>")
    return bands.selectExpr("path", f"{STEM} as image_id", "band", "h", "w", "data")


def image_ids(listing: DataFrame, side: str = "A") -> DataFrame:
    """Sorted ids of the files in the side's folder."""
    return listing.where(f"path rlike '/{side}/[^/]+\\\\.png$'").selectExpr(f"{STEM} as image_id").distinct().orderBy("image_id")


def split_layout(listing: DataFrame) -> DataFrame:
    """'presplit' when train, val and test all hold an A folder, 'flat' when only A exists."""
    seg = "regexp_extract(path, '/(train|val|test)/A/[^/]+$', 1)"
    return listing.agg(
        expr(f"count(distinct nullif({seg}, '')) as n_splits"), expr("count_if(path rlike '/A/[^/]+$') as n_a")
    ).selectExpr("case when n_splits = 3 then 'presplit' when n_a > 0 then 'flat' else 'unknown' end as layout")


def with_split(listing: DataFrame) -> DataFrame:
    return listing.selectExpr(
        "*", "regexp_extract(path, '/(train|val|test)/(A|B|label)/[^/]+$', 1) as split",
        "regexp_extract(path, '/(A|B|label)/[^/]+$', 1) as side", f"{STEM} as image_id",
    )


def suffix_pairs(listing: DataFrame) -> DataFrame:
    """`<id>_A.*` / `<id>_B.*` names -> (image_id, side)."""
    return listing.where(f"{STEM} rlike '_[AB]$'").selectExpr(
        "path", f"regexp_extract({STEM}, '^(.*)_([AB])$', 1) as image_id", f"regexp_extract({STEM}, '^(.*)_([AB])$', 2) as side"
    )


def digest_prefix(rows: DataFrame, content: str = "content", length: int = 8) -> DataFrame:
    return rows.withColumn("digest", expr(f"substring(sha2({content}, 256), 1, {length})"))


def file_digests(spark: SparkSession, root: str, length: int = 8) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return digest_prefix(files.select("path", "content"), length=length).select("path", "digest")


def write_patches(patches: DataFrame, path: str) -> None:
    """One folder per split, as the training readers prune on it."""
    patches.write.mode("append").partitionBy("split").parquet(path)
