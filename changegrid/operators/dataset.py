"""Training-set preparation: triplets, leakage-free splits, subsets, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.functions import expr

from changegrid.plans.joins import salted_join

# Split names and expected folders of the known dataset layouts.
SPLITS = ("train", "val", "test")
SIDES = ("A", "B", "label")


def pair_triplets(a: DataFrame, b: DataFrame, label: DataFrame, key: str = "image_id") -> DataFrame:
    """Images that have A, B and label. All three joins share one partitioning by id."""
    return a.join(b, key).join(label, key)


def incomplete_triplets(assets: DataFrame) -> DataFrame:
    """Images lacking a part, from (image_id, side) rows; one aggregation, no anti joins."""
    have = assets.groupBy("image_id").agg(*[expr(f"bool_or(side = '{s}') as has_{s.lower()}") for s in SIDES])
    return have.where("has_a and not (has_b and has_label)")


def image_split(ids: DataFrame, key: str = "image_id", train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Exact-size split by image: the first int(n*train) ids in hash order train, and so on.

    A hash prefix cuts the ids into even bins; bins are counted and offset first, so ranking
    runs inside bins in parallel instead of in one global window.
    """
    hashed = ids.select(key).distinct().selectExpr(key, f"sha2(concat('{seed}:', string({key})), 256) as _h")
    hashed = hashed.selectExpr("*", "substring(_h, 1, 4) as _bin")
    # At most 65536 bins, whatever the number of ids.
    bins = hashed.groupBy("_bin").agg(expr("count(1) as _c")).selectExpr(
        "_bin",
        "coalesce(sum(_c) over (order by _bin rows between unbounded preceding and 1 preceding), 0) as _before",
        "sum(_c) over () as _total",
    )
    ranked = hashed.selectExpr(key, "_bin", f"row_number() over (partition by _bin order by _h, {key}) - 1 as _r")
    at = "_before + _r"
    n_train, n_val = f"bigint(floor(_total * {train}D))", f"bigint(floor(_total * {val}D))"
    return ranked.join(bins, "_bin").selectExpr(
        key, f"case when {at} < {n_train} then 'train' when {at} < {n_train} + {n_val} then 'val' else 'test' end as split"
    )


def image_split_hashed(ids: DataFrame, key: str = "image_id", train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Threshold form: row-local, stable when ids are added, sizes only approximate."""
    u = f"double(conv(substring(sha2(concat('{seed}:', string({key})), 256), 1, 8), 16, 10)) / {float(2**32)}D"
    return ids.selectExpr(key, f"{u} as _u").selectExpr(
        key, f"case when _u < {train}D then 'train' when _u < {train + val}D then 'val' else 'test' end as split"
    )


def leakage(rows: DataFrame, key: str = "image_id") -> DataFrame:
    """Ids that occur in more than one split, with the splits; empty means no leakage."""
    return (
        rows.groupBy(key)
        .agg(expr("sort_array(collect_set(split)) as _s"))
        .where("size(_s) > 1")
        .selectExpr(key, "array_join(_s, ',') as splits", "bigint(size(_s)) as n_splits")
    )


def assert_no_leakage(rows: DataFrame, key: str = "image_id") -> None:
    found = leakage(rows, key).orderBy(key).limit(5).collect()
    if found:
        raise RuntimeError(f"data leakage, for example {[r[key] for r in found]}")


def split_counts(patches: DataFrame) -> DataFrame:
    """Patches per split, zero rows kept: each split name seeds its own sum."""
    spark = patches.sparkSession
    seeds = spark.sql(f"select explode(array({', '.join(repr(s) for s in SPLITS)})) as split, 0L as n")
    return patches.selectExpr("split", "1L as n").unionByName(seeds).groupBy("split").agg(expr("sum(n) as n_patches"))


def first_n(rows: DataFrame, n: int, key: str = "image_id", quarter: bool = False) -> DataFrame:
    """First n ids (or n // 4 for validation), by take-ordered rather than a global sort."""
    return rows.orderBy(key).limit(n // 4 if quarter else n)


def missing_assets(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected folders with no file in the listing; empty means the dataset is complete."""
    return expected.join(listing.select("dataset", "rel_dir").distinct(), ["dataset", "rel_dir"], "left_anti")


def rejected_pairs(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Pairs naming a file that does not exist, with the first missing side.

    `manifest` holds (pair_id, img_a, img_b); `listing` holds path. The paths of a manifest
    may repeat without bound, so the listing is joined with a salt.
    """
    paths = listing.select("path").distinct()
    a = salted_join(manifest, paths.selectExpr("path as img_a", "true as _a"), ["img_a"], ["pair_id"], "left")
    b = salted_join(a, paths.selectExpr("path as img_b", "true as _b"), ["img_b"], ["pair_id"], "left")
    return b.where("_a is null or _b is null").selectExpr(
        "pair_id", "img_a", "img_b", "if(_a is null, 'img_a', 'img_b') as missing"
    )
