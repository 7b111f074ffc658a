"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegrid.plans.lineage import cut


def _attach_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least node m among u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star over edges (u, v) with u > v."""
    both = edges.union(edges.selectExpr("v as u", "u as v"))
    large = _attach_least(both).where("v > u and v > m").selectExpr("v as u", "m as v").distinct()
    small = _attach_least(large)
    to_least = small.where("v > m").selectExpr("v as u", "m as v")
    return to_least.union(small.where("u > m").selectExpr("u", "m as v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) per node u that is not the least of its component, v being that least node.

    `edges` has long columns u and v in any direction, loops and repeats allowed; none may be
    null. Every round halves the height of the trees at least, nothing is collected but a count
    and a checksum, and each round's edges are written to the shared folder.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (digest := _digest(now)) != before:
        before = digest
        if digest[0] == 0:
            break
        now = cut(_step(now))
    return now
