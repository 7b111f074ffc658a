"""Exact top-k inner products by block-at-a-time pruning.

Rows are laid out in blocks of neighbouring rows, each with the largest and least value of every
dimension and its rows as a dense forward index. A query's bound for a block is the sum over
dimensions of the better of its products with the two extremes. Blocks are visited in order of
that bound; once it falls below the k-th score so far, no later block can hold an answer.

Blocks are gathered into groups, and queries travel to groups in chunks: first each query to the
group with its best bound, which gives it a k-th score to beat, then to those other groups whose
bound reaches that score. Chunks of queries against groups of blocks are the unit of work; no
task holds all queries or all rows, and only k results per query and group are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegrid.plans.lineage import cut

BLOCK_ROWS = 128
GROUP_ROWS = 1024
MAX_GROUPS = 4096
QUERY_CHUNK = 1024


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as doubles; rows that are null, or hold a null
    or non-finite component, or are empty, are left out."""
    whole = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    return vectors.where(whole).where("vec_id is not null").select("vec_id", F.expr(f"transform(embedding, x -> double(floor({scale} * double(x))))").alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    lengths = batch.column("v").value_lengths().to_numpy()
    for n in np.unique(lengths).tolist():
        yield n, batch.filter(pa.array(lengths == n))


def _grouped(rows: DataFrame) -> DataFrame:
    """rows with `group`: rows share their length, largest component and its sign, so that bounds are
    tight; crowded groups are dealt out by vec_id. There are at most about MAX_GROUPS groups: beyond that
    groups grow, so the table of group bounds stays bounded."""
    n = rows.count()
    per_group = max(GROUP_ROWS, -(-n // MAX_GROUPS))
    size = "transform(v, x -> abs(x))"
    kinds = rows.selectExpr("*", f"int(array_position({size}, array_max({size}))) - 1 as _at").selectExpr("*", "size(v) * (size(v) - 1L) + 2 * _at + int(v[_at] < 0) as _kind")
    parts = kinds.groupBy("_kind").agg(F.count("*").alias("_n")).selectExpr("_kind as _k", f"int(ceil(_n / {per_group})) as _parts")
    return kinds.join(parts, F.col("_kind") == F.col("_k")).selectExpr("vec_id", "v", "_kind * 100000L + pmod(xxhash64(vec_id), _parts) as group")


def _extremes(grouped: DataFrame) -> list:
    """Largest and least value of each dimension per group; as many rows as there are groups."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for _, batch in (part for whole in batches for part in _by_length(whole)):
            of, x = batch.column("group").to_numpy(), _matrix(batch.column("v"))
            for g in np.unique(of).tolist():
                top, low = x[of == g].max(0), x[of == g].min(0)
                best[g] = (np.maximum(best[g][0], top), np.minimum(best[g][1], low)) if g in best else (top, low)
        yield pa.RecordBatch.from_arrays([pa.array([*best], pa.int64()), pa.array([v[0] for v in best.values()], pa.list_(pa.float64())), pa.array([v[1] for v in best.values()], pa.list_(pa.float64()))], ["group", "top", "low"])

    partial = grouped.mapInArrow(fold, "group long, top array<double>, low array<double>")
    each = partial.selectExpr("group", "posexplode(arrays_zip(top, low)) as (d, x)").groupBy("group", "d").agg(F.max("x.top").alias("top"), F.min("x.low").alias("low"))
    sorted_list = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("d", c))), lambda s: s[c]).alias(c)
    return each.groupBy("group").agg(sorted_list("top"), sorted_list("low")).collect()


def _route(queries: DataFrame, extremes: list, home: bool) -> DataFrame:
    """(query_id, v, chunk, floor, _group): to the group of best bound, or to all others whose bound reaches `floor`."""
    table = {}
    for n in {len(r["top"]) for r in extremes}:
        alike = [r for r in extremes if len(r["top"]) == n]
        table[n] = np.array([r["group"] for r in alike], np.int64), np.array([r["top"] for r in alike]), np.array([r["low"] for r in alike])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in (part for whole in batches for part in _by_length(whole)):
            groups, top, low = table[n]
            q = _matrix(batch.column("v"))
            bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
            best = bounds.argmax(1)
            if home:
                row, group = np.arange(len(q)), best
            else:
                wanted = bounds >= batch.column("floor").to_numpy()[:, None]
                wanted[np.arange(len(q)), best] = False
                row, group = np.nonzero(wanted)
            sent = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(groups[group])], [*sent.schema.names, "_group"])

    return queries.select("query_id", "v", "chunk", "floor").mapInArrow(run, "query_id long, v array<double>, chunk int, floor double, _group long")


def _visit(routed: DataFrame, grouped: DataFrame, k: int) -> DataFrame:
    """Best k rows per query and group, a chunk of queries and a group at a time."""
    met = routed.selectExpr("_group as _met", "chunk as _chunk").distinct()
    rows = grouped.join(met, F.col("group") == F.col("_met")).select("vec_id", "v", "group", "_chunk")
    return routed.groupBy("_group", "chunk").cogroup(rows.groupBy("group", "_chunk")).applyInArrow(_search(k), "query_id long, vec_id long, score long")


def _search(k: int):
    """Arrow cogroup function: queries of a chunk against the rows of one group part."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if not queries.num_rows or not rows.num_rows:
            return pa.table(empty)
        q = _matrix(queries["v"].combine_chunks())
        ids, x = rows["vec_id"].to_numpy(), _matrix(rows["v"].combine_chunks())
        order = np.lexsort((x[:, 0], np.argmax(np.abs(x), axis=1), np.sign(x[np.arange(len(x)), np.argmax(np.abs(x), axis=1)])))
        ids, x = ids[order], x[order]
        cuts = range(0, len(x), BLOCK_ROWS)
        top = np.stack([x[i : i + BLOCK_ROWS].max(0) for i in cuts])
        low = np.stack([x[i : i + BLOCK_ROWS].min(0) for i in cuts])
        bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
        floors = queries["floor"].to_numpy()
        out = []
        for i, query_id in enumerate(queries["query_id"].to_numpy()):
            best_scores, best_ids, kth = np.zeros(0), np.zeros(0, np.int64), floors[i]
            for b in np.argsort(-bounds[i], kind="stable"):
                if bounds[i, b] < kth:
                    break
                at = slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS)
                scores = x[at] @ q[i]
                good = (scores >= kth) & (ids[at] != query_id)
                best_scores, best_ids = np.append(best_scores, scores[good]), np.append(best_ids, ids[at][good])
                if len(best_scores) > k:
                    keep = np.lexsort((best_ids, -best_scores))[:k]
                    best_scores, best_ids = best_scores[keep], best_ids[keep]
                if len(best_scores) == k:
                    kth = max(kth, best_scores.min())
            out.append((np.full(len(best_ids), query_id), best_ids, best_scores.astype(np.int64)))
        q_ids, v_ids, scores = (np.concatenate([o[c] for o in out]) for c in range(3))
        return pa.table({"query_id": q_ids, "vec_id": v_ids, "score": scores})

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row.

    `is_query` is a SQL condition over vec_id. Scores are integer inner products of the quantised
    vectors; ties go to the smaller vec_id. A row never answers a query of its own vec_id;
    unequal query rows of one vec_id count as the least of their vectors. Rows
    with a null vec_id, a null vector, or null or non-finite components take no part; repeated
    rows answer as often as they come; an empty table gives no rows; fewer candidates than k give
    all. Vectors of unlike lengths have no inner product and never meet.
    """
    rows = cut(quantised(vectors, scale))
    grouped = cut(_grouped(rows))
    extremes = _extremes(grouped)
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    chunks = max(1, -(-asked.count() // QUERY_CHUNK))
    queries = cut(asked.selectExpr("*", f"int(pmod(xxhash64(query_id, 1), {chunks})) as chunk"))
    if not extremes:
        return queries.selectExpr("query_id", "0 as rank", "query_id as vec_id", "0L as score").where("false")
    first = cut(_visit(_route(queries.withColumn("floor", F.lit(float("-inf"))), extremes, True), grouped, k))
    kth = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(f"n = {k}").select("query_id", "least")
    known = queries.join(kth, "query_id", "left").withColumn("floor", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))
    second = _visit(_route(known, extremes, False), grouped, k)
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
