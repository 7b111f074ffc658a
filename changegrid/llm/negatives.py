"""Hard negatives from an R-tree packed by sort-tile-recursive.

Rows of one label and length are packed together: cut into slabs of equal count by the first
coordinate and those by the second; a tile holds a few thousand rows and is cut by the same rule
into leaf boxes, by its coordinates of largest variance. The least and largest value of every coordinate in a box give an
interval for each term of an inner product, and their sums an interval for every score in the box.

A query first visits the tile of best bound, which gives it a k-th score. It then visits the other
tiles whose interval meets one of its score windows and does not lie strictly below that window's
k-th score. In a tile, leaf boxes leave a queue best bound first, under the same two tests.

Queries travel in chunks and meet tiles through the tiles' boxes, themselves held in blocks, so
that no task or driver holds all queries, all rows or all boxes. Score windows and k are all that
tells the search for positives (one open window, own label) from that for negatives (a window per
positive, other labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegrid.plans.joins import salted_join
from changegrid.plans.lineage import cut

TILE_ROWS, LEAF_ROWS = 4096, 32
QUERY_CHUNK, BOX_BLOCK = 1024, 256
TILED_BY, FINEST = 2, 128


def quantised(vectors: DataFrame, label: str, scale: int = 256, most: int = 8) -> DataFrame:
    """(vec_id, label, v): labelled rows with floor(scale * x) of every component as doubles.

    Rows with a null label or vec_id, a null or empty vector, or null or non-finite components are
    left out. Of rows equal in all three, `most` stay: no result asks for more.
    """
    whole = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = vectors.where(whole).where("vec_id is not null and label is not null").selectExpr(
        "vec_id", f"int({label}) as label", f"transform(embedding, x -> double(floor({scale} * double(x)))) as v"
    )
    return rows.groupBy("vec_id", "label", "v").agg(F.count("*").alias("n")).selectExpr("vec_id", "label", "v", f"explode(sequence(1, int(least(n, {most})))) as copy").drop("copy")


def packed(rows: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """rows with `size`, the length of v, and `tile`, a string that begins with label and size.

    Slab borders are approximate quantiles; they shape the boxes and decide no result. A tile that
    came out too large, through ties or beyond FINEST slabs a coordinate, is dealt out by a hash.
    """
    rows = rows.withColumn("size", F.size("v"))
    slabs = f"int(least({FINEST}, ceil(pow(ceil(n / {tile_rows}), 1.0 / {TILED_BY})))) as slabs"
    kinds = cut(rows.groupBy("label", "size").agg(F.count("*").alias("n")).selectExpr("label", "size", slabs))
    tiled = salted_join(rows, kinds, ["label", "size"], ["vec_id"]).withColumn("tile", F.concat_ws("/", "label", "size"))
    borders = [k / FINEST for k in range(1, FINEST)]
    for k in range(TILED_BY):
        x = F.get(F.col("v"), F.lit(k))
        cuts = cut(tiled.where("slabs > 1").groupBy("tile").agg(F.percentile_approx(x, borders, 10 * FINEST).alias("cuts")))
        below = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda b: b < x))
        slab = F.floor(below * F.col("slabs") / FINEST).cast("int").cast("string")
        tiled = salted_join(tiled, cuts, ["tile"], ["vec_id"], "left").withColumn("tile", F.concat_ws("/", "tile", slab)).drop("cuts")
    tiled = cut(tiled.select("vec_id", "label", "v", "size", "tile"))
    parts = cut(tiled.groupBy("tile").agg(F.count("*").alias("n")).selectExpr("tile", f"int(ceil(n / {tile_rows})) as parts"))
    dealt = salted_join(tiled, parts, ["tile"], ["vec_id"])
    return dealt.selectExpr("vec_id", "label", "v", "size", "concat_ws('/', tile, cast(pmod(xxhash64(vec_id, v), parts) as string)) as tile")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _padded(column, fill: float) -> np.ndarray:
    """A list column as a matrix; short rows end in `fill`."""
    rows = column.to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=0)), fill)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def boxes(rows: DataFrame) -> DataFrame:
    """(tile, label, size, low, top): the bounding box of each tile; a tile is one bounded group."""

    def run(tile: pa.Table) -> pa.Table:
        x = _matrix(tile["v"])
        first = tile.slice(0, 1).select(["tile", "label", "size"])
        return first.append_column("low", pa.array([x.min(0)], pa.list_(pa.float64()))).append_column("top", pa.array([x.max(0)], pa.list_(pa.float64())))

    return rows.groupBy("tile").applyInArrow(run, "tile string, label int, size int, low array<double>, top array<double>")


def _intervals(q: np.ndarray, low: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every query with any point of every box."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return plus @ low.T + minus @ top.T, plus @ top.T + minus @ low.T


def _alive(least: np.ndarray, most: np.ndarray, floor: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Queries x boxes: boxes that meet a score window and are not strictly below its k-th score."""
    alive = np.zeros(most.shape, bool)
    for w in range(hi.shape[1]):
        alive |= (most >= floor[:, w, None]) & (least <= hi[:, w, None])
    return alive


def _route(queries: DataFrame, tree: DataFrame, own: bool, home: bool) -> DataFrame:
    """(query_id, tile) to visit: the tile of best bound, or all others that windows and k-th scores leave.

    Chunks of queries meet blocks of boxes of their size, a pair a group; `own` keeps to tiles of
    the query's label, otherwise to those of other labels.
    """

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = {"query_id": pa.array([], pa.int64()), "tile": pa.array([], pa.string()), "bound": pa.array([], pa.float64())}
        if not asked.num_rows or not known.num_rows:
            return pa.table(out)
        least, most = _intervals(_matrix(asked["v"]), _matrix(known["low"]), _matrix(known["top"]))
        same = asked["label"].to_numpy()[:, None] == known["label"].to_numpy()[None, :]
        floor = np.maximum(_padded(asked["lo"], np.inf), _padded(asked["kth"], np.inf))
        alive = (same == own) & _alive(least, most, floor, _padded(asked["hi"], -np.inf))
        if home:
            best = np.where(alive, most, -np.inf).argmax(1)
            alive &= np.arange(alive.shape[1])[None, :] == best[:, None]
        row, box = np.nonzero(alive)
        return pa.table({"query_id": asked["query_id"].take(row), "tile": known["tile"].take(box), "bound": most[row, box]})

    asked = queries.withColumn("block", F.expr("explode(sequence(0, blocks - 1))"))
    known = tree.withColumn("chunk", F.expr("explode(sequence(0, chunks - 1))"))
    met = asked.groupBy("size", "chunk", "block").cogroup(known.groupBy("size", "chunk", "block")).applyInArrow(run, "query_id long, tile string, bound double")
    if home:
        return met.groupBy("query_id").agg(F.max_by("tile", F.struct("bound", "tile")).alias("tile"))
    return met.select("query_id", "tile")


def _leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows, first row of each leaf box) by sort-tile-recursive on the widest coordinates."""
    n = len(x)
    axes = np.argsort(-x.var(0), kind="stable")[:TILED_BY]
    slabs = max(1, int(np.ceil((n / LEAF_ROWS) ** (1 / len(axes)))))
    of = np.zeros(n, np.int64)
    for axis in axes:
        order = np.lexsort((x[:, axis], of))
        start = np.flatnonzero(np.diff(of[order], prepend=-1))
        size = np.diff(np.append(start, n))
        place = np.arange(n) - np.repeat(start, size)
        of[order] = of[order] * slabs + place * slabs // np.repeat(size, size)
    return np.argsort(of, kind="stable"), np.arange(0, n, LEAF_ROWS)


def _visit(pairs: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, slot, vec_id, score): best k rows per query, window and visited tile."""

    def run(asked: pa.Table, tile: pa.Table) -> pa.Table:
        if not asked.num_rows or not tile.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q, x, ids = _matrix(asked["v"]), _matrix(tile["v"]), tile["vec_id"].to_numpy()
        order, cuts = _leaves(x)
        x, ids = x[order], ids[order]
        least, most = _intervals(q, np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts))
        lo, hi, kth = (_padded(asked[c], fill) for c, fill in (("lo", np.inf), ("hi", -np.inf), ("kth", np.inf)))
        floor, out = np.maximum(lo, kth), []
        for i, query_id in enumerate(asked["query_id"].to_numpy()):
            queue, step = np.argsort(-most[i], kind="stable"), 16
            best = [(np.zeros(0), np.zeros(0, np.int64))] * lo.shape[1]
            while len(queue) and most[i, queue[0]] >= floor[i].min():
                taken, queue, step = queue[:step], queue[step:], 2 * step
                wanted = (most[i, taken, None] >= floor[i]) & (least[i, taken, None] <= hi[i])
                taken = np.sort(taken[wanted.any(1)])
                at = (cuts[taken, None] + np.arange(LEAF_ROWS)).ravel()
                at = at[at < len(x)]
                scores, others = x[at] @ q[i], ids[at] != query_id
                for w in np.flatnonzero(wanted.any(0)):
                    good = others & (scores >= floor[i, w]) & (scores <= hi[i, w])
                    if good.any():
                        s, v = np.append(best[w][0], scores[good]), np.append(best[w][1], ids[at][good])
                        top = np.lexsort((v, -s))[:k]
                        best[w] = s[top], v[top]
                        if len(top) == k:
                            floor[i, w] = max(floor[i, w], s[top[-1]])
            out += [(np.full(len(s), query_id), np.full(len(s), w, np.int32), v, s.astype(np.int64)) for w, (s, v) in enumerate(best)]
        return pa.table(dict(zip(("query_id", "slot", "vec_id", "score"), (np.concatenate([o[c] for o in out]) for c in range(4)))))

    sent = pairs.join(queries, "query_id").select("tile", "chunk", "query_id", "v", "lo", "hi", "kth")
    met = sent.selectExpr("tile as _tile", "chunk as _chunk").distinct()
    there = rows.join(met, F.col("tile") == F.col("_tile")).select("vec_id", "v", "_tile", "_chunk")
    return sent.groupBy("tile", "chunk").cogroup(there.groupBy("_tile", "_chunk")).applyInArrow(run, "query_id long, slot int, vec_id long, score long")


def _search(queries: DataFrame, rows: DataFrame, tree: DataFrame, k: int, own: bool) -> DataFrame:
    """(query_id, slot, rank, vec_id, score): the k best rows in each score window of each query.

    `queries` is (query_id, label, v, size, chunk, blocks, lo, hi), the last two being arrays with an entry per window.
    """
    rank = F.row_number().over(Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "vec_id"))
    open_ = cut(queries.withColumn("kth", F.transform("lo", lambda _: F.lit(float("-inf")))))
    home = cut(_route(open_, tree, own, True))
    first = cut(_visit(home, open_, rows, k))
    full = first.withColumn("rank", rank).where(f"rank = {k}").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("score").cast("double")))).alias("full"))
    kth = F.transform("kth", lambda x, i: F.coalesce(F.try_element_at("full", i), x))
    known = cut(open_.join(full, "query_id", "left").withColumn("kth", kth).drop("full"))
    rest = cut(_route(known, tree, own, False).join(home, ["query_id", "tile"], "left_anti"))
    found = first.unionByName(_visit(rest, known, rows, k))
    return found.withColumn("rank", rank).where(f"rank <= {k}")


def hard_negatives(
    vectors: DataFrame, is_anchor: str, label: str = "label", positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95,
    scale: int = 256, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best other rows of its label; its negatives for a positive are
    the best rows of other labels whose score lies between the two percentages of the positive's,
    borders included. Scores are integer inner products of the quantised vectors, exact below 2^53;
    ties go to the smaller vec_id. `is_anchor` is SQL over vec_id, `label` SQL over the row.

    Rows with a null vec_id, label or vector, or with null or non-finite components, take no part;
    vectors of unlike lengths have no inner product and never meet. A row never answers its own
    vec_id; unequal anchor rows of one vec_id count as the least (label, vector). Repeated rows
    answer as often as they come. A positive without negatives gives no row, nor does one with a
    negative score, whose window is empty. An empty table gives no rows; extra columns are not read.
    """
    whole = cut(quantised(vectors, label, scale, max(positives, negatives)))
    rows = cut(packed(whole, tile_rows))
    asked = whole.where(is_anchor).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "v")).alias("q"))
    asked = cut(asked.selectExpr("query_id", "q.*", "size(q.v) as size"))
    tree = cut(boxes(rows))
    chunks = asked.groupBy("size").agg(F.count("*").alias("n")).selectExpr("size", f"int(ceil(n / {QUERY_CHUNK})) as chunks")
    parts = cut(tree.groupBy("size").agg(F.count("*").alias("n")).selectExpr("size", f"int(ceil(n / {BOX_BLOCK})) as blocks").join(chunks, "size"))
    tree = cut(tree.join(parts, "size").withColumn("block", F.expr("int(pmod(xxhash64(tile), blocks))")))
    asked = cut(asked.join(parts, "size").withColumn("chunk", F.expr("int(pmod(xxhash64(query_id, 1), chunks))")))
    open_ended = asked.withColumn("lo", F.array(F.lit(float("-inf")))).withColumn("hi", F.array(F.lit(float("inf"))))
    liked = cut(_search(open_ended, rows, tree, positives, own=True).selectExpr("query_id", "rank - 1 as slot", "vec_id as positive_id", "score as positive_score"))
    each = F.array_sort(F.collect_list(F.struct("slot", F.col("positive_score").alias("s"))))
    windows = liked.groupBy("query_id").agg(each.alias("w")).selectExpr(
        "query_id", f"transform(w, x -> double(ceil({least_percent} * x.s / 100))) as lo", f"transform(w, x -> double(floor({most_percent} * x.s / 100))) as hi"
    )
    found = _search(asked.join(windows, "query_id"), rows, tree, negatives, own=False)
    return found.join(liked, ["query_id", "slot"]).selectExpr(
        "query_id as anchor_id", "positive_id", "rank", "vec_id as negative_id", "positive_score", "score as negative_score"
    )
