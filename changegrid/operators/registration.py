"""Image registration over many pairs: matching, homography, quality gate, warping."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import expr

from changegrid.functions import expr as X
from changegrid.plans.groups import dealt, map_each_group
from changegrid.plans.joins import salted_join
from changegrid.plans.lineage import cut

# Limits of matching.
MIN_MATCHES = 10
MIN_KEYPOINTS = 4
RATIO = 0.75
CHUNK = 2048


# --- matching -------------------------------------------------------------------------------

def _two_nearest(metric: str):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["pair_id", "kp_id", "t_id", "dist"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=cols)
        a, b = np.stack(left["vec"]), np.stack(right["t_vec"])
        dist = np.zeros((len(a), len(b)))
        for k in range(a.shape[1]):  # one dimension at a time keeps the exact differences
            if metric == "hamming":
                dist += np.bitwise_count(a[:, k, None].astype(np.uint64) ^ b[None, :, k].astype(np.uint64))
            else:
                dist += (a[:, k, None] - b[None, :, k]) ** 2
        if metric != "hamming":
            dist = np.sqrt(dist)
        ids = right["t_id"].to_numpy()
        best = np.lexsort((np.broadcast_to(ids, dist.shape), dist), axis=1)[:, :2]
        rows = np.repeat(np.arange(len(a)), best.shape[1])
        return pd.DataFrame(
            {
                "pair_id": left["pair_id"].iloc[0],
                "kp_id": left["kp_id"].to_numpy()[rows],
                "t_id": ids[best.ravel()],
                "dist": dist[rows, best.ravel()],
            }
        )

    return run


def knn2(descriptors: DataFrame, metric: str = "l2", chunk: int = CHUNK) -> DataFrame:
    """Two nearest B descriptors per A descriptor, exact: (pair_id, kp_id, t_id, dist, rank).

    Both sides of a pair are cut into chunks of about `chunk` key points and every chunk pair
    is one task that returns two rows per query, so a pair with many key points spreads over
    many tasks and the distance matrix is never emitted.
    """
    sizes = descriptors.groupBy("pair_id", "side").agg(expr(f"1 + (count(1) - 1) div {chunk} as n"))
    sizes = sizes.groupBy("pair_id").agg(
        expr("max(if(side = 'A', n, null)) as _na"), expr("max(if(side = 'B', n, null)) as _nb")
    ).where("_na is not null and _nb is not null")
    d = salted_join(descriptors, sizes, ["pair_id"], ["kp_id"]).selectExpr("*", "int(pmod(xxhash64(kp_id), if(side = 'A', _na, _nb))) as _own")
    a = d.where("side = 'A'").selectExpr("pair_id", "kp_id", "vec", "_own as _ca", "explode(sequence(0, int(_nb) - 1)) as _cb")
    b = d.where("side = 'B'").selectExpr(
        "pair_id as _bp", "kp_id as t_id", "vec as t_vec", "explode(sequence(0, int(_na) - 1)) as _bca", "_own as _bcb"
    )
    pair_type = descriptors.schema["pair_id"].dataType.simpleString()
    local = a.groupBy("pair_id", "_ca", "_cb").cogroup(b.groupBy("_bp", "_bca", "_bcb")).applyInPandas(
        _two_nearest(metric), f"pair_id {pair_type}, kp_id bigint, t_id bigint, dist double"
    )
    return local.selectExpr(
        "*", "row_number() over (partition by pair_id, kp_id order by dist, t_id) as rank"
    ).where("rank <= 2")


def ratio_matches(nearest: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Queries whose best neighbour is clearly closer than the second; both must exist."""
    return (
        nearest.groupBy("pair_id", "kp_id")
        .agg(
            expr("max(if(rank = 1, t_id, null)) as t_id"),
            expr("max(if(rank = 1, dist, null)) as d1"),
            expr("max(if(rank = 2, dist, null)) as d2"),
        )
        .where(f"d1 < {ratio}D * d2")
    )


def detector_counts(descriptors: DataFrame, metric: str = "l2") -> DataFrame:
    """Key points per side and good matches per pair, for one detector."""
    kp = descriptors.groupBy("pair_id").agg(expr("count_if(side = 'A') as kp_a"), expr("count_if(side = 'B') as kp_b"))
    good = ratio_matches(knn2(descriptors, metric)).groupBy("pair_id").agg(expr("count(1) as good"))
    return kp.join(good, "pair_id", "left").selectExpr("pair_id", "kp_a", "kp_b", "coalesce(good, 0) as good")


def pair_match_status(primary: DataFrame, fallback: DataFrame, metric: str = "l2", fallback_metric: str = "l2") -> DataFrame:
    """Which detector carries a pair: the first with enough key points and good matches."""
    enough = f"{{0}}kp_a >= {MIN_KEYPOINTS} and {{0}}kp_b >= {MIN_KEYPOINTS} and {{0}}good >= {MIN_MATCHES}"
    p = detector_counts(primary, metric)
    f = detector_counts(fallback, fallback_metric).selectExpr("pair_id", "kp_a as f_kp_a", "kp_b as f_kp_b", "good as f_good")
    return p.join(f, "pair_id", "full_outer").selectExpr(
        "pair_id",
        "coalesce(good, 0) as primary_matches",
        "coalesce(f_good, 0) as fallback_matches",
        f"case when {enough.format('')} then 'primary' when {enough.format('f_')} then 'fallback' else 'failed' end as status",
    )


# --- homography -----------------------------------------------------------------------------

# Stands for the zero denominator of a point on the horizon: it lands far away, on the edge.
ON_HORIZON = 1e-12


def apply_h(h: str, x: str, y: str) -> tuple[str, str]:
    """Projective map of (x, y) by a row-major array of nine."""
    w = f"coalesce(nullif({h}[6] * {x} + {h}[7] * {y} + {h}[8], 0D), {ON_HORIZON}D)"
    return f"(({h}[0] * {x} + {h}[1] * {y} + {h}[2]) / {w})", f"(({h}[3] * {x} + {h}[4] * {y} + {h}[5]) / {w})"


def det3(h: str) -> str:
    return (
        f"({h}[0] * ({h}[4] * {h}[8] - {h}[5] * {h}[7]) - {h}[1] * ({h}[3] * {h}[8] - {h}[5] * {h}[6])"
        f" + {h}[2] * ({h}[3] * {h}[7] - {h}[4] * {h}[6]))"
    )


def inverse3(h: str) -> str:
    """Adjugate: the inverse up to scale, which a projective map does not see."""
    m = lambda a, b, c, d: f"{h}[{a}] * {h}[{b}] - {h}[{c}] * {h}[{d}]"
    cells = [m(4, 8, 5, 7), m(2, 7, 1, 8), m(1, 5, 2, 4), m(5, 6, 3, 8), m(0, 8, 2, 6), m(2, 3, 0, 5), m(3, 7, 4, 6), m(1, 6, 0, 7), m(0, 4, 1, 3)]
    return f"array({', '.join(cells)})"


def _equations(xb, yb, xa, ya):
    """Rows of the direct linear transform, two per match: A h = 0."""
    one, zero = np.ones_like(xb), np.zeros_like(xb)
    first = np.stack([xb, yb, one, zero, zero, zero, -xa * xb, -xa * yb, -xa], -1)
    second = np.stack([zero, zero, zero, xb, yb, one, -ya * xb, -ya * yb, -ya], -1)
    return np.concatenate([first, second], -2)


def _project(h, x, y):
    w = h[..., 6, None] * x + h[..., 7, None] * y + h[..., 8, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return (h[..., 0, None] * x + h[..., 1, None] * y + h[..., 2, None]) / w, (h[..., 3, None] * x + h[..., 4, None] * y + h[..., 5, None]) / w


def _fits_of_four(xb, yb, xa, ya):
    """Matrices from samples of four matches each, and the samples that gave one."""
    a = _equations(xb, yb, xa, ya)
    left, right = a[..., :8], -a[..., 8]
    size = np.maximum(np.abs(left).max(1, keepdims=True), 1e-12) if len(left) else np.ones((0, 1, 8))
    left = left / size
    sound = np.abs(np.linalg.det(left)) > 1e-12  # collinear samples say nothing
    h = np.linalg.solve(left[sound], right[sound][..., None])[..., 0] / size[sound][:, 0]
    h = np.concatenate([h, np.ones((len(h), 1))], 1)
    finite = np.isfinite(h).all(1)
    return h[finite], np.flatnonzero(sound)[finite]


def _minimal_fits(batches):
    """Candidate matrices from samples of four matches each (columns xb, yb, xa, ya are arrays of four)."""
    for batch in batches:
        h, rows = _fits_of_four(*(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4) for c in ("xb", "yb", "xa", "ya")))
        picked = batch.select(["pair_id", "_t"]).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(list(h), pa.list_(pa.float64()))], ["pair_id", "_t", "h"])


# Limits of the search.
MAX_TRIALS, CONFIDENCE = 2000, 0.995
FIRST_TRIALS = 64


def _numbered(matches: DataFrame, cols: list[str]) -> DataFrame:
    """matches with `_i`, 0 .. n-1 within the pair. Hash bins are counted first, so a pair of any
    size is numbered in many tasks."""
    binned = matches.select(*cols).selectExpr("*", "xxhash64(match_id) as _key").selectExpr("*", "int(shiftrightunsigned(_key, 54)) as _bin")
    counts = binned.groupBy("pair_id", "_bin").agg(expr("count(1) as _n"))
    before = counts.selectExpr("pair_id", "_bin", "sum(_n) over (partition by pair_id order by _bin) - _n as _before")
    placed = binned.join(before, ["pair_id", "_bin"])
    return placed.selectExpr(*cols, "int(_before + row_number() over (partition by pair_id, _bin order by _key, match_id) - 1) as _i")


def _samples(numbered: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair_id, _t, h): matrices for trials _from .. _to - 1 of each pair of `wanted` (pair_id, n, _from, _to).

    A trial draws four numbers over all matches of its pair; draws that repeat a match are void.
    """
    pair_type = numbered.schema["pair_id"].dataType.simpleString()
    draws = dealt(wanted, "pair_id").where("n >= 4 and _to > _from").selectExpr("pair_id", "n", "explode(sequence(_from, _to - 1)) as _t").selectExpr(
        "pair_id", "_t", "explode(transform(sequence(0, 3), k -> struct(k, int(pmod(xxhash64(pair_id, _t, k), n)) as _i))) as d"
    ).selectExpr("pair_id", "_t", "d.k as _k", "d._i as _i")
    # The optimiser does not see what an explode adds; at its estimate it would broadcast the draws.
    points = draws.hint("merge").join(numbered, ["pair_id", "_i"]).groupBy("pair_id", "_t").agg(
        expr("array_sort(collect_list(struct(_k, _i, x_b, y_b, x_a, y_a))) as p")
    ).where("size(array_distinct(transform(p, q -> q._i))) = 4")
    four = points.selectExpr("pair_id", "_t", *[f"transform(p, q -> q.{c}) as {c.replace('_', '')}" for c in ("x_b", "y_b", "x_a", "y_a")])
    return four.mapInArrow(_minimal_fits, f"pair_id {pair_type}, _t int, h array<double>")


def _hash_int(value, seed):
    """xxhash64 of 32-bit integers as Spark computes it, on arrays; `seed` is the hash of what comes before."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    u = np.uint64
    x = (seed + p5 + u(4)) ^ (value.astype(u) * p1)
    x = ((x << u(23)) | (x >> u(41))) * p2 + p3
    x = (x ^ (x >> u(33))) * p2
    x = (x ^ (x >> u(29))) * p3
    return x ^ (x >> u(32))


def _draws(seed: int, n: int, first: int, end: int) -> np.ndarray:
    """The draws of `_samples` for trials first .. end - 1, four distinct numbers below n a row; `seed` is xxhash64(pair_id)."""
    start = np.full((1, 1), seed, np.int64).view(np.uint64)
    d = _hash_int(np.arange(4)[None], _hash_int(np.arange(first, end)[:, None], start)).view(np.int64) % n
    return d[(np.diff(np.sort(d, 1)) > 0).all(1)]


def _near(h, xb, yb, xa, ya, threshold):
    px, py = _project(h, xb, yb)
    return np.hypot(px - xa, py - ya) < threshold


# A vote holds this many distances at once; more fall out of a core's cache.
VOTES_AT_ONCE = 1 << 14


def _search(seed: int, points: tuple, threshold: float, trials: int) -> tuple[np.ndarray, int] | None:
    """The best matrix of one pair: both rounds of `fit_homography` with its draws, votes and ties."""
    n, best = len(points[0]), None
    first, end = 0, min(trials, FIRST_TRIALS)
    for _ in range(2):
        d = _draws(seed, n, first, end) if n >= 4 and end > first else np.empty((0, 4), int)
        h = _fits_of_four(*(v[d] for v in points))[0] + 0.0
        if len(h):
            step = max(1, VOTES_AT_ONCE // n)
            votes = np.concatenate([_near(h[k : k + step], *points, threshold).sum(1) for k in range(0, len(h), step)])
            # As in the grouped form, votes of equal matrices add up.
            _, at, same = np.unique(np.ascontiguousarray(h).view("V72").ravel(), return_index=True, return_inverse=True)
            total = np.bincount(same, votes).astype(int)
            most = int(total.max())
            top = most, max(h[at[total == most]].tolist())
            best = top if best is None else max(best, top)
        first, end = FIRST_TRIALS, _trials_needed(best[0] if best else 0, n, trials)
    return best and (np.array(best[1]), best[0])


def _trials_needed(most: int, n: int, trials: int) -> int:
    """Trials after which a clean sample is nearly certain, if a share of most / n are inliers."""
    clean = (most / n) ** 4
    if clean >= 1:
        return 0
    return trials if clean < 1e-6 else min(trials, math.ceil(math.log(round(1 - CONFIDENCE, 6)) / math.log(1 - clean)))


def fit_homography(matches: DataFrame, threshold: float = 3.0, trials: int = MAX_TRIALS, chunk: int = 4096) -> DataFrame:
    """Robust B -> A homography per pair: (pair_id, h, n_matches, n_inliers).

    Samples are drawn over all matches of a pair. After a first round, a pair goes on until its
    best inlier share makes a clean sample nearly certain, up to `trials`. All matches vote in
    chunks, and the winner is refitted on all its inliers through summed normal equations. So no
    match is left out of the draws, the vote or the fit, and no task holds more than a chunk of a
    pair. A pair of one chunk is searched where its matches are: its draws and matrices, many times
    its matches, never leave the task. `h` is NULL for a pair without any hypothesis.
    """
    pair_type = matches.schema["pair_id"].dataType.simpleString()
    cols = ["pair_id", "match_id", "x_b", "y_b", "x_a", "y_a"]
    sizes = matches.groupBy("pair_id").agg(expr("count(1) as n"))
    sizes = cut(sizes.selectExpr("pair_id", "n as n_matches", f"int(1 + (n - 1) div {chunk}) as _n"))
    sized = salted_join(matches.select(*cols), sizes.drop("n_matches"), ["pair_id"], ["match_id"])
    won = _fit_whole(sized.where("_n = 1"), threshold, trials)
    if not sizes.where("_n > 1").isEmpty():
        won = won.unionByName(_fit_chunked(sized.where("_n > 1"), sizes.where("_n > 1"), threshold, trials))

    def solve(batches):
        for pdf in batches:
            out = []
            for s, h0 in zip(pdf["s"], pdf["_h0"]):
                _, v = np.linalg.eigh(np.asarray(s).reshape(9, 9))
                h = v[:, 0]
                h = np.asarray(h0) if abs(h[8]) < 1e-12 else h / h[8] * _UNSCALE
                out.append(h.tolist())
            yield pdf.assign(h=out)[["pair_id", "h", "n_inliers"]]

    fitted = won.mapInPandas(solve, f"pair_id {pair_type}, h array<double>, n_inliers bigint")
    return sizes.join(fitted, "pair_id", "left").selectExpr("pair_id", "h", "n_matches", "coalesce(n_inliers, 0) as n_inliers")


def _normal_sums(xb, yb, xa, ya):
    """Normal equations of matches, flat. Coordinates are scaled by a fixed factor to keep the sums well conditioned."""
    a = _equations(xb / _SCALE, yb / _SCALE, xa / _SCALE, ya / _SCALE)
    return (a.T @ a).ravel()


def _fit_whole(matches: DataFrame, threshold: float, trials: int) -> DataFrame:
    """(pair_id, _h0, s, n_inliers): winner and normal equations of pairs of one chunk, a group each."""
    pair_type = matches.schema["pair_id"].dataType.simpleString()
    # In the order of `_numbered`: by the unsigned hash.
    rows = matches.selectExpr("pair_id", "match_id", "xxhash64(match_id) ^ shiftleft(1L, 63) as _key", "xxhash64(pair_id) as _seed", "x_b", "y_b", "x_a", "y_a")

    def fit(pair):
        points = tuple(pair[c].astype(float) for c in ("x_b", "y_b", "x_a", "y_a"))
        found = _search(int(pair["_seed"][0]), points, threshold, trials)
        if not found:
            return []
        ok = _near(found[0], *points, threshold)
        return [(pair["pair_id"][0], found[0], _normal_sums(*(v[ok] for v in points)), int(ok.sum()))]

    return cut(map_each_group(rows, ["pair_id"], fit, f"pair_id {pair_type}, _h0 array<double>, s array<double>, n_inliers bigint", ["_key", "match_id"]))


def _fit_chunked(sized: DataFrame, sizes: DataFrame, threshold: float, trials: int) -> DataFrame:
    """`_fit_whole` for pairs of many chunks: draws, votes and sums are spread over tasks and joined."""
    pair_type = sized.schema["pair_id"].dataType.simpleString()
    cols = ["pair_id", "match_id", "x_b", "y_b", "x_a", "y_a"]
    chunked = sized.selectExpr(*cols, "int(pmod(xxhash64(match_id), _n)) as _c")
    numbered = cut(_numbered(sized, cols))
    key = pa.int32() if pair_type == "int" else pa.int64() if pair_type == "bigint" else pa.string()
    vote_schema = pa.schema([("pair_id", key), ("k", pa.int32()), ("h", pa.list_(pa.float64())), ("n", pa.int64())])
    sum_schema = pa.schema([("pair_id", key), ("s", pa.list_(pa.float64())), ("n", pa.int64())])

    def votes(ms: pa.Table, hs: pa.Table) -> pa.Table:
        h = np.empty((0, 9))
        if ms.num_rows and hs.num_rows:
            h = hs.column("hs").combine_chunks().flatten().to_numpy().reshape(-1, 9)
        if not len(h):
            return vote_schema.empty_table()
        xb, yb, xa, ya = (ms.column(c).to_numpy() for c in cols[2:])
        n = _near(h, xb, yb, xa, ya, threshold).sum(1)
        pairs = pa.concat_arrays([hs.column("_bp").combine_chunks()[:1]] * len(h))
        return pa.Table.from_arrays([pairs, pa.array(np.arange(len(h)), pa.int32()), pa.array(list(h), pa.list_(pa.float64())), pa.array(n, pa.int64())], schema=vote_schema)

    def tally(hyps: DataFrame) -> DataFrame:
        """Votes of all matches per hypothesis: (pair_id, n, h)."""
        grouped = hyps.groupBy("pair_id", expr("_t div 512 as _g")).agg(expr("flatten(transform(array_sort(collect_list(struct(_t, h))), x -> x.h)) as hs"))
        spread = grouped.join(sizes, "pair_id").selectExpr("pair_id as _bp", "_g as _bg", "hs", "explode(sequence(0, _n - 1)) as _bc")
        met = chunked.join(grouped.select("pair_id", "_g"), "pair_id")
        voted = met.groupBy("pair_id", "_g", "_c").cogroup(spread.groupBy("_bp", "_bg", "_bc")).applyInArrow(votes, f"pair_id {pair_type}, k int, h array<double>, n bigint")
        return voted.groupBy("pair_id", "h").agg(expr("sum(n) as n"))

    span = sizes.selectExpr("pair_id", "n_matches as n", "0 as _from", f"{min(trials, FIRST_TRIALS)} as _to")
    first = cut(tally(_samples(numbered, span)))
    share = first.groupBy("pair_id").agg(expr("max(n) as _most"))
    clean = "pow(coalesce(_most, 0) / n_matches, 4)"  # chance of a sample of four inliers
    needed = f"case when {clean} >= 1 then 0 when {clean} < 1e-6 then {trials} else least({trials}, ceil(ln({1 - CONFIDENCE:.6f}) / ln(1 - {clean}))) end"
    more = sizes.join(share, "pair_id", "left").selectExpr("pair_id", "n_matches as n", f"{FIRST_TRIALS} as _from", f"int({needed}) as _to")
    best = cut(first.unionByName(tally(_samples(numbered, more))).groupBy("pair_id").agg(expr("max_by(h, struct(n, h)) as _h0")))

    def normal(ms: pa.Table, hs: pa.Table) -> pa.Table:
        if not (ms.num_rows and hs.num_rows):
            return sum_schema.empty_table()
        h = hs.column("_h0").combine_chunks().flatten().to_numpy()[:9]
        xb, yb, xa, ya = (ms.column(c).to_numpy() for c in cols[2:])
        ok = _near(h, xb, yb, xa, ya, threshold)
        return pa.Table.from_arrays(
            [hs.column("_bp").combine_chunks()[:1], pa.array([_normal_sums(xb[ok], yb[ok], xa[ok], ya[ok])], pa.list_(pa.float64())), pa.array([int(ok.sum())], pa.int64())], schema=sum_schema
        )

    winners = best.join(sizes, "pair_id").selectExpr("pair_id as _bp", "_h0", "explode(sequence(0, _n - 1)) as _bc")
    sums = chunked.groupBy("pair_id", "_c").cogroup(winners.groupBy("_bp", "_bc")).applyInArrow(
        normal, f"pair_id {pair_type}, s array<double>, n bigint"
    )
    cells = ", ".join(f"sum(s[{i}])" for i in range(81))
    total = sums.groupBy("pair_id").agg(expr(f"array({cells}) as s"), expr("sum(n) as n_inliers"))
    return total.join(best, "pair_id").select("pair_id", "_h0", "s", "n_inliers")


_SCALE = 1000.0
_UNSCALE = np.array([1, 1, _SCALE, 1, 1, _SCALE, 1 / _SCALE, 1 / _SCALE, 1])


def reprojection_error(matches: DataFrame, homographies: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Inlier count and mean inlier error per pair; infinite without inliers or matrix."""
    j = salted_join(matches, homographies.select("pair_id", "h"), ["pair_id"], ["match_id"], "left")
    x, y = apply_h("h", "x_b", "y_b")
    err = f"hypot({x} - x_a, {y} - y_a)"
    return (
        j.selectExpr("pair_id", "h is not null as _has", f"{err} as _e")
        .groupBy("pair_id")
        .agg(expr(f"count_if(_e < {threshold}D) as n_inliers"), expr(f"coalesce(avg(if(_e < {threshold}D, _e, null)), double('infinity')) as error_px"))
    )


def registration_qc(results: DataFrame, max_error: float = 5.0, min_inliers: int = 10) -> DataFrame:
    """Accept or reject with a reason. `results` holds (pair_id, h, error_px, n_inliers).

    `valid` allows an error equal to the limit, `success` does not. A rejected pair reports
    infinite error and no inliers in the `out_` columns.
    """
    det = det3("h")
    reason = (
        f"case when h is null then 'no_homography' when error_px > {max_error}D then 'error' when n_inliers < {min_inliers} then 'inliers'"
        f" when abs({det}) < 0.1D or abs({det}) > 10D then 'degenerate' else 'ok' end"
    )
    return results.selectExpr("pair_id", "error_px", "n_inliers", f"{det} as det", f"{reason} as reason").selectExpr(
        "*", "reason = 'ok' as valid",
        "if(reason = 'ok', error_px, double('infinity')) as out_error_px", "if(reason = 'ok', n_inliers, 0) as out_inliers",
    ).selectExpr("*", f"out_error_px < {max_error}D and out_inliers >= {min_inliers} as success")


# --- warping --------------------------------------------------------------------------------

def warp_bilinear(target: DataFrame, source: DataFrame, registrations: DataFrame, meta: DataFrame) -> DataFrame:
    """Resample `source` (date B) onto the pixel grid of `target` (date A), in long layout.

    `registrations` holds (scene_id, h); NULL or absent keeps B as it is. Outside B the edge
    pixel is repeated. Null and missing pixels of B do not count: the other taps share their
    weight, and a pixel without any gives no row. Four equi-joined taps per output pixel, keyed by pixel, so one huge
    scene spreads like any other.
    """
    keys = ["scene_id", "band"]
    identity = "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D)"
    m = meta.select("scene_id", "height", "width").join(registrations.select("scene_id", "h"), "scene_id", "left")
    # Stored, so that the optimiser knows its size; else it may take the pixels for the smaller side and broadcast them.
    m = cut(m.selectExpr("scene_id", "height", "width", f"if(h is null, {identity}, {inverse3('h')}) as _g"))
    x, y = apply_h("_g", "col", "row")
    grid = (
        salted_join(target.select(*keys, "row", "col"), m, ["scene_id"], ["row", "col"])
        .selectExpr(*keys, "row", "col", f"least(greatest({x}, 0D), width - 1D) as _x", f"least(greatest({y}, 0D), height - 1D) as _y")
        .selectExpr("*", "int(floor(_x)) as _c", "int(floor(_y)) as _r")
    )
    fx, fy = "(_x - _c)", "(_y - _r)"
    taps = ", ".join(
        f"struct(_r + {dr} as r, _c + {dc} as c, {fy if dr else f'(1D - {fy})'} * {fx if dc else f'(1D - {fx})'} as w)" for dr in (0, 1) for dc in (0, 1)
    )
    probe = grid.selectExpr(*keys, "row", "col", f"explode(filter(array({taps}), k -> k.w > 0)) as _k").selectExpr(
        *keys, "row", "col", "_k.r as _sr", "_k.c as _sc", "_k.w as _w"
    )
    src = source.where("value is not null").selectExpr(*keys, "row as _sr", "col as _sc", "value as _v")
    # Pixels unpacked from blocks look as small as the blocks' files; they must not be broadcast.
    return probe.join(src.hint("merge"), [*keys, "_sr", "_sc"]).groupBy(*keys, "row", "col").agg(expr("sum(_w * _v) / sum(_w) as value"))


# Footprints of more source blocks than this are read tap by tap.
MOSAIC_BLOCKS = 16


def warp_blocks(
    targets: DataFrame,
    source: DataFrame,
    registrations: DataFrame,
    meta: DataFrame,
    block_h: int,
    block_w: int,
    mosaic_blocks: int = MOSAIC_BLOCKS,
) -> DataFrame:
    """`warp_bilinear` in block layout, the form for whole archives.

    An output block resamples from what `warp_requests` asks for: a mosaic of a few source blocks
    where its footprint is small, single taps elsewhere. So no group holds more than
    `mosaic_blocks` blocks per band, or four taps per pixel of its own, under any homography.
    `targets` lists (scene_id, block_row, block_col, h, w) of date A; `source` holds the blocks
    of date B with their bands. Null and missing source pixels do not count: the other taps share
    their weight, and a pixel without any is null.
    """
    keys = ["scene_id", "block_row", "block_col"]
    asks = warp_requests(targets, registrations, meta, block_h, block_w, mosaic_blocks)
    src = source.selectExpr("scene_id", "block_row as _sr", "block_col as _sc", "band", "h as _sh", "w as _sw", "data as _data")
    picked = "if(_pos is null, _data, transform(_pos, p -> _data[p]))"
    supply = asks.join(src, ["scene_id", "_sr", "_sc"]).withColumn("_data", expr(picked)).drop("_pos")
    types = source.schema["scene_id"].dataType.simpleString()

    def by_band(rows, *columns: str):
        for band in np.unique(rows["band"]):
            here = rows["band"] == band
            yield int(band), zip(*(rows[c][here] for c in columns))

    def from_taps(rows, n: int):
        for band, parts in by_band(rows, "_at", "_wt", "_data"):
            value, weight = np.zeros(n), np.zeros(n)
            for at, w, data in parts:
                data = np.asarray(data, float)
                seen = ~np.isnan(data)
                value += np.bincount(at[seen], w[seen] * data[seen], n)
                weight += np.bincount(at[seen], w[seen], n)
            yield band, np.divide(value, weight, out=np.full(n, np.nan), where=weight > 0)

    def from_mosaic(rows, one: dict):
        r_lo, c_lo = rows["_sr"].min() * block_h, rows["_sc"].min() * block_w
        r_hi = (rows["_sr"] * block_h + rows["_sh"]).max()
        c_hi = (rows["_sc"] * block_w + rows["_sw"]).max()
        # A tap without weight may lie past a missing block.
        taps = [
            (np.minimum(r, r_hi - 1) - r_lo, np.minimum(c, c_hi - 1) - c_lo, w) for r, c, w in _taps(one, block_h, block_w)
        ]
        for band, parts in by_band(rows, "_sr", "_sc", "_sh", "_sw", "_data"):
            mosaic = np.full((r_hi - r_lo, c_hi - c_lo), np.nan)
            for sr, sc, h, w, data in parts:
                r, c = sr * block_h - r_lo, sc * block_w - c_lo
                mosaic[r : r + h, c : c + w] = np.reshape(data, (h, w))
            value, weight = np.zeros(one["h"] * one["w"]), np.zeros(one["h"] * one["w"])
            for r, c, w in taps:
                data = mosaic[r, c]
                w = np.where(np.isnan(data), 0.0, w)
                value += np.where(w > 0, data, 0.0) * w
                weight += w
            yield band, np.divide(value, weight, out=np.full(len(value), np.nan), where=weight > 0)

    def resample(rows):
        one = {c: v[0] for c, v in rows.items()}
        found = from_mosaic(rows, one) if one["_at"] is None else from_taps(rows, one["h"] * one["w"])
        return ((*(one[k] for k in keys), band, one["h"], one["w"], data) for band, data in found)

    return map_each_group(
        supply, keys, resample, f"scene_id {types}, block_row int, block_col int, band int, h int, w int, data array<double>"
    ).withColumn("data", expr(X.nan_to_null("data")))


def warp_requests(
    targets: DataFrame, registrations: DataFrame, meta: DataFrame, block_h: int, block_w: int, mosaic_blocks: int = MOSAIC_BLOCKS
) -> DataFrame:
    """What each output block needs of each source block (_sr, _sc), a row per pair of blocks.

    The four mapped corners bound the footprint of a block that the map's horizon does not
    cross; if that is at most `mosaic_blocks` blocks, it asks for them whole. Any other block
    names its taps: positions in itself (_at) and in the source block (_pos) with weights (_wt),
    which are null in whole requests.
    """
    identity = "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D)"
    m = meta.select("scene_id", "height", "width").join(registrations.select("scene_id", "h"), "scene_id", "left")
    m = cut(m.selectExpr("scene_id", "height", "width", f"if(h is null, {identity}, {inverse3('h')}) as _g"))
    rest = ["scene_id", "block_row", "block_col", "h", "w", "height", "width", "_g"]
    t = salted_join(targets.select(*rest[:5]), m, ["scene_id"], ["block_row", "block_col"])
    top, left = f"block_row * {block_h}", f"block_col * {block_w}"
    corners = [(f"({left} + {dx})", f"({top} + {dy})") for dx in ("0", "w - 1") for dy in ("0", "h - 1")]
    mapped = [apply_h("_g", x, y) for x, y in corners]
    signs = [f"signum(_g[6] * {x} + _g[7] * {y} + _g[8])" for x, y in corners]

    def reach(values: list[str], side: str, block: int) -> tuple[str, str]:
        inside = [f"least(greatest({v}, 0D), {side} - 1D)" for v in values]
        return f"int(floor(least({', '.join(inside)})) div {block})", f"int(least(floor(greatest({', '.join(inside)})) + 1, {side} - 1) div {block})"

    (r0, r1), (c0, c1) = reach([v for _, v in mapped], "height", block_h), reach([u for u, _ in mapped], "width", block_w)
    t = t.selectExpr(*rest, f"abs({' + '.join(signs)}) = 4 as _one_side", f"{r0} as _r0", f"{r1} as _r1", f"{c0} as _c0", f"{c1} as _c1").selectExpr(
        "*", f"_one_side and bigint(_r1 - _r0 + 1) * (_c1 - _c0 + 1) <= {mosaic_blocks} as _near"
    )
    # Both kinds read the list of blocks: a row per block, stored once.
    t = cut(t)
    whole = t.where("_near").selectExpr(*rest, "_c0", "_c1", "explode(sequence(_r0, _r1)) as _sr").selectExpr(
        *rest, "_sr", "explode(sequence(_c0, _c1)) as _sc", "cast(null as array<int>) as _at", "cast(null as array<int>) as _pos", "cast(null as array<double>) as _wt"
    )
    far = t.where("not _near").select(*rest)

    def name_taps(batches):
        for pdf in batches:
            for _, one in pdf.iterrows():
                r, c, w = (np.concatenate(x) for x in zip(*_taps(one, block_h, block_w)))
                at = np.tile(np.arange(one["h"] * one["w"]), 4)
                r, c, w, at = (x[w > 0] for x in (r, c, w, at))
                sr, sc = r // block_h, c // block_w
                pos = (r - sr * block_h) * np.minimum(block_w, one["width"] - sc * block_w) + c - sc * block_w
                order = np.lexsort((sc, sr))
                cuts = np.flatnonzero(np.diff(sr[order]) | np.diff(sc[order])) + 1
                groups = np.split(order, cuts)
                yield pd.DataFrame(
                    {**{k: [one[k]] * len(groups) for k in rest}, "_sr": [sr[g[0]] for g in groups], "_sc": [sc[g[0]] for g in groups],
                     "_at": [at[g] for g in groups], "_pos": [pos[g] for g in groups], "_wt": [w[g] for g in groups]}
                )

    return whole.unionByName(far.mapInPandas(name_taps, whole.schema))


def _taps(one, block_h: int, block_w: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The four source pixels (row, column) of each pixel of an output block, with their weights."""
    y, x = np.mgrid[0 : one["h"], 0 : one["w"]]
    y, x = y.ravel() + one["block_row"] * block_h, x.ravel() + one["block_col"] * block_w
    g = np.asarray(one["_g"], float)
    w = g[6] * x + g[7] * y + g[8]
    w = np.where(w == 0, ON_HORIZON, w)
    sx = np.clip((g[0] * x + g[1] * y + g[2]) / w, 0, one["width"] - 1)
    sy = np.clip((g[3] * x + g[4] * y + g[5]) / w, 0, one["height"] - 1)
    c, r = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - c, sy - r
    c1, r1 = np.minimum(c + 1, one["width"] - 1), np.minimum(r + 1, one["height"] - 1)
    return [(r, c, (1 - fy) * (1 - fx)), (r, c1, (1 - fy) * fx), (r1, c, fy * (1 - fx)), (r1, c1, fy * fx)]
