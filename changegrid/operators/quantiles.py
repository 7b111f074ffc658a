"""Exact per-group quantiles that never hold a group in one task.

Spark's `percentile` keeps every distinct value of a group in one aggregation buffer, which
a scene with a third of all pixels would blow up. Here a mergeable sketch first brackets
each wanted rank; a second pass counts what lies below the bracket (map-side combined to one
row per partition) and keeps only the distinct values inside it; ranks are then resolved
exactly on that sliver. The result equals linear-interpolated `percentile`.

The sketch and the result hold one row per group. Both are written to the shared folder, so
the optimiser knows their true size when they are joined back to the big table: it broadcasts
them while they are small and falls back to the salted shuffle join when they are not. The
input is read twice and should be a stored table or a plain scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from changegrid.functions.expr import num
from changegrid.plans.joins import salted_join
from changegrid.plans.lineage import cut

ACCURACY = 20_000


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    spread: Sequence[str],
    accuracy: int = ACCURACY,
    packed: bool = False,
) -> DataFrame:
    """One row per group: keys, one exact quantile column per name, and the maximum `vmax`.

    `packed` says that `value` is an array of values; the bracket is then joined to the packed
    rows, before they are unpacked.
    """
    keys = list(keys)
    flat = df.selectExpr(*keys, f"explode({value}) as {value}") if packed else df
    by = ", ".join(keys)
    # Two brackets per rank, (margin, smallest group it is safe for): a margin must cover the
    # sketch error and a few ranks. Groups too small for both keep all their values.
    tiers = ((5.0 / accuracy, int(0.6 * accuracy)), (0.01, 300)) if accuracy >= 1000 else ((0.01, 300),)
    edges = [num(x) for p in probs for m, _ in tiers for x in (max(0.0, p - m), min(1.0, p + m))]
    sketch = flat.groupBy(*keys).agg(
        *_exprs(
            f"count({value}) as _n",
            f"min({value}) as _min",
            f"max({value}) as _max",
            f"percentile_approx({value}, array({', '.join(edges)}), {accuracy}) as _e",
        )
    )
    marks = []
    for i, p in enumerate(probs):
        lo, hi = [], []
        for k, (m, least) in enumerate(tiers):
            at = 2 * (i * len(tiers) + k)
            lo.append(f"when _n >= {least} then {'_min' if p - m <= 0 else f'_e[{at}]'}")
            hi.append(f"when _n >= {least} then {'_max' if p + m >= 1 else f'_e[{at + 1}]'}")
        bracket = f"case {' '.join(lo)} else _min end as lo, case {' '.join(hi)} else _max end as hi"
        marks.append(f"struct({i} as i, {num(p)} * (_n - 1) as pos, {bracket})")
    sketch = cut(sketch.selectExpr(*keys, "_min", "_max", f"array({', '.join(marks)}) as _marks"))

    slim = df.where(f"{value} is not null").select(*dict.fromkeys([*keys, *spread, value]))

    def resolve(brackets: DataFrame) -> DataFrame:
        """(keys, _max, _i, _q): the quantile inside each bracket, null where its rank lies outside."""
        joined = salted_join(slim, brackets, keys, spread)
        if packed:
            joined = joined.selectExpr(*keys, "_max", "_marks", f"explode({value}) as {value}").where(f"{value} is not null")
        counted = (
            joined.selectExpr(*keys, "_max", f"{value} as _v", "explode(_marks) as _m")
            .where("_v <= _m.hi")
            .selectExpr(*keys, "_max", "_m.i as _i", "_m.pos as _pos", "if(_v >= _m.lo, _v, null) as _v")
            .groupBy(*keys, "_max", "_i", "_pos", "_v")
            .agg(*_exprs("count(1) as _c"))
        )
        ranked = counted.repartition(*keys).selectExpr(
            "*", f"sum(_c) over (partition by {by}, _i order by _v asc nulls first rows unbounded preceding) as _cum"
        )
        picked = ranked.groupBy(*keys, "_max", "_i", "_pos").agg(
            *_exprs(
                "min(if(_v is not null and _cum > floor(_pos), _v, null)) as _lo",
                "min(if(_v is not null and _cum > ceil(_pos), _v, null)) as _hi",
                "coalesce(sum(if(_v is null, _c, 0)), 0) as _below",
            )
        )
        missed = "_below > floor(_pos) or _lo is null or _hi is null"
        return picked.selectExpr(*keys, "_max", "_i", f"if({missed}, null, _lo + (_hi - _lo) * (_pos - floor(_pos))) as _q")

    found = cut(resolve(sketch))
    open_ = found.where("_q is null").select(*keys, "_i")
    if not open_.isEmpty():  # a sketch that erred: those groups are ranked over all their values
        wide = "transform(_marks, m -> struct(m.i as i, m.pos as pos, _min as lo, _max as hi))"
        again = resolve(sketch.join(open_.select(*keys).distinct(), keys, "left_semi").selectExpr(*keys, "_min", "_max", f"{wide} as _marks"))
        found = found.where("_q is not null").unionByName(again.join(open_, [*keys, "_i"], "left_semi"))
    return cut(
        found.groupBy(*keys).agg(*_exprs(*[f"max(if(_i = {i}, _q, null)) as {n}" for i, n in enumerate(names)], "max(_max) as vmax"))
    )


def _exprs(*texts: str):
    from pyspark.sql.functions import expr

    return [expr(t) for t in texts]
