"""Hard negatives against brute force, boxes and tiles included."""

import numpy as np
import pytest

from changegrid.llm import negatives


def _brute(rows, ids_are_anchors=50):
    """rows: (vec_id, label, floats) that take part."""
    quant = [(i, lab, np.floor(256 * np.array(np.float32(v), np.float64)).astype(int)) for i, lab, v in rows]
    out, done = [], set()
    for i, lab, q in sorted(quant, key=lambda r: (r[0], r[1], r[2].tolist())):
        if i % ids_are_anchors or i in done:
            continue
        done.add(i)
        scored = [(-int(q @ v), j, m) for j, m, v in quant if j != i and len(v) == len(q)]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:5]:
            pos = -s
            good = sorted(x for x in scored if x[2] != lab and 50 * pos <= -100 * x[0] <= 95 * pos)[:3]
            out += [(i, j, k + 1, n, pos, -t) for k, (t, n, _) in enumerate(good)]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' as tile", "1 as score", "2 as rank", "3 as chunk")


@pytest.mark.parametrize("tile_rows", [16, 4096])
def test_against_brute_force(spark, tile_rows):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 0.3, (4, 6))
    vec = lambda k: [float(x) for x in centres[k % 4] + rng.normal(0, 0.15, 6)]
    rows = [(i, int(rng.integers(0, 4)), vec(i)) for i in range(500)]
    rows += [(1000 + i, 1 + i % 2, rows[0][2]) for i in range(90)]  # ties: one vector many times
    rows += [(3000 + i, 2, vec(i)[:3]) for i in range(40)]  # vectors of another length meet among themselves
    rows += [rows[3]] * 4 + [rows[50]] + [(100, 3, vec(1))]  # repeated rows, and two rows of one id
    bad = [(5000, None, [0.1] * 6), (5050, 1, None), (5100, 1, [float("nan")] * 6), (5150, 1, [None] + [0.1] * 5), (None, 1, [0.2] * 6), (5200, 1, [float("inf")] + [0.0] * 5), (5250, 1, [])]
    got = negatives.hard_negatives(_frame(spark, rows + bad).repartition(5), "vec_id % 50 = 0", tile_rows=tile_rows).collect()
    assert sorted(map(tuple, got)) == _brute(rows)


def test_few_rows(spark):
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.6, 0.5]), (2, 2, [0.3, 0.4]), (3, 2, [0.9, 0.9])]
    assert sorted(map(tuple, negatives.hard_negatives(_frame(spark, rows), "vec_id % 50 = 0").collect())) == _brute(rows)
    assert negatives.hard_negatives(_frame(spark, rows[:1]), "vec_id % 50 = 0").count() == 0
    assert negatives.hard_negatives(_frame(spark, rows[1:]), "vec_id % 50 = 0").count() == 0
    assert negatives.hard_negatives(_frame(spark, rows).limit(0), "vec_id % 50 = 0").count() == 0


def test_intervals_hold_every_product():
    rng = np.random.default_rng(1)
    x, q = rng.normal(0, 5, (300, 7)).round(), rng.normal(0, 5, (20, 7)).round()
    order, cuts = negatives._leaves(x)
    assert sorted(order) == list(range(300))
    x = x[order]
    least, most = negatives._intervals(q, np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts))
    of = np.arange(300) // negatives.LEAF_ROWS
    products = q @ x.T
    assert (least[:, of] <= products).all() and (products <= most[:, of]).all()
    plain = np.ptp(rng.permutation(x)[:288].reshape(9, 32, 7), axis=1).sum()
    assert np.ptp(x[:288].reshape(9, 32, 7), axis=1).sum() < 0.9 * plain  # packing makes boxes smaller


def test_tiles_are_bounded(spark):
    """A third of all rows are one vector: ties do not make a tile grow."""
    rng = np.random.default_rng(4)
    rows = [(i, 1, [float(x) for x in rng.normal(0, 0.3, 4)]) for i in range(4000)] + [(9000 + i, 1, [0.25] * 4) for i in range(2000)]
    whole = negatives.quantised(_frame(spark, rows), "label")
    sizes = [r["count"] for r in negatives.packed(whole, 100).groupBy("tile").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 200
