"""Re-Pair goes on until no pair is frequent, with the production values."""

import numpy as np
import pytest

from changegrid.llm import repair


@pytest.mark.parametrize("kind", ["passage", "run", "mixed"])
def test_no_frequent_pair_is_left(kind):
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 49408, 300)
    parts = {
        "passage": [np.concatenate([passage, rng.integers(0, 49408, 20)]) for _ in range(400)],
        "run": [np.full(30000, 7), rng.integers(0, 49408, 50)],
        "mixed": [rng.zipf(1.3, 200_000) % 49408],
    }[kind]
    ids = np.concatenate(parts).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum([len(p) for p in parts]) - 1] = True
    symbols, marks, rules, lengths, levels = repair.compress(ids, ends)
    assert (repair.Grammar(rules, lengths, levels).expand(symbols) == ids).all()
    inside = ~marks[:-1]
    # Pairs of one symbol overlap in a run; two of them there are one that can be replaced.
    _, n = np.unique(symbols[:-1][inside].astype(np.uint64) << np.uint64(32) | symbols[1:][inside], return_counts=True)
    assert n.max(initial=0) < repair.LEAST_COUNT
    if kind == "passage":
        assert lengths.max() == 300
