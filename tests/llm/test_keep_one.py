"""Which rows near-duplicate removal keeps when ids are missing or repeat."""

import random

from changegrid.llm import neardup


def _texts(n, seed=11):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40)) for _ in range(n)]


def test_unlike_texts_without_id_or_with_one_id_all_stay(spark):
    t = _texts(9)
    rows = [(None, x) for x in t[:3]] + [(5, x) for x in t[3:6]] + [(1, t[6]), (2, t[6]), (None, t[6]), (None, t[7]), (None, t[7]), (5, t[8]), (5, t[8])]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, x) for x in t[:3]] + [(5, x) for x in t[3:6]] + [(1, t[6]), (None, t[7]), (5, t[8])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_an_id_in_two_classes(spark):
    """Row 7 of the class of 3 goes, row 7 of its own class stays, whichever hash is less."""
    for seed in range(4):
        a, b = _texts(2, seed)
        got = neardup.keep_one(spark.createDataFrame([(3, a), (7, a), (7, b)], "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted([(3, a), (7, b)])


def test_columns_and_empty_table(docs, empty):
    assert neardup.keep_one(docs).columns == docs.columns and neardup.keep_one(empty).count() == 0
