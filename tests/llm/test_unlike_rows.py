"""Rows without ids in the mix, and vectors of unlike lengths in the search."""

import sys
from pathlib import Path

import duckdb
import numpy as np

from changegrid.llm import mixing, oracle, topk

sys.path.insert(0, str(Path(__file__).parents[2]))
from tools.check_oracle import compare


def test_rows_without_id_are_spread_by_their_text(spark, tmp_path):
    rows = [(None if i % 3 else i, f"text number {i} " + "word " * (i % 11), ["a", "b", None][i % 3]) for i in range(900)]
    rows += [(None, None, "a"), (None, "", "b"), (7, None, None)] + [(None, "same words each time", "a")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert compare(mixing.mix(docs.repartition(5)).drop("source").toPandas(), con.execute(oracle.SQL["op2_mixing"]).df()) == ""
    # A source's last epoch ends among its rows without id as it does among others.
    without = mixing.mix(docs).where("doc_id is null and source = 'b' and size > 3").collect()
    assert len({r.taken // r.size for r in without}) == 2


def test_vectors_of_unlike_lengths_never_meet(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, (8, 5, 3)[i % 3])]) for i in range(600)] + [(650, [0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    quant = {i: np.floor(256 * np.array(np.float32(v), np.float64)).astype(int) for i, v in rows}
    want = set()
    for i, q in quant.items():
        if i % 50 == 0:
            ranked = sorted((-int(q @ v), j) for j, v in quant.items() if j != i and len(v) == len(q))[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(ranked)}
    got = {tuple(r) for r in topk.top_k(frame, "vec_id % 50 = 0").collect()}
    assert got == want and 650 not in {g[0] for g in got}
