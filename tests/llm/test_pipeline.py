"""The corpus pipeline, stage by stage, against plain code."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from changegrid.llm import neardup, oracle, queries
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/stage-{name}-{spark.sparkContext.applicationId}")
        outs[name] = (docs, docs := spark.read.parquet(path))
        if name != "packing":
            assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = (x.collect() for x in outs["quality"])
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    kept = {r.doc_id for r in after}
    good = [r.doc_id in kept for r in before if labels.get(r.doc_id) == 1]
    bad = [r.doc_id in kept for r in before if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.4 * len(bad)

    before, after = (x.collect() for x in outs["neardup"])
    fps = {r.doc_id: neardup.fingerprint((r.text or "").encode()) for r in before}
    kept = sorted(r.doc_id for r in after)
    close = lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4
    assert not any(close(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :])
    assert all(any(close(d, o) for o in fps if o != d) for d in set(fps) - set(kept))

    before, after = (x.collect() for x in outs["pii"])
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(mail.search(r.text or "") for r in after)

    before, after = (x.collect() for x in outs["mixing"])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words, source = Counter(), Counter()
    for r in after:
        words[r.doc_id] += size(r.text)
    for r in before:
        source[r.source] += size(r.text)
        assert words[r.doc_id] <= 3 * size(r.text)
    assert abs(sum(words.values()) - sum(source.values())) <= len(source)

    before, pieces = outs["packing"][0].collect(), outs["packing"][1].collect()
    fill = Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 2048 and {p.doc_id for p in pieces} == {r.doc_id for r in before}


def test_run_and_registry(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(oracle.SQL[name]).fetchdf()) == ""
