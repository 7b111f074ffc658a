"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from changegrid.llm import variants

UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _brute(rows, least_count=5, noise_every=199):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER_TO_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= least_count}
    near = defaultdict(set)
    for w in n:
        near[w] = {v for v in n if _near(w, v)}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def _words(rng):
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "ÿzzzzz×", "x" * 700]
    out = set(base)
    for w in base:
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            out |= {w[:k] + rng.choice("abcßz") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k + 1 :]}
    return sorted(out)


@pytest.mark.parametrize("noise_every", [199, 3])
def test_against_brute_force(spark, docs, rows, noise_every):
    """Chains of forms, ties, repeated letters, edits at both ends, a very long word, null ids and texts."""
    rng = random.Random(noise_every)
    texts = []
    for w in _words(rng):
        texts += [w if rng.random() < 0.7 else w.title()] * rng.choice([1, 5, 5, 6, 30, 160, 900])
    rng.shuffle(texts)
    made = [(5000 + i, " ".join(texts[i::40])) for i in range(40)] + [(None, " ".join(texts[::7])), (None, None), (6000, "")]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")).selectExpr("*", "'x' as word", "1 as n", "2 as side")
    plain = [(r.doc_id, r.text) for r in docs.collect()] + made
    got = variants.spelling_variants(frame, noise_every=noise_every).collect()
    want = _brute(plain, noise_every=noise_every)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert sum(f is not None for _, f, *_ in want) > 20 and any(r not in (w, f) for w, f, r, *_ in want if f)


def test_empty(empty):
    assert variants.spelling_variants(empty).count() == 0


def test_short_words_and_one_character(spark):
    words = ["a", "b", "ab", "ba", "abc", "abd", "é"]
    got = variants.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in words for b in words if _near(a, b))


def test_only_measured_rows_are_broadcast(spark, monkeypatch):
    """Exploded prefixes, and tables whose files are smaller than the threshold and whose rows are not, shuffle."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(6, 9))) for _ in range(4000)})
    plans, real = [], variants.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(variants, "cut", cut)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
        got = variants.near_words(spark.createDataFrame([(w,) for w in words], "word string"))
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        got = {tuple(r) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    held = set(words)
    edits = lambda w: {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in ["", *"abcdefgh"] for d in (0, 1)}
    assert got == {(w, v) for w in words for v in edits(w) & held if v != w} and len(got) > 20
    exploded = [x for x in plans if "Generate explode(transform(sequence" in x and "Join" in x]
    assert exploded and not any("Broadcast" in x for x in exploded)
    # The states of the first levels are 8,000 rows of 80 bytes and more; edges lie on the way from few to many rows.
    levels = [x for x in plans if "levenshtein" in x and "nexts" in x]
    assert "BroadcastHashJoin" in levels[0] and any("SortMergeJoin" in x and "Broadcast" not in x for x in levels)
    assert "Broadcast" not in plans[-1]
