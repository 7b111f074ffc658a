"""Near duplicates, mixing, repetition, scores, personal data, search and quality against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from changegrid.llm import lattice, mixing, neardup, pii, quality, repetition, topk
from changegrid.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# --- near duplicates ------------------------------------------------------------------------

def _fingerprint(text):
    words = WORD.findall(text.encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams))


def _classes(fps, names):
    least = list(range(len(fps)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4):
            a, b = find(i), find(i + 1 + int(j))
            least[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(i)
    out = [None] * len(fps)
    for members in groups.values():
        known = [names[i] for i in members if names[i] is not None]
        for i in members:
            out[i] = min(known) if known else None
    return out


def test_near_duplicates(docs, rows, empty):
    fps = [_fingerprint(t) for _, t, _ in rows]
    names = [i for i, _, _ in rows]
    classes = _classes(fps, list(range(len(fps))))
    want = Counter(zip(names, (format(f, "016x") for f in fps), _classes(fps, names)))
    got = neardup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(classes))
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_triples_meet_every_four_positions():
    from itertools import combinations

    triples = [set(t) for t in neardup.position_triples()]
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


@pytest.mark.parametrize("chunk", [4, 1024])
def test_crowded_lists_lose_no_link(spark, chunk):
    """A large group of near copies, chains included, in chunks far smaller than the group."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(120)}
    chain = [int(rng.integers(0, 1 << 63))]
    for k in range(15):
        chain.append(chain[-1] ^ (0b1111 << 4 * k))
    fps = sorted(fps | set(chain) | {int(x) for x in rng.integers(0, 1 << 63, 200)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = dict(neardup.fingerprint_classes(spark.createDataFrame([(f,) for f in signed], "fp long"), chunk=chunk).collect())
    assert [got.get(f, f) for f in signed] == _classes(fps, signed)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}


# --- mixing ---------------------------------------------------------------------------------

def test_mixing(docs, rows, empty):
    size = lambda t: len(WORD.findall(t.encode()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:  # share, stop at the caps, share the rest again
        rest = total - sum(capped.values())
        open_ = [s for s in order if s not in capped]
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3 * sizes[s] for s in over}
    target |= capped
    got = mixing.mix(docs).collect()
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in order)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    rows_out = mixing.mixed_documents(docs)
    assert rows_out.columns == docs.columns
    words = Counter()
    for r in rows_out.collect():
        words[r.source] += size(r.text)
        assert r.n_chars == len(r.text)
    assert words == +taken
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# --- repetition -----------------------------------------------------------------------------

def test_repetition(docs, rows, empty):
    def facts(t):
        w = [x.decode() for x in WORD.findall(t.encode())]
        cover = {}
        for n in (5, 8, 10):
            grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            count = Counter(grams)
            cover[n] = {j for k, g in enumerate(grams) if count[g] > 1 for j in range(k, k + n)}
        lines = [x for x in t.split("\n") if WORD.search(x.encode())]
        chars = sum(map(len, w))
        failed = len(w) < 10 or 100 * len(cover[5]) > 20 * len(w)
        share = lambda n: sum(len(w[j]) for j in cover[n]) / max(chars, 1)
        return len(w), chars, sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover[5]), failed, round(share(8), 9), round(share(10), 9)

    got = repetition.repetition_rules(docs).collect()
    seen = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.share_8, 9), round(r.share_10, 9)) for r in got)
    assert seen == Counter((i, *facts(t)) for i, t, _ in rows)
    for r in got:
        shares = [r.share_5, r.share_6, r.share_7, r.share_8, r.share_9, r.share_10]
        assert r.kept == (not r.base_failed and all(x <= repetition.NGRAM_LIMITS[n] for n, x in enumerate(shares, 5)) and r.line_share <= 0.3)
    assert repetition.repetition_rules(empty).count() == 0


def test_each_length_can_decide(spark):
    """Twelve words of equal length twice among 200: 12 % pass the limits up to 8 words, not those of 9 and 10."""
    words = [f"w{k:04d}" for k in range(200)]
    twice, short = list(words), list(words)
    twice[100:112] = words[:12]
    for at in (40, 80, 120):  # 6 words, four times: again 12 %, in no repeated 9-gram
        short[at : at + 6] = words[:6]
    rows = [(0, " ".join(words)), (1, " ".join(twice)), (2, " ".join(short))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition_rules(frame).collect()}
    assert [got[k].base_failed for k in range(3)] == [False] * 3 and [got[k].kept for k in range(3)] == [True, False, True]
    assert got[1].share_5 == got[1].share_10 == 0.12 and (got[2].share_5, got[2].share_9) == (0.12, 0.0)
    assert repetition.repetition_rules(frame, {n: 0.12 for n in range(5, 11)}).where("kept").count() == 3


# --- language model -------------------------------------------------------------------------

def test_lattice_sums_all_segmentations():
    pieces = lattice.pieces_of(lattice.tokenizer_path("piece_bpe_32k.model"))
    number = {p: i for i, p in enumerate(pieces.pieces)}
    log_weight = np.append(pieces.start, -np.inf)

    def brute(word):
        total = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            total[j] = sum(total[i] * math.exp(log_weight[number[word[i:j]]]) for i in range(j) if word[i:j] in number)
        return math.log(total[-1])

    for word in (b" the", b" thonerin", " größe".encode(), b" zzqx", b" a"):
        matrix = np.frombuffer(word, np.uint8)[None, :]
        lattice_ = lattice.Lattices(pieces, matrix)
        assert lattice_.forward(log_weight)[-1][0] == pytest.approx(brute(word))
        one, uses = lattice.long_word(pieces, matrix[0], log_weight, 3.0)
        assert one == pytest.approx(brute(word))
        assert uses == pytest.approx(lattice_.expected(log_weight, np.array([3.0]), len(pieces.pieces)))
        assert sum(u * len(p) for u, p in zip(uses, pieces.pieces)) == pytest.approx(3 * len(word))


def test_lm_scores(spark, docs, rows, empty):
    held = "doc_id % 7 = 2"
    got = lattice.score_documents(spark, docs, held, rounds=1).collect()
    tokens = [(i, [w.lower() for w in WORD.findall(t.encode())] + [None]) for i, t, _ in rows]
    count = Counter(w for i, ws in tokens if i is None or i % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((i, i is not None and i % 7 == 2, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.score_documents(spark, empty, held).count() == 0
    alone = lattice.score_documents(spark, docs.where("doc_id % 7 = 2"), held).collect()
    assert alone and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in alone)


# --- personal data --------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def _base_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    holds = {
        "email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 14 <= len(digits(v)) <= 19 and _luhn(digits(v)), "phone": lambda v: 10 <= len(digits(v)) <= 15,
    }
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text) if holds[kind](m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_personal_data_spans(spark, docs, rows, empty):
    more = [
        (900, "é a@b.co ü x.y@z.org.uk_q@r.st @no a@b"), (901, "1.2.3.4.5 300.1.1.1 001.2.3.4 9.9.9 255.255.255.255"),
        (902, "4111-1111-1111-1111 5500000000000004 4111 1111 1111 1112 " + "9" * 400), (903, "+1 (234) 555-0100 +12 +4 99 +331234567890123456"),
        (904, "4111111111111111@mail.org 10.0.0.1-10.0.0.2@x.y " * 40),
    ]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = pii.personal_data(all_docs).collect()
    want = Counter()
    for i, t in [(i, t) for i, t, _ in rows] + more:
        spans = _base_spans(t)
        want[(i, *(sum(s.startswith(k + ":") for s in spans) for k in PATTERNS), hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.personal_data(empty).count() == 0


def test_terms_that_disclose(spark):
    """A name that stands beside one address only gives it away; common words do not."""
    plain = [(i, f"the report of day {i} was sent to all of them and read by some") for i in range(200)]
    holders = [(300 + i, f"on day {i} the note went to Zorbulon at zb@corp.org with the plan {i} attached") for i in range(3)]
    docs = spark.createDataFrame(plain + holders, "doc_id long, text string").withColumn("n_chars", pii.F.char_length("text").cast("long"))
    spans = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert all(spans[i] == "" for i, _ in plain)
    for i, t in holders:
        a = t.index("Zorbulon")
        assert f"term:{a}:{a + 8}" in spans[i].split(",") and not any(s == f"term:{t.index('day')}:{t.index('day') + 3}" for s in spans[i].split(","))
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert len(clean) == 203 and all(clean[i].text == t for i, t in plain)
    for i, _ in holders:
        assert "Zorbulon" not in clean[i].text and "[EMAIL]" in clean[i].text and clean[i].n_chars == len(clean[i].text)


def test_sanitise_keeps_rows_and_columns(docs, empty):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and pii.sanitise(empty).count() == 0
    assert out.where("text like '%4111%' or text like '%a.b@c.org%'").count() == 0


# --- top-k ----------------------------------------------------------------------------------

def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(700)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)]  # ties
    bad = [(5000, None), (5050, [float("nan")] * 8), (5100, [None] + [0.1] * 7), (None, [0.1] * 8), (5150, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").selectExpr("*", "'x' as score", "1 as rank")
    m = np.floor(256 * np.array([np.float32(v) for _, v in vectors], np.float64)).astype(int)
    ids = [i for i, _ in vectors]
    want = set()
    for q, i in enumerate(ids):
        if i % 50 == 0:
            ranked = sorted((-int(m[q] @ m[c]), j) for c, j in enumerate(ids) if j != i)[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(ranked)}
    assert {tuple(r) for r in topk.top_k(frame, "vec_id % 50 = 0").collect()} == want
    assert topk.top_k(frame.limit(0), "vec_id % 50 = 0").count() == 0
    few = topk.top_k(frame.where("vec_id in (0, 1, 2)"), "vec_id % 50 = 0").collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


# --- quality --------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score_quality(docs, labels, "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0")
    judged = out.where("held_out").join(labels, "doc_id").collect()
    good = [r.predicted for r in judged if r.quality == 1]
    bad = [r.predicted for r in judged if r.quality == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.35
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert [int(zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.limit(50).collect()] == [int(r.held_out) for r in out.limit(50).collect()]


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, none, "doc_id % 5 = 0").where("score = 0.5").count() == docs.count()
    out = quality.accepted(docs, none, "doc_id % 5 = 0")
    assert out.columns == docs.columns and out.count() == docs.count() and quality.accepted(docs, none, "doc_id % 5 = 0", 0.6).count() == 0
    one_sided = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, one_sided, "doc_id % 5 = 0").count() == docs.count()
    assert quality.score_quality(empty, none, "doc_id % 5 = 0").count() == 0
