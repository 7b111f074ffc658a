"""Token files, token counts and packing against the tokenizer libraries."""

import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from changegrid.llm import encoding, packing, piece_counts, repair
from changegrid.plans.lineage import shared_folder


def _crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name, drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_parts_encode_like_whole_texts(texts, name, drops):
    enc = encoding.PartEncoder(encoding.tokenizer_path(name), drops, cache_parts=200)  # the cache is emptied on the way
    for some in (texts, texts[::-1]):
        ids, offsets = enc.encode(pa.array(some))
        for i, t in enumerate(some):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 40), 200), rng.integers(0, 49408, 3000), np.full(500, 7)]).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[rng.integers(0, len(ids), 60)] = True
    ends[-1] = True
    symbols, marks, rules, lengths, levels = repair.compress(ids, ends, rounds=6, least=4)
    grammar = repair.Grammar(rules, lengths, levels)
    assert (grammar.expand(symbols) == ids).all() and len(symbols) < len(ids) / 2
    assert np.cumsum(grammar.size[symbols])[marks].tolist() == (np.flatnonzero(ends) + 1).tolist()  # rules stay inside documents
    assert [grammar.token(symbols, p) for p in (0, 17, 8100, len(ids) - 1)] == ids[[0, 17, 8100, -1]].tolist()
    assert len(repair.compress(ids[:1], ends[:1])[0]) == 1 and len(repair.compress(ids[:0], ends[:0])[0]) == 0


def test_token_files(spark, docs, rows, empty):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    repair.write_ids(docs, path, shard_tokens=4000)
    got = repair.read_ids(spark, path).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) as crc").collect()
    tok = encoding.encoder(encoding.tokenizer_path("word_bpe_49k.json"), True).tokenizer
    want = Counter()
    for i, t, _ in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want[(i, len(ids), _crc(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.crc) for r in got) == want
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == [0, *np.cumsum([r.n_tokens for r in by_start])[:-1].tolist()]
    keys = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert keys == sorted(keys)
    shard = spark.read.parquet(path).where("size(doc_ids) > 1").first()
    one = repair.read_document(shard.asDict(), 1)
    assert len(one) == shard.token_offsets[2] - shard.token_offsets[1] and one[-1] == 2
    nothing = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    repair.write_ids(empty, nothing)
    assert repair.read_ids(spark, nothing).count() == 0


def test_piece_counts(docs, rows, empty):
    m = piece_counts.model(encoding.tokenizer_path("piece_bpe_32k.model"))
    got = piece_counts.count_tokens(docs, limit=50).collect()
    want = Counter((i, len(t.encode()), len(m.encode(t)), len(m.encode(t)) > 50) for i, t, _ in rows)
    assert Counter(map(tuple, got)) == want
    assert piece_counts.count_tokens(empty).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000, 3, 2047, 1, 1], [1500] * 7, [1] * 5000, list(range(1, 400))])
def test_windows_hold_every_token_once(lengths):
    plan = packing.plan_shard(np.array(lengths, np.int64))
    seen, fill = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in plan.tolist():
        seen[doc].append((start, length))
        fill[sequence].append((offset, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at and length > 0
            at += length
        assert at == n
    padding = 0
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= sum(lengths) / 32


def test_best_fit_takes_the_tightest_window():
    tree = packing.CapacityTree(16)
    for room, window in ((9, 0), (5, 1), (16, 2), (5, 3)):
        tree.put(room, window)
    assert tree.take(4)[0] == 5 and tree.take(5)[0] == 5 and tree.take(5) == (9, 0) and tree.take(10) == (16, 2) and tree.take(1) is None


def test_packing(docs, rows, empty):
    got = packing.pack(docs).selectExpr("*", "crc32(ids) as crc").collect()
    tok = encoding.encoder(encoding.tokenizer_path("byte_bpe_50k.json"), False).tokenizer
    total = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r.length for r in got) == total and all(len(r.ids) == 4 * r.length for r in got)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for i, t, _ in rows:
        if sum(x[0] == i for x in rows) == 1:
            ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
            for r in by_id[i]:
                assert r.doc_tokens == len(ids) and r.crc == _crc(ids[r.start : r.start + r.length])
    assert packing.pack(empty).count() == 0


def test_words_of_any_script_share_texts(monkeypatch):
    """Words with letters beyond ASCII go to the library many in one text; the ids are those of each word alone."""
    enc = encoding.PartEncoder(encoding.tokenizer_path("word_bpe_49k.json"), True)
    words = [f"ñ{chr(97 + i % 26)}ö{chr(97 + i // 26 % 26)}ß" for i in range(600)] + ["ΣΑΣ", "漢字"]
    odd = ["İstanbul", "naïve's", "x́y", "é2"]  # lower-casing or marks make several pre-tokens
    for some in (words, words + odd):
        enc.clear()
        sent, plain = [], enc.tokenizer
        monkeypatch.setattr(enc, "_ids", lambda texts: sent.extend(texts) or encoding.PartEncoder._ids(enc, texts))
        ids, _ = enc.encode(pa.array([" ".join(some)]))
        assert ids.tolist() == plain.encode(" ".join(some), add_special_tokens=False).ids
        if some is words:
            assert len(sent) <= 2
