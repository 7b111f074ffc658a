"""Token ids in shard files compressed by a Re-Pair grammar.

Documents are range-partitioned and sorted by doc_id. A shard holds a few million ids; its most
frequent adjacent id pairs are replaced by new symbols, round after round, until no pair is
frequent. A round replaces many pairs at once, the more frequent of two overlapping ones first.
Rules never cross documents, and each rule's expansion length is stored, so one document (or one
token of it) can be read without expanding the rest.

File format: a Parquet table with one row per shard, in ascending order of `part`, `shard`.

| column | content |
| --- | --- |
| part, shard | place in the global order |
| n_tokens | ids in the shard |
| doc_ids, token_offsets, symbol_offsets | per document; offsets have one entry more |
| rules | uint32 pairs; rule i makes symbol FIRST_RULE + i |
| rule_lengths | uint32 expansion length of each rule |
| rule_levels | number of rules after each round; a rule uses earlier rounds' symbols only |
| symbols | uint32, the compressed sequence |
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from changegrid.llm import text as T
from changegrid.llm.encoding import encoder, tokenizer_path
from changegrid.plans.lineage import cut

FIRST_RULE = 1 << 16
SHARD_TOKENS = 2 << 20
RULES_PER_ROUND, LEAST_COUNT = 16384, 24
_SLOTS_LOG2 = 20


def _multiplier(k: int) -> np.uint32:
    """An odd 32-bit number of its own for each k."""
    return np.uint32((k + 1) * 0x9E3779B97F4A7C15 >> 29 & 0xFFFFFFFF | 1)


def _frequent(left: np.ndarray, right: np.ndarray, slot: np.ndarray, slots: int, least: int, per_round: int):
    """(number of the pair or -1, one position per number) of the pairs that come `least` times, the
    most frequent first. A pair is counted if it holds its hash slot; where no such pair is frequent,
    all pairs are counted."""
    own = np.zeros(slots, np.int32)
    own[slot] = np.arange(len(slot), dtype=np.int32)
    pair = left.astype(np.uint64) << np.uint64(32) | right
    held = pair[own][slot] == pair if len(pair) > slots else pair[own[slot]] == pair
    count = np.bincount(slot[held], minlength=slots)
    if not (count >= least).any():
        _, own, slot, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        held = np.ones(len(left), bool)
    chosen = np.flatnonzero(count >= least)
    chosen = chosen[np.argsort(-count[chosen], kind="stable")][:per_round]
    number = np.full(len(count), -1, np.int32)
    number[chosen] = np.arange(len(chosen), dtype=np.int32)
    return np.where(held, number[slot], -1), own[chosen]


def compress(ids: np.ndarray, ends: np.ndarray, rounds: int | None = None, per_round: int = RULES_PER_ROUND, least: int = LEAST_COUNT):
    """(symbols, end flags, rules, rule lengths, rules after each round) of ids below FIRST_RULE.

    `ends` marks the last id of each document. Rounds end when no pair comes `least` times, or after
    `rounds` if given. A pair of old symbols can only grow rarer, so a round looks at a working set
    of places: those whose pair fell into a hash slot of `least` pairs or more last time, and those
    beside a replacement. Every round hashes in its own way, so that a rare pair leaves the set soon.
    """
    n = len(ids)
    seq, ends = np.append(ids, 0).astype(np.uint32), np.append(ends, True)
    following, preceding = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    preceding[:1] = n  # the place after the last stands for none
    alive, at = np.ones(n, bool), np.flatnonzero(~ends[: max(n - 1, 0)])
    rules, lengths, levels, made = [], [], [], 0
    size_of = np.ones(FIRST_RULE, np.int64)
    none = np.iinfo(np.int32).max
    while (rounds is None or len(levels) < rounds) and len(at) >= least:
        bits = min(_SLOTS_LOG2, max(10, len(at).bit_length()))
        left, right = seq[at], seq[following[at]]
        slot = ((left * _multiplier(2 * len(levels)) + right * _multiplier(2 * len(levels) + 1)) >> np.uint32(32 - bits)).astype(np.int64)
        hot = (np.bincount(slot, minlength=1 << bits) >= least)[slot]
        at, left, right, slot = at[hot], left[hot], right[hot], slot[hot]
        number, examples = _frequent(left, right, slot, 1 << bits, least, per_round)
        if not len(examples):
            break
        found = np.flatnonzero(number >= 0)
        here, place = number[found], at[found]
        joined = np.append(False, following[place[:-1]] == place[1:])  # the pair before begins one symbol earlier
        before = np.where(joined, np.append(none, here[:-1]), none)
        after = np.where(np.append(joined[1:], False), np.append(here[1:], none), none)
        # Of two overlapping pairs the more frequent goes first; in a run of one pair every other place is taken.
        each = np.arange(len(here))
        start = np.maximum.accumulate(np.where(here != before, each, 0))
        take = ((each - start) % 2 == (before < here)[start]) & (here <= after)
        where, base = place[take], FIRST_RULE + made
        rules.append(np.stack([left[examples], right[examples]], 1))
        lengths.append(size_of[rules[-1]].sum(1))
        size_of = np.concatenate([size_of, lengths[-1]])
        made += len(examples)
        levels.append(made)
        gone = following[where]
        seq[where] = base + here[take]
        ends[where] = ends[gone]
        following[where] = following[gone]
        preceding[following[gone]] = where
        alive[gone] = False
        look = np.zeros(n + 1, bool)
        look[at] = look[where] = look[preceding[where]] = True
        look[gone] = False
        at = np.flatnonzero(look & ~ends)
        if len(at) > n >> 3:
            # While much is still looked at, symbols are moved together, so that neighbours lie side by side.
            keep = np.append(alive, True)
            at = np.flatnonzero((look & ~ends)[keep])
            seq, ends, n = seq[keep], ends[keep], int(alive.sum())
            alive, following, preceding = np.ones(n, bool), np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
            preceding[:1] = n
    return (
        seq[:n][alive], ends[:n][alive],
        np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32),
        np.concatenate(lengths) if lengths else np.zeros(0, np.int64),
        levels,
    )


class Grammar:
    """Expands symbols of one shard."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, levels: list[int]):
        self.size = np.concatenate([np.ones(FIRST_RULE, np.int64), lengths])
        self.first = np.concatenate([np.arange(FIRST_RULE), FIRST_RULE + np.cumsum(lengths) - lengths])
        self.pool = np.empty(FIRST_RULE + int(lengths.sum()), np.uint32)
        self.pool[:FIRST_RULE] = np.arange(FIRST_RULE)
        done, at = 0, FIRST_RULE
        for level in levels:
            made = self.expand(rules[done:level].ravel())
            self.pool[at : at + len(made)] = made
            done, at = level, at + len(made)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.pool[T.ranges(self.first[symbols], self.size[symbols])]

    def token(self, symbols: np.ndarray, position: int) -> int:
        """The id at `position` of a symbol sequence, by expansion lengths alone."""
        ends = np.cumsum(self.size[symbols])
        i = int(np.searchsorted(ends, position, "right"))
        return int(self.pool[self.first[symbols[i]] + position - (int(ends[i - 1]) if i else 0)])


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    drops_space: bool = True,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode whole texts, append `end_id` to each, and write shard files in doc_id order.

    A null text is empty; null doc_ids come first; rows of one doc_id follow the order of a hash
    of their text; repeated rows are all written; an empty table makes an empty file set. Extra
    columns are not stored.
    """
    vocabulary = tokenizer_path(tokenizer)
    key = docs.schema["doc_id"].dataType
    schema = StructType(
        [StructField("part", IntegerType()), StructField("shard", IntegerType()), StructField("n_tokens", LongType()), StructField("doc_ids", ArrayType(key)),
         StructField("token_offsets", ArrayType(LongType())), StructField("symbol_offsets", ArrayType(LongType())), StructField("rules", BinaryType()),
         StructField("rule_lengths", BinaryType()), StructField("rule_levels", ArrayType(IntegerType())), StructField("symbols", BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, drops_space)
        part, shard, keys, texts, sizes, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            nonlocal shard, keys, texts, sizes, held
            if held:
                yield _shard_row(part, shard, pa.concat_arrays(keys), np.concatenate(texts), np.concatenate(sizes))
                shard += 1
            keys, texts, sizes, held = [], [], [], 0

        for batch in batches:
            for piece in T.slices(batch, step=4 << 20):
                ids, offsets = enc.encode(piece.column("text"))
                ids = np.insert(ids, offsets[1:], np.uint32(end_id))
                keys.append(piece.column("doc_id"))
                texts.append(ids)
                sizes.append(np.diff(offsets) + 1)
                held += len(ids)
                if held >= shard_tokens:
                    yield from flush()
        yield from flush()

    order = docs.selectExpr("doc_id", "text", "xxhash64(text) as _tie")
    ordered = order.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    ordered.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def _shard_row(part: int, shard: int, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    ends = np.zeros(len(ids), bool)
    ends[offsets[1:] - 1] = True
    symbols, ends, rules, lengths, levels = compress(ids, ends)
    symbol_offsets = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(ends) + 1])
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()),
         pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
         pa.array([offsets], pa.list_(pa.int64())), pa.array([symbol_offsets], pa.list_(pa.int64())), pa.array([rules.astype("<u4").tobytes()], pa.binary()),
         pa.array([lengths.astype("<u4").tobytes()], pa.binary()), pa.array([levels], pa.list_(pa.int32())), pa.array([symbols.astype("<u4").tobytes()], pa.binary())],
        ["part", "shard", "n_tokens", "doc_ids", "token_offsets", "symbol_offsets", "rules", "rule_lengths", "rule_levels", "symbols"],
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: (doc_id, start, n_tokens, ids).

    `start` counts the ids of all documents before it; `ids` holds little-endian unsigned 32-bit
    integers. Offsets come from a prefix sum over shard totals, per part first.
    """
    shards = spark.read.parquet(path)
    key = shards.schema["doc_ids"].dataType.elementType
    totals = shards.select("part", "shard", "n_tokens")
    parts = totals.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("part").orderBy("shard")
    starts = totals.select("part", "shard", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("_inside"))
    starts = cut(starts.join(parts, "part").select("part", "shard", (F.col("_inside") + F.col("_before")).alias("start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield _decode_row(row)

    schema = StructType([StructField("doc_id", key), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    return shards.drop("n_tokens").join(starts, ["part", "shard"]).mapInArrow(run, schema)


def _decode_row(row: pa.RecordBatch) -> pa.RecordBatch:
    value = lambda name: row.column(name)[0]
    words = lambda name: np.frombuffer(value(name).as_buffer(), "<u4")
    grammar = Grammar(words("rules").reshape(-1, 2), words("rule_lengths").astype(np.int64), value("rule_levels").as_py())
    ids = grammar.expand(words("symbols"))
    offsets = value("token_offsets").values.to_numpy()
    keys = value("doc_ids").values
    payload = pa.Array.from_buffers(
        pa.binary(), len(keys), [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]
    )
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(offsets[:-1] + value("start").as_py()), pa.array(np.diff(offsets)), payload], ["doc_id", "start", "n_tokens", "ids"]
    )


def read_document(row: dict, position: int) -> np.ndarray:
    """Ids of one document of a shard row, expanding that document only."""
    grammar = Grammar(np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64), list(row["rule_levels"]))
    a, b = row["symbol_offsets"][position : position + 2]
    return grammar.expand(np.frombuffer(row["symbols"], "<u4")[a:b])
