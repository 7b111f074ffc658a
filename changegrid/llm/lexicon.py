"""Block dictionaries: score every distinct word once, then add up per document.

Documents are cut into blocks of some tens of megabytes. A block keeps, for each document, its
distinct words as block-local numbers with their frequencies, and the block's distinct words,
dealt into hash buckets. Only the words meet the corpus-wide lexicon, one bucket at a time: a
very common word costs one entry per block, not one per occurrence, and token streams are never
stored or shuffled. The values found for a block's words then go back to the block and are
summed per document. Words and numbers travel as packed, compressed arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from changegrid.llm import text as T
from changegrid.plans.lineage import cut

BLOCK_BYTES = 24 << 20
PACK_PAIRS = 1 << 19
Segment = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def lower_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, document) of words, A-Z lower-cased."""
    data, offsets = T.utf8(column)
    data = T.LOWER[data]
    return data, *T.word_bounds(data, offsets)


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def expand(packed: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype)


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(words))


def unpack_words(packed: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    ends = [*accumulate(np.frombuffer(raw, "<u4", n).tolist(), initial=4 * n)]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def bucket_count(spark: SparkSession) -> int:
    """A few buckets per shuffle partition, so that a bucket stays small as the session is sized."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_table(docs: DataFrame, segment: Segment, keep: list[str], weigh_by: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Store blocks of `docs` (columns `text`, `keep`) and return the stored table.

    Word rows: (block, bucket, n, words, weights): the distinct words of the block in one bucket
    and their occurrences in documents whose boolean column `weigh_by` is true (all, if None).
    Document rows: (block, docs, sizes, codes, counts): kept columns of a run of documents, their
    numbers of distinct words, and the words' numbers and frequencies one after the other. A
    word's number in the block follows bucket order. The other columns of a row are null.
    """
    kept = StructType([StructField(c, docs.schema[c].dataType) for c in keep])
    schema = StructType(
        [StructField("block", LongType()), StructField("bucket", IntegerType()), StructField("n", IntegerType()), StructField("words", BinaryType()),
         StructField("weights", BinaryType()), StructField("docs", ArrayType(kept)), StructField("sizes", BinaryType()), StructField("codes", BinaryType()),
         StructField("counts", BinaryType())]
    )
    buckets = bucket_count(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, parts = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for piece in T.slices(batch, step=4 << 20):
                data, start, end, doc = segment(piece.column("text"))
                parts.append((piece.select(keep), *_distinct(data, start, end, doc)))
                held += len(data)
                if held >= block_bytes:
                    yield _block_rows((task << 32) + number, parts, weigh_by, buckets)
                    number, held, parts = number + 1, 0, []
        if parts:
            yield _block_rows((task << 32) + number, parts, weigh_by, buckets)

    return cut(docs.select("text", *keep).mapInArrow(run, schema))


def _distinct(data, start, end, doc):
    """(hashes and bytes of a slice's distinct words, its (doc, local word, count) triples)."""
    if not len(start):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), [], empty, empty, empty
    codes, uniques = pd.factorize(T.span_hashes(data, start, end))
    firsts = np.empty(len(uniques), np.int64)
    firsts[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    pairs, counts = np.unique(doc.astype(np.int64) * len(uniques) + codes, return_counts=True)
    return uniques, T.take_spans(data, start[firsts], end[firsts]), pairs // len(uniques), pairs % len(uniques), counts


def _block_rows(block: int, parts: list, weigh_by: str | None, buckets: int) -> pa.RecordBatch:
    codes, uniques = pd.factorize(np.concatenate([p[1] for p in parts]))
    bucket = (T.mix(uniques ^ T._LANE) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[codes]  # numbers in bucket order
    words: list[bytes] = [b""] * len(uniques)
    at, triples, docs_before = 0, [], 0
    for frame, hashes, spans, doc, local, count in parts:
        of_slice = codes[at : at + len(hashes)]
        for c, w in zip(of_slice.tolist(), spans):
            words[c] = w
        code = of_slice[local] if len(local) else local
        within = np.argsort(doc * len(words) + code)
        triples.append((doc[within] + docs_before, code[within], count[within]))
        at, docs_before = at + len(hashes), docs_before + frame.num_rows
    doc, code, count = (np.concatenate([t[k] for t in triples]) for k in range(3))
    kept = pa.Table.from_batches([p[0] for p in parts]).combine_chunks()
    weights = count
    if weigh_by is not None:
        weights = count * kept[weigh_by].to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    weights = np.bincount(code, weights=weights, minlength=len(words)).astype("<i8")

    rows: dict[str, list] = {c: [] for c in ("bucket", "n", "words", "weights", "sizes", "codes", "counts")}
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    for b, (i, j) in enumerate(zip(edges, edges[1:])):
        if i < j:
            row = (b, j - i, pack_words(words[i:j]), squeeze(weights[i:j]), None, None, None)
            for c, v in zip(rows, row):
                rows[c].append(v)
    n_word_rows = len(rows["n"])
    where = np.searchsorted(doc, np.arange(docs_before + 1))
    cuts = [0]
    while cuts[-1] < docs_before:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(where, where[cuts[-1]] + PACK_PAIRS, "right")) - 1))
    for i, j in zip(cuts, cuts[1:]):
        low, high = where[i], where[j]
        steps = np.diff(code[low:high], prepend=0)
        heads = where[i:j][where[i:j] < where[i + 1 : j + 1]]
        steps[heads - low] = code[heads]
        row = (None, None, None, None, squeeze(np.diff(where[i : j + 1]).astype("<u4")), squeeze(steps.astype("<u4")), squeeze(count[low:high].astype("<u4")))
        for c, v in zip(rows, row):
            rows[c].append(v)
    structs = pa.StructArray.from_arrays([kept[c].combine_chunks() if isinstance(kept[c], pa.ChunkedArray) else kept[c] for c in kept.column_names], kept.column_names)
    lists = pa.ListArray.from_arrays(pa.array([None] * n_word_rows + cuts, pa.int32()), structs)
    types = {"bucket": pa.int32(), "n": pa.int32()}
    columns = {c: pa.array(v, types.get(c, pa.binary())) for c, v in rows.items()} | {"docs": lists}
    columns["block"] = pa.array(np.full(len(rows["n"]), block))
    names = ["block", "bucket", "n", "words", "weights", "docs", "sizes", "codes", "counts"]
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def _words(blocks: DataFrame) -> DataFrame:
    return blocks.where("bucket is not null").select("block", "bucket", "n", "words", "weights")


def documents_of(blocks: DataFrame) -> DataFrame:
    """Kept columns, one row per document."""
    return blocks.where("sizes is not null").selectExpr("inline(docs)")


def lexicon(blocks: DataFrame) -> DataFrame:
    """(bucket, word, c): every distinct word once, with its total weight."""

    def gather(rows: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for n, words, weights in zip(rows["n"].to_pylist(), rows["words"], rows["weights"]):
            for w, c in zip(unpack_words(words.as_buffer(), n), expand(weights.as_buffer(), "<i8").tolist()):
                total[w] = total.get(w, 0) + c
        bucket = pa.array(np.full(len(total), rows["bucket"][0].as_py(), np.int32))
        return pa.table({"bucket": bucket, "word": pa.array(total, pa.binary()), "c": pa.array(total.values(), pa.int64())})

    return _words(blocks).select("bucket", "n", "words", "weights").groupBy("bucket").applyInArrow(gather, "bucket int, word binary, c long")


def _found(rows: pa.Table, value_of: dict[bytes, int], values: np.ndarray) -> pa.Table:
    """Rows (block, bucket, found): values of each block's words, in their order."""
    found = [squeeze(values[:, [value_of[w] for w in unpack_words(words.as_buffer(), n)]]) for n, words in zip(rows["n"].to_pylist(), rows["words"])]
    return pa.table({"_block": rows["block"], "bucket": rows["bucket"], "found": pa.array(found, pa.binary())})


def values_by_rule(blocks: DataFrame, rule: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """Word values from a function of the word alone, called once per distinct word: `rule` gives
    an array (values, words)."""

    def look_up(rows: pa.Table) -> pa.Table:
        distinct: dict[bytes, int] = {}
        for n, words in zip(rows["n"].to_pylist(), rows["words"]):
            for w in unpack_words(words.as_buffer(), n):
                distinct.setdefault(w, len(distinct))
        return _found(rows, distinct, rule([*distinct]).astype("<f8"))

    return _words(blocks).select("block", "bucket", "n", "words").groupBy("bucket").applyInArrow(look_up, "_block long, bucket int, found binary")


def values_by_join(blocks: DataFrame, scored: DataFrame, names: list[str]) -> DataFrame:
    """Word values from a table (bucket, word, *names) that has every word of the blocks."""

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        value_of = {w: i for i, w in enumerate(known["word"].to_pylist())}
        values = np.stack([known[n].to_numpy().astype("<f8") for n in names])
        return _found(rows, value_of, values)

    words = _words(blocks).select("block", "bucket", "n", "words")
    scored = scored.selectExpr("bucket as _bucket", "word", *names)
    return words.groupBy("bucket").cogroup(scored.groupBy("_bucket")).applyInArrow(look_up, "_block long, bucket int, found binary")


def sum_values(blocks: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(kept columns, *names) per document: each word value times the word's frequency, summed."""
    docs = blocks.where("sizes is not null").select("block", "docs", "sizes", "codes", "counts")
    kept = blocks.schema["docs"].dataType.elementType
    schema = StructType([*kept, *(StructField(n, DoubleType()) for n in names)])

    def add_up(packs: pa.Table, found: pa.Table) -> pa.Table:
        by_bucket = np.argsort(found["bucket"].to_numpy()) if found.num_rows else []
        values = [expand(found["found"][int(i)].as_buffer(), "<f8").reshape(len(names), -1) for i in by_bucket]
        table = np.concatenate(values, axis=1) if values else np.zeros((len(names), 0))
        result = []
        for row, sizes, codes, counts in zip(packs["docs"], packs["sizes"], packs["codes"], packs["counts"]):
            sizes = expand(sizes.as_buffer(), "<u4").astype(np.int64)
            steps = expand(codes.as_buffer(), "<u4").astype(np.int64)
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(steps)])
            ends = np.cumsum(sizes)
            code = total[1:] - np.repeat(total[ends - sizes], sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            count = expand(counts.as_buffer(), "<u4").astype(float)
            sums = [np.bincount(doc, weights=table[k, code] * count, minlength=len(sizes)) for k in range(len(names))]
            result.append(pa.table([*row.values.flatten(), *sums], names=[*kept.names, *names]))
        return pa.concat_tables(result)

    return docs.groupBy("block").cogroup(values.groupBy("_block")).applyInArrow(add_up, schema)
