"""Near-duplicate classes by SimHash, through an inverted index over fingerprint bytes.

Fingerprints within 4 bits share at least 4 of their 8 bytes. Among any 4 of 8 positions lies
one of 20 position triples, so the index lists fingerprints under 20 (triple, bytes) keys and
every qualifying pair meets in some list. Within a list, shared positional bytes are tallied per
pair, pairs below the guaranteed minimum are dropped, and the rest is verified bit by bit.

Exact copies fall together before the index. Crowded lists (a large group of near copies has one
per key) never emit their pairs: each member is first linked to the list's least fingerprint,
and after those links are contracted, only members outside the list's main component are
compared, in chunks, with the list; every emitted link joins two components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from changegrid.llm import text as T
from changegrid.llm.components import components
from changegrid.plans.lineage import cut

SHINGLE_WORDS = 4
MAX_BITS = 4
CHUNK = 1024


def fingerprint(data: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text's lower-cased word shingles, repeats included."""
    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    spans = zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):  # column sums of a bounded bit matrix
        bits = np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, tie: Column | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; a null text counts as having no words.

    `tie`, a long that tells texts apart, is carried along as a third column.
    """
    carried = ["doc_id"] if tie is None else ["doc_id", "tie"]
    rows = docs.select("doc_id", "text", *([] if tie is None else [tie.alias("tie")]))
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in carried), StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            raw = data.tobytes()
            fps = np.fromiter((fingerprint(raw[a:b], words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(fps.view(np.int64))], [*carried, "fp"])

    return rows.mapInArrow(run, schema)


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions such that any 4 positions contain one: triples inside a part of
    a split into three parts, and pairs of a part with one of the next part."""
    parts = [[0, 1, 2], [3, 4, 5], [6, 7]]
    inside = [t for p in parts for t in combinations(p, 3)]
    return inside + [(*two, one) for k, p in enumerate(parts) for two in combinations(p, 2) for one in parts[(k + 1) % 3]]


def _postings(fps: DataFrame) -> DataFrame:
    """(key, fp): 20 list entries per distinct fingerprint."""
    byte = lambda p: f"(shiftrightunsigned(fp, {8 * p}) & 255L)"
    keys = [f"{i}L * 16777216L + {byte(a)} * 65536L + {byte(b)} * 256L + {byte(c)}" for i, (a, b, c) in enumerate(position_triples())]
    return fps.selectExpr(f"explode(array({', '.join(keys)})) as key", "fp")


def _compare(max_bits: int):
    """Arrow function over rows sorted by cell: links between different components."""
    least = 8 - max_bits

    def links(cell_rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        asks = cell_rows["asks"]
        fp, comp = cell_rows["fp"].view(np.uint64), cell_rows["comp"]
        q, a = np.flatnonzero(asks), np.flatnonzero(~asks)
        found_u, found_v = [], []
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            differ = fp[part][:, None] ^ fp[a]
            shared = (differ.view(np.uint8).reshape(len(part), len(a), 8) == 0).sum(2) if len(a) else np.zeros((len(part), 0))
            x, y = np.nonzero((shared >= least) & (comp[part][:, None] != comp[a]))  # the tally
            close = np.bitwise_count(differ[x, y]) <= max_bits  # the verification
            pairs = np.unique(np.stack([comp[part][x[close]], comp[a][y[close]]]), axis=1)
            found_u.append(pairs[0])
            found_v.append(pairs[1])
        return np.concatenate(found_u or [np.zeros(0, np.int64)]), np.concatenate(found_v or [np.zeros(0, np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table):
            cols = {c: table[c].to_numpy() for c in ("key", "ask", "list", "fp", "comp", "asks")}
            new = np.flatnonzero((np.diff(cols["key"]) != 0) | (np.diff(cols["ask"]) != 0) | (np.diff(cols["list"]) != 0)) + 1
            edges = [0, *new.tolist(), table.num_rows]
            us, vs = zip(*(links({c: cols[c][a:b] for c in ("fp", "comp", "asks")}) for a, b in zip(edges[:-1], edges[1:])))
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            tail = [table[c][-1].as_py() for c in ("key", "ask", "list")]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == t for c, t in zip(("key", "ask", "list"), tail)])
            if same.all():
                continue  # the cell goes on
            keep = batch.num_rows - int(np.argmin(same[::-1]))
            whole = table.num_rows - batch.num_rows + keep
            yield from emit(table.slice(0, whole))
            held = [batch.slice(keep)]
        if held and sum(b.num_rows for b in held):
            yield from emit(pa.Table.from_batches(held))

    return run


def fingerprint_classes(fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(u, v) per distinct fingerprint u that is linked, directly or not, to a lesser one; v is the least.

    `fps` holds distinct non-null longs in column fp; links are pairs within `max_bits` <= 4 bits.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the position triples guarantee links of up to 4 bits")
    postings = _postings(fps)
    lists = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).where("n > 1")
    shared = cut(postings.join(lists, "key"))
    pivots = shared.where(f"fp <> pivot and bit_count(fp ^ pivot) <= {max_bits}")
    first = components(pivots.selectExpr("fp as u", "pivot as v"))

    named = cut(shared.join(first.withColumnRenamed("u", "fp"), "fp", "left").selectExpr("key", "fp", "n", "coalesce(v, fp) as comp"))
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.max("size").alias("size"), F.count("*").alias("comps"))
    open_lists = main.where("comps > 1").select("key", "main", "size")
    members = named.join(open_lists, "key").selectExpr(
        "key", "fp", "comp", "comp <> main as outside",
        f"int(ceil((n - size) / {chunk})) as asks_in", f"int(ceil(n / {chunk})) as lists_in", "int(pmod(xxhash64(fp), 2147483647)) as spread",
    )
    # Members outside the main component ask; all members are listed; a cell is one chunk of each.
    asks = members.where("outside").selectExpr(
        "key", "int(spread % asks_in) as ask", "explode(sequence(0, lists_in - 1)) as list", "fp", "comp", "true as asks"
    )
    listed = members.selectExpr("key", "explode(sequence(0, asks_in - 1)) as ask", "int(spread % lists_in) as list", "fp", "comp", "false as asks")
    cells = asks.unionByName(listed).repartition("key", "ask", "list").sortWithinPartitions("key", "ask", "list")
    second = cells.mapInArrow(_compare(max_bits), "u long, v long").distinct()
    return components(first.union(second))


def _rooted(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first_doc, root) per distinct fingerprint of (doc_id, fp): root names its class."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    classes = fingerprint_classes(distinct.select("fp"), max_bits)
    return distinct.join(classes.withColumnRenamed("u", "fp"), "fp", "left").selectExpr("fp", "first_doc", "coalesce(v, fp) as root")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp), one row per input row.

    component_id is the smallest doc_id reachable over links of at most `max_bits` bits, its own
    included. Null or blank texts have fingerprint zero and link like any other; a null doc_id
    keeps its row and is never the smallest unless nothing else is there; repeated rows stay;
    an empty table gives no rows. Extra columns are not carried.
    """
    fps = cut(fingerprints(docs, words))
    rooted = _rooted(fps, max_bits)
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "component_id"))
    out = fps.join(named, "fp")
    return out.selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') as fingerprint", "component_id", "fp")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of `docs` without near duplicates: of each class one row stays, the one with the smallest doc_id.

    Classes are those of the texts, whatever their ids: unlike texts under one doc_id, or under
    none, all stay. Rows that share the smallest doc_id of a class are settled by a hash of their
    text, then by any one of equals; a row without doc_id stays only if its class has no other.
    """
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    fps = cut(fingerprints(docs, words, tie=tie))
    rooted = cut(_rooted(fps, max_bits).select("fp", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie"))
    # Copies fall together before the classes are joined.
    per_fp = fps.groupBy("fp").agg(first.alias("first"))
    kept = cut(per_fp.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_doc"), F.col("first.tie").alias("_tie")))
    rows = docs.select(F.struct("*").alias("row"), tie.alias("tie"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie"))
    stays = rows.join(kept, same, "left_semi")
    return stays.groupBy("row.doc_id", "tie").agg(F.first("row").alias("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
