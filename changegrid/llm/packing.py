"""Best-fit-decreasing packing of tokenised documents into windows.

Each input partition packs its own documents, so nothing is shuffled and a lost task is simply
run again. Within a shard of a few million tokens, overlong documents are first cut into full
windows; the rest is placed, longest first, into the open window with the tightest gap, which a
segment tree over remaining capacities finds in log(window) steps. Windows left with a wide gap
are then emptied, and their pieces laid end to end and cut, so that at most the tail of a shard
is short; the tail is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from changegrid.llm import text as T
from changegrid.llm.encoding import encoder, tokenizer_path

WINDOW = 2048
SHARD_TOKENS = 4 << 20


class CapacityTree:
    """Open windows by remaining capacity; `take` gives one with the least sufficient room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room >= need."""
        node = need + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child: nothing larger below this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.open[room].pop()
        if not self.open[room]:
            self.any[node] = 0
            while node > 1:
                node >>= 1
                self.any[node] = self.any[2 * node] | self.any[2 * node + 1]
        return room, window


def best_fit_decreasing(sizes: np.ndarray, window: int) -> list[list[int]]:
    """Windows as lists of piece numbers; every size is between 1 and `window`."""
    tree, windows = CapacityTree(window), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        found = tree.take(size)
        if found is None:
            room, at = window, len(windows)
            windows.append([])
        else:
            room, at = found
        windows[at].append(piece)
        if room > size:
            tree.put(room - size, at)
    return windows


def plan_shard(lengths: np.ndarray, window: int = WINDOW, slack: int | None = None) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that hold every token exactly once.

    `slack`: windows with at most so many free places stay as they are (default: a 64th).
    """
    slack = window // 64 if slack is None else slack
    lengths = np.asarray(lengths, np.int64)
    full = lengths // window
    doc = np.repeat(np.arange(len(lengths)), full)
    rank = T.ranges(np.zeros(len(lengths), np.int64), full)
    rows = [np.stack([doc, rank * window, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64)], 1)]
    sequence = len(doc)
    rest = np.flatnonzero(lengths % window)
    sizes, begins = lengths[rest] % window, full[rest] * window
    loose: list[int] = []
    placed: list[tuple[int, int, int, int, int]] = []
    for pieces in best_fit_decreasing(sizes, window):
        if window - int(sizes[pieces].sum()) > slack:
            loose += pieces
            continue
        offset = 0
        for p in pieces:
            placed.append((int(rest[p]), int(begins[p]), int(sizes[p]), sequence, offset))
            offset += int(sizes[p])
        sequence += 1
    left = int(sizes[loose].sum()) if loose else 0
    room, offset = _next_window(left, window), 0
    for p in loose:
        begin, size = int(begins[p]), int(sizes[p])
        while size:
            part = min(size, room - offset)
            placed.append((int(rest[p]), begin, part, sequence, offset))
            begin, size, offset, left = begin + part, size - part, offset + part, left - part
            if offset == room:
                sequence, offset, room = sequence + 1, 0, _next_window(left, window)
    rows.append(np.array(placed, np.int64).reshape(-1, 5))
    return np.concatenate(rows)


def _next_window(left: int, window: int) -> int:
    return window if left >= window else 1 << max(left, 1).bit_length() - 1


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    window: int = WINDOW,
    end_id: int = 1,
    drops_space: bool = False,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    `ids` holds the piece's token ids as little-endian unsigned 32-bit integers. A null or empty
    text is its end id alone; a null doc_id stays null; repeated rows are packed as often as they
    come; an empty table gives no pieces. Extra columns are not carried. Sequence ids are unique
    (input partition times 2^32 plus a counter); offsets in a sequence are gapless from 0.
    """
    path = tokenizer_path(tokenizer)
    doc_id = docs.schema["doc_id"]
    schema = StructType(
        [StructField("doc_id", doc_id.dataType), StructField("start", LongType()), StructField("length", LongType()),
         StructField("ids", BinaryType()), StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()), StructField("offset", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, drops_space)
        sequence = TaskContext.get().partitionId() << 32
        names, texts, sizes, held = [], [], [], 0

        def flush():
            nonlocal sequence, names, texts, sizes, held
            if held:
                keys, ids, lengths = pa.concat_arrays(names), np.concatenate(texts), np.concatenate(sizes)
                rows = plan_shard(lengths, window)
                yield from _emit(keys, ids, lengths, rows, sequence)
                sequence += int(rows[:, 3].max()) + 1
            names, texts, sizes, held = [], [], [], 0

        for batch in batches:
            for piece in T.slices(batch, step=4 << 20):
                ids, offsets = enc.encode(piece.column("text"))
                ids = np.insert(ids, offsets[1:], np.uint32(end_id))
                names.append(piece.column("doc_id"))
                texts.append(ids)
                sizes.append(np.diff(offsets) + 1)
                held += len(ids)
                if held >= shard_tokens:
                    yield from flush()
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _emit(keys, ids, lengths, rows, sequence, step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about `step` tokens each."""
    begins = np.cumsum(lengths) - lengths
    first, total = 0, np.concatenate([[0], np.cumsum(rows[:, 2])])
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(total, total[first] + step, "right")) - 1)
        doc, start, size, seq, offset = rows[first:last].T
        flat = ids[T.ranges(begins[doc] + start, size)].astype("<u4")
        where = (np.concatenate([[0], np.cumsum(size)]) * 4).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(where.tobytes()), pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(doc)), pa.array(start), pa.array(size), payload, pa.array(lengths[doc]), pa.array(seq + sequence), pa.array(offset)],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        first = last
