"""Numpy views of Arrow text columns: bytes, words, word hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D. All helpers work on a whole
batch at once; `slices` bounds how much text one step holds, however long the documents are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
STEP_BYTES = 8 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LANE = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The text column, or the text field of a column `row` that holds whole rows."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def slices(batch: pa.RecordBatch, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about `step` bytes of text, or one longer document."""
    _, offsets = utf8(text_of(batch))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every word, in order; words never cross documents."""
    inside = ~IS_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that low bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for all spans at once, eight bytes a step."""
    lanes = np.ndarray(len(data) + 1, np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]).data, 0, (1,))
    size = end - start
    result = (lanes[start] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _LANE
    result *= _LANE
    result ^= result >> np.uint64(29)
    done, longer = 8, np.flatnonzero(size > 8)
    while len(longer):
        lane = lanes[start[longer] + done] & _LOW_BYTES[np.minimum(size[longer] - done, 8)]
        step = (result[longer] ^ lane) * _LANE
        result[longer] = step ^ (step >> np.uint64(32))
        done += 8
        longer = longer[size[longer] > done]
    return mix(result)


def take_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The bytes of each span."""
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+length[0]-1, start[1] .., in one array."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - length), length) + np.arange(total)
