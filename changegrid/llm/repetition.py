"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines.

All word n-grams of a slice of documents are hashed at once by a rolling recurrence over word
hashes, for several lengths; an n-gram counts as repeated when its document holds it at least
twice. Shares are taken of the characters in words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from changegrid.llm import text as T

# Most of a text's characters that repeated n-grams of each length may hold, as published
# for web corpora (Rae et al. 2021, table A1). Longer n-grams repeat less by chance: lower limits.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
LEAST_WORDS = 10
BASE_NGRAM, BASE_PERCENT = 5, 20
SYMBOLS = b"#*$%&|<>"

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[*SYMBOLS]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True where a key comes at least twice in its group."""
    mixed = T.mix(keys + group.astype(np.uint64) * _STEP)
    order = np.argsort(mixed, kind="stable")
    ordered = mixed[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    result = np.empty(len(keys), bool)
    result[order] = same[1:] | same[:-1]
    return result


def seen_before(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True where the same key came earlier in its group."""
    mixed = T.mix(keys + group.astype(np.uint64) * _STEP)
    order = np.argsort(mixed, kind="stable")
    result = np.zeros(len(keys), bool)
    result[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
    return result


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts and shares of each document of a slice."""
    docs = len(offsets) - 1
    start, end, doc = T.word_bounds(data, offsets)
    first_bytes = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # one per code point
    chars = first_bytes[end] - first_bytes[start]
    hashes = T.span_hashes(data, start, end)
    per_doc = lambda values, where: np.bincount(where, weights=values, minlength=docs).astype(np.int64)
    out = {"n_words": np.bincount(doc, minlength=docs), "word_chars": per_doc(chars, doc)}
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    # Lines end at \n and at the end of their document; only those with a word count.
    breaks = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    line_start, line_end = breaks[:-1], breaks[1:]
    line_end = line_end - (data[line_end - 1] == 10) if len(line_end) else line_end
    words_before = np.searchsorted(start, [line_start, line_end]) if len(start) else np.zeros((2, len(line_start)), int)
    worded = words_before[1] > words_before[0]
    line_start, line_end, words_before = line_start[worded], line_end[worded], words_before[:, worded]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_keys = T.span_hashes(data, line_start, line_end)
    total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = total[words_before[1]] - total[words_before[0]]
    again = seen_before(line_keys, line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=docs)
    out["line_chars"] = per_doc(line_chars[repeated(line_keys, line_doc)], line_doc[repeated(line_keys, line_doc)])

    rolled, n = hashes.copy(), 1
    for want in range(2, max(lengths, default=1) + 1):
        if len(rolled) < 2:
            rolled = rolled[:0]
        else:
            rolled = rolled[:-1] * _STEP + hashes[want - 1 :]
        if want not in lengths:
            continue
        last = np.arange(want - 1, len(doc))
        inside = doc[: len(rolled)] == doc[last]
        twice = np.flatnonzero(inside)[repeated(rolled[inside], doc[: len(rolled)][inside])]
        covered = np.zeros(len(doc) + 1, np.int64)
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + want, -1)
        hit = np.cumsum(covered[:-1]) > 0
        out[f"chars_{want}"] = per_doc(chars[hit], doc[hit])
        if want == BASE_NGRAM:
            out["n_repeat_words"] = np.bincount(doc[hit], minlength=docs)
    return out


def repetition_rules(docs: DataFrame, ngram_limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    line_share, share_N...), one row per input row.

    `base_failed`: fewer than 10 words, or over 20 % of the words in repeated five-word windows.
    `kept`: not base_failed, and no share above its limit. A null, empty or blank text has zero
    counts and shares and fails. Null doc_ids and repeated rows stay; an empty table gives no
    rows; extra columns are not carried.
    """
    lengths = tuple(sorted({*ngram_limits, BASE_NGRAM}))
    shares = {"line_share": ("line_chars", line_limit)} | {f"share_{n}": (f"chars_{n}", ngram_limits[n]) for n in sorted(ngram_limits)}
    schema = StructType(
        [StructField("doc_id", docs.schema["doc_id"].dataType)] + [StructField(c, LongType()) for c in COUNTS]
        + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())] + [StructField(c, DoubleType()) for c in shares]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch, step=2 << 20):
                m = measure(*T.utf8(piece.column("text")), lengths)
                failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
                found = {c: m[of] / np.maximum(m["word_chars"], 1) for c, (of, _) in shares.items()}
                kept = ~failed
                for c, (_, limit) in shares.items():
                    kept &= found[c] <= limit
                columns = [piece.column("doc_id"), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in found.values()], [f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
