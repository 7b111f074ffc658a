"""Token counts of whole texts without token ids.

The vocabulary's pieces hold word marks only in front, so a text's pieces never cross the start
of a run of marks. Each pre-token (marks and what follows them) is counted once per corpus, and
counts are joined to the pre-token frequencies of each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegrid.llm import text as T
from changegrid.llm.encoding import tokenizer_path
from changegrid.llm.lexicon import block_table, sum_values, values_by_rule

MARK = "▁"


def pretokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, document) of runs of spaces with what follows; each text gets a space in front."""
    column = pc.replace_substring(pc.fill_null(column, ""), MARK, " ")
    column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(" ", column, ""))
    data, offsets = T.utf8(column)
    space = data == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(begins)
    return data, start, np.append(start[1:], len(data)), np.searchsorted(offsets, start, "right") - 1


_MODELS: dict[str, object] = {}


def model(path: str):
    """The vocabulary, loaded once per Python worker."""
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def count_pieces(words: list[bytes], path: str) -> np.ndarray:
    """Pieces of distinct pre-tokens, each beginning with a space; an array of one row."""
    m = model(path)
    # The model puts its own mark in front of a text, in place of the first space.
    counts = np.fromiter((len(x) for x in m.encode([w[1:].decode() for w in words], num_threads=1)), np.int64, len(words))
    bare = len(m.encode("a ")) - len(m.encode("a"))  # a mark alone; the model keeps white space
    return np.where(np.fromiter((w == b" " for w in words), bool, len(words)), bare, counts)[None, :]


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    Null or empty texts have no bytes and no tokens; special strings in a text are ordinary text;
    null doc_ids and repeated rows stay as they are; an empty table gives no rows. Extra columns
    are not carried.
    """
    path = tokenizer_path(vocabulary)
    rows = docs.selectExpr("doc_id", "text", "coalesce(octet_length(text), 0L) as n_bytes")
    blocks = block_table(rows, pretokens, ["doc_id", "n_bytes"])
    totals = sum_values(blocks, values_by_rule(blocks, lambda words: count_pieces(words, path)), ["pieces"])
    n = F.round("pieces").cast("long")
    return totals.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))
