"""Document likelihood under a subword unigram model, summed over all segmentations.

The vocabulary is a public one. The scores in its file are merge ranks, not log probabilities, and
are not read: the start is 1 / (rank + 10) by the file's order, and two rounds of expectation
maximisation over the training words replace it by weights fitted to the corpus. A document is its words,
each led by a space, and one end piece. No piece crosses a word start, so its probability is the
product over words of a lattice sum, which a forward recursion over byte positions computes in
log space. Each distinct word of the corpus is scored once. Single bytes are pieces too, so
every text has a positive probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegrid.llm import text as T
from changegrid.llm.encoding import tokenizer_path
from changegrid.llm.lexicon import block_table, documents_of, lexicon, lower_words, sum_values, values_by_join
from changegrid.llm.piece_counts import MARK, model
from changegrid.plans.lineage import cut

EM_ROUNDS = 2
SMOOTHING = 0.1
SCORE_BATCH = 4096
LONG_WORD = 160


class Pieces:
    """The vocabulary as byte strings: single bytes first, then longer pieces in the file's order."""

    def __init__(self, path: str):
        m = model(path)
        texts = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        longer = dict.fromkeys(t.replace(MARK, " ").encode() for t in texts)
        self.pieces = [bytes([b]) for b in range(256)] + [p for p in longer if len(p) > 1]
        self.longest = max(map(len, self.pieces))
        sizes = np.array([len(p) for p in self.pieces])
        ends = np.cumsum(sizes)
        hashes = T.span_hashes(np.frombuffer(b"".join(self.pieces), np.uint8), ends - sizes, ends)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        rank = {p: i for i, p in enumerate(longer)}
        places = np.array([rank.get(p, len(longer)) for p in self.pieces], float)
        weights = 1 / (places + 10)  # the file ranks its pieces by frequency
        self.start = np.log(weights / weights.sum())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 if none."""
        at = np.searchsorted(self.sorted, hashes)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(terms)
    top = stacked.max(0)
    return top + np.log(np.exp(stacked - top).sum(0))


class Lattices:
    """All segmentations of words that have the same number of bytes."""

    def __init__(self, pieces: Pieces, words: np.ndarray):
        n, self.length = words.shape
        self.edges: dict[tuple[int, int], np.ndarray] = {}
        flat, base = np.ascontiguousarray(words).ravel(), np.arange(n) * self.length
        spans = [(i, j) for i in range(self.length) for j in range(i + 1, min(self.length, i + pieces.longest) + 1)]
        for at in range(0, len(spans), 64):
            some = spans[at : at + 64]
            starts = np.concatenate([base + i for i, _ in some])
            ends = np.concatenate([base + j for _, j in some])
            found = pieces.find(T.span_hashes(flat, starts, ends)).reshape(len(some), n)
            self.edges |= {s: f for s, f in zip(some, found) if (f >= 0).any()}
        self.n = n

    def forward(self, log_weight: np.ndarray) -> list[np.ndarray]:
        """log_weight has -inf as its last entry, where absent pieces (-1) point."""
        alpha = [np.zeros(self.n)]
        into: dict[int, list[int]] = {}
        for i, j in self.edges:
            into.setdefault(j, []).append(i)
        for j in range(1, self.length + 1):
            alpha.append(log_sum([alpha[i] + log_weight[self.edges[i, j]] for i in into[j]]))
        return alpha

    def expected(self, log_weight: np.ndarray, count: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected uses of each piece over the words, weighted by their counts."""
        alpha = self.forward(log_weight)
        beta: list = [None] * self.length + [np.zeros(self.n)]
        out: dict[int, list[int]] = {}
        for i, j in self.edges:
            out.setdefault(i, []).append(j)
        for i in range(self.length - 1, 0, -1):
            beta[i] = log_sum([beta[j] + log_weight[self.edges[i, j]] for j in out[i]])
        uses = np.zeros(n_pieces + 1)
        for (i, j), piece in self.edges.items():
            share = np.exp(alpha[i] + log_weight[piece] + beta[j] - alpha[-1]) * count
            uses += np.bincount(piece % (n_pieces + 1), weights=share, minlength=n_pieces + 1)
        return uses[:-1]


def by_length(words: pa.Array, step: int = SCORE_BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, byte matrix with a leading space) of words of equal length."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        most = max(1, min(step, (1 << 21) // (size + 1)))
        for i in range(0, len(rows), most):
            some = rows[i : i + most]
            matrix = np.full((len(some), size + 1), 32, np.uint8)
            matrix[:, 1:] = data[offsets[some][:, None] + np.arange(size)]
            yield some, matrix


def long_word(pieces: Pieces, word: np.ndarray, log_weight: np.ndarray, count: float | None = None):
    """(log probability, expected uses or None) of one word of any length, position by position."""
    n, m = len(word), pieces.longest
    starts = np.repeat(np.arange(n), m)
    ends = starts + np.tile(np.arange(1, m + 1), n)
    found = np.full(n * m, -1, np.int64)
    fits = ends <= n
    found[fits] = pieces.find(T.span_hashes(word, starts[fits], ends[fits]))
    found = found.reshape(n, m)
    weight = log_weight[found]
    alpha = np.full(n + m + 1, -np.inf)
    alpha[0] = 0
    for i in range(n):
        alpha[i + 1 : i + 1 + m] = np.logaddexp(alpha[i + 1 : i + 1 + m], alpha[i] + weight[i])
    if count is None:
        return alpha[n], None
    beta = np.full(n + m + 1, -np.inf)
    beta[n] = 0
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce(weight[i] + beta[i + 1 : i + 1 + m])
    share = np.exp(alpha[:n, None] + weight + np.lib.stride_tricks.sliding_window_view(beta, m)[1 : n + 1] - alpha[n]) * count
    return alpha[n], np.bincount(found[found >= 0], weights=share[found >= 0], minlength=len(log_weight) - 1)


def train(counted: DataFrame, path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and, last, of the end piece.

    `counted` holds (word, c); c is the word's number of training occurrences, and the row of the
    empty word counts the ends. Only expected counts per piece, bounded by the vocabulary, come
    to the driver.
    """
    n_pieces = len(pieces_of(path).pieces)
    ends = counted.where("word = cast('' as binary)").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    weights = np.append(pieces_of(path).start, 0.0)
    for _ in range(rounds):
        log_weight = np.append(weights[:-1], -np.inf)

        def expect(batches: Iterator[pa.RecordBatch], log_weight=log_weight) -> Iterator[pa.RecordBatch]:
            pieces, uses = pieces_of(path), np.zeros(n_pieces)
            for batch in batches:
                count = batch.column("c").to_numpy().astype(float)
                for rows, words in by_length(batch.column("word")):
                    if words.shape[1] > LONG_WORD:
                        for row, word in zip(rows.tolist(), words):
                            uses += long_word(pieces, word, log_weight, count[row])[1]
                    else:
                        uses += Lattices(pieces, words).expected(log_weight, count[rows], n_pieces)
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(uses[used])], ["piece", "uses"])

        seen = counted.where("c > 0 and octet_length(word) > 0").select("word", "c").mapInArrow(expect, "piece long, uses double")
        total = np.zeros(n_pieces)
        for row in seen.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # at most one row per piece
            total[row.piece] = row.uses
        counts = np.append(total + SMOOTHING, ends + SMOOTHING)
        weights = np.log(counts / counts.sum())
    return weights


def word_scores(counted: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """(bucket, word, c, model), model being the log10 probability of each word."""
    log_weight = np.append(weights[:-1], -np.inf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            result = np.zeros(batch.num_rows)
            for rows, words in by_length(batch.column("word")):
                if words.shape[1] > LONG_WORD:
                    result[rows] = [long_word(pieces, w, log_weight)[0] for w in words]
                else:
                    result[rows] = Lattices(pieces, words).forward(log_weight)[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result / np.log(10))], ["bucket", "word", "c", "model"])

    return counted.where("octet_length(word) > 0").select("bucket", "word", "c").mapInArrow(score, "bucket int, word binary, c long, model double")


def score_documents(
    spark: SparkSession, docs: DataFrame, held_out: str, vocabulary: str = "piece_bpe_32k.model", rounds: int = EM_ROUNDS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per input row.

    `held_out` is a SQL condition over `docs`; where it is null the row trains. Tokens are words,
    A-Z lower-cased, and one end per document. A null text is empty and has its end only; empty
    tables give no rows; repeated rows count as often as they come; extra columns are not carried.
    Without training rows the model keeps the vocabulary's own scores.
    """
    path = tokenizer_path(vocabulary)
    rows = docs.selectExpr("doc_id", "text", f"coalesce({held_out}, false) as held_out").withColumn("trains", ~F.col("held_out"))
    blocks = block_table(rows, lower_words, ["doc_id", "held_out", "trains"], weigh_by="trains")
    ends = documents_of(blocks).agg(F.coalesce(F.sum(F.col("trains").cast("long")), F.lit(0)).alias("c"))
    counted = cut(lexicon(blocks).unionByName(ends.selectExpr("-1 as bucket", "cast('' as binary) as word", "c")))
    n, v = counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_ends = counted.where("octet_length(word) = 0").agg(F.sum("c")).first()[0]
    weights = train(counted, path, rounds)
    names = ["words", "known", "base", "model"]
    scored = word_scores(counted, path, weights).selectExpr("bucket", "word", "1 as words", "int(c > 0) as known", f"log10((c + 1) / ({n} + ({v} + 1))) as base", "model")
    sums = sum_values(blocks, values_by_join(blocks, scored, names), names)
    return sums.selectExpr(
        "doc_id", "held_out", "bigint(round(words)) + 1 as n_tokens", f"bigint(round(known)) + {int(n_ends > 0)} as n_known", f"{n}L as train_tokens",
        f"base + log10(({n_ends} + 1) / ({n} + ({v} + 1))) as base_score", f"model + {float(weights[-1] / np.log(10))!r}D as score",
    )
