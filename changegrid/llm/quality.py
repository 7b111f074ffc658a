"""Quality classifier learned from trusted positives and unlabelled text.

Non-negative positive-unlabelled risk: with class prior p, the negatives' share of the loss is
the unlabelled loss less p times the positives' loss as negatives; where that estimate falls
below zero, its gradient is turned back instead of followed. The model is linear in the square
roots of hashed character-trigram shares and a few shape features of the text, so it sees the
whole text and nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from changegrid.llm import text as T
from changegrid.plans.lineage import cut

HASH_BITS = 10
SAMPLE_ROWS = 8_000
THRESHOLD = 0.3
STEPS, BATCH, RATE, DECAY = 3_000, 512, 0.02, 1e-4

_KIND = np.zeros(256, np.uint8)  # 0 letter, 1 digit, 2 upper case, 3 space, 4 line end, 5 other sign
_KIND[33:128] = 5
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 0
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[10] = 4
N_SHAPE = 12
SHORT_BYTES = 200  # trigram shares of texts about this long or shorter are shrunk
N_FEATURES = (1 << HASH_BITS) + N_SHAPE


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One float32 row per document."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    folded = T.LOWER[data].astype(np.uint32)
    upper = _KIND[data] == 2
    grams = np.zeros(len(data), np.int64)
    if len(data) > 2:
        code = folded[:-2] * np.uint32(0x01000193) ^ (folded[1:-1] * np.uint32(0x9E3779B1)) ^ (folded[2:] * np.uint32(0x85EBCA77))
        grams[:-2] = (code * np.uint32(0xC2B2AE35)) >> np.uint32(32 - HASH_BITS)
    kinds = _KIND[data]
    start, end, doc = T.word_bounds(data, offsets)
    hashes = T.span_hashes(T.LOWER[data], start, end) if len(start) else np.zeros(0, np.uint64)
    word_edges = np.searchsorted(doc, np.arange(n + 1))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a > 2:
            counts = np.bincount(grams[a : b - 2], minlength=1 << HASH_BITS)
            out[i, : 1 << HASH_BITS] = np.sqrt(counts / (b - a - 2 + SHORT_BYTES))
        size = max(b - a, 1)
        share = np.bincount(kinds[a:b], minlength=6) / size
        words = hashes[word_edges[i] : word_edges[i + 1]]
        distinct = len(np.unique(words)) / len(words) if len(words) else 0.0
        again = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0
        shape = [
            share[1], share[2], share[3], 10 * share[4], share[5], upper[a:b].sum() / max((kinds[a:b] == 0).sum() + upper[a:b].sum(), 1),
            np.log1p(len(words)) / 10, distinct, (b - a) / max(len(words), 1) / 10, float(len(words) == 0), again, float(again > 0.1),
        ]
        out[i, 1 << HASH_BITS :] = shape
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = 0) -> Model:
    """Minimise the non-negative risk with logistic loss by Adam."""
    rng = np.random.default_rng(seed)
    scale = np.maximum(np.concatenate([positive, unlabelled]).std(0), 1e-3)
    positive, unlabelled = positive / scale, unlabelled / scale
    centre = unlabelled.mean(0)
    positive -= centre
    unlabelled -= centre
    w, b = np.zeros(positive.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), BATCH)]
        u = unlabelled[rng.integers(0, len(unlabelled), BATCH)]
        fp, fu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        as_negative = np.append(su @ u / len(u) - prior * (sp @ p) / len(p), su.mean() - prior * sp.mean())
        as_positive = prior * np.append((sp - 1) @ p / len(p), (sp - 1).mean())
        grad = as_positive + as_negative if negative >= 0 else -as_negative
        grad[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE / np.sqrt(1 + 10 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = w / scale
    return Model(weights, float(b - centre @ w), prior)


def _featured(docs: DataFrame) -> DataFrame:
    """(role, x): float32 features of the sampled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch, step=2 << 20):
                rows = features(*T.utf8(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("role"), pa.array([r.tobytes() for r in rows], pa.binary())], ["role", "x"])

    return docs.select("role", "text").mapInArrow(run, "role int, x binary")


def train(docs: DataFrame, labels: DataFrame, held_out: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most `sample_rows` trusted positives and as many unlabelled documents.

    `held_out` is a SQL condition over doc_id; such rows, and rows it is null for, teach nothing.
    Both samples are the least by a hash of doc_id. The class prior is the positives' share of
    all labelled training rows. One task fits the model, on the bounded sample alone; only its
    weights come to the driver. None if there are no positives.
    """
    known = labels.where(f"not ({held_out})").where("quality is not null").select("doc_id", "quality")
    prior = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    if not prior:
        return None
    by_hash = F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")
    positives = known.where("quality = 1").select("doc_id").distinct().orderBy(*by_hash).limit(sample_rows).selectExpr("doc_id", "1 as role")
    others = docs.where(f"not ({held_out})").select("doc_id").distinct().orderBy(*by_hash).limit(sample_rows).selectExpr("doc_id", "0 as role")
    sample = cut(positives.union(others))
    # At most 2 * sample_rows ids; of rows that share one, the least text stands for it.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "role").agg(F.min("text").alias("text"))
    width = N_FEATURES * 4

    def learn(rows: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
        role = rows["role"].to_numpy()
        if not (role == 1).any() or not (role == 0).any():
            return pa.table({"weights": pa.array([], pa.binary()), "bias": pa.array([], pa.float64())})
        positive, unlabelled = x[role == 1], x[role == 0]
        del x
        model = fit(positive, unlabelled, min(prior, 0.99))
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": pa.array([model.bias])})

    featured = cut(_featured(chosen).where(f"octet_length(x) = {width}"))
    found = featured.withColumn("all", F.col("role") * 0).groupBy("all").applyInArrow(learn, "weights binary, bias double").collect()
    return Model(np.frombuffer(found[0].weights), found[0].bias, prior) if found else None


def _scored(docs: DataFrame, labels: DataFrame, held_out: str, sample_rows: int) -> DataFrame:
    """(held_out, score, row): `row` is the whole input row, so no name can clash."""
    model = train(docs, labels, held_out, sample_rows)
    rows = docs.select(F.expr(f"coalesce({held_out}, false)").alias("held_out"), F.struct("*").alias("row"))
    schema = StructType([rows.schema["held_out"], StructField("score", DoubleType()), rows.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch, step=2 << 20):
                scores = np.full(piece.num_rows, 0.5) if model is None else model.score(features(*T.utf8(T.text_of(piece))))
                yield pa.RecordBatch.from_arrays([piece.column("held_out"), pa.array(scores.astype(float)), piece.column("row")], ["held_out", "score", "row"])

    return rows.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, held_out: str, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Labels, language, source and doc_id are no inputs of a score. Null texts count as empty and
    are scored; where nothing can be learned every score is 0.5; null doc_ids are not held out
    and teach nothing; repeated rows stay; empty tables give no rows; extra columns are not kept.
    """
    scored = _scored(docs.select("doc_id", "text"), labels, held_out, sample_rows)
    return scored.select("row.doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, held_out: str, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns."""
    kept = _scored(docs, labels, held_out, sample_rows).where(F.col("score") >= threshold)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
