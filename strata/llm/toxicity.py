"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training text counts as unlabelled, whatever its label says.  A
linear model in numpy minimises the class-prior-corrected risk

    prior * R(positives, +1) + max(0, R(unlabelled, -1) - prior * R(positives, -1))

with the sigmoid loss.  Where the second part falls below zero, the step goes against it, so that the model does
not learn the unlabelled positives as negatives.

Features are the words of a text and their beginnings, hashed.  Each is weighted by its class-prior-corrected log
ratio before training, so the model starts from what tells positives from the negatives hidden among the unlabelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import byte_text, stored

# Bounds of the training sample; the model is fitted on no more texts than these.
MAX_POSITIVE = 1500
MAX_UNLABELLED = 6000
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
STEPS = 300
# Weight of the square of the weights.
DECAY = 1e-3
# Standard errors by which the shares of a feature must differ.
SIGNIFICANT = 6
FOLDS = 5

_TO_WORDS = bytes.maketrans(
    bytes(range(65, 91)) + bytes(x for x in range(128) if not chr(x).isalnum()),
    bytes(range(97, 123)) + b" " * sum(not chr(x).isalnum() for x in range(128)),
)


def features(text: bytes) -> np.ndarray:
    """The distinct hashed features of a UTF-8 text: its words, and the first bytes of longer ones."""
    words = set(text.translate(_TO_WORDS).split())
    found = set(words)
    for n in PREFIXES:
        found.update({w[:n] + b"*" for w in words if len(w) > n})
    hashed = np.fromiter(map(crc32, found), np.int64, len(found)) & (BUCKETS - 1)
    return np.unique(hashed).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features(text)].sum(dtype=np.float64) + self.bias, -60, 60))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk(margin: np.ndarray, is_positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The corrected risk of texts with these margins, and the slope of each margin that a step follows.

    While the negative part is not below zero, the slopes are those of the risk; below, those of that part turned round.
    """
    n_pos, nu = int(is_positive.sum()), int((~is_positive).sum())
    as_negative = _sigmoid(margin)  # the loss for -1; that for +1 is 1 minus it
    rest = as_negative[~is_positive].mean() - prior * as_negative[is_positive].mean()
    value = prior * (1 - as_negative[is_positive]).mean() + max(0.0, rest)
    up = as_negative * (1 - as_negative)
    if rest >= 0:
        return value, np.where(is_positive, -2 * prior * up / n_pos, up / nu)
    return value, np.where(is_positive, prior * up / n_pos, -up / nu)


def _without_copies(docs: list[np.ndarray]) -> list[np.ndarray]:
    """One of the feature sets that share their five smallest mixed values: copies and most near copies."""
    mixed = lambda d: np.sort((d.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF))[:5]
    return list({mixed(d).tobytes(): d for d in docs}.values())


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> Model:
    """Weights for the features of texts, from those of positive and of unlabelled ones."""
    if not positive or not unlabelled or prior <= 0:
        return Model(np.zeros(BUCKETS, np.float32), -60.0)
    positive, unlabelled = _without_copies(positive), _without_copies(unlabelled)
    docs = positive + unlabelled
    sizes = np.array([len(d) for d in docs])
    index = np.concatenate(docs)
    row = np.repeat(np.arange(len(docs)), sizes)
    n_pos, nu = len(positive), len(unlabelled)
    in_positive = np.bincount(index[row < n_pos], minlength=BUCKETS)
    in_unlabelled = np.bincount(index[row >= n_pos], minlength=BUCKETS)
    p = (in_positive + 0.5) / (n_pos + 1)
    n = np.maximum(in_unlabelled / nu - prior * in_positive / n_pos, 0) / (1 - prior) + 0.5 / (nu + 1)
    # A feature counts only where its shares differ by more than chance explains.
    share = (in_positive + in_unlabelled + 1) / (n_pos + nu + 1)
    chance = np.sqrt(share * (1 - share) * (1 / n_pos + 1 / nu))
    scale = np.where((np.abs(p - n) > SIGNIFICANT * chance) & (np.abs(np.log(p / n)) > 1), np.log(p / n), 0.0)
    used = np.flatnonzero(scale)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    at = place[index]
    row, at = row[at >= 0], at[at >= 0]
    value = scale[used][at]
    is_positive = np.arange(len(docs)) < n_pos
    w, b = np.full(len(used), 0.2), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(row, weights=w[at] * value, minlength=len(docs)) + b
        _, slope = risk(margin, is_positive, prior)
        grad = np.append(np.bincount(at, weights=slope[row] * value, minlength=len(used)) + DECAY * w, slope.sum())
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad**2 - square)
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * scale[used]
    return Model(weights, float(b))


def held_out(id_col: str) -> Column:
    """Whether a row belongs to the fold that is never learnt from; rows without an id belong to none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["positive", "features"])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """A model from the training folds of ``labels`` and ``docs``.

    Learns from at most ``max_positive`` labelled toxic texts and ``max_unlabelled`` others, those with the smallest
    hashes of their ids; the class prior is the share of toxic rows among all labelled rows of the training folds.
    An id labelled more than once is toxic if any of its labels says so; null ids and labels are left out.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    )
    shares = known.agg(F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic")).first()
    if not shares.rows or not shares.toxic:
        return fit([], [], 0.0)
    ids = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"))
    positive = known.where("toxic = 1").select("id").orderBy(F.xxhash64("id"), "id").limit(max_positive)
    others = ids.join(known.where("toxic = 1"), "id", "left_anti").distinct()
    unlabelled = others.orderBy(F.xxhash64("id"), "id").limit(max_unlabelled)
    chosen = stored(
        positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False))), "chosen"
    )
    # A bounded number of short rows.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), byte_text(text_col).alias("text")).join(
        F.broadcast(chosen), "id"
    )
    # Repeated rows of a chosen id count once.
    texts = texts.groupBy("id", "positive").agg(F.min("text").alias("text")).select("positive", "text")
    sample = texts.mapInArrow(_feature_batches, "positive boolean, features binary").toArrow()
    # Rows come in any order, sums of floats would differ with it.
    rows = sorted(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist(), strict=True))
    read = lambda want: [np.frombuffer(f, np.int32) for p, f in rows if p == want]
    return fit(read(True), read(False), float(shares.toxic) / shares.rows)


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["id", "held_out", "score", "predicted"],
            )

    return run


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    The score depends on nothing but the text; null texts count as empty.  Without any toxic label in the training
    folds every score is (nearly) 0.  Repeated rows are repeated; an empty table gives an empty result; other
    columns are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col, max_positive, max_unlabelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), byte_text(text_col).alias("text"))
    scored = rows.mapInArrow(_score_batches(model), "id long, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all columns."""
    model = train(docs, labels, id_col, text_col)
    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.score((t or "").encode()) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
