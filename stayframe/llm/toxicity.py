"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned with FTRL-proximal.

Every weight has a learning rate of its own and stays exactly 0 until its evidence exceeds the L1 strength, so a model is
a short list of weights. It is fitted on a bounded sample of labelled rows, read in the order of a hash of their key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.llm.words import ALPHANUMERIC, Texts, find_words, span_hashes, text_blocks, window_hashes

#: Hash space of features.
FEATURES = 1 << 22
#: The model is fitted on at most this many labelled rows, those with the smallest hash of their key, one row a key; and on
#: no further ones once they have this many features in all.
SAMPLE_ROWS = 20_000
SAMPLE_FEATURES = 48_000_000
EPOCHS = 6
#: Learning rate, its smoothing, and the L1 strength.
ALPHA, BETA, L1 = 4.0, 1.0, 10.0
#: A toxic row counts as so many others, as there are few of them.
TOXIC_WEIGHT = 4.0
#: Score from which a text is predicted toxic.
TOXIC_SCORE = 0.7


def block_features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features and the text each is in: words, pairs of neighbours, and pairs with one word skipped."""
    words = find_words(texts, ALPHANUMERIC)
    hashes = span_hashes(texts.data, words.starts, words.ends, caseless=True)
    text = words.text_of()
    found, owner = [hashes], [text]
    for reach in (1, 2):
        inside = text[reach:] == text[:-reach]
        pairs = window_hashes(np.stack([hashes[:-reach][inside], hashes[reach:][inside]], axis=1).ravel(), 2)[::2]
        found.append(pairs + np.uint64(reach))
        owner.append(text[reach:][inside])
    return (np.concatenate(found) & np.uint64(FEATURES - 1)).astype(np.int64), np.concatenate(owner)


def distinct_features(features: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every feature of a text once, texts in order."""
    keys = np.unique(owner * FEATURES + features)
    return keys % FEATURES, keys // FEATURES


@dataclass
class FtrlProximal:
    """State of the optimiser: per feature the adjusted gradient sum and the sum of squared gradients."""

    size: int = FEATURES
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)
    bias_z: float = 0.0
    bias_n: float = 0.0

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (BETA + np.sqrt(n)) / ALPHA
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / step)

    def bias(self) -> float:
        return -self.bias_z / ((BETA + np.sqrt(self.bias_n)) / ALPHA)

    def learn(self, at: np.ndarray, label: float) -> None:
        """One step on a text with the features ``at``."""
        weights, bias = self.weights(at), self.bias()
        wrong = 1 / (1 + np.exp(-np.clip(weights.sum() + bias, -35, 35))) - label
        wrong *= TOXIC_WEIGHT if label else 1.0
        square = wrong * wrong
        self.z[at] += wrong - (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / ALPHA * weights
        self.n[at] += square
        self.bias_z += wrong - (np.sqrt(self.bias_n + square) - np.sqrt(self.bias_n)) / ALPHA * bias
        self.bias_n += square


@dataclass(frozen=True)
class ToxicityModel:
    """The features with a weight, ascending, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: Texts) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.features):
            features, owner = block_features(texts)
            has_weight = np.zeros(FEATURES, dtype=bool)
            has_weight[self.features] = True
            weighted = has_weight[features]
            features, owner = distinct_features(features[weighted], owner[weighted])
            np.add.at(total, owner, self.weights[np.searchsorted(self.features, features)])
        return 1 / (1 + np.exp(-total))


def _labelled_features(labelled: DataFrame) -> DataFrame:
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(0)):
                features, owner = distinct_features(*block_features(texts))
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(features.astype(np.int32)))
                rows = slice(texts.first, texts.first + len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(1)[rows], batch.column(2)[rows], lists], ["place", "toxic", "features"])

    return labelled.select(F.col("text").cast("binary").alias("text"), "place", "toxic").mapInArrow(
        per_batch, "place long, toxic int, features array<int>"
    )


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Learn from all rows of the one partition; yields the weights that are not 0, the bias as feature -1."""
    texts: list[np.ndarray] = []
    labels: list[int] = []
    n_features = 0
    for batch in batches:
        lists = batch.column(2)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for a, b, label in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column(1).to_pylist(), strict=True):
            if n_features < SAMPLE_FEATURES:
                texts.append(values[a:b].copy())
                labels.append(label)
                n_features += b - a
    state = FtrlProximal()
    for _ in range(EPOCHS if labels else 0):
        for at, label in zip(texts, labels, strict=True):
            state.learn(at, float(label))
    used = np.flatnonzero(np.abs(state.z) > L1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(state.weights(used), state.bias()))], ["feature", "weight"]
    )


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on a sample of rows with a ``toxic`` label of 0 or 1; all keys if there are at most :data:`SAMPLE_ROWS`.

    Null labels are ignored, a doc_id without a document too; a null text is an empty one. Of rows that share a doc_id the
    one whose text has the smallest hash is taken. Without labelled rows every text scores one half. The sample is bounded
    in rows and in features (a text has at most :data:`FEATURES`), so its order and the model fit one task.
    """
    wanted = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    n_rows = wanted.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    wanted = wanted.withColumn("place", place).where(
        F.col("place") <= F.lit(min(2**63 - 1, int(2**63 * (1.5 * SAMPLE_ROWS / max(n_rows, 1)))))
    ).orderBy("place", "toxic").limit(SAMPLE_ROWS)
    # At most SAMPLE_ROWS keys, so the documents need no shuffle.
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    # A doc_id may stand on any number of rows; they are reduced to one before they meet.
    smallest = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    sample = sample.groupBy("place", "toxic").agg(smallest.alias("text"))
    ordered = _labelled_features(sample).repartition(1).sortWithinPartitions("place", "toxic", "features")
    weights = ordered.mapInArrow(_learn, "feature long, weight double").toPandas().sort_values("feature")
    own = weights[weights["feature"] >= 0]
    bias = weights.loc[weights["feature"] < 0, "weight"]
    return ToxicityModel(own["feature"].to_numpy(), own["weight"].to_numpy(), float(bias.iloc[0]) if len(bias) else 0.0)


def score(docs: DataFrame, model: Broadcast[ToxicityModel]) -> DataFrame:
    """doc_id and ``score`` (0 to 1) of the whole ``text`` of every row; an empty or null text has that of the bias."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                keys = batch.column(0)[texts.first : texts.first + len(texts)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(model.value.scores(texts))], ["doc_id", "score"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(per_batch, f"doc_id {key_type}, score double")
