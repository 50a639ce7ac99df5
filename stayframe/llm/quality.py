"""Quality rules: statistics of whole texts, an isolation forest over them, and a threshold from labelled rows.

The forest is fitted on a bounded sample of rows labelled good, so a long path means "like good documents" and a short one
"unlike them". Statistics, scores and the threshold cover all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayframe.llm.words import (
    NOT_SPACE,
    Texts,
    Words,
    covered,
    distinct_spans,
    equal_spans,
    find_words,
    keyed_by_text,
    span_hashes,
    summed_by_text,
    text_blocks,
    whole_windows,
    window_hashes,
)

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule measures that do not grow with the length of a text; higher is worse.
RATES = ("long_words", "short_words", "symbol_rate", "dup_line_rate", "repeat_rate", "bare_rate", "stutter_rate")
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: The forest is fitted on at most this many rows labelled good, those with the smallest hash of their key.
SAMPLE_ROWS = 20_000
TREES = 100
ROWS_PER_TREE = 256
#: A measure counts from where it exceeds this share of the rows labelled good.
GOOD_SHARE = 0.99
#: Scores are compared with labels in this many equal steps from 0 to 1.
SCORE_STEPS = 1000
#: A rejected good row weighs as much as so many kept bad ones.
GOOD_WEIGHT = 20

_EVERY_BYTE = np.arange(256)
_SYMBOLS = np.isin(_EVERY_BYTE, list(b"#*$%&|<>"))
_LETTERS = ((_EVERY_BYTE | 32) >= 97) & ((_EVERY_BYTE | 32) <= 122) & (_EVERY_BYTE < 128) | (_EVERY_BYTE >= 128)
_NEWLINE = 10


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all lines; a text without bytes has none."""
    breaks = np.flatnonzero(texts.data == _NEWLINE)
    filled = np.flatnonzero(np.diff(texts.bounds) > 0)
    starts = np.sort(np.concatenate([texts.bounds[:-1][filled], breaks + 1]))
    ends = np.sort(np.concatenate([texts.bounds[1:][filled], breaks]))
    # A line break that ends a text leaves an empty last line, which has the start of the next text.
    text = np.searchsorted(texts.bounds[1:], ends, side="left")
    return starts, ends, text


def _later_duplicates(keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), dtype=bool)
    later[first] = False
    return later


def _found_twice(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _checked_windows(texts: Texts, words: Words, windows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``keys`` if windows of one text with equal keys have equal words, which is checked on the bytes; else other keys."""
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    pairs = windows[order[same]], windows[order[same + 1]]
    text = words.text_of()
    if (text[pairs[0]] == text[pairs[1]]).all() and all(
        equal_spans(texts.data, pairs[0] + i, pairs[1] + i, words.starts, words.ends).all() for i in range(REPEAT_WINDOW)
    ):
        return keys
    _, number = distinct_spans(texts.data, words.starts, words.ends)
    rows = np.stack([text[windows], *(number[windows + i] for i in range(REPEAT_WINDOW))], axis=1)
    return np.unique(rows, axis=0, return_inverse=True)[1].ravel()


def block_statistics(texts: Texts) -> dict[str, np.ndarray]:
    """The statistics of every text of a block."""
    words = find_words(texts, NOT_SPACE)
    n_words = words.counts()
    text_of_word = words.text_of()
    starts_point = ((texts.data & 0xC0) != 0x80) & NOT_SPACE[texts.data]
    starts, ends, line_text = _lines(texts)
    with_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, line_text = starts[with_word], ends[with_word], line_text[with_word]
    first, line_number = distinct_spans(texts.data, starts, ends)
    line_keys = line_text * max(len(first), 1) + line_number
    n_texts = len(texts)
    windows = whole_windows(words, REPEAT_WINDOW)
    hashes = span_hashes(texts.data, words.starts, words.ends)
    window_keys = keyed_by_text(window_hashes(hashes, REPEAT_WINDOW)[windows], text_of_word[windows])
    repeated = windows[_found_twice(_checked_windows(texts, words, windows, window_keys))]
    letters = np.concatenate([[0], np.cumsum(_LETTERS[texts.data])])
    bare = letters[words.ends] == letters[words.starts]
    same = np.zeros(len(words.starts), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text_of_word[1:] == text_of_word[:-1])
    n_lines = np.bincount(line_text, minlength=n_texts)
    found = {
        "n_words": n_words,
        "word_chars": summed_by_text(starts_point, texts.bounds),
        "n_symbols": summed_by_text(_SYMBOLS[texts.data], texts.bounds),
        "n_dup_lines": np.bincount(line_text[_later_duplicates(line_keys)], minlength=n_texts),
        "n_repeat_words": summed_by_text(covered(repeated, REPEAT_WINDOW, len(words.starts)), words.bounds),
    }
    per_word = 1.0 / np.maximum(n_words, 1)
    return found | {
        "long_words": found["word_chars"] * per_word,
        "short_words": -found["word_chars"] * per_word,
        "symbol_rate": found["n_symbols"] * per_word,
        "dup_line_rate": found["n_dup_lines"] / np.maximum(n_lines, 1),
        "repeat_rate": found["n_repeat_words"] * per_word,
        "bare_rate": summed_by_text(bare, words.bounds) * per_word,
        "stutter_rate": summed_by_text(same, words.bounds) * per_word,
    }


def _batch_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [block_statistics(texts) for texts in text_blocks(column)]
    types = {**dict.fromkeys(STATISTICS, np.int64), **dict.fromkeys(RATES, np.float64)}
    return {
        name: np.concatenate([part[name] for part in parts]).astype(kind) if parts else np.zeros(0, kind)
        for name, kind in types.items()
    }


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, :data:`STATISTICS` and :data:`RATES` of every row's whole ``text``; zeros for a null or empty text.

    Other columns are ignored, rows are neither merged nor dropped.
    """
    names = [*STATISTICS, *RATES]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _batch_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[name]) for name in names]], ["doc_id", *names])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    columns = [f"doc_id {key_type}", *[f"{name} long" for name in STATISTICS], *[f"{name} double" for name in RATES]]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(per_batch, ", ".join(columns))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def excess(found: dict[str, np.ndarray], limits: np.ndarray) -> np.ndarray:
    """By how much every measure exceeds its limit, on a logarithmic scale; one row per text."""
    return np.log1p(20 * np.maximum(np.stack([found[name] for name in RATES], axis=1) - limits, 0))


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationForest:
    """Trees as arrays: split feature (-1: leaf), split value, left child (right is the next), path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    expected_path: float

    @classmethod
    def fit(
        cls, rows: np.ndarray, high: np.ndarray, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, seed: int = 42
    ) -> IsolationForest:
        """Split the box from 0 to ``high`` at random, and count rows of a sample in its parts.

        Values are drawn from the box, not from between the sample's extremes: a measure that is 0 in all good rows
        still isolates the rows where it is not.
        """
        rng = np.random.default_rng(seed)
        own = min(rows_per_tree, len(rows))
        depth = max(1, math.ceil(math.log2(max(own, 2))))
        grown = [_tree(rows[rng.choice(len(rows), own, replace=False)], high, depth, rng) for _ in range(trees)]
        table = np.zeros((trees, max(len(tree) for tree in grown), 4))
        for k, tree in enumerate(grown):
            table[k, : len(tree)] = tree
        expected = max(float(_mean_path(own)), 1.0)
        return cls(table[:, :, 0].astype(np.int64), table[:, :, 1], table[:, :, 2].astype(np.int64), table[:, :, 3], depth, expected)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; higher: more isolated."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, value, child, path in zip(self.feature, self.value, self.child, self.path, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                split = feature[node]
                goes_right = rows[at_row, np.maximum(split, 0)] >= value[node]
                node = np.where(split < 0, node, child[node] + goes_right)
            total += path[node]
        return 2.0 ** (-total / len(self.path) / self.expected_path)


def _tree(rows: np.ndarray, high: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree: random feature, random value in the node's box, until a box is empty or ``depth`` is reached."""
    nodes: list[tuple | None] = [None]
    waiting = [(0, rows, np.zeros(len(high)), high, 0)]
    while waiting:
        at, own, low, high, level = waiting.pop()
        wide = np.flatnonzero(high > low)
        if level == depth or len(own) == 0 or len(wide) == 0:
            nodes[at] = (-1, 0.0, 0, level + float(_mean_path(len(own))))
            continue
        feature = int(rng.choice(wide))
        value = float(rng.uniform(low[feature], high[feature]))
        right = own[:, feature] >= value
        child = len(nodes)
        nodes += [None, None]
        nodes[at] = (feature, value, child, 0.0)
        cut_high, cut_low = high.copy(), low.copy()
        cut_high[feature] = cut_low[feature] = value
        waiting += [(child, own[~right], low, cut_high, level + 1), (child + 1, own[right], cut_low, high, level + 1)]
    return nodes


@dataclass(frozen=True)
class QualityModel:
    """Limits of the measures, a forest, and the score from which a text is rejected.

    Without rows labelled good there is no forest, and only the base rules reject.
    """

    limits: np.ndarray
    forest: IsolationForest | None
    threshold: float

    def scores(self, found: dict[str, np.ndarray]) -> np.ndarray:
        if self.forest is None:
            return np.zeros(len(found["n_words"]))
        return self.forest.score(excess(found, self.limits))

    def kept(self, found: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
        n_words, repeated = found["n_words"], found["n_repeat_words"]
        failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
        return ~failed & (scores < self.threshold)


def _with_scores(statistics: DataFrame, model: QualityModel) -> DataFrame:
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in (*STATISTICS, *RATES)}
            scores = model.scores(found)
            arrays = [*batch.columns, pa.array(scores), pa.array(model.kept(found, scores))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "score", "kept"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in statistics.dtypes) + ", score double, kept boolean"
    return statistics.mapInArrow(per_batch, schema)


def fit(statistics: DataFrame, labels: DataFrame, seed: int = 42) -> QualityModel:
    """Fit limits and threshold on all labelled rows, the forest on a sample of those labelled good (``quality`` 1).

    Rows that fail the base rules are rejected anyway and take no part. Null labels and labels without a document are
    ignored, repeated labels count once. The threshold is where the share of bad rows rejected less
    :data:`GOOD_WEIGHT` times the share of good rows rejected is largest; without bad rows it is out of reach.
    """
    labelled = labels.select("doc_id", "quality").where("quality in (0, 1)").distinct()
    judged = statistics.where(~base_failed()).join(labelled, "doc_id")
    good = F.col("quality") == 1
    measured = judged.agg(
        *[F.percentile_approx(F.when(good, F.col(name)), GOOD_SHARE, 10_000).alias(f"limit_{name}") for name in RATES],
        *[F.max(name).alias(f"max_{name}") for name in RATES],
        F.count(F.when(good, True)).alias("n_good"),
    ).first()
    if measured["limit_" + RATES[0]] is None:
        return QualityModel(np.zeros(len(RATES)), None, 2.0)
    limits = np.array([measured[f"limit_{name}"] for name in RATES])
    high = excess({name: np.array([measured[f"max_{name}"]]) for name in RATES}, limits)[0]
    columns = ["doc_id", *RATES]
    # Each task only offers about its share of the sample.
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    near = place <= F.lit(min(2**63 - 1, int(2**63 * (1.5 * SAMPLE_ROWS / measured["n_good"]))))
    sample = judged.where(good & near).select(*columns).orderBy(place, *columns).limit(SAMPLE_ROWS).toPandas()
    sample = sample.sort_values(columns)
    forest = IsolationForest.fit(excess({name: sample[name].to_numpy() for name in RATES}, limits), high, seed=seed)
    step = F.floor(F.col("score") * SCORE_STEPS).cast("int").alias("step")
    counted = _with_scores(judged, QualityModel(limits, forest, 2.0)).groupBy(step, "quality").count().collect()
    by_step = np.zeros((2, SCORE_STEPS + 1))
    for row in counted:
        by_step[row["quality"], row["step"]] += row["count"]
    if not by_step[0].sum():
        return QualityModel(limits, forest, 2.0)
    rejected = by_step[:, ::-1].cumsum(axis=1)[:, ::-1] / by_step.sum(axis=1, keepdims=True)
    gain = rejected[0] - GOOD_WEIGHT * rejected[1]
    # Of equal gains the middle one: as far from bad rows as from good ones.
    best = np.flatnonzero(gain == gain.max())
    return QualityModel(limits, forest, float(best[len(best) // 2]) / SCORE_STEPS)


def judge(statistics: DataFrame, model: QualityModel) -> DataFrame:
    """Statistics with ``base_failed``, ``score`` (0 to 1, higher: stranger) and ``kept``."""
    return _with_scores(statistics, model).withColumn("base_failed", base_failed())


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the rules and the forest keep, with all their columns, in one pass without a shuffle.

    Each row is judged by its text alone: null and empty texts go, repeated rows all stay or all go, whatever their doc_id.
    An empty table stays empty.
    """
    at = docs.columns.index("text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _batch_statistics(batch.column(at).cast(pa.large_binary()))
            yield batch.filter(pa.array(model.kept(found, model.scores(found))))

    return docs.mapInArrow(per_batch, docs.schema)
