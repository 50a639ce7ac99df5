"""Regression trees grown on histograms: forests bagged by key, and boosting.

Features are cut into bins once. Each pass over the rows then adds up, for every open node, feature and bin, the number of
drawn rows and their labels, and every node is split where the squared error falls most. Nodes that few rows reach are not
worth a pass for each level below them: their rows are brought together once, and the subtree is grown where they are,
by the same rules.

Labels are added up as whole numbers, and whether and how often a tree draws a row comes from a hash of the row's key and
the tree's number. So equal rows and settings give equal trees, however the rows are spread over the cluster.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.session import written

#: Bin bounds come from at most about so many values, of rows with the smallest hashes of their keys.
SAMPLE_VALUES = 4_000_000
#: A node that at most so many drawn rows reach is finished where its rows are brought together.
LOCAL_ROWS = 1 << 17
#: Histogram cells that a task holds at a time; more take further passes.
CELLS = 1 << 24
#: Rows that travel together, as one record of byte strings.
BLOCK_ROWS = 1 << 15
#: Rows after which a task turns sums in doubles into whole numbers, so that they stay exact.
EXACT_ROWS = 1 << 20
#: Histogram cells of a group of nodes that are split together.
CHUNK_CELLS = 1 << 16
#: Bytes of histograms, of all tasks, up to which the driver adds them up itself.
DRIVER_BYTES = 1 << 24
#: What a pass costs besides its histograms, in bytes shuffled in the same time: as a job, and for every row and tree it goes through.
PASS_BYTES, PASS_ROW_BYTES = 1 << 23, 0.5
#: Histogram cells that are searched for splits together; so few stay in a core's cache.
SPLIT_CELLS = 1 << 16
#: Rows whose subtrees are grown one after the other; so few stay in a core's cache.
CACHED_ROWS = 1 << 16
#: Levels of a tree that are looked up at once; the nodes below them are bits of one number.
LOOKED_UP = 6
#: Rows from which the tables for that are worth building.
LEAST_LOOKED_UP = 4096
#: Labels are split into two whole numbers of so many bits, high and low.
HIGH_BITS, LOW_BITS = 27, 28
#: Boosting keeps what is left over in memory after so many trees, so that later passes need not work it out again.
KEPT_EVERY = 4
#: And it writes that after so many, so that nothing older is worked out again when an executor is lost.
STORED_EVERY = 20
#: Gains below this share of a node's own term are rounding.
LEAST_GAIN = 1e-12
MISSING = float("nan")


@dataclass(frozen=True)
class TreeSettings:
    """Parameters by their common names.

    ``max_features`` is a share below 1.0, a whole number of features, or None for all of them. ``min_samples_split`` may be
    a share too. ``max_leaf_nodes`` grows best first: the split that lowers the error most comes first, wherever it is.
    """

    n_estimators: int = 100
    max_depth: int = 5
    max_features: float | int | None = None
    min_samples_leaf: int = 1
    min_samples_split: float | int = 2
    max_leaf_nodes: int | None = None
    random_state: int = 42
    bootstrap: bool = True
    max_bins: int = 32
    learning_rate: float = 0.1

    @classmethod
    def of(cls, params: Mapping) -> TreeSettings:
        unknown = sorted(set(params) - set(cls.__dataclass_fields__))
        if unknown:
            raise ValueError(f"unknown tree parameters {unknown}")
        settings = cls(**params)
        if not 1 <= settings.max_depth <= 30 or not 2 <= settings.max_bins <= 256 or settings.n_estimators < 1:
            raise ValueError("max_depth is 1 to 30, max_bins 2 to 256, and n_estimators at least 1")
        if settings.max_leaf_nodes is not None and settings.max_leaf_nodes < 2:
            raise ValueError("max_leaf_nodes is 2 or more")
        return settings

    def features_per_node(self, features: int) -> int:
        if self.max_features is None:
            return features
        share = isinstance(self.max_features, float) and self.max_features <= 1.0
        return min(features, max(1, int(self.max_features * features if share else self.max_features)))

    def for_rows(self, n: int) -> TreeSettings:
        """The settings with ``min_samples_split`` as a number of rows."""
        least = self.min_samples_split
        return replace(self, min_samples_split=max(2, math.ceil(least * n)) if isinstance(least, float) and least <= 1.0 else int(least))


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values spread over all their bits."""
    # In place, as rows times trees go through here.
    values = values + np.uint64(0x9E3779B97F4A7C15)
    shifted = values >> np.uint64(30)
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        values ^= shifted
        values *= np.uint64(factor)
        np.right_shift(values, np.uint64(shift), out=shifted)
    values ^= shifted
    return values


_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def drawn(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws every row: by the hash of the row's key, after Poisson's law of mean 1."""
    salt = _mixed(np.array([seed], dtype=np.int64).view(np.uint64) ^ _mixed(np.array([tree], dtype=np.uint64)))
    mixed = _mixed(keys.view(np.uint64) ^ salt)
    times = _BY_FIRST_BITS[(mixed >> np.uint64(52)).view(np.int64)]
    close = np.flatnonzero(times < 0)
    times[close] = np.searchsorted(_DRAWN, (mixed[close] >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")
    return times


def _drawn_table() -> np.ndarray:
    """How often a row is drawn, by the first 12 bits of its hash; -1 where these do not tell."""
    first = np.searchsorted(_DRAWN, np.arange(4096) / 4096.0, side="right")
    last = np.searchsorted(_DRAWN, (np.arange(1, 4097) - 2.0**-41) / 4096.0, side="right")
    return np.where(first == last, first, -1).astype(np.int8)


_BY_FIRST_BITS = _drawn_table()


def considered(tree: int, nodes: np.ndarray, features: int, of: int, seed: int) -> np.ndarray:
    """The ``of`` features that every node may split on, in ascending order; by the hash of tree and node."""
    if of == features:
        return np.broadcast_to(np.arange(features), (len(nodes), features))
    salt = _mixed(np.array([seed], dtype=np.int64).view(np.uint64) + _mixed(np.array([tree], dtype=np.uint64)))
    draw = _mixed(_mixed(nodes.astype(np.uint64) ^ salt)[:, None] + np.arange(features, dtype=np.uint64))
    return np.sort(np.argsort(draw, axis=1, kind="stable")[:, :of], axis=1)


@dataclass(frozen=True)
class Tree:
    """Nodes by ascending number: 1 is the root, 2i and 2i + 1 are below i. ``feature`` is -1 for a leaf.

    A row goes left (to ``left``, a place in these arrays) if its bin is at most ``bin``, else to the next place.
    """

    number: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    weight: np.ndarray
    total: np.ndarray

    @property
    def left(self) -> np.ndarray:
        return np.where(self.feature >= 0, np.searchsorted(self.number, 2 * self.number), 0)

    @property
    def value(self) -> np.ndarray:
        return self.total / np.maximum(self.weight, 1)

    def without(self, closed: np.ndarray) -> Tree:
        """The tree with the nodes of these numbers as leaves."""
        feature = np.where(np.isin(self.number, closed), -1, self.feature)
        keep = np.zeros(len(self.number), dtype=bool)
        keep[0] = True
        for place in range(len(self.number)):
            if keep[place] and feature[place] >= 0:
                keep[np.searchsorted(self.number, 2 * self.number[place]) + np.arange(2)] = True
        return Tree(self.number[keep], feature[keep], self.bin[keep], self.gain[keep], self.weight[keep], self.total[keep])


_COLUMNS = (("number", np.int64), ("feature", np.int32), ("bin", np.int32), ("gain", np.float64), ("weight", np.int64), ("total", np.float64))


def _tree(parts: Sequence[Sequence[np.ndarray]]) -> Tree:
    arrays = [np.concatenate([np.asarray(part[i], dtype=kind) for part in parts]) for i, (_, kind) in enumerate(_COLUMNS)]
    order = np.argsort(arrays[0])
    return Tree(*[values[order] for values in arrays])


class Pairs:
    """The bins of every two neighbouring features of rows as one number; worked out once for all trees."""

    def __init__(self, bins: np.ndarray, n_bins: int):
        self.bins, self.side = bins, n_bins
        width = bins.shape[1]
        self.numbers = [
            bins[:, f].astype(np.int64) * n_bins + bins[:, f + 1] if f + 1 < width else bins[:, f].astype(np.int64) for f in range(0, width, 2)
        ]


class Router:
    """Finds the node that rows reach in a tree."""

    def __init__(self, tree: Tree):
        # A node in one number: the place to its left, the feature, the bin. A leaf leads to itself.
        inner = tree.feature >= 0
        left = np.where(inner, tree.left, np.arange(len(inner))).astype(np.int64)
        self.code = (left << 32) | (np.where(inner, tree.feature, 0).astype(np.int64) << 8) | np.where(inner, tree.bin, 255)
        self.steps = int(tree.number[-1]).bit_length() - 1
        self.looked_up: tuple | None = None

    def places(self, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Of all rows of ``bins``, or of these."""
        flat, width = bins.reshape(-1), bins.shape[1]
        starts = np.arange(0, len(bins) * width, max(width, 1)) if rows is None else rows * width
        if not self.steps:
            return np.zeros(len(bins) if rows is None else len(rows), dtype=np.int64)
        root = int(self.code[0])
        at = (flat[starts + (root >> 8 & 0xFFFFFF)] > (root & 255)) + (root >> 32)
        return self._walked(flat, starts, at, self.steps - 1)

    def _walked(self, flat: np.ndarray, starts: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            code = self.code[at]
            at = code >> 32
            at += flat[starts + (code >> 8 & 0xFFFFFF)] > (code & 255).astype(np.uint8)
        return at

    def places_of(self, pairs: Pairs, rows: np.ndarray | None = None) -> np.ndarray:
        """As :meth:`places`. The first levels are looked up: of each pair of bins, in which nodes of that depth a row can be."""
        width = pairs.bins.shape[1]
        known = self.looked_up is not None and self.looked_up[0] == pairs.side
        if self.steps < 4 or pairs.side > 64 or width > 16 or (not known and len(pairs.bins) < LEAST_LOOKED_UP):
            return self.places(pairs.bins, rows)
        if not known:
            self.looked_up = pairs.side, *self._tables(pairs.side, width)
        _, tables, place = self.looked_up
        left = None
        for table, number in zip(tables, pairs.numbers, strict=True):
            found = table[number if rows is None else number[rows]]
            left = found if left is None else np.bitwise_and(left, found, out=left)
        # One bit is left, that of the node; the number of ones below it is its rank.
        left -= np.uint64(1)
        at = place[np.bitwise_count(left)]
        if self.steps > LOOKED_UP:
            starts = np.arange(0, pairs.bins.size, width) if rows is None else rows * width
            at = self._walked(pairs.bins.reshape(-1), starts, at, self.steps - LOOKED_UP)
        return at

    def _tables(self, side: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Per pair of features, for each pair of bins, the nodes ``LOOKED_UP`` levels down (or leaves above) that allow it, as bits."""
        nodes = [(0, np.zeros(width, dtype=np.int64), np.full(width, side, dtype=np.int64))]
        for _ in range(LOOKED_UP):
            below = []
            for at, low, high in nodes:
                code = int(self.code[at])
                place, feature, cut = code >> 32, code >> 8 & 0xFFFFFF, code & 255
                if place == at:
                    below.append((at, low, high))
                    continue
                left_high, right_low = high.copy(), low.copy()
                left_high[feature], right_low[feature] = min(high[feature], cut + 1), max(low[feature], cut + 1)
                below += [(place, low, left_high), (place + 1, right_low, high)]
            nodes = below
        low, high = (np.stack([node[i] for node in nodes]) for i in (1, 2))
        bit = np.uint64(1) << np.arange(len(nodes), dtype=np.uint64)
        bins = np.arange(side)
        allowed = (low[:, :, None] <= bins) & (bins < high[:, :, None])
        bits = np.bitwise_or.reduce(np.where(allowed, bit[:, None, None], np.uint64(0)), axis=0)
        tables = [(bits[f][:, None] & bits[f + 1]).reshape(-1) if f + 1 < width else bits[f] for f in range(0, width, 2)]
        return tables, np.array([node[0] for node in nodes], dtype=np.int64)


@dataclass(frozen=True)
class Labels:
    """Labels as whole numbers ``high`` and ``low``: exact to 55 bits of the largest, and exactly added up in any order."""

    exponent: int

    def split(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.ldexp(values, self.exponent)
        high = np.floor(scaled)
        return high.astype(np.int64), np.rint((scaled - high) * 2.0**LOW_BITS).astype(np.int64)

    def joined(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = low * 2.0**-LOW_BITS
        out += high
        # A power of two scales exactly, like ldexp, which is far slower.
        return out * 2.0**-self.exponent if abs(self.exponent) < 1000 else np.ldexp(out, -self.exponent)


@dataclass(frozen=True)
class Splits:
    """The best split of every node; ``feature`` is -1 where none lowers the error. ``left_total`` and ``left_weight`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    weight: np.ndarray
    total: np.ndarray
    left_weight: np.ndarray
    left_total: np.ndarray


def best_splits(
    weight: np.ndarray, high: np.ndarray, low: np.ndarray, features: np.ndarray, labels: Labels, settings: TreeSettings
) -> Splits:
    """``weight[node, k, bin]`` holds the drawn rows for the k-th of a node's ``features``, ``high`` and ``low`` their labels' sums.

    All are whole numbers, as doubles only if these hold their sums exactly. Of equal gains that of the first feature and bin counts.
    """
    n, k, bins = weight.shape
    step = max(1, SPLIT_CELLS // max(3 * k * bins, 1))
    found = [
        _best_splits(*[np.cumsum(sums[at : at + step], axis=2) for sums in (weight, high, low)], features[at : at + step], labels, settings)
        for at in range(0, max(n, 1), step)
    ]
    return _joined_splits(found)


def _joined_splits(found: Sequence[Splits]) -> Splits:
    if len(found) == 1:
        return found[0]
    return Splits(*[np.concatenate([getattr(part, name) for part in found]) for name in Splits.__dataclass_fields__])


def _best_splits(weights: np.ndarray, highs: np.ndarray, lows: np.ndarray, features: np.ndarray, labels: Labels, settings: TreeSettings) -> Splits:
    """Of sums over all bins up to each."""
    n, _, bins = weights.shape
    weight, total = weights[:, 0, -1], labels.joined(highs[:, 0, -1], lows[:, 0, -1])
    left_weight, left_total = weights[:, :, :-1], labels.joined(highs[:, :, :-1], lows[:, :, :-1])
    right_weight = weight[:, None, None] - left_weight
    right_total = labels.joined(highs[:, :1, -1:] - highs[:, :, :-1], lows[:, :1, -1:] - lows[:, :, :-1])
    own = total * total / np.maximum(weight, 1)
    gain = left_total * left_total
    gain /= np.maximum(left_weight, 1)
    right_total *= right_total
    right_total /= np.maximum(right_weight, 1)
    gain += right_total
    gain -= own[:, None, None]
    gain[(left_weight < settings.min_samples_leaf) | (right_weight < settings.min_samples_leaf)] = -1.0
    gain = gain.reshape(n, -1)
    best = np.argmax(gain, axis=1) if gain.shape[1] else np.zeros(n, dtype=np.int64)
    if not gain.shape[1]:
        gain = np.full((n, 1), -1.0)
    rows = np.arange(n)
    gained = gain[rows, best]
    which, at = best // max(bins - 1, 1), best % max(bins - 1, 1)
    good = (gained > LEAST_GAIN * np.maximum(own, np.finfo(float).tiny)) & (weight >= settings.min_samples_split)
    if bins < 2:
        good[:] = False
        left_weight, left_total = weight[:, None, None], total[:, None, None]
    return Splits(
        np.where(good, features[rows, which], -1), np.where(good, at, 0), np.where(good, gained, 0.0), weight.astype(np.int64), total,
        left_weight[rows, which, at].astype(np.int64), left_total[rows, which, at],
    )


def _add_histogram(
    out: np.ndarray, slots: np.ndarray, features: np.ndarray, bins: np.ndarray, rows: np.ndarray | None, n_bins: int, sums: Sequence[np.ndarray]
) -> None:
    """Add sums per considered feature, sum, node (``slots``) and bin. ``sums`` are small enough to add up as doubles exactly.

    ``rows`` are the places of the rows in ``bins``, if these are not all in order.
    """
    k, width = features.shape[1], bins.shape[1]
    cells = out.shape[2]
    flat, start = bins.reshape(-1), slots * n_bins
    first = np.arange(0, len(slots) * width, max(width, 1)) if rows is None else rows * width
    for j in range(k):
        cell = start + flat[first + (j if k == width else features[:, j][slots])]
        for i, values in enumerate(sums):
            out[j, i] += np.bincount(cell, values, cells)


def _by_node(sums: np.ndarray, n_bins: int) -> np.ndarray:
    """Whole numbers by node, feature, bin and sum."""
    k, kinds, cells = sums.shape
    return sums.astype(np.int64).reshape(k, kinds, cells // n_bins, n_bins).transpose(2, 0, 3, 1)


def _open(weight: np.ndarray, depth: int, settings: TreeSettings) -> np.ndarray:
    """Which nodes of a depth may be split."""
    return (weight >= max(settings.min_samples_split, 2 * settings.min_samples_leaf)) & (depth < settings.max_depth)


def grown_from_rows(
    tree: int, node: int, bins: np.ndarray, weight: np.ndarray, high: np.ndarray, low: np.ndarray, n_bins: int, labels: Labels,
    settings: TreeSettings,
) -> list[list[np.ndarray]]:
    """The nodes from ``node`` down, in parts with the columns of a :class:`Tree`; the rows are those that reach it."""
    n_features = bins.shape[1]
    k = settings.features_per_node(n_features)
    step = max(1, min(CELLS, SPLIT_CELLS) // (k * n_bins * 3))
    parts: list[list[np.ndarray]] = []
    # Rows stay in the order of their nodes, so that those of some nodes are a slice.
    weighted = [values.astype(np.float64) for values in (weight, weight * high, weight * low)]
    waiting = [(np.array([node], dtype=np.int64), np.zeros(len(bins), dtype=np.int64), np.ascontiguousarray(bins.T), weighted)]
    while waiting:
        numbers, slots, columns, weighted = waiting.pop()
        depth = int(numbers[0]).bit_length() - 1
        features = considered(tree, numbers, n_features, k, settings.random_state)
        flat, n = columns.reshape(-1), columns.shape[1]
        places = np.arange(n)
        column_starts = features * n
        bounds = np.searchsorted(slots, np.arange(0, len(numbers) + step, step))
        found = []
        for at, start, end in zip(range(0, len(numbers), step), bounds, bounds[1:], strict=False):
            to = min(at + step, len(numbers))
            own = slots[start:end] - at
            first, some = own * n_bins, [values[start:end] for values in weighted]
            sums = np.empty((3, to - at, k, n_bins))
            for j in range(k):
                bin_of = columns[j, start:end] if k == n_features else flat[column_starts[at:to, j][own] + places[start:end]]
                cell = first + bin_of
                for i in range(3):
                    sums[i, :, j] = np.bincount(cell, some[i], (to - at) * n_bins).reshape(-1, n_bins)
            found.append(best_splits(*sums, features[at:to], labels, settings))
        splits = _joined_splits(found)
        inner = splits.feature >= 0
        parts.append([numbers, splits.feature, splits.bin, splits.gain, splits.weight, splits.total])
        # Children of the nodes that are split; those that cannot be split again are leaves at once.
        child_number, child_weight, child_total = _children(numbers, splits, inner)
        again = _open(child_weight, depth + 1, settings)
        leaf = ~again
        nothing = np.zeros(int(leaf.sum()))
        parts.append([child_number[leaf], nothing - 1, nothing, nothing, child_weight[leaf], child_total[leaf]])
        if not again.any():
            continue
        slot_of_child = np.full((len(numbers), 2), -1, dtype=np.int64)
        slot_of_child[inner] = np.where(again, np.cumsum(again) - 1, -1).reshape(-1, 2)
        beyond = flat[(np.maximum(splits.feature, 0) * n)[slots] + places] > splits.bin.astype(np.uint8)[slots]
        slots = slot_of_child.reshape(-1)[2 * slots + beyond]
        numbers = child_number[again]
        order = np.flatnonzero(slots >= 0)
        # Numbers of 16 bits are sorted in linear time.
        order = order[np.argsort(slots[order].astype(np.min_scalar_type(len(numbers))), kind="stable")]
        slots, columns, weighted = slots[order], columns.take(order, axis=1), [values[order] for values in weighted]
        ends = np.searchsorted(slots, np.arange(len(numbers)), side="right")
        at = 0
        while at < len(numbers):
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + CACHED_ROWS, side="right")))
            end = ends[to - 1]
            waiting.append((numbers[at:to], slots[start:end] - at, np.ascontiguousarray(columns[:, start:end]), [values[start:end] for values in weighted]))
            at = to
    return parts


def best_first(tree: Tree, leaves: int) -> np.ndarray:
    """Numbers of the nodes that are not split if the splits of largest gain come first and ``leaves`` leaves are the limit."""
    import heapq

    place = {int(number): i for i, number in enumerate(tree.number)}
    inner = {int(number) for number, feature in zip(tree.number, tree.feature, strict=True) if feature >= 0}
    waiting = [(-float(tree.gain[0]), 1)] if 1 in inner else []
    split = set()
    while waiting and len(split) < leaves - 1:
        _, number = heapq.heappop(waiting)
        split.add(number)
        for child in (2 * number, 2 * number + 1):
            if child in inner:
                heapq.heappush(waiting, (-float(tree.gain[place[child]]), child))
    return np.array(sorted(inner - split), dtype=np.int64)


@dataclass(frozen=True)
class BinnedRows:
    """``rows`` has a ``key`` hash, the label ``y`` and ``bins`` (a byte per feature); ``bounds`` are the features' bin bounds."""

    rows: DataFrame
    n: int
    bounds: list[np.ndarray]
    labels: Labels
    packed: DataFrame | None = None

    def blocks(self) -> DataFrame:
        """Records of many rows: their keys, labels and bins, each as one byte string."""
        if self.packed is not None:
            return self.packed
        width = len(self.bounds)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, n = [], 0
            for batch in batches:
                waiting.append(batch)
                n += batch.num_rows
                if n >= BLOCK_ROWS:
                    yield from packed(waiting)
                    waiting, n = [], 0
            yield from packed(waiting)

        def packed(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sum(batch.num_rows for batch in waiting):
                numbers = [b"".join(batch.column(i).to_numpy(zero_copy_only=False).tobytes() for batch in waiting) for i in (0, 1)]
                bins = b"".join(_unpacked(batch.column(2), width).tobytes() for batch in waiting)
                yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary()) for value in (*numbers, bins)], ["key", "y", "bins"])

        return self.rows.select("key", "y", "bins").mapInArrow(pack, "key binary, y binary, bins binary")

    def kept(self) -> BinnedRows:
        """The same, its blocks kept by the executors until :meth:`release`."""
        return replace(self, packed=self.blocks().persist(StorageLevel.MEMORY_AND_DISK))

    def release(self) -> None:
        self.packed.unpersist()

    @property
    def n_bins(self) -> int:
        return max((len(own) + 1 for own in self.bounds), default=1)


def bin_bounds(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Upper bounds of all bins but the last: every distinct value if they are few, else equal shares of the rows."""
    values = values[~np.isnan(values)]
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) <= max_bins:
        return distinct[:-1]
    reached = np.cumsum(counts)
    wanted = np.arange(1, max_bins) * (len(values) / max_bins)
    return np.unique(distinct[np.minimum(np.searchsorted(reached, wanted), len(distinct) - 2)])


def _bins(x: np.ndarray, bounds: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every value; NaN is beyond all bounds."""
    out = np.empty(x.shape, dtype=np.uint8)
    for i, own in enumerate(bounds):
        out[:, i] = np.searchsorted(own, x[:, i], side="left")
    return out


def binned(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], max_bins: int) -> BinnedRows:
    """Rows with a label, and their features in bins. Null and NaN features go to the last bin, so they never go left.

    ``keys`` identify a row; without any, the row's own values do.
    """
    numbers = [F.coalesce(F.col(name).cast("double"), F.lit(MISSING)).alias(f"x{i}") for i, name in enumerate(features)]
    hashed = F.xxhash64(*(keys or [*features, label])).alias("key")
    rows = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).select(
        hashed, F.col(label).cast("double").alias("y"), F.array(*numbers).alias("x")
    )
    # Read three times, and what they come from may be long: counted, sampled and cut.
    rows = written(rows.select("key", "y", *[F.col("x")[i].alias(f"x{i}") for i in range(len(features))]), "tree-rows")
    rows = rows.select("key", "y", F.array(*[f"x{i}" for i in range(len(features))]).alias("x"))
    found = rows.agg(F.count("*").alias("n"), F.max(F.abs("y")).alias("largest")).first()
    n, largest = found["n"], found["largest"] or 0.0
    if not n:
        raise ValueError("no row has a label")
    if math.isinf(largest):
        raise ValueError("a label is infinite")
    wanted = max(10_000, SAMPLE_VALUES // max(len(features), 1))
    sample = rows.select("key", "x")
    if n > wanted:
        # Mixed once more, so that the sample does not follow the hash that the rows are bagged by.
        sample = sample.where(F.xxhash64("key") < int((2 * wanted / n - 1) * 2.0**63))
    sample = sample.select("x").toArrow()["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
    bounds = [bin_bounds(sample[:, i], max_bins) for i in range(len(features))]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(bounds))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(_bins(x, bounds))], ["key", "y", "bins"])

    exponent = HIGH_BITS - 1 - math.frexp(largest)[1] if largest else 0
    cut = rows.mapInArrow(per_batch, "key long, y double, bins binary")
    # Every pass works on each row once per tree, so the rows, a few bytes each by now, are spread evenly first.
    return BinnedRows(cut.repartition(_pieces(df.sparkSession, n), "key"), n, bounds, Labels(exponent))


def _packed(values: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = values.shape
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1].tobytes() if width else bytes(4 * (n + 1)))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, dtype=np.int32)[column.offset]
    return np.frombuffer(data, dtype=np.uint8)[first : first + len(column) * width].reshape(-1, width)


def _blocks_of(batch: pa.RecordBatch, width: int, labels: Labels) -> Iterator[tuple]:
    """(keys, bins, high and low labels) of every block; the last two columns are the bins and the label."""
    for row in range(batch.num_rows):
        *key, packed, target = (column[row].as_buffer() for column in batch.columns)
        values = np.frombuffer(target, dtype=np.float64)
        keys = np.frombuffer(key[0], dtype=np.int64) if key else None
        yield keys, np.frombuffer(packed, dtype=np.uint8).reshape(len(values), width), *labels.split(values)


def _reaching(block: tuple, partial: Mapping[int, tuple], seed: int | None, n_bins: int) -> Iterator[tuple]:
    """(tree, slots, rows, weights) of the drawn rows of a block that reach wanted nodes; without a seed all rows are drawn once."""
    keys, bins, _, _ = block
    pairs = Pairs(bins, n_bins)
    for tree, (router, slots, _) in partial.items():
        some, weight = np.arange(len(bins)), np.ones(len(bins), dtype=np.int64)
        if seed is not None:
            weight = drawn(keys, tree, seed)
            some = np.flatnonzero(weight != 0)
            weight = weight[some]
        slot = slots[router.places_of(pairs, some)]
        if len(slot) and slot.min() < 0:
            live = np.flatnonzero(slot >= 0)
            slot, some, weight = slot[live], some[live], weight[live]
        yield tree, slot, some, weight


class _Growth:
    """Grows trees of one kind of settings together, pass by pass, from blocks of rows."""

    def __init__(self, data: BinnedRows, blocks: DataFrame, settings: TreeSettings, trees: Sequence[int], target: str, bagged: bool):
        self.data, self.settings, self.trees, self.bagged = data, settings, list(trees), bagged
        self.rows = blocks.select(*(["key"] if bagged else []), "bins", target)
        self.pieces = _pieces(blocks.sparkSession, data.n)
        self.parts: dict[int, list[list]] = {tree: [] for tree in trees}
        self.width = len(data.bounds)
        # Many trees are dealt over all cores by larger nodes, too.
        self.local_rows = LOCAL_ROWS * min(8, max(1, len(self.trees) // blocks.sparkSession.sparkContext.defaultParallelism))

    def grow(self) -> list[Tree]:
        root, n = np.array([1], dtype=np.int64), np.array([self.data.n], dtype=np.int64)
        small: list[dict[int, np.ndarray]] = []
        waiting = self._apart({tree: (root, n) for tree in self.trees}, small)
        while waiting:
            opened = {}
            for tree, numbers, splits in self._passes(waiting):
                inner = splits.feature >= 0
                self.parts[tree].append([numbers, splits.feature, splits.bin, splits.gain, splits.weight, splits.total])
                children = _children(numbers, splits, inner)
                again = _open(children[1], int(numbers[0]).bit_length(), self.settings)
                leaves = [values[~again] for values in children]
                nothing = np.zeros(len(leaves[0]))
                self.parts[tree].append([leaves[0], nothing - 1, nothing, nothing, *leaves[1:]])
                if again.any():
                    opened.setdefault(tree, []).append([values[again] for values in children[:2]])
            joined = {tree: tuple(np.concatenate(column) for column in zip(*found, strict=True)) for tree, found in opened.items()}
            waiting = self._apart(self._reachable(joined), small)
        finish: dict[int, list] = {}
        for found in small:
            for tree, own in found.items():
                finish.setdefault(tree, []).append(own)
        together = self._reachable({tree: tuple(np.concatenate(column) for column in zip(*own, strict=True)) for tree, own in finish.items()})
        if together:
            self._finish({tree: numbers for tree, (numbers, _) in together.items()})
        return [self._limited(_tree(self.parts[tree])) for tree in self.trees if self.parts[tree]]

    def _apart(self, opened: Mapping[int, tuple], small: list) -> dict[int, np.ndarray]:
        """Nodes that take a pass. Those that few rows reach go to ``small``, if bringing these rows together moves less than
        the histograms of all levels below do."""
        limit = self.local_rows
        few = {tree: (numbers[own], weight[own]) for tree, (numbers, weight) in opened.items() if (own := weight <= limit).any()}
        if few:
            weight = sum(int(own.sum()) for _, own in few.values())
            nodes = sum(len(numbers) for numbers, _ in few.values())
            depth = min(int(numbers[0]).bit_length() - 1 for numbers, _ in few.values())
            most = max(1, weight // max(self.settings.min_samples_leaf, 1))
            cells = self.settings.features_per_node(self.width) * self.data.n_bins * 24 * self.pieces
            # Larger nodes take about so many levels of passes anyway.
            largest = max(int(own.max()) for _, own in opened.values())
            shared = math.ceil(math.log2(largest / limit)) if largest > limit else 0
            one_pass = PASS_BYTES + PASS_ROW_BYTES * self.data.n * len(few)
            passes = sum(
                min(nodes * 2.0**level, most) * cells + (0 if level < shared else one_pass) for level in range(self.settings.max_depth - depth)
            )
            if passes > weight * (self.width + 9):
                small.append(few)
                opened = {tree: (numbers[own], weight[own]) for tree, (numbers, weight) in opened.items() if (own := weight > limit).any()}
        return {tree: np.sort(numbers) for tree, (numbers, _) in opened.items()}

    def _reachable(self, nodes: Mapping[int, tuple]) -> dict[int, tuple]:
        """Without nodes that a limit of leaves cuts off, whatever gains are still to be found; these become leaves.

        Splits that are not known yet can only come before known ones, so a known split beyond the limit stays beyond it.
        """
        if self.settings.max_leaf_nodes is None:
            return dict(nodes)
        out = {}
        for tree, (numbers, weight) in nodes.items():
            own = numbers == 1
            if not own.all():
                own |= ~np.isin(numbers // 2, best_first(_tree(self.parts[tree]), self.settings.max_leaf_nodes))
            if own.any():
                out[tree] = numbers[own], weight[own]
        return out

    def _limited(self, tree: Tree) -> Tree:
        if self.settings.max_leaf_nodes is None:
            return tree
        return tree.without(best_first(tree, self.settings.max_leaf_nodes))

    def _partial(self, nodes: Mapping[int, np.ndarray]) -> dict[int, tuple[Router, np.ndarray, np.ndarray]]:
        """Per tree: what finds the nodes of rows, the number of the wanted one at every place (-1: none), and these numbers."""
        out = {}
        for tree, wanted in sorted(nodes.items()):
            wanted = np.sort(wanted)
            parts = self.parts[tree]
            empty = [np.zeros(0, dtype=np.int64)]
            split = np.concatenate([*empty, *[np.asarray(part[0])[np.asarray(part[1]) >= 0] for part in parts]])
            present = np.concatenate([*empty, *[part[0] for part in parts]])
            # Nodes that are not grown yet, or that a limit of leaves cut off, stand as leaves.
            below = np.setdiff1d(np.concatenate([2 * split, 2 * split + 1, wanted]), present)
            known = _tree([*parts, [below, np.full(len(below), -1), *[np.zeros(len(below))] * 4]])
            slots = np.full(len(known.number), -1, dtype=np.int64)
            slots[np.searchsorted(known.number, wanted)] = np.arange(len(wanted))
            out[tree] = (Router(known), slots, wanted)
        return out

    def _passes(self, nodes: Mapping[int, np.ndarray]) -> Iterator[tuple]:
        k, n_bins = self.settings.features_per_node(self.width), self.data.n_bins
        together = max(1, CELLS // (k * n_bins * 3))
        some, room = {}, together
        for tree, numbers in sorted(nodes.items()):
            while len(numbers):
                some[tree], numbers = numbers[:room], numbers[room:]
                room -= len(some[tree])
                if not room:
                    yield from self._pass(some)
                    some, room = {}, together
        if some:
            yield from self._pass(some)

    def _pass(self, nodes: Mapping[int, np.ndarray]) -> Iterator[tuple]:
        """(tree, numbers, splits): the best split of every node that rows reach, by one pass over the rows."""
        partial, n_bins, labels, settings, width = self._partial(nodes), self.data.n_bins, self.data.labels, self.settings, self.width
        k = settings.features_per_node(width)
        own = {tree: considered(tree, wanted, width, k, settings.random_state) for tree, (_, _, wanted) in partial.items()}
        seed = settings.random_state if self.bagged else None
        per_chunk = max(1, CHUNK_CELLS // (k * n_bins * 3))
        exact = EXACT_ROWS

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {tree: np.zeros((k, 3, len(wanted) * n_bins)) for tree, (_, _, wanted) in partial.items()}
            whole: dict[int, np.ndarray] = {}
            since = 0
            for batch in batches:
                for block in _blocks_of(batch, width, labels):
                    _, bins, high, low = block
                    high, low = high.astype(np.float64), low.astype(np.float64)
                    if since and since + len(bins) > exact:
                        for tree, found in sums.items():
                            whole[tree] = whole.get(tree, 0) + found.astype(np.int64)
                            found[:] = 0.0
                        since = 0
                    since += len(bins)
                    for tree, slot, rows, weight in _reaching(block, partial, seed, n_bins):
                        times = weight.astype(np.float64)
                        _add_histogram(sums[tree], slot, own[tree], bins, rows, n_bins, [times, high[rows] * times, low[rows] * times])
            for tree, found in sums.items():
                cells = _by_node(found, n_bins)
                if tree in whole:
                    cells = cells + _by_node(whole[tree], n_bins)
                for chunk, at in enumerate(range(0, len(cells), per_chunk)):
                    some = cells[at : at + per_chunk]
                    if some[:, 0, :, 0].any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tree], pa.int64()), pa.array([chunk], pa.int64()), pa.array([some.tobytes()], pa.binary())],
                            ["tree", "chunk", "cells"],
                        )

        def split_of(tree: int, chunk: int, parts: Sequence[bytes]) -> Splits:
            numbers = partial[tree][2][chunk * per_chunk : (chunk + 1) * per_chunk]
            cells = sum(np.frombuffer(part, dtype=np.int64) for part in parts).reshape(len(numbers), k, n_bins, 3)
            return best_splits(*np.moveaxis(cells, 3, 0), own[tree][chunk * per_chunk : (chunk + 1) * per_chunk], labels, settings)

        def split(table: pa.Table) -> pa.Table:
            tree, chunk = table["tree"][0].as_py(), table["chunk"][0].as_py()
            best = split_of(tree, chunk, [part.as_buffer() for part in table["cells"]])
            values = [[getattr(best, name).astype(kind).tobytes()] for name, kind in _SPLIT_KINDS]
            return pa.table([[tree], [chunk], *values], schema=_SPLIT_ARROW)

        added = self.rows.mapInArrow(add_up, "tree long, chunk long, cells binary")
        wanted = sum(len(numbers) for numbers in nodes.values())
        found: dict[tuple[int, int], Splits] = {}
        if wanted * k * n_bins * 24 * self.pieces <= DRIVER_BYTES:
            partials: dict[tuple[int, int], list[bytes]] = {}
            for row in added.collect():
                partials.setdefault((row["tree"], row["chunk"]), []).append(row["cells"])
            found = {at: split_of(*at, parts) for at, parts in partials.items()}
        else:
            chunks = sum(-(-len(numbers) // per_chunk) for numbers in nodes.values())
            # A task costs more than splitting what is small; so no more of them than cores, unless histograms are large.
            size = wanted * k * n_bins * 24 * self.pieces
            tasks = min(chunks, max(added.sparkSession.sparkContext.defaultParallelism, size >> 25))
            best = _spread(added, tasks, "tree", "chunk").groupBy("tree", "chunk").applyInArrow(split, _SPLIT_SCHEMA)
            for row in best.collect():
                found[row["tree"], row["chunk"]] = Splits(*[np.frombuffer(row[name], dtype=kind) for name, kind in _SPLIT_KINDS])
        for (tree, chunk), splits in sorted(found.items(), key=lambda item: item[0]):
            reached = splits.weight > 0
            numbers = partial[tree][2][chunk * per_chunk : (chunk + 1) * per_chunk][reached]
            if len(numbers):
                yield tree, numbers, Splits(*[getattr(splits, name)[reached] for name in Splits.__dataclass_fields__])

    def _finish(self, nodes: Mapping[int, np.ndarray]) -> None:
        """Grow the subtrees of nodes that few rows reach, each where its rows are brought together."""
        partial, n_bins, labels, settings, width = self._partial(nodes), self.data.n_bins, self.data.labels, self.settings, self.width
        seed = settings.random_state if self.bagged else None
        kinds = [np.dtype(np.uint8), np.dtype(np.int32), np.dtype(np.int32)]

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _blocks_of(batch, width, labels):
                    _, bins, high, low = block
                    for tree, slot, rows, weight in _reaching(block, partial, seed, n_bins):
                        order = np.argsort(slot.astype(np.min_scalar_type(len(partial[tree][2]))), kind="stable")
                        rows = rows[order]
                        cuts = np.searchsorted(slot[order], np.arange(len(partial[tree][2]) + 1))
                        filled = np.flatnonzero(np.diff(cuts))
                        ends = np.append(cuts[filled], cuts[-1])
                        arrays = [bins[rows], *[values.astype(kind) for values, kind in zip((weight[order], high[rows], low[rows]), kinds, strict=True)]]
                        packed = [_pieces_of(values, ends, size) for values, size in zip(arrays, (width, 1, 4, 4), strict=True)]
                        ids = [pa.array(np.full(len(filled), tree, dtype=np.int64)), pa.array(partial[tree][2][filled])]
                        yield pa.RecordBatch.from_arrays([*ids, *packed], ["tree", "number", "bins", "weight", "high", "low"])

        def grow(table: pa.Table) -> pa.Table:
            tree, number = table["tree"][0].as_py(), table["number"][0].as_py()
            weight, high, low = (
                np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind).astype(np.int64)
                for name, kind in zip(("weight", "high", "low"), kinds, strict=True)
            )
            bins = np.frombuffer(b"".join(table["bins"].to_pylist()), dtype=np.uint8).reshape(len(weight), width)
            parts = grown_from_rows(tree, number, bins, weight, high, low, n_bins, labels, settings)
            columns = [np.concatenate([np.asarray(part[i], dtype=kind) for part in parts]) for i, (_, kind) in enumerate(_COLUMNS)]
            values = [column.tobytes() for column in columns]
            return pa.table([pa.array([tree], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], schema=_NODES_ARROW)

        rows = self.rows.mapInArrow(gather, "tree long, number long, bins binary, weight binary, high binary, low binary")
        groups = sum(len(numbers) for numbers in nodes.values())
        grown = _spread(rows, groups, "tree", "number").groupBy("tree", "number").applyInArrow(grow, _NODES_SCHEMA)
        for row in grown.collect():
            self.parts[row["tree"]].append([np.frombuffer(row[name], dtype=kind) for name, kind in _COLUMNS])


def _children(numbers: np.ndarray, splits: Splits, inner: np.ndarray) -> list[np.ndarray]:
    """Numbers, weights and totals of what is below the nodes that are split."""
    weight, total = splits.left_weight[inner], splits.left_total[inner]
    pairs = (
        (2 * numbers[inner], 2 * numbers[inner] + 1), (weight, splits.weight[inner] - weight), (total, splits.total[inner] - total)
    )
    return [np.stack(pair, axis=1).ravel() for pair in pairs]


def _pieces_of(values: np.ndarray, ends: np.ndarray, size: int) -> pa.Array:
    """Consecutive rows of ``size`` bytes as byte strings, cut at ``ends``."""
    offsets = pa.py_buffer((ends * size).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


_SPLIT_KINDS = (
    ("feature", np.int32), ("bin", np.int32), ("gain", np.float64), ("weight", np.int64), ("total", np.float64), ("left_weight", np.int64),
    ("left_total", np.float64),
)
_SPLIT_SCHEMA = "tree long, chunk long, " + ", ".join(f"{name} binary" for name, _ in _SPLIT_KINDS)
_SPLIT_ARROW = pa.schema([("tree", pa.int64()), ("chunk", pa.int64()), *[(name, pa.binary()) for name, _ in _SPLIT_KINDS]])
_NODES_SCHEMA = "tree long, " + ", ".join(f"{name} binary" for name, _ in _COLUMNS)
_NODES_ARROW = pa.schema([("tree", pa.int64()), *[(name, pa.binary()) for name, _ in _COLUMNS]])


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _pieces(spark: SparkSession, n: int) -> int:
    """Partitions of binned rows: one for each core if there are rows for that, twice or more times as many if they would get long."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(cores, -(-n // 8192)), cores * -(-n // (cores << 20)))


def _spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """By tree and node over about as many tasks as there is work for."""
    return df.repartition(max(1, min(groups, 4 * _tasks(df.sparkSession))), *keys)


@dataclass(frozen=True)
class Ensemble:
    """Trees whose weighted values add up to the prediction; ``bounds`` are the bin bounds of the features."""

    bounds: list[np.ndarray]
    trees: list[Tree]
    weights: list[float]

    def walker(self) -> Callable[[np.ndarray], np.ndarray]:
        """What predicts rows of feature values; it holds no more than that takes."""
        bounds, n_bins = self.bounds, max((len(own) + 1 for own in self.bounds), default=1)
        steps = [(Router(tree), tree.value * weight) for tree, weight in zip(self.trees, self.weights, strict=True)]

        def walk(x: np.ndarray) -> np.ndarray:
            pairs = Pairs(_bins(x, bounds), n_bins)
            total = np.zeros(len(x))
            for router, values in steps:
                total += values[router.places_of(pairs)]
            return total

        return walk

    def importances(self) -> np.ndarray:
        """How much each feature lowers the squared error, as a share: per tree, then over the trees."""
        total = np.zeros(len(self.bounds))
        for tree in self.trees:
            inner = tree.feature >= 0
            own = np.bincount(tree.feature[inner], tree.gain[inner], len(self.bounds))
            total += own / own.sum() if own.sum() else own
        return total / total.sum() if total.sum() else total

    def thresholds(self, tree: Tree) -> np.ndarray:
        """The largest value that goes left, of every inner node."""
        return np.array([self.bounds[f][b] if f >= 0 else 0.0 for f, b in zip(tree.feature.tolist(), tree.bin.tolist(), strict=True)])


def grow_forest(data: BinnedRows, settings: TreeSettings) -> Ensemble:
    """Trees whose mean is the prediction. Among very few rows a tree may draw none; it is left out."""
    settings = settings.for_rows(data.n)
    blocks = data.blocks()
    trees = _Growth(data, blocks, settings, range(settings.n_estimators), "y", settings.bootstrap).grow()
    trees = trees or _Growth(data, blocks, settings, [0], "y", False).grow()
    return Ensemble(data.bounds, trees, [1.0 / len(trees)] * len(trees))


def grow_boosting(data: BinnedRows, settings: TreeSettings) -> Ensemble:
    """The first tree fits the label, every other one what the trees before it leave, shrunk by the learning rate."""
    settings = settings.for_rows(data.n)
    trees: list[Tree] = []
    weights: list[float] = []
    # What is left over may be larger than any label, for a row at the other end of its leaf.
    wider = replace(data, labels=Labels(data.labels.exponent - 1))
    rows, applied, kept = data.blocks().select("bins", F.col("y").alias("left_over")), 0, None
    try:
        for number in range(settings.n_estimators):
            now, before = left_over(rows, trees[applied:], weights[applied:], len(data.bounds)), kept
            if number - applied >= KEPT_EVERY or (number and number % STORED_EVERY == 0):
                rows = written(now, "left-over") if number % STORED_EVERY == 0 else now
                now = rows = kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
                applied = number
            trees += _Growth(wider, now, settings, [number], "left_over", False).grow()
            weights.append(1.0 if number == 0 else settings.learning_rate)
            if before is not None and before is not kept:
                # The passes of this tree have read all of what follows it.
                before.unpersist()
    finally:
        if kept is not None:
            kept.unpersist()
    return Ensemble(data.bounds, trees, weights)


def left_over(rows: DataFrame, trees: Sequence[Tree], weights: Sequence[float], width: int) -> DataFrame:
    """Blocks of ``rows`` with the trees' predictions taken from ``left_over``, tree by tree."""
    if not trees:
        return rows
    steps = [(Router(tree), tree.value * weight) for tree, weight in zip(trees, weights, strict=True)]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, target in zip(batch.column(0), batch.column(1), strict=True):
                left = np.frombuffer(target.as_buffer(), dtype=np.float64).copy()
                bins = np.frombuffer(packed.as_buffer(), dtype=np.uint8).reshape(len(left), width)
                for router, values in steps:
                    left -= values[router.places(bins)]
                columns = [pa.array([packed.as_py()], pa.binary()), pa.array([left.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bins", "left_over"])

    return rows.select("bins", "left_over").mapInArrow(per_batch, "bins binary, left_over binary")


class _TreeParams(HasInputCols, HasLabelCol, HasPredictionCol):
    kind = Param(Params._dummy(), "kind", "forest or boosting", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "tree parameters, as JSON", TypeConverters.toString)
    keyCols = Param(Params._dummy(), "keyCols", "columns that identify a row", TypeConverters.toListString)


class HistogramTrees(Estimator, _TreeParams):
    """A forest or boosting on number columns. Rows without a label are left out; missing features go right."""

    @keyword_only
    def __init__(self, *, kind=None, inputCols=None, labelCol=None, settings=None, keyCols=None, predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def tree_settings(self) -> TreeSettings:
        return TreeSettings.of(json.loads(self.getOrDefault(self.settings)))

    def _fit(self, dataset: DataFrame) -> HistogramTreesModel:
        settings = self.tree_settings()
        keys = self.getOrDefault(self.keyCols) if self.isSet(self.keyCols) else []
        data = binned(dataset, self.getInputCols(), self.getLabelCol(), keys, settings.max_bins)
        data = data.kept()
        try:
            return self.grown(data)
        finally:
            data.release()

    def grown(self, data: BinnedRows) -> HistogramTreesModel:
        """The model, from rows that are binned already."""
        grow = {"forest": grow_forest, "boosting": grow_boosting}[self.getOrDefault(self.kind)]
        model = HistogramTreesModel(grow(data, self.tree_settings()))
        return self._copyValues(model)


class HistogramTreesModel(Model, _TreeParams, MLReadable, MLWritable):
    def __init__(self, ensemble: Ensemble | None = None):
        super().__init__()
        self.ensemble = ensemble

    @property
    def featureImportances(self) -> np.ndarray:
        return self.ensemble.importances()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Batches of rows walk a tree together, which for large ensembles beats one expression per step by far; for a
        column without a Python worker see :func:`~stayframe.operators.compiled.prediction`."""
        walk = self.ensemble.walker()

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            return pd.Series(walk(np.stack([column.to_numpy(dtype=np.float64) for column in columns], axis=1)))

        inputs = [F.coalesce(F.col(name).cast("double"), F.lit(MISSING)) for name in self.getInputCols()]
        return dataset.withColumn(self.getPredictionCol(), predicted(*inputs))

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader()


class _TreesWriter(MLWriter):
    """Parameters as any stage stores them, and a table with a row per tree."""

    def __init__(self, model: HistogramTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        ensemble = self.model.ensemble
        rows = [
            (i, weight, *[getattr(tree, name).astype(kind).tobytes() for name, kind in _COLUMNS])
            for i, (tree, weight) in enumerate(zip(ensemble.trees, ensemble.weights, strict=True))
        ]
        columns = ", ".join(f"{name} binary" for name, _ in _COLUMNS)
        spark.createDataFrame(rows, f"tree int, tree_weight double, {columns}").write.parquet(f"{path}/trees")
        bounds = [(i, own.tolist()) for i, own in enumerate(ensemble.bounds)]
        spark.createDataFrame(bounds, "feature int, bounds array<double>").coalesce(1).write.parquet(f"{path}/bounds")


class _TreesReader(MLReader):
    def load(self, path: str) -> HistogramTreesModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        bounds = [np.array(row["bounds"], dtype=np.float64) for row in spark.read.parquet(f"{path}/bounds").orderBy("feature").collect()]
        trees = [Tree(*[np.frombuffer(row[name], dtype=kind) for name, kind in _COLUMNS]) for row in rows]
        model = HistogramTreesModel(Ensemble(bounds, trees, [row["tree_weight"] for row in rows]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def settings_json(params: Mapping) -> str:
    return json.dumps(asdict(TreeSettings.of(params)))
