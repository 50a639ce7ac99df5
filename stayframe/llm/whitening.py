"""Whitening of embeddings by polarisation: covariances from variances of dimensions and of sums of dimensions.

Entries are quantised to whole numbers, so every sum here is exact. With n vectors of sums S, ``n * x - S`` is a centred
entry times n; its squares are added up for every dimension and for the sum of every two, and
``cov(a, b) = (var(a + b) - var(a) - var(b)) / 2``. The squares travel as digits of :data:`DIGIT_BITS` bits, which Spark
adds up without overflow, and the driver puts them together: d * (d + 1) / 2 numbers for vectors of d entries.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayframe.llm.stored import stored

#: An entry c counts as floor(SCALE * c).
SCALE = 256
COMPONENTS = 4
DIGIT_BITS = 30
#: Vectors whose pair sums are squared together.
TOGETHER = 2048


def usable(vector: str) -> Column:
    """A vector without null, NaN and infinite entries. One that is too large for a long when scaled counts as infinite."""
    return F.coalesce(F.forall(vector, lambda entry: F.coalesce(F.abs(entry.cast("double")) * SCALE < 2.0**63, F.lit(False))), F.lit(False))


def quantised(vector: str) -> Column:
    return F.transform(vector, lambda entry: F.floor(entry.cast("double") * SCALE))


def digits(number: int) -> list[int]:
    """A whole number in digits of :data:`DIGIT_BITS` bits, the lowest first; the last may be negative."""
    out = []
    while not -1 <= number >> DIGIT_BITS <= 0:
        out.append(number & ((1 << DIGIT_BITS) - 1))
        number >>= DIGIT_BITS
    return [*out, number]


def whole(sums: dict[int, int]) -> int:
    """The number that sums of digits, by their place, stand for."""
    return sum(total << (DIGIT_BITS * place) for place, total in sums.items())


def _exact(values: np.ndarray, bound: int) -> np.ndarray:
    """``values`` as they are if results up to ``bound`` fit in 64 bits, else as Python's unbounded numbers."""
    return values if bound < 1 << 62 else values.astype(object)


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _largest(values: np.ndarray) -> int:
    return max(-int(values.min(initial=0)), int(values.max(initial=0)))


def _totals(df: DataFrame, schema_keys: str, per_batch) -> DataFrame:
    """Digits that ``per_batch`` yields per key, added up."""
    names = [part.split()[0] for part in schema_keys.split(", ")]
    found = df.mapInArrow(per_batch, f"{schema_keys}, place int, digit long")
    return found.groupBy(*names, "place").agg(F.sum("digit").alias("total"))


def _digit_rows(keys: list[list[int]], numbers: list[int], names: list[str]) -> pa.RecordBatch:
    rows = [(*key, place, digit) for key, number in zip(keys, numbers, strict=True) for place, digit in enumerate(digits(number))]
    arrays = [pa.array(list(column), pa.int32()) for column in list(zip(*rows, strict=True))[:-1]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([row[-1] for row in rows], pa.int64())], [*names, "place", "digit"])


def dimension_sums(fit_list: DataFrame, dimensions: int) -> list[int]:
    """Exact sums of every dimension of ``x``."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * dimensions
        for batch in batches:
            x = _vectors(batch.column(0), dimensions)
            added = _exact(x, _largest(x) * len(x)).sum(axis=0).tolist()
            sums = [a + b for a, b in zip(sums, added, strict=True)]
        yield _digit_rows([[k] for k in range(dimensions)], sums, ["dimension"])

    found: dict[int, dict[int, int]] = defaultdict(dict)
    for row in _totals(fit_list.select("x"), "dimension int", per_task).collect():
        found[row["dimension"]][row["place"]] = row["total"]
    return [whole(found[k]) for k in range(dimensions)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exactly."""
    largest = n * _largest(x) + max(map(abs, sums), default=0)
    wide = largest >= 1 << 62
    return (x.astype(object) if wide else x) * n - np.array(sums, dtype=object if wide else np.int64)


def squared_sums(values: np.ndarray) -> np.ndarray:
    """Exact sums of squares of every column."""
    largest = _largest(values)
    total = np.zeros(values.shape[1], dtype=object)
    # As many rows at a time as a 64-bit sum holds.
    values = _exact(values, largest * largest)
    step = max(1, len(values) if values.dtype == object else (1 << 62) // max(largest * largest, 1))
    for at in range(0, len(values), step):
        part = values[at : at + step]
        total += (part * part).sum(axis=0).astype(object)
    return total


def pair_squares(fit_list: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Exact squared centred values, added up: of dimension a below (a, a), of the sum of a and b below (a, b), a < b."""
    dimensions = len(sums)
    pairs = [[a, b] for a in range(dimensions) for b in range(a, dimensions)]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(dimensions - a, dtype=object) for a in range(dimensions)]
        for batch in batches:
            every = _vectors(batch.column(0), dimensions)
            for at in range(0, len(every), TOGETHER):
                y = centred(every[at : at + TOGETHER], n, sums)
                for a in range(dimensions):
                    sums_of_two = y[:, a:] + y[:, a : a + 1]
                    sums_of_two[:, 0] = y[:, a]
                    totals[a] += squared_sums(sums_of_two)
        yield _digit_rows(pairs, [int(total) for own in totals for total in own], ["a", "b"])

    found: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for row in _totals(fit_list.select("x"), "a int, b int", per_task).collect():
        found[row["a"], row["b"]][row["place"]] = row["total"]
    return {key: whole(parts) for key, parts in found.items()}


def covariance(squares: dict[tuple[int, int], int], n: int, dimensions: int) -> np.ndarray:
    """Every entry correctly rounded: the numbers are whole until the last division, which Python rounds correctly."""
    out = np.empty((dimensions, dimensions))
    for (a, b), square in squares.items():
        twice = 2 * square if a == b else square - squares[a, a] - squares[b, b]
        out[a, b] = out[b, a] = twice / (2 * n**3)
    return out


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors of exact sums ``sums``; column k of ``axes`` is component k + 1, divided by its standard deviation."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened rows, and the exact deviation of every row (None beyond a long)."""
        y = centred(x, self.n, self.sums)
        largest = _largest(y)
        squares = _exact(y, largest * largest * max(len(self.sums), 1))
        deviation = (squares * squares).sum(axis=1).tolist()
        return (y / self.n).astype(np.float64) @ self.axes, [d if d < 1 << 63 else None for d in deviation]


def fit_list(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every distinct quantised vector ``x`` of the length that most of them have (of two such lengths the larger)."""
    x = stored(embeddings.where(usable(vector)).select(quantised(vector).alias("x")).distinct(), "distinct-vectors")
    length = x.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return x.where(F.size("x") == F.lit(length["length"] if length else 0))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors ``x`` of a fit list. None if there is none, or all are alike.

    A component whose variance is nothing but rounding (beside the largest) is left out.
    """
    first = vectors.agg(F.count("*").alias("n"), F.any_value(F.size("x")).alias("dimensions")).first()
    n, dimensions = first["n"], first["dimensions"]
    if not n or not dimensions:
        return None
    sums = dimension_sums(vectors, dimensions)
    v = covariance(pair_squares(vectors, n, sums), n, dimensions)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    real = values > np.finfo(float).eps * dimensions * max(values[0], 0.0)
    if not real.any():
        return None
    return Whitening(n, sums, axes[:, real] / np.sqrt(values[real]), values[real] / np.trace(v))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry, without its sign, of the fit list's whitened covariance minus the identity."""
    k = model.axes.shape[1]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            white, _ = model.apply(_vectors(batch.column(0), len(model.sums)))
            products += white.T @ white
            sums += white.sum(axis=0)
        rows = [(a, b, float(products[a, b])) for a in range(k) for b in range(k)] + [(a, -1, float(sums[a])) for a in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(list(column)) for column in zip(*rows, strict=True)], ["a", "b", "value"])

    found = vectors.select("x").mapInArrow(per_task, "a long, b long, value double").groupBy("a", "b").agg(F.sum("value").alias("value"))
    total = {(row["a"], row["b"]): row["value"] / model.n for row in found.collect()}
    # Whitened values are centred up to rounding; the products are corrected for what that leaves.
    return max(abs(total[a, b] - total[a, -1] * total[b, -1] - (a == b)) for a in range(k) for b in range(k))


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of all rows.

    Rows with a null vector, or with null, NaN or infinite entries, go, and so do those of another length than the fit
    list's (:func:`fit_list`). All others have one row per component, copies and rows with equal or null keys included;
    there are none if no two vectors differ. Components beyond the rank of the vectors have no rows. ``deviation`` is null
    where it is too large for a long. Other columns are ignored.
    """
    rows = embeddings.where(usable(vector)).select(F.col(key).alias("key"), quantised(vector).alias("x"))
    key_type = rows.schema["key"].dataType.simpleString()
    schema = f"{key} {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = fit_list(embeddings, vector)
    model = fit(vectors, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    k = model.axes.shape[1]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white, deviation = model.apply(_vectors(batch.column(1), len(model.sums)))
            n_rows = len(white)
            row = np.repeat(np.arange(n_rows), k)
            arrays = [
                batch.column(0).take(pa.array(row)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n_rows)),
                pa.array(np.full(len(row), model.n, dtype=np.int64)),
                pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                pa.array(white.ravel()),
                pa.array(np.tile(model.explained, n_rows)),
                pa.array(np.full(len(row), error)),
            ]
            names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.where(F.size("x") == len(model.sums)).mapInArrow(per_batch, schema)
