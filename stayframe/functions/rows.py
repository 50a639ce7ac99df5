"""Expressions across the columns of one row, and per-row keys and values."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: multiplier of the split hash (the 32-bit golden ratio).
_MIX = 2654435761


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns; null as soon as one of them is null."""
    return reduce(operator.add, [F.col(name) for name in columns])


def row_mean(columns: Sequence[str]) -> Column:
    return row_sum(columns) / F.lit(len(columns))


#: Positions that a key can take; shares down to a millionth can be told apart.
POSITIONS = 1_000_000


def key_hash(key: str | Column) -> Column:
    """0..2^32-1 from an integer key. It is reduced modulo 2^31 first, so that the product stays inside a bigint."""
    column = F.col(key) if isinstance(key, str) else key
    return (F.pmod(column, F.lit(2**31)) * F.lit(_MIX)) % F.lit(2**32)


def key_percentile(key: str | Column) -> Column:
    """0..99 from an integer key: the same on every run, partitioning and engine."""
    return key_hash(key) % 100


def key_position(key: str | Column) -> Column:
    """0..:data:`POSITIONS` - 1 from an integer key, in the order of :func:`key_percentile` and finer."""
    hashed = key_hash(key)
    return hashed % 100 * (POSITIONS // 100) + F.floor(hashed / 100) % (POSITIONS // 100)


def key_noise(key: str | Column, low: float = -0.25, high: float = 0.25) -> Column:
    """A value in [low, high) that depends on the key alone; stands in for an unseeded random column.

    The key is reduced modulo 1000 first, which changes nothing for the remainder of the product.
    """
    column = F.col(key) if isinstance(key, str) else key
    return (F.pmod(column, F.lit(1000)) * 7919 % 1000).cast("double") / 1000 * (high - low) + F.lit(low)


def seeded_noise(seed: int, low: float = -0.25, high: float = 0.25) -> Column:
    """Uniform in [low, high). Values follow the partitioning: store the frame before using it twice."""
    return F.rand(seed) * (high - low) + F.lit(low)
