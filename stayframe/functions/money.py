"""Money and percent strings to numbers. A string that is no number gives null, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRIPPED = {"strict_dollar": "$", "thousands": "$,"}


def _without(column: str | Column, characters: str) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def money(column: str | Column, style: str = "strict_dollar") -> Column:
    """``$85.00`` to 85.0. ``thousands`` also reads ``$1,200.00``; ``strict_dollar`` strips the dollar sign only,
    so the comma makes that value null."""
    return _without(column, _STRIPPED[style]).try_cast("double")


def percent(column: str | Column) -> Column:
    """``97%`` to 0.97, as double throughout."""
    return _without(column, "%").try_cast("double") / 100
