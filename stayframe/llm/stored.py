"""Tables written once below the shared folder and read from there, so that later stages neither recompute nor lose them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stayframe.session import new_workspace


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a fresh workspace and return the written table."""
    path = new_workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {column.lower() for column in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out
