"""Profiles over many versions of a table from states that are stored with each version, without reading a row again.

A state holds counts and extremes, which add up exactly, and sketches, which merge with known error: of distinct values and of
ranks for quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayframe.sources import storage
from stayframe.sources.snapshots import SnapshotTable

#: Registers of a distinct sketch, as a power of two: its estimate has a standard error of about 0.8 in 2 ** (LOG_REGISTERS / 2).
LOG_REGISTERS = 14
#: Size of a rank sketch: ranks are off by more than RANK_ERROR in about one case of a hundred.
RANK_SIZE, RANK_ERROR = 400, 0.01

STATE = (
    "version bigint, position int, column_name string, n_rows bigint, n_null bigint, least double, largest double, total double, "
    "distinct_state binary, rank_state binary"
)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def profile_states(df: DataFrame, version: int) -> DataFrame:
    """One state per column of flat type, from one pass."""
    aggregates, rows = [], []
    for i, field in enumerate(df.schema):
        if not isinstance(field.dataType, (T.NumericType, T.StringType)):
            continue
        name = _quoted(field.name)
        number = isinstance(field.dataType, T.NumericType)
        present = f"nanvl(CAST({name} AS DOUBLE), NULL)" if number else name
        measures = {
            "n_null": f"count(*) - count({present})",
            "least": f"min({present})" if number else "CAST(NULL AS DOUBLE)",
            "largest": f"max({present})" if number else "CAST(NULL AS DOUBLE)",
            "total": f"sum({present})" if number else "CAST(NULL AS DOUBLE)",
            # Doubles are told apart by their text.
            "distinct_state": f"hll_sketch_agg(CAST({present} AS STRING), {LOG_REGISTERS})",
            "rank_state": f"kll_sketch_agg_double({present}, {RANK_SIZE})" if number else "CAST(NULL AS BINARY)",
        }
        aggregates += [f"{expression} AS `{i}_{measure}`" for measure, expression in measures.items()]
        fields = ", ".join(f"'{measure}', `{i}_{measure}`" for measure in measures)
        label = field.name.replace("\\", "\\\\").replace("'", "\\'")
        rows.append(f"named_struct('position', {i}, 'column_name', '{label}', 'n_rows', n_rows, {fields})")
    found = df.selectExpr("count(*) AS n_rows", *aggregates).selectExpr(f"inline(array({', '.join(rows)}))")
    return found.select(F.lit(version).cast("long").alias("version"), "*")


class ProfiledTable:
    """A versioned table that stores the states of every version it writes."""

    def __init__(self, table: SnapshotTable):
        self.table = table
        self.spark = table.spark

    def _path(self) -> str:
        return f"{self.table.path}/profile"

    def write(self, df: DataFrame, **options) -> int:
        """The next version, and the states of its stored rows."""
        version = self.table.write(df, **options)
        states = profile_states(self.table.read(version), version)
        states.coalesce(1).write.mode("append").parquet(self._path())
        return version

    def states(self, versions: Sequence[int] | None = None) -> DataFrame:
        if not storage.exists(self.spark, self._path()):
            return self.spark.createDataFrame([], STATE)
        states = self.spark.read.schema(STATE).parquet(self._path())
        return states if versions is None else states.where(F.col("version").isin(list(versions)))

    def profile(self, versions: Sequence[int] | None = None) -> DataFrame:
        """One row per column over the rows of all given versions: exact counts, extremes and mean; ``distinct_estimate``
        with its standard error as a share, and quartiles whose ranks are off by about :data:`RANK_ERROR` at most.

        Reads one state per column and version, no rows. A column that a version lacks has no state of it.
        """
        merged = self.states(versions).groupBy("column_name").agg(
            F.min("position").alias("position"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_null").alias("n_null"),
            F.min("least").alias("min"),
            F.max("largest").alias("max"),
            (F.sum("total") / F.sum(F.when(F.col("total").isNotNull(), F.col("n_rows") - F.col("n_null")))).alias("mean"),
            F.expr("hll_sketch_estimate(hll_union_agg(distinct_state))").alias("distinct_estimate"),
            F.collect_list("rank_state").alias("ranks"),
        )
        joined = F.when(F.size("ranks") > 0, F.expr(
            "aggregate(slice(ranks, 2, greatest(size(ranks) - 1, 0)), get(ranks, 0), (one, other) -> kll_sketch_merge_double(one, other))"
        ))
        quartiles = [
            F.when(F.col("rank_state").isNotNull() & (F.col("n_null") < F.col("n_rows")), F.expr(f"kll_sketch_get_quantile_double(rank_state, {share}D)")).alias(name)
            for name, share in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
        ]
        error = F.lit(0.8 / 2 ** (LOG_REGISTERS / 2)).alias("distinct_error")
        return merged.withColumn("rank_state", joined).select(
            "position", "column_name", "n_rows", "n_null", "mean", "min", *quartiles, "max", "distinct_estimate", error
        )
