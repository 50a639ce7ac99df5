"""Analysis of a run log: long rows (experiment_id, run_id, metric, value, text, ts, event_id), any number of them.

A metric has a number in ``value``, a parameter a string in ``text``; logs without parameters need no such column. A name may be
logged often; its latest row counts, by ``ts`` and then ``event_id``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.sources.snapshots import utc

RUN = ["experiment_id", "run_id"]


def run_rows(
    spark: SparkSession,
    experiment_id,
    run_id: str,
    values: Mapping[str, float],
    params: Mapping[str, object] | None = None,
    at: datetime | str | None = None,
) -> DataFrame:
    """Log rows of one run, metrics and parameters, ready to be appended to a log. Parameters are kept as text."""
    logged = [(name, float(value), None) for name, value in values.items()]
    logged += [(name, None, str(value)) for name, value in (params or {}).items()]
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.lit(value).cast("double").alias("value"),
                F.lit(text).cast("string").alias("text"),
                F.lit(i).cast("long").alias("event_id"),
            )
            for i, (name, value, text) in enumerate(logged)
        ]
    )
    row = spark.range(1, numPartitions=1).select(
        F.lit(experiment_id).alias("experiment_id"), F.lit(run_id).alias("run_id"), utc(at).alias("ts"), F.inline(cells)
    )
    return row.select(*RUN, "metric", "value", "text", "ts", "event_id")


def moment() -> Column:
    """The order of log rows as one number, by ``ts`` and then ``event_id`` (not negative). Unlike a struct it can be
    aggregated by hashing."""
    micros = "CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DECIMAL(19, 0))"
    return F.expr(f"CAST({micros} * 10000000000000000000BD + CAST(event_id AS DECIMAL(19, 0)) AS DECIMAL(38, 0))")


def latest_values(log: DataFrame, name: str = "metric") -> DataFrame:
    """The value of each metric of each run, and when the metric was first and last logged."""
    return log.groupBy(*RUN, name).agg(
        F.max_by("value", moment()).alias("value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def start_times(log: DataFrame) -> DataFrame:
    """Every run and when it started."""
    return log.groupBy(*RUN).agg(F.min("ts").alias("start_time"))


def runs_table(log: DataFrame, metrics: Sequence[str], params: Sequence[str] = ()) -> DataFrame:
    """One row per run: start time, a column per metric and a ``param_`` column per parameter, null where a run did not
    log it. One shuffle, of one row per run and task; with parameters, whose texts have no fixed size, it also sorts."""

    def latest(name: str, column: str) -> Column:
        logged = F.col("metric") == name
        return F.max_by(F.when(logged, F.col(column)), F.when(logged & F.col(column).isNotNull(), moment()))

    return log.groupBy(*RUN).agg(
        F.min("ts").alias("start_time"),
        *[latest(name, "value").alias(name) for name in metrics],
        *[latest(name, "text").alias(f"param_{name}") for name in params],
    )


def open_runs(log: DataFrame) -> DataFrame:
    """One row per run: start time, a map ``metrics`` and a map ``params``, of whatever names the run logged.

    The latest row of each name is found first, combined map-side, so that a run which logs very often is no burden; what
    then goes to the run's row is one value per name. The maps are as large as a run's names are many.
    """
    latest = log.groupBy(*RUN, "metric").agg(
        F.min("ts").alias("first_ts"),
        F.max_by("value", F.when(F.col("value").isNotNull(), moment())).alias("value"),
        F.max_by("text", F.when(F.col("text").isNotNull(), moment())).alias("text"),
    )

    def named(column: str) -> Column:
        entry = F.when(F.col(column).isNotNull(), F.struct("metric", column))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    return latest.groupBy(*RUN).agg(F.min("first_ts").alias("start_time"), named("value").alias("metrics"), named("text").alias("params"))


def store_log(log: DataFrame, path: str) -> None:
    """Store a log so that one experiment's rows lie together, in as many files as they need."""
    log.repartitionByRange("experiment_id", "run_id", "ts", "event_id").sortWithinPartitions(
        "experiment_id", "run_id"
    ).write.mode("overwrite").parquet(path)


def experiment_runs(log: DataFrame, experiment_id, metrics: Sequence[str], params: Sequence[str] = ()) -> DataFrame:
    """The runs of one experiment; the filter reaches the scan."""
    return runs_table(log.where(F.col("experiment_id") == F.lit(experiment_id)), metrics, params)


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that started last; among equal start times the largest run id."""
    return runs.orderBy(F.desc("start_time"), F.desc("run_id")).limit(1)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of every experiment, combined map-side: an experiment's runs do not meet in one task."""
    others = [name for name in runs.columns if name not in (*RUN, "start_time")]
    newest = runs.groupBy("experiment_id").agg(F.max(F.struct("start_time", "run_id", *others)).alias("newest"))
    return newest.select("experiment_id", *[F.col(f"newest.{name}").alias(name) for name in runs.columns[1:]])


def metrics_of(log: DataFrame, run: DataFrame) -> DataFrame:
    """Metric values of the given run or runs (run: one or few rows with the run's keys)."""
    logged = log.where("value IS NOT NULL").join(run.select(*RUN), RUN, "left_semi")
    return latest_values(logged).select(*RUN, "metric", "value")


def params_of(log: DataFrame, run: DataFrame) -> DataFrame:
    """Parameters of the given run or runs, as text."""
    logged = log.where("text IS NOT NULL").join(run.select(*RUN), RUN, "left_semi")
    latest = logged.groupBy(*RUN, F.col("metric").alias("param")).agg(F.max_by("text", moment()).alias("text"))
    return latest.select(*RUN, "param", "text")


def artifacts_of(artifacts: DataFrame, run: DataFrame) -> DataFrame:
    """Artifact paths of the given run or runs."""
    return artifacts.join(run.select(*RUN), RUN, "left_semi").select(*RUN, "path").distinct()


def metric_gap(runs: DataFrame, train: str, test: str) -> DataFrame:
    """Train and test metric of every run that has both, and their difference."""
    return runs.where(F.col(train).isNotNull() & F.col(test).isNotNull()).select(
        *RUN, train, test, (F.col(train) - F.col(test)).alias("gap")
    )


def best_run(runs: DataFrame, metric: str, larger_is_better: bool) -> DataFrame:
    """The run with the best value of a metric; runs without it do not compete."""
    order = F.desc(metric) if larger_is_better else F.asc(metric)
    return runs.where(F.col(metric).isNotNull()).orderBy(order, "run_id").limit(1)
