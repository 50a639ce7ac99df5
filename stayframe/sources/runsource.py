"""Runs of a stored log as a data source: ``spark.read.format("stayframe_runs").option("log", path).load(experiment)``.

A run log is stored sorted by experiment and run, with a list of what range each file holds. Planning reads that list: only
files that may hold the wanted experiment are read, and neighbouring files that share a run are read by one task, so every
run comes out whole. A task streams its files and keeps the latest value of each name of the run it is at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from stayframe.operators.runlog import store_log

FORMAT = "stayframe_runs"
RUN_SCHEMA = "experiment_id long, run_id string, start_time timestamp, metrics map<string,double>, params map<string,string>"
_RANGES = "_ranges"


def store_runs(log: DataFrame, path: str) -> None:
    """Store a log (see :mod:`~stayframe.operators.runlog`) for this source: its files, and a list of their ranges."""
    store_log(log, path)
    spark = log.sparkSession
    key = F.struct("experiment_id", "run_id")
    ranges = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    flat = ranges.select("file", *[F.col(f"{end}.{name}").alias(f"{end}_{name}") for end in ("first", "last") for name in ("experiment_id", "run_id")])
    flat.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_RANGES}")


@dataclass
class _Files(InputPartition):
    files: tuple[str, ...]
    experiments: tuple[int, ...] | None


class RunReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["log"].rstrip("/")
        wanted = options.get("path")
        self.experiments: tuple[int, ...] | None = None if wanted in (None, "") else (int(wanted),)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take a filter on one experiment; leave all others to Spark."""
        for found in filters:
            if isinstance(found, EqualTo) and found.attribute == ("experiment_id",) and self.experiments is None:
                self.experiments = (int(found.value),)
            else:
                yield found

    def partitions(self) -> Sequence[InputPartition]:
        import pyarrow.dataset as ds

        fs, folder = _located(f"{self.path}/{_RANGES}")
        rows = ds.dataset(folder, filesystem=fs, format="parquet").to_table().to_pylist()
        rows = [row for row in rows if self.experiments is None or any(row["first_experiment_id"] <= e <= row["last_experiment_id"] for e in self.experiments)]
        rows.sort(key=lambda row: (row["first_experiment_id"], row["first_run_id"], row["last_experiment_id"], row["last_run_id"]))
        groups: list[list[dict]] = []
        for row in rows:
            reached = max(((r["last_experiment_id"], r["last_run_id"]) for r in groups[-1]), default=None) if groups else None
            if reached is not None and (row["first_experiment_id"], row["first_run_id"]) <= reached:
                groups[-1].append(row)
            else:
                groups.append([row])
        # Spark wants one partition at least.
        return [_Files(tuple(row["file"] for row in group), self.experiments) for group in groups or [[]]]

    def read(self, partition: _Files) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        current, state = None, None
        for file in partition.files:
            fs, name = _located(file)
            rows = ds.dataset(name, filesystem=fs, format="parquet")
            chosen = None if partition.experiments is None else pc.field("experiment_id").isin(list(partition.experiments))
            columns = ["experiment_id", "run_id", "metric", "value", "text", "ts", "event_id"]
            for batch in rows.to_batches(columns=columns, filter=chosen, batch_size=4096):
                # Moments are stored in UTC, with or without saying so.
                moments = batch.column(5).cast(pa.timestamp("us")).cast(pa.timestamp("us", tz="UTC"))
                own = [moments if name == "ts" else batch.column(i) for i, name in enumerate(columns)]
                for experiment, run, metric, value, text, ts, event in zip(*(column.to_pylist() for column in own), strict=True):
                    if (experiment, run) != current:
                        if current is not None:
                            yield state.row(current)
                        current, state = (experiment, run), _RunState()
                    state.add(metric, value, text, ts, event)
        if current is not None:
            yield state.row(current)


class _RunState:
    """The latest value and text of every name of a run."""

    def __init__(self):
        self.start = None
        self.values: dict[str, tuple] = {}
        self.texts: dict[str, tuple] = {}

    def add(self, name: str, value: float | None, text: str | None, ts, event: int) -> None:
        self.start = ts if self.start is None else min(self.start, ts)
        for latest, what in ((self.values, value), (self.texts, text)):
            if what is not None and (name not in latest or latest[name][0] <= (ts, event)):
                latest[name] = ((ts, event), what)

    def row(self, run: tuple) -> tuple:
        return (*run, self.start, {k: v for k, (_, v) in sorted(self.values.items())}, {k: v for k, (_, v) in sorted(self.texts.items())})


class RunSource(DataSource):
    """Options: ``log``, the stored log; the path of ``load`` is the experiment (all of them without one)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RUN_SCHEMA

    def reader(self, schema: StructType) -> RunReader:
        if "log" not in self.options:
            raise ValueError("give the option log: where the run log is stored")
        return RunReader(self.options)


def _located(path: str):
    """The file system of a path or URI, and the path in it."""
    import pyarrow.fs as pafs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return pafs.FileSystem.from_uri(path)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.dataSource.register(RunSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
