"""Keyed feature tables, training sets built by lookup, and models that carry their lookups."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayframe.operators.joins import lookup, lookup_in_place
from stayframe.sources import storage
from stayframe.sources.snapshots import NoSuchVersion, SnapshotTable, stored_schema, utc

_META_SCHEMA = "location string, primary_keys array<string>, description string, partition_columns array<string>, buckets int"
_MODEL_SCHEMA = "name string, version bigint, ts timestamp, meta string, run_id string"


class KeyViolation(ValueError):
    """A primary key is null or occurs more than once."""


class RetiredFeature(ValueError):
    """A model needs a feature that the wanted version of its table no longer fills."""


class SignatureMismatch(ValueError):
    """The rows to score lack a column the model was trained with, or have it in a type of another sort."""


def require_signature(df: DataFrame, signature: Sequence[Sequence[str]]) -> None:
    """Raise unless ``df`` has every (name, type) column in that type, or for numbers in any number type."""
    types = {field.name: field.dataType for field in df.schema}
    missing = [name for name, _ in signature if name not in types]
    if missing:
        raise SignatureMismatch(f"missing columns {missing}")
    for name, wanted in signature:
        have = types[name]
        # Numbers are told by their names; nothing else is read into a type's text.
        numeric = isinstance(have, T.NumericType) and wanted.split("(")[0] in _NUMBERS
        if have.simpleString() != wanted and not numeric:
            raise SignatureMismatch(f"column {name} is {have.simpleString()}, the model was trained on {wanted}")


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


@dataclass(frozen=True)
class FeatureTable:
    name: str
    location: str
    primary_keys: list[str]
    features: list[str]
    description: str
    partition_columns: list[str]
    buckets: int | None = None


@dataclass(frozen=True)
class FeatureLookup:
    """Take ``feature_names`` (all when None) of a table by a key of the spine.

    ``in_place`` is for tables stored by key, and spines whose keys are spread (one row each, as a rule): the rows move to
    the buckets and the features are not shuffled. Otherwise a key may hold any share of the spine.
    """

    table_name: str
    lookup_key: str | Sequence[str]
    feature_names: Sequence[str] | None = None
    in_place: bool = False


@dataclass(frozen=True)
class ResolvedLookup:
    """A lookup as it was read: the table's keys, the features, and the version they came from."""

    table: str
    primary_keys: list[str]
    lookup_keys: list[str]
    features: list[str]
    version: int
    buckets: int | None = None


class TrainingSet:
    """Spine, looked-up features and label; a lazy frame until a model is fitted on it."""

    def __init__(
        self,
        spine: DataFrame,
        lookups: list[ResolvedLookup],
        sources: list[DataFrame],
        label: str,
        exclude: list[str],
    ):
        self.spine = spine
        self.lookups = lookups
        self.sources = sources
        self.label = label
        self.exclude = exclude

    def load_df(self) -> DataFrame:
        return join_features(self.spine, self.lookups, self.sources).drop(*self.exclude)

    def first_rows(self, n: int) -> DataFrame:
        """The first ``n`` rows by lookup key, then by the spine's columns; features are read for their keys alone."""
        keys = [key for item in self.lookups for key in item.lookup_keys]
        order = list(dict.fromkeys([*keys, *[f.name for f in self.spine.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]]))
        rows = self.spine.orderBy(*order).limit(n).collect()
        spine = self.spine.sparkSession.createDataFrame(rows, self.spine.schema).coalesce(1)
        sources = []
        for item, source in zip(self.lookups, self.sources, strict=True):
            for own, key in zip(item.primary_keys, item.lookup_keys, strict=True):
                # Keys of one type are compared as they are; others are left to the lookup.
                if source.schema[own].dataType == self.spine.schema[key].dataType:
                    source = source.where(F.col(own).isin([row[key] for row in rows if row[key] is not None]))
            sources.append(source)
        plain = [replace(item, buckets=None) for item in self.lookups]
        return join_features(spine, plain, sources).drop(*self.exclude).orderBy(*[name for name in order if name not in self.exclude])

    @property
    def features(self) -> list[str]:
        looked_up = [name for item in self.lookups for name in item.features]
        return [name for name in [*self.spine.columns, *looked_up] if name != self.label and name not in self.exclude]


def require_unique_keys(stored: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a key is null or repeated. Reads the key columns only; counts are combined map-side, and rows that are
    stored by key are counted in their buckets, without a shuffle."""
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    found = (
        stored.groupBy(*keys)
        .agg(F.count("*").alias("n_rows"))
        .agg(F.max("n_rows").alias("worst"), F.max(any_null).alias("has_null"))
        .first()
    )
    if found["has_null"]:
        raise KeyViolation(f"a null in key {list(keys)}")
    if found["worst"] is not None and found["worst"] > 1:
        raise KeyViolation(f"a key in {list(keys)} occurs {found['worst']} times")


def join_features(df: DataFrame, lookups: Sequence[ResolvedLookup], sources: Sequence[DataFrame]) -> DataFrame:
    """Add looked-up features to rows; ``sources`` are the tables of the lookups, in their order."""
    for item, source in zip(lookups, sources, strict=True):
        keys = [F.col(key).alias(wanted) for key, wanted in zip(item.primary_keys, item.lookup_keys, strict=True)]
        found = source.select(*keys, *item.features)
        df = lookup_in_place(df, found, item.lookup_keys, item.buckets) if item.buckets else lookup(df, found, item.lookup_keys)
    return df


class FeatureStore:
    """Feature tables and models below one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- feature tables

    def create_table(
        self,
        name: str,
        primary_keys: Sequence[str],
        df: DataFrame | None = None,
        schema: T.StructType | None = None,
        description: str = "",
        partition_columns: Sequence[str] = (),
        at: datetime | str | None = None,
        buckets: int | None = None,
    ) -> FeatureTable:
        """Create a table from rows, or empty from a schema. With ``buckets`` all its versions are stored by key."""
        if self.has_table(name):
            raise ValueError(f"feature table {name} exists")
        if df is None:
            if schema is None:
                raise ValueError("give df or schema")
            df = self.spark.createDataFrame([], schema)
        elif schema is not None:
            df = df.select([F.col(field.name).cast(field.dataType).alias(field.name) for field in schema])
        location = f"{self._table_root(name)}/data"
        keys, partitions = list(primary_keys), list(partition_columns)
        self._write(location, df, keys, partitions, buckets, "CREATE", at)
        self._describe(name, location, keys, description, partitions, buckets)
        return FeatureTable(name, location, keys, [c for c in df.columns if c not in keys], description, partitions, buckets)

    def register_table(self, name: str, location: str, primary_keys: Sequence[str], description: str = "") -> FeatureTable:
        """Make an existing snapshot table a feature table, if its newest version has proper keys."""
        if self.has_table(name):
            raise ValueError(f"feature table {name} exists")
        require_unique_keys(SnapshotTable(self.spark, location).read(), primary_keys)
        self._describe(name, location, primary_keys, description, ())
        return self.get_table(name)

    def write_table(self, name: str, df: DataFrame, mode: str = "overwrite", at: datetime | str | None = None) -> int:
        """Store the next version. New columns appear; columns the frame lacks stay, as null."""
        if mode != "overwrite":
            raise ValueError(f"unknown mode {mode!r}")
        meta = self._meta(name)
        return self._write(meta.location, df, meta.primary_keys, meta.partition_columns, meta.buckets, "OVERWRITE", at)

    def read_table(self, name: str, as_of: datetime | str | None = None, version: int | None = None) -> DataFrame:
        return self._snapshots(name).read(version, as_of)

    def get_table(self, name: str) -> FeatureTable:
        meta = self._meta(name)
        schema = stored_schema(SnapshotTable(self.spark, meta.location).entry())
        features = [column for column in schema.names if column not in meta.primary_keys]
        return FeatureTable(
            name, meta.location, list(meta.primary_keys), features, meta.description, list(meta.partition_columns), meta.buckets
        )

    def history(self, name: str) -> DataFrame:
        return self._snapshots(name).history()

    def has_table(self, name: str) -> bool:
        return storage.exists(self.spark, f"{self._table_root(name)}/meta")

    def list_tables(self) -> list[str]:
        return [name for name in storage.list_names(self.spark, f"{self.root}/tables") if self.has_table(name)]

    def drop_table(self, name: str) -> None:
        """Drop a table with its data, in all versions."""
        location = self._meta(name).location
        storage.delete(self.spark, self._table_root(name))
        storage.delete(self.spark, location)

    # --- training sets

    def create_training_set(
        self, df: DataFrame, lookups: Sequence[FeatureLookup], label: str, exclude_columns: Sequence[str] | str = ()
    ) -> TrainingSet:
        """Fix the spine, the table versions to read, and the columns to leave out."""
        if label not in df.columns:
            raise ValueError(f"no label column {label}")
        exclude = [exclude_columns] if isinstance(exclude_columns, str) else list(exclude_columns)
        resolved, sources = [], []
        for item in lookups:
            found, source = self._resolve(item)
            resolved.append(found)
            sources.append(source)
        names = [*df.columns, *[feature for item in resolved for feature in item.features]]
        if len(set(names)) < len(names):
            raise ValueError(f"columns meet twice: {sorted({name for name in names if names.count(name) > 1})}")
        return TrainingSet(df, resolved, sources, label, exclude)

    # --- models

    def log_model(
        self,
        name: str,
        model: PipelineModel,
        training_set: TrainingSet,
        at: datetime | str | None = None,
        run_id: str | None = None,
        example_rows: int = 3,
    ) -> int:
        """Store a model as the next version; the first is 1.

        With it go its lookups, its signature (input, looked-up and label columns with their types), the run that made
        it, and its first input rows by key.
        """
        wanted = model_inputs(model)
        lookups = [
            {**asdict(item), "features": [feature for feature in item.features if feature in wanted]}
            for item in training_set.lookups
        ]
        keys = [key for item in training_set.lookups for key in item.lookup_keys]
        spine = [
            [field.name, field.dataType.simpleString()]
            for field in training_set.spine.schema
            if field.name != training_set.label and (field.name in wanted or field.name in keys)
        ]
        rows = training_set.load_df()
        types = {field.name: field.dataType.simpleString() for field in training_set.spine.schema}
        used = [feature for item in lookups for feature in item["features"] if feature in rows.columns]
        meta = {
            "label": training_set.label,
            "label_type": types[training_set.label],
            "lookups": lookups,
            "signature": spine,
            "looked_up": [[feature, rows.schema[feature].dataType.simpleString()] for feature in used],
        }
        log = self._model_log(name)
        newest = log.agg(F.max("version")).first()[0] if log is not None else None
        version = (newest or 0) + 1
        model.write().overwrite().save(self._model_path(name, version))
        inputs = [column for column in [*[name for name, _ in spine], *used] if column in rows.columns]
        example = training_set.first_rows(example_rows).select(*inputs)
        example.write.mode("overwrite").parquet(self._example_path(name, version))
        row = self.spark.range(1, numPartitions=1).select(
            F.lit(name).alias("name"),
            F.lit(version).cast("long").alias("version"),
            utc(at).alias("ts"),
            F.lit(json.dumps(meta)).alias("meta"),
            F.lit(run_id).cast("string").alias("run_id"),
        )
        row.write.mode("append").parquet(f"{self.root}/model_log")
        return version

    def model_meta(self, name: str, version: int) -> dict:
        log = self._model_log(name)
        found = log.where(F.col("version") == version).first() if log is not None else None
        if found is None:
            raise NoSuchVersion(f"model {name}, version {version}")
        return json.loads(found.meta)

    def load_model(self, name: str, version: int) -> PipelineModel:
        self.model_meta(name, version)
        return PipelineModel.load(self._model_path(name, version))

    def load_run_model(self, run_id: str) -> PipelineModel:
        """The model that a run logged; of several the newest."""
        log = self._model_log()
        newest = [F.desc("ts"), F.desc("name"), F.desc("version")]
        found = log.where(F.col("run_id") == run_id).orderBy(*newest).first() if log is not None else None
        if found is None:
            raise NoSuchVersion(f"run {run_id} logged no model")
        return PipelineModel.load(self._model_path(found.name, found.version))

    def model_signature(self, name: str, version: int) -> DataFrame:
        """Position, name, type and role (input, looked up, label) of the columns a model was trained on."""
        meta = self.model_meta(name, version)
        columns = [(*column, "input") for column in meta["signature"]]
        columns += [(*column, "looked up") for column in meta["looked_up"]]
        columns.append((meta["label"], meta["label_type"], "label"))
        rows = [(i, *column) for i, column in enumerate(columns)]
        return self.spark.createDataFrame(rows, "position int, name string, type string, role string")

    def model_example(self, name: str, version: int) -> DataFrame:
        """The first input rows that were stored with a model."""
        self.model_meta(name, version)
        return self.spark.read.parquet(self._example_path(name, version))

    def model_lookups(self, name: str) -> DataFrame:
        """(version, table, feature, table_version) of every feature that a model's versions look up."""
        element = "struct<lookups: array<struct<table: string, features: array<string>, version: bigint>>>"
        parsed = self._model_log(name).select("version", F.from_json("meta", element).alias("meta"))
        per_table = parsed.select("version", F.explode("meta.lookups").alias("item"))
        return per_table.select(
            "version",
            F.col("item.table").alias("table_name"),
            F.explode("item.features").alias("feature"),
            F.col("item.version").alias("table_version"),
        )

    def score_batch(
        self, name: str, version: int, df: DataFrame, result_type: str = "double", as_of: datetime | str | None = None
    ) -> DataFrame:
        """Add looked-up features and ``prediction`` to rows that hold the keys and the fresh features.

        Features come from the newest version of their tables, or from the one at ``as_of``. When that version no
        longer fills a feature the model uses, the call raises instead of scoring on nulls.
        """
        meta = self.model_meta(name, version)
        require_signature(df, meta["signature"])
        lookups = [ResolvedLookup(**item) for item in meta["lookups"]]
        sources, current = [], []
        for item in lookups:
            snapshots = self._snapshots(item.table)
            entry = snapshots.entry(as_of=as_of)
            retired = [feature for feature in item.features if feature not in entry.columns]
            if retired:
                raise RetiredFeature(
                    f"{item.table} version {entry.version} has no {retired}; "
                    f"the model was trained on version {item.version}: give as_of"
                )
            in_place = bool(item.buckets and entry.buckets)
            sources.append(snapshots.scan_by_key(entry) if in_place else snapshots.scan(entry))
            current.append(replace(item, buckets=entry.buckets if in_place else None))
        rows = join_features(df, current, sources)
        scored = PipelineModel.load(self._model_path(name, version)).transform(rows)
        return scored.select(*rows.columns, F.col("prediction").cast(result_type).alias("prediction"))

    # --- storage

    def _table_root(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def _model_path(self, name: str, version: int) -> str:
        return f"{self.root}/models/{name}/version={version}"

    def _example_path(self, name: str, version: int) -> str:
        return f"{self.root}/models/{name}/example={version}"

    def _model_log(self, name: str | None = None) -> DataFrame | None:
        """The log of all models, or of one."""
        path = f"{self.root}/model_log"
        if not storage.exists(self.spark, path):
            return None
        log = self.spark.read.schema(_MODEL_SCHEMA).parquet(path)
        return log if name is None else log.where(F.col("name") == name)

    def _snapshots(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, self._meta(name).location)

    def _meta(self, name: str):
        if not self.has_table(name):
            raise LookupError(f"no feature table {name}")
        return self.spark.read.schema(_META_SCHEMA).parquet(f"{self._table_root(name)}/meta").first()

    def _describe(self, name, location, primary_keys, description, partition_columns, buckets=None) -> None:
        row = self.spark.range(1, numPartitions=1).select(
            F.lit(location).alias("location"),
            F.array(*map(F.lit, primary_keys)).alias("primary_keys"),
            F.lit(description).alias("description"),
            F.array(*map(F.lit, partition_columns)).cast("array<string>").alias("partition_columns"),
            F.lit(buckets).cast("int").alias("buckets"),
        )
        row.write.mode("overwrite").parquet(f"{self._table_root(name)}/meta")

    def _write(self, location, df, primary_keys, partition_columns, buckets, operation, at) -> int:
        return SnapshotTable(self.spark, location).write(
            df,
            schema_mode="grow",
            operation=operation,
            at=at,
            partition_by=partition_columns,
            bucket_by=primary_keys,
            buckets=buckets,
            check=lambda stored: require_unique_keys(stored, primary_keys),
        )

    def _resolve(self, item: FeatureLookup) -> tuple[ResolvedLookup, DataFrame]:
        meta = self._meta(item.table_name)
        snapshots = SnapshotTable(self.spark, meta.location)
        entry = snapshots.entry()
        keys = [item.lookup_key] if isinstance(item.lookup_key, str) else list(item.lookup_key)
        known = [name for name in stored_schema(entry).names if name not in meta.primary_keys]
        features = known if item.feature_names is None else list(item.feature_names)
        unknown = [feature for feature in features if feature not in known]
        if unknown:
            raise ValueError(f"{item.table_name} has no {unknown}")
        if item.in_place and not entry.buckets:
            raise ValueError(f"{item.table_name} is not stored by key")
        buckets = entry.buckets if item.in_place else None
        resolved = ResolvedLookup(item.table_name, list(meta.primary_keys), keys, features, entry.version, buckets)
        return resolved, snapshots.scan_by_key(entry) if item.in_place else snapshots.scan(entry)


def model_inputs(model: PipelineModel) -> set[str]:
    """Names of all columns the model's stages read."""
    inputs = set()
    for stage in model.stages:
        if stage.hasParam("inputCols") and stage.isSet("inputCols"):
            inputs.update(stage.getInputCols())
        if stage.hasParam("inputCol") and stage.isSet("inputCol"):
            inputs.add(stage.getInputCol())
    return inputs
