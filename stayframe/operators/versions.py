"""Model versions folded from an append-only log.

Log rows: model, version_key, ts, event_id, stage (None, Staging, Production, Archived; null: no change),
archive_existing, description (null: no change). Rows are ordered by ``ts`` and then ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayframe.operators.joins import lookup
from stayframe.operators.numbering import number_within
from stayframe.operators.runlog import moment

VERSION = ["model", "version_key"]
# The stages.
STAGES = ["None", "Staging", "Production", "Archived"]
# The stages a version may be deleted in.
DELETABLE = ["Archived", "None"]
# The stages whose older holders a change can archive.
ACTIVE = ["Staging", "Production"]


def stage_code() -> Column:
    """A stage as its place among :data:`STAGES`, which aggregates by hashing; null for no change."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")
    unknown = F.raise_error(F.concat(F.lit("unknown stage "), F.col("stage"))).cast("int")
    return F.when(F.col("stage").isNull(), None).when(place > 0, place).otherwise(unknown)


def stage_name(code: Column) -> Column:
    """The stage of a code; a version that had no change is in None."""
    return F.element_at(F.array(*map(F.lit, STAGES)), F.coalesce(code, F.lit(1)))


def _folded(log: DataFrame, *more: Column) -> DataFrame:
    """One row per version: first seen, code and moment of the last stage change, and what else is asked for."""
    staged = F.when(F.col("stage").isNotNull(), moment())
    return log.groupBy(*VERSION).agg(
        F.min("ts").alias("first_ts"), F.max_by(stage_code(), staged).alias("code"), F.max(staged).alias("staged_at"), *more
    )


def fold_versions(log: DataFrame) -> DataFrame:
    """One row per version: when it was first seen and its last stage."""
    return _folded(log).select(*VERSION, "first_ts", stage_name(F.col("code")).alias("stage"))


def number_versions(versions: DataFrame) -> DataFrame:
    """Versions of a model are 1, 2, ... by first appearance, then by key."""
    return number_within(versions, ["model"], ["first_ts", "version_key"], "version")


def current_stages(log: DataFrame) -> DataFrame:
    """The last stage of every version, as if no change had archived others."""
    return fold_versions(log).select(*VERSION, "stage")


def append_transition(log: DataFrame, change: DataFrame) -> DataFrame:
    """The log with further rows; the fold then reads the new state."""
    return log.unionByName(change, allowMissingColumns=True)


def archived_stages(log: DataFrame) -> DataFrame:
    """The current stage where a change with ``archive_existing`` archives the older holders of its stage.

    A version holds its last stage from ``staged_at`` on. It is archived when the model's latest archiving change to
    that stage came later; the change itself is another version's, since its own would be its last one. The log is read
    and shuffled once: a model's latest archiving changes come from its versions' latest ones.
    """
    archiving = {
        stage: F.max(F.when(F.col("archive_existing") & (F.col("stage") == stage), moment())).alias(f"archived_{stage}")
        for stage in ACTIVE
    }
    versions = _folded(log, *archiving.values())
    of_model = versions.groupBy("model").agg(*[F.max(f"archived_{stage}").alias(f"archived_{stage}") for stage in ACTIVE])
    joined = lookup(versions.select(*VERSION, "code", "staged_at"), of_model, ["model"])
    stage = stage_name(F.col("code"))
    overtaken = F.lit(False)
    for active in ACTIVE:
        overtaken = overtaken | ((stage == active) & (F.col(f"archived_{active}") > F.col("staged_at")))
    return joined.select(*VERSION, F.when(overtaken, "Archived").otherwise(stage).alias("stage"))


def version_descriptions(log: DataFrame) -> DataFrame:
    """The latest description of every version that has one."""
    described = log.where("description IS NOT NULL")
    return described.groupBy(*VERSION).agg(F.max_by("description", moment()).alias("description"))


def model_descriptions(log: DataFrame) -> DataFrame:
    """The latest description given for every model."""
    described = log.where("description IS NOT NULL")
    return described.groupBy("model").agg(F.max_by("description", moment()).alias("description"))


def judge_deletions(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Deletion requests (model, version_key) with the version's stage, and whether the deletion is allowed.

    A version in another stage than Archived or None is refused, and so is one that does not exist (stage is null).
    """
    stages = archived_stages(log)
    judged = lookup(requests, stages, VERSION)
    return judged.withColumn("allowed", F.coalesce(F.col("stage").isin(*DELETABLE), F.lit(False)))


class DeletionRefused(ValueError):
    """A version outside Archived and None was to be deleted."""


def require_deletable(requests: DataFrame, log: DataFrame) -> None:
    refused = judge_deletions(requests, log).where(~F.col("allowed")).orderBy(*VERSION).first()
    if refused is not None:
        raise DeletionRefused(f"{refused.model}/{refused.version_key} is in stage {refused.stage}")


def without_deleted_models(versions: DataFrame, deleted_models: DataFrame) -> DataFrame:
    """Versions of models that were not deleted; deleting a model ends all of its versions."""
    ended = deleted_models.select("model").distinct().withColumn("_ended", F.lit(True))
    return lookup(versions, ended, ["model"]).where("_ended IS NULL").drop("_ended")
