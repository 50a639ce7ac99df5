"""The ``events`` table read as a run log and as a model-version log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The metrics, and the stage an event type moves a version to.
RUN_METRICS = ["click", "error", "purchase", "signup", "view"]
RUN_PARAMS = ["signup", "purchase"]
STAGE_OF_EVENT = {"view": "Staging", "purchase": "Production", "error": "Archived"}


def run_log(events: DataFrame) -> DataFrame:
    """A user is an experiment, a user's day is a run, the event types are the metrics, and their properties parameters."""
    run_id = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return events.select(
        F.col("user_id").alias("experiment_id"),
        run_id.alias("run_id"),
        F.col("event_type").alias("metric"),
        "value",
        F.col("props").alias("text"),
        "ts",
        "event_id",
    )


def artifact_log(log: DataFrame) -> DataFrame:
    """One artifact per metric a run logged."""
    path = F.concat(F.lit("metrics/"), F.col("metric"), F.lit(".csv"))
    return log.select("experiment_id", "run_id", path.alias("path"))


def version_log(events: DataFrame) -> DataFrame:
    """Ten models; each user is a version of one of them, and all events but clicks are stage changes."""
    kind = F.col("event_type")
    stage = F.lit("None")
    for event, target in STAGE_OF_EVENT.items():
        stage = F.when(kind == event, target).otherwise(stage)
    return events.where(kind != "click").select(
        (F.col("user_id") % 10).alias("model"),
        F.col("user_id").alias("version_key"),
        "ts",
        "event_id",
        stage.alias("stage"),
        (F.col("event_id") % 2 == 0).alias("archive_existing"),
        F.when(F.col("event_id") % 5 == 0, F.col("props")).alias("description"),
    )
