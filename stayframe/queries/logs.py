"""Run-log and version-log analysis."""

from pyspark.sql import functions as F

from stayframe.operators import runlog, search, versions
from stayframe.operators.foldedlog import FoldedLog, stages_of
from stayframe.plans.logs import RUN_METRICS, RUN_PARAMS, artifact_log, run_log, version_log
from stayframe.queries.oracle import over
from stayframe.queries.registry import query, rounded
from stayframe.session import new_workspace
from stayframe.sources.listings import table


def runs_of(spark, sf_dir):
    return run_log(table(spark, sf_dir, "events"))


def changes_of(spark, sf_dir):
    return version_log(table(spark, sf_dir, "events"))


_LATEST = "(SELECT run_id FROM runs ORDER BY start_time DESC, run_id DESC LIMIT 1)"


@query(
    "i4_best_trial",
    over(
        "runs",
        "SELECT run_id AS trial, 'purchase' AS metric, purchase AS value FROM runs WHERE purchase IS NOT NULL "
        "ORDER BY purchase DESC, run_id LIMIT 1",
    ),
)
def i4_best_trial(spark, sf_dir):
    """The run log as a trial table; the larger value is taken as better."""
    values = runlog.latest_values(runs_of(spark, sf_dir))
    best = runlog.best_run(values.where("metric = 'purchase'").withColumnRenamed("value", "purchase"), "purchase", True)
    return best.select(F.col("run_id").alias("trial"), "metric", F.col("purchase").alias("value"))


@query(
    "i4_best_by_error",
    over(
        "latest_values",
        "SELECT run_id AS trial, metric, value FROM latest_values WHERE metric = 'error' ORDER BY value, run_id LIMIT 1",
    ),
)
def i4_best_by_error(spark, sf_dir):
    values = runlog.latest_values(runs_of(spark, sf_dir)).select(F.col("run_id").alias("trial"), "metric", "value")
    return search.best_trial(values, "error")


_PARAMS = ", ".join(
    f"arg_max(props, (ts, event_id)) FILTER (WHERE event_type = '{name}' AND props IS NOT NULL) AS param_{name}" for name in RUN_PARAMS
)


@query(
    "j1_runs_table",
    over(
        "runs",
        f"""SELECT r.*, p.* EXCLUDE (run_id) FROM runs r JOIN (
            SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id, {_PARAMS}
            FROM events GROUP BY 1) p USING (run_id)""",
    ),
)
def j1_runs_table(spark, sf_dir):
    """Metrics and parameters of every run."""
    return runlog.runs_table(runs_of(spark, sf_dir), RUN_METRICS, RUN_PARAMS)


@query("j1_metrics_only", over("runs", "SELECT * FROM runs"))
def j1_metrics_only(spark, sf_dir):
    return runlog.runs_table(runs_of(spark, sf_dir), RUN_METRICS)


def told(runs):
    """The maps of runs as text and numbers that any engine can compare."""
    names = F.array_sort(F.map_keys("metrics"))
    total = F.aggregate(F.map_values("metrics"), F.lit(0.0), lambda sum, value: sum + value)
    texts = F.transform(F.array_sort(F.map_entries("params")), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"]))
    return runs.select(
        *runlog.RUN, "start_time", F.size("metrics").cast("long").alias("n_metrics"),
        F.when(F.size("metrics") > 0, F.array_join(names, ",")).alias("metrics"),
        F.round(F.when(F.size("metrics") > 0, total), 6).alias("values_total"),
        F.when(F.size("params") > 0, F.array_join(texts, ";")).alias("params"),
    )


OPEN_RUNS_SQL = """SELECT l.experiment_id, l.run_id, min(s.start_time) AS start_time, count(l.value) AS n_metrics,
            string_agg(l.metric, ',' ORDER BY l.metric) FILTER (WHERE l.value IS NOT NULL) AS metrics,
            round(sum(l.value), 6) AS values_total, string_agg(p.metric || '=' || p.text, ';' ORDER BY p.metric) AS params
            FROM (SELECT experiment_id, run_id, metric, arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value
                  FROM run_log GROUP BY ALL) l
            JOIN (SELECT run_id, min(ts) AS start_time FROM run_log GROUP BY run_id) s USING (run_id)
            LEFT JOIN (SELECT run_id, metric, arg_max(text, (ts, event_id)) AS text FROM (
                SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id, event_type AS metric, props AS text, ts, event_id
                FROM events WHERE props IS NOT NULL) GROUP BY ALL) p ON p.run_id = l.run_id AND p.metric = l.metric
            GROUP BY l.experiment_id, l.run_id"""


@query("j1_open_metrics", over("run_log", OPEN_RUNS_SQL))
def j1_open_metrics(spark, sf_dir):
    """Metrics and parameters of every run, whatever their names; none is given."""
    return told(runlog.open_runs(runs_of(spark, sf_dir)))


@query("j2_latest_run", over("runs", "SELECT * FROM runs ORDER BY start_time DESC, run_id DESC LIMIT 1"))
def j2_latest_run(spark, sf_dir):
    return runlog.latest_run(runlog.runs_table(runs_of(spark, sf_dir), RUN_METRICS))


@query(
    "j2_latest_run_per_experiment",
    over(
        "runs",
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
             PARTITION BY experiment_id ORDER BY start_time DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1""",
    ),
)
def j2_latest_run_per_experiment(spark, sf_dir):
    return runlog.latest_runs(runlog.runs_table(runs_of(spark, sf_dir), RUN_METRICS))


@query(
    "j3_run_metrics",
    over("runs", f"SELECT experiment_id, run_id, metric, value FROM latest_values WHERE run_id = {_LATEST}"),
)
def j3_run_metrics(spark, sf_dir):
    log = runs_of(spark, sf_dir)
    return runlog.metrics_of(log, runlog.latest_run(runlog.start_times(log)))


@query(
    "j4_run_artifacts",
    over(
        "runs",
        f"""SELECT DISTINCT experiment_id, run_id, 'metrics/' || metric || '.csv' AS path FROM run_log
            WHERE run_id = {_LATEST}""",
    ),
)
def j4_run_artifacts(spark, sf_dir):
    log = runs_of(spark, sf_dir)
    return runlog.artifacts_of(artifact_log(log), runlog.latest_run(runlog.start_times(log)))


@query(
    "j5_metric_gap",
    over(
        "runs",
        """SELECT experiment_id, run_id, view, click, round(view - click, 6) AS gap FROM runs
           WHERE view IS NOT NULL AND click IS NOT NULL""",
    ),
)
def j5_metric_gap(spark, sf_dir):
    runs = runlog.runs_table(runs_of(spark, sf_dir), ["view", "click"])
    return rounded(runlog.metric_gap(runs, "view", "click"), ["gap"])


@query("k1_version_numbers", over("numbered", "SELECT model, version_key, version, first_ts FROM numbered"))
def k1_version_numbers(spark, sf_dir):
    seen = versions.fold_versions(changes_of(spark, sf_dir)).select("model", "version_key", "first_ts")
    return versions.number_versions(seen)


@query("k2_current_stages", over("last_change", "SELECT model, version_key, stage FROM last_change"))
def k2_current_stages(spark, sf_dir):
    return versions.current_stages(changes_of(spark, sf_dir))


_NEXT = "CASE WHEN stage = 'Staging' THEN 'Production' ELSE stage END"


@query("k3_stage_change", over("last_change", f"SELECT model, version_key, {_NEXT} AS stage FROM last_change"))
def k3_stage_change(spark, sf_dir):
    """Every version in Staging moves to Production: appended to the log, then folded again."""
    log = changes_of(spark, sf_dir)
    staged = versions.current_stages(log).where("stage = 'Staging'")
    after = log.agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    change = staged.crossJoin(F.broadcast(after)).select(
        "model",
        "version_key",
        (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"),
        (F.col("event_id") + 1).alias("event_id"),
        F.lit("Production").alias("stage"),
        F.lit(False).alias("archive_existing"),
    )
    return versions.current_stages(versions.append_transition(log, change))


@query("k4_archived_stages", over("archived", "SELECT model, version_key, stage FROM archived"))
def k4_archived_stages(spark, sf_dir):
    return versions.archived_stages(changes_of(spark, sf_dir))


_DESCRIBED = """SELECT {keys}, description FROM (SELECT {keys}, description, row_number() OVER (
    PARTITION BY {keys} ORDER BY ts DESC, event_id DESC) AS rn FROM version_log WHERE description IS NOT NULL) WHERE rn = 1"""


@query(
    "k4_fold_and_tail",
    over(
        "archived",
        f"""SELECT a.model, a.version_key, n.first_ts, a.stage, d.description FROM archived a
            JOIN (SELECT model, version_key, min(ts) AS first_ts FROM version_log GROUP BY model, version_key) n USING (model, version_key)
            LEFT JOIN ({_DESCRIBED.format(keys="model, version_key")}) d USING (model, version_key)""",
    ),
)
def k4_fold_and_tail(spark, sf_dir):
    """The log in two appends: the first is folded and stored, the second is read as the tail."""
    log = changes_of(spark, sf_dir)
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    cut = first + (last - first) * 2 / 3
    folded = FoldedLog(spark, new_workspace(spark, "version-log"))
    folded.append(log.where(F.col("ts") <= F.lit(cut)))
    folded.fold(cut)
    folded.append(log.where(F.col("ts") > F.lit(cut)))
    return stages_of(folded.states())


@query("k5_version_descriptions", over("version_log", _DESCRIBED.format(keys="model, version_key")))
def k5_version_descriptions(spark, sf_dir):
    return versions.version_descriptions(changes_of(spark, sf_dir))


@query("k5_model_descriptions", over("version_log", _DESCRIBED.format(keys="model")))
def k5_model_descriptions(spark, sf_dir):
    return versions.model_descriptions(changes_of(spark, sf_dir))


@query(
    "k6_deletion_requests",
    over(
        "archived",
        """SELECT u.user_id % 10 AS model, u.user_id AS version_key, a.stage,
             coalesce(a.stage IN ('Archived', 'None'), false) AS allowed
           FROM (SELECT DISTINCT user_id FROM events) u
           LEFT JOIN archived a ON a.model = u.user_id % 10 AND a.version_key = u.user_id""",
    ),
)
def k6_deletion_requests(spark, sf_dir):
    """A request to delete every user's version, also of users who never had one."""
    events = table(spark, sf_dir, "events")
    users = events.select((F.col("user_id") % 10).alias("model"), F.col("user_id").alias("version_key")).distinct()
    return versions.judge_deletions(users, changes_of(spark, sf_dir))


@query(
    "k7_deleted_models",
    over("ended", "SELECT model, version_key, version FROM numbered WHERE model NOT IN (SELECT model FROM ended)"),
)
def k7_deleted_models(spark, sf_dir):
    """Models with more changes to Archived than to Production count as deleted; the others' versions are left."""
    log = changes_of(spark, sf_dir)
    balance = F.count_if(F.col("stage") == "Archived") - F.count_if(F.col("stage") == "Production")
    deleted = log.groupBy("model").agg(balance.alias("balance")).where("balance > 0")
    left = versions.without_deleted_models(versions.fold_versions(log), deleted)
    return versions.number_versions(left.select("model", "version_key", "first_ts")).drop("first_ts")
