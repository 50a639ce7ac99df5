import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from stayframe.operators import runlog, versions
from stayframe.operators.foldedlog import FoldedLog, stages_of
from stayframe.sources import runsource

LOG = "model long, version_key long, ts timestamp, event_id long, stage string, archive_existing boolean, description string"


def _log(spark, *changes):
    rows = [(1, key, i, i, stage, archive, text) for i, (key, stage, archive, text) in enumerate(changes)]
    frame = spark.createDataFrame(rows, LOG.replace("ts timestamp", "ts long"))
    return frame.withColumn("ts", F.timestamp_seconds("ts"))


def _stages(frame):
    return {row.version_key: row.stage for row in frame.collect()}


def test_archiving_change_ends_the_older_holder(spark):
    log = _log(spark, (1, "Production", False, None), (2, "Production", True, None))
    assert _stages(versions.archived_stages(log)) == {1: "Archived", 2: "Production"}
    assert _stages(versions.current_stages(log)) == {1: "Production", 2: "Production"}


def test_unflagged_change_leaves_several_holders(spark):
    log = _log(spark, (1, "Production", False, None), (2, "Production", False, None))
    assert _stages(versions.archived_stages(log)) == {1: "Production", 2: "Production"}


def test_archiving_touches_only_its_stage_and_earlier_holders(spark):
    log = _log(
        spark, (1, "Staging", False, None), (2, "Production", True, None), (3, "Production", False, None),
        (4, "None", True, None), (5, "None", False, None),
    )
    assert _stages(versions.archived_stages(log)) == {1: "Staging", 2: "Production", 3: "Production", 4: "None", 5: "None"}


def test_version_that_left_the_stage_in_time(spark):
    log = _log(spark, (1, "Production", False, None), (1, "Staging", False, None), (2, "Production", True, None))
    assert _stages(versions.archived_stages(log)) == {1: "Staging", 2: "Production"}


def test_new_version_starts_in_none_and_is_numbered(spark):
    log = _log(spark, (9, None, False, "first"), (4, None, False, None), (9, None, False, "second"))
    folded = versions.fold_versions(log)
    assert _stages(folded) == {9: "None", 4: "None"}
    numbers = versions.number_versions(folded.select("model", "version_key", "first_ts"))
    assert {row.version_key: row.version for row in numbers.collect()} == {9: 1, 4: 2}
    assert [row.description for row in versions.version_descriptions(log).collect()] == ["second"]
    with pytest.raises(Exception, match="unknown stage"):
        versions.current_stages(_log(spark, (1, "Retired", False, None))).collect()


def test_deletion(spark):
    production = _log(spark, (2, "Production", False, None))
    request = spark.createDataFrame([(1, 2)], "model long, version_key long")
    with pytest.raises(versions.DeletionRefused, match="Production"):
        versions.require_deletable(request, production)
    versions.require_deletable(request, _log(spark, (2, "Production", False, None), (2, "Archived", False, None)))
    versions.require_deletable(request, _log(spark, (2, None, False, None)))
    with pytest.raises(versions.DeletionRefused):
        versions.require_deletable(spark.createDataFrame([(1, 3)], "model long, version_key long"), production)


def test_deleted_model_ends_its_versions(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "model long, version_key long")
    left = versions.without_deleted_models(rows, spark.createDataFrame([(1,), (1,)], "model long"))
    assert [tuple(row) for row in left.collect()] == [(2, 3)]


def test_transition_is_appended(spark):
    log = _log(spark, (1, "Staging", False, None))
    change = log.select("model", "version_key", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(5).cast("long").alias("event_id"), F.lit("Production").alias("stage"), F.lit(True).alias("archive_existing"))
    assert _stages(versions.archived_stages(versions.append_transition(log, change))) == {1: "Production"}


@pytest.fixture(scope="module")
def run_log(spark):
    first = runlog.run_rows(spark, 1, "a", {"r2_train": 0.9, "r2_test": 0.7}, {"depth": 5, "seed": None}, at="2024-01-01T00:00:00")
    again = runlog.run_rows(spark, 1, "a", {"r2_test": 0.6}, {"depth": 6}, at="2024-01-01T01:00:00")
    second = runlog.run_rows(spark, 1, "b", {"r2_train": 0.8}, at="2024-01-02T00:00:00")
    other = runlog.run_rows(spark, 2, "c", {"r2_train": 0.5, "r2_test": 0.5}, at="2023-01-01T00:00:00")
    return first.unionByName(again).unionByName(second).unionByName(other)


def test_runs_table_takes_the_latest_value(run_log):
    runs = {row.run_id: row for row in runlog.runs_table(run_log, ["r2_train", "r2_test"]).collect()}
    assert runs["a"].r2_test == 0.6 and runs["b"].r2_test is None
    assert runs["a"].start_time.isoformat() == "2024-01-01T00:00:00"


def test_latest_run_and_its_metrics(run_log):
    runs = runlog.runs_table(run_log, ["r2_train", "r2_test"])
    latest = runlog.latest_run(runs)
    assert latest.first().run_id == "b"
    assert [(row.metric, row.value) for row in runlog.metrics_of(run_log, latest).collect()] == [("r2_train", 0.8)]
    per_experiment = runlog.latest_runs(runs)
    assert per_experiment.columns == runs.columns
    assert {row.experiment_id: row.run_id for row in per_experiment.collect()} == {1: "b", 2: "c"}


def test_gap_and_best_run(run_log):
    runs = runlog.runs_table(run_log, ["r2_train", "r2_test"])
    gaps = {row.run_id: row.gap for row in runlog.metric_gap(runs, "r2_train", "r2_test").collect()}
    assert gaps == {"a": pytest.approx(0.3), "c": 0.0}
    assert runlog.best_run(runs, "r2_test", True).first().run_id == "a"
    assert runlog.best_run(runs, "r2_test", False).first().run_id == "c"


def test_experiment_filter_reaches_the_stored_log(spark, run_log, tmp_path, plan):
    runlog.store_log(run_log, str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    runs = runlog.experiment_runs(stored, 2, ["r2_test"])
    assert [row.run_id for row in runs.collect()] == ["c"]
    assert "EqualTo(experiment_id,2)" in plan(runs)


def test_parameters_are_columns_of_the_runs_table(spark, run_log):
    runs = {row.run_id: row for row in runlog.runs_table(run_log, ["r2_test"], ["depth", "seed"]).collect()}
    assert (runs["a"].param_depth, runs["a"].param_seed, runs["b"].param_depth) == ("6", "None", None)
    run = run_log.where("run_id = 'a'").select(*runlog.RUN).distinct()
    assert {row.param: row.text for row in runlog.params_of(run_log, run).collect()} == {"depth": "6", "seed": "None"}
    assert {row.metric for row in runlog.metrics_of(run_log, run).collect()} == {"r2_train", "r2_test"}


def test_log_folds_take_one_shuffle_and_no_sort(spark, sf_dir, plan):
    from stayframe.plans.logs import RUN_METRICS
    from stayframe.plans.logs import run_log as events_log
    from stayframe.plans.logs import version_log
    from stayframe.sources.listings import table

    events = table(spark, sf_dir, "events")
    for frame in (runlog.runs_table(events_log(events), RUN_METRICS), versions.current_stages(version_log(events))):
        text = plan(frame)
        assert text.count("Exchange") == 1 and "SortAggregate" not in text and "Sort [" not in text
    text = plan(versions.archived_stages(version_log(events)))
    assert "SortAggregate" not in text


def changes(spark, rows):
    schema = "model int, version_key int, ts timestamp, event_id long, stage string, archive_existing boolean, description string"
    text = [(m, v, str(ts), e, s, a, d) for m, v, ts, e, s, a, d in rows]
    return spark.createDataFrame(text, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_fold_of_state_and_tail_equals_the_whole_fold_for_any_cut(spark, tmp_path):
    rng = random.Random(5)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [
        (rng.randrange(3), rng.randrange(4), start + timedelta(hours=7 * k), k, rng.choice([None, *versions.STAGES]), rng.random() < 0.5, rng.choice([None, f"d{k}"]))
        for k in range(60)
    ]
    log = changes(spark, rows)
    whole = {(row.model, row.version_key): row.stage for row in versions.archived_stages(log).collect()}
    texts = {(row.model, row.version_key): row.description for row in versions.version_descriptions(log).collect()}
    for n, cuts in enumerate([[], [0], [59], [20], [10, 30, 45]]):
        folded = FoldedLog(spark, str(tmp_path / f"log{n}"))
        done = 0
        for cut in cuts:
            folded.append(log.where(f"event_id >= {done} AND event_id <= {cut}"))
            folded.fold(rows[cut][2])
            done = cut + 1
        folded.append(log.where(f"event_id >= {done}"))
        found = stages_of(folded.states()).collect()
        assert {(row.model, row.version_key): row.stage for row in found} == whole
        assert {(row.model, row.version_key): row.description for row in found if row.description} == texts
        if cuts:
            assert folded.tail().count() == 59 - cuts[-1]
            with pytest.raises(ValueError):
                folded.fold(rows[cuts[-1]][2])


def test_only_the_tails_files_are_read(spark, tmp_path, plan):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    log = changes(spark, [(1, k % 3, start + timedelta(days=k), k, "Staging", False, None) for k in range(10)])
    folded = FoldedLog(spark, str(tmp_path / "log"))
    folded.append(log)
    folded.fold(start + timedelta(days=7))
    tail = folded.tail()
    assert "PartitionFilters: [isnotnull(day" in plan(tail)
    files = tail.select(F.input_file_name().alias("file")).distinct().collect()
    assert tail.count() == 2 and len(files) == 2
    with pytest.raises(LookupError):
        FoldedLog(spark, str(tmp_path / "none")).states()


def test_runs_as_a_data_source(spark, tmp_path, plan):
    rng = random.Random(1)
    rows = [
        (rng.choice([1, 1, 1, 2, 3]), f"r{rng.randrange(6)}", rng.choice(["a", "b", "c"]), rng.choice([None, rng.random()]), rng.choice([None, "t"]), f"2024-01-{1 + k % 28:02d}", k)
        for k in range(3000)
    ]
    log = spark.createDataFrame(rows, "experiment_id long, run_id string, metric string, value double, text string, ts string, event_id long")
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "runs")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runsource.store_runs(log, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    runsource.register(spark)

    def told(frame):
        return {(row.experiment_id, row.run_id): (row.start_time, row.metrics, row.params) for row in frame.collect()}

    expected = told(runlog.open_runs(log))
    source = spark.read.format(runsource.FORMAT).option("log", path)
    assert told(source.load()) == expected
    of_one = {key: value for key, value in expected.items() if key[0] == 2}
    assert told(source.load("2")) == of_one and told(source.load().where("experiment_id = 2")) == of_one
    reader = runsource.RunReader({"log": path})
    every = reader.partitions()
    assert sum(len(part.files) for part in every) >= 3 and len({file for part in every for file in part.files}) == sum(len(part.files) for part in every)
    assert list(reader.pushFilters([EqualTo(("experiment_id",), 3), EqualTo(("run_id",), "r1")])) == [EqualTo(("run_id",), "r1")]
    assert sum(len(part.files) for part in reader.partitions()) < sum(len(part.files) for part in every)
    assert source.load("99").count() == 0
    with pytest.raises(Exception, match="log"):
        spark.read.format(runsource.FORMAT).load("1").count()
