import os
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stayframe.plans.cleaning import etl_rows
from stayframe.queries import QUERIES
from stayframe.session import drop_workspaces, new_workspace, recorded_workspaces, shared_root, written
from stayframe.sources import catalog, storage
from stayframe.sources.csvfiles import read_csv, write_csv
from stayframe.sources.snapshots import NoSuchVersion, SnapshotTable


def test_csv_keeps_quotes_line_breaks_empty_and_null(spark, tmp_path):
    rows = [
        (1, 'a "q" b\nline2', 1.5), (2, "", None), (3, None, -2.0), (4, "  padded, ", 0.0), (5, "back\\slash", 1.0),
        (6, 'ends with "', 2.0),
    ]
    frame = spark.createDataFrame(rows, "id int, text string, x double")
    write_csv(frame, str(tmp_path / "out"), compression="gzip", null_value="\\N")
    back = read_csv(spark, str(tmp_path / "out"), frame.schema, null_value="\\N")
    assert sorted(map(tuple, back.collect())) == rows
    assert any(name.endswith(".csv.gz") for name in storage.list_names(spark, str(tmp_path / "out")))


def test_csv_escaped_field_as_written_by_others(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,text\n7,"a ""q"" b\nline2"\n')
    assert [tuple(row) for row in read_csv(spark, str(tmp_path / "in.csv")).collect()] == [(7, 'a "q" b\nline2')]


def test_csv_inference_separator_null_value_and_repartition(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id;price;beds\n1;$5.00;2\n2;NA;NA\n")
    frame = read_csv(spark, str(tmp_path / "in.csv"), sep=";", null_value="NA", repartition=3)
    assert frame.dtypes == [("id", "int"), ("price", "string"), ("beds", "int")]
    assert sorted(map(tuple, frame.collect())) == [(1, "$5.00", 2), (2, None, None)]


def test_versions_history_and_time(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    five = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, b int, c int, d int, e int")
    assert table.write(five, at="1970-01-01T00:00:10") == 0
    assert table.write(table.read().drop("d", "e"), at="1970-01-01T00:00:20") == 1
    assert table.read().columns == ["a", "b", "c"]
    assert table.read(version=0).columns == ["a", "b", "c", "d", "e"]
    for second, columns in ((10, 5), (15, 5), (20, 3), (99, 3)):
        assert len(table.read(as_of=f"1970-01-01T00:01:{second - 60:02d}" if second > 59 else f"1970-01-01T00:00:{second}").columns) == columns
    with pytest.raises(NoSuchVersion):
        table.read(as_of="1970-01-01T00:00:09")
    with pytest.raises(NoSuchVersion):
        table.read(version=2)
    history = table.history().orderBy("version").collect()
    assert [(row.version, row.n_rows, len(row.columns)) for row in history] == [(0, 1, 5), (1, 1, 3)]


def test_times_with_a_zone(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.write(spark.range(1), at="2024-01-01T01:00:00+01:00")
    assert table.read(as_of="2024-01-01T00:00:00+00:00").count() == 1
    with pytest.raises(NoSuchVersion):
        table.read(as_of="2024-01-01T00:59:00+01:00")


def test_write_without_history_row_is_no_version(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3))

    def refuse(stored):
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        table.write(spark.range(9), check=refuse)
    assert not storage.exists(spark, table.version_path(1)) and table.read().count() == 3
    assert table.write(spark.range(5)) == 1 and table.read().count() == 5


def test_growing_schema(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.write(spark.createDataFrame([(1, 2.0)], "id int, old double"))
    table.write(spark.createDataFrame([(1, "x")], "id int, new string"), schema_mode="grow")
    assert table.read().dtypes == [("id", "int"), ("old", "double"), ("new", "string")]
    assert table.entry().columns == ["id", "new"]
    with pytest.raises(ValueError, match="column id"):
        table.write(spark.createDataFrame([("1",)], "id string"), schema_mode="grow")


def test_old_version_reads_only_its_folder_and_pushes_filters(spark, tmp_path, listings, plan):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.write(etl_rows(listings))
    table.write(etl_rows(listings).drop("minimum_nights"))
    old = table.read(version=0)
    assert all("/version=0/" in name for name in old.inputFiles())
    text = plan(old.where("bedrooms = 2").select("price"))
    assert "EqualTo(bedrooms,2)" in text and "ReadSchema: struct<bedrooms:bigint,price:double>" in text


def test_database_and_tables(spark, tmp_path):
    catalog.create_database(spark, "shelf", str(tmp_path / "shelf"))
    catalog.create_database(spark, "shelf")
    catalog.save_table(spark.range(3), "shelf.a")
    catalog.save_table(spark.range(2).withColumn("x", F.lit(1)), "shelf.a")
    catalog.save_table(spark.range(1), "shelf.b")
    assert spark.table("shelf.a").columns == ["id", "x"] and spark.table("shelf.a").count() == 2
    with pytest.raises(Exception, match="UNSUPPORTED_OVERWRITE"):
        catalog.save_table(spark.table("shelf.a"), "shelf.a")
    catalog.drop_table(spark, "shelf.b")
    catalog.drop_table(spark, "shelf.b")
    spark.range(1).createOrReplaceTempView("passing_view")
    assert [row.tableName for row in catalog.tables(spark, "shelf").collect()] == ["a"]
    catalog.drop_database(spark, "shelf")
    assert not spark.catalog.databaseExists("shelf")


def _session(master, settings):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: settings.get(key, default)), sparkContext=SimpleNamespace(master=master)
    )


def test_workspace_follows_the_configured_folder():
    shared = _session("spark://somewhere", {"spark.checkpoint.dir": "hdfs://shared/folder/"})
    assert shared_root(shared) == "hdfs://shared/folder"
    assert new_workspace(shared, "x").startswith("hdfs://shared/folder/")
    assert new_workspace(shared, "x") != new_workspace(shared, "x")


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(_session("spark://somewhere", {}))


def test_plain_csv_files_are_split(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(60_000).selectExpr("id", "repeat('x', 20) AS t").coalesce(1).write.option("header", True).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        plain = read_csv(spark, path, "id long, t string", multi_line=False)
        assert plain.rdd.getNumPartitions() > 4 and plain.count() == 60_000
        assert read_csv(spark, path, "id long, t string").rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_malformed_csv_rows(spark, tmp_path):
    (tmp_path / "odd.csv").write_text("a,b\n1,2\nx,3\n4,5,6\n7,8\n")
    path, schema = str(tmp_path / "odd.csv"), "a int, b int"
    rows = read_csv(spark, path, schema, corrupt_column="bad").collect()
    assert [row.bad for row in rows] == [None, "x,3", "4,5,6", None]
    assert [tuple(row) for row in read_csv(spark, path, schema, mode="DROPMALFORMED").collect()] == [(1, 2), (7, 8)]
    with pytest.raises(Exception):
        read_csv(spark, path, schema, mode="FAILFAST").collect()


def test_a_rejected_table_is_not_listed(spark, tmp_path):
    from stayframe.operators.features import FeatureStore, KeyViolation

    store = FeatureStore(spark, str(tmp_path / "store"))
    with pytest.raises(KeyViolation):
        store.create_table("t", ["id"], spark.createDataFrame([(1,), (1,)], "id int"))
    assert store.list_tables() == [] and not store.has_table("t")


def test_partitioned_versions_have_few_files(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.write(spark.range(0, 4000, 1, 16).selectExpr("id", "id % 5 AS p"), partition_by=["p"])
    files = list((tmp_path / "t" / "version=0").rglob("*.parquet"))
    assert len(files) <= 10 and table.read().count() == 4000


def test_queries_leave_no_database_and_workspaces_can_be_cleaned(spark, sf_dir, tmp_path, monkeypatch):
    from datetime import timedelta

    from stayframe import session
    from stayframe.queries import QUERIES

    before = {database.name for database in spark.catalog.listDatabases()}
    monkeypatch.setattr(session, "shared_root", lambda spark: str(tmp_path))
    for name in ("a4_database", "a5_overwrite_table", "a6_drop_table"):
        assert QUERIES[name](spark, sf_dir).count() > 0
    assert {database.name for database in spark.catalog.listDatabases()} == before
    assert session.clean_workspaces(spark, timedelta(days=1)) == 0 and list((tmp_path / "stayframe").iterdir())
    assert session.clean_workspaces(spark, timedelta(seconds=-60)) > 0 and not list((tmp_path / "stayframe").iterdir())


def test_entry_without_the_corpus_operators(tmp_path):
    """The operators for corpora and their pipeline can be deleted; an error inside them would show."""
    home = Path(__file__).resolve().parent.parent
    shutil.copytree(home / "stayframe", tmp_path / "stayframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(QUERIES))] * 2
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    (tmp_path / "stayframe" / "llm").mkdir()
    (tmp_path / "stayframe" / "llm" / "queries.py").write_text("")
    broken = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "no_such_module" in broken.stderr


def test_recorded_workspaces_go_when_told(spark):
    with recorded_workspaces() as outer:
        first = written(spark.range(3), "one")
        with recorded_workspaces() as inner:
            second = written(first, "two")
    assert len(outer) == 2 and inner == outer[1:]
    drop_workspaces(spark, outer[:1])
    assert not storage.exists(spark, outer[0]) and storage.exists(spark, outer[1]) and second.count() == 3
