"""Every query with a DuckDB text against that text; every other one for rows and a stable schema."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry
from stayframe.queries import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _rows(frame, columns):
    cleaned = [tuple(None if pd.isna(v) else v for v in row) for row in frame[columns].itertuples(index=False)]
    return sorted(cleaned, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    assert {n: TYPES[t] for n, t in result.dtypes} == dict(zip(expected.columns, map(str, expected.types), strict=True))
    columns = sorted(result.columns)
    assert _rows(result.toPandas(), columns) == _rows(expected.df(), columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_sorted_query_keeps_its_order(spark, sf_dir):
    rows = QUERIES["l1_sort"](spark, sf_dir).collect()
    assert rows == sorted(rows, key=lambda row: (-row.price, row.id))


def test_entry(spark):
    row = entry(spark).first()
    assert set(row.asDict()) == {"avg_price_bedrooms_2", "avg_price_bedrooms_3"}


def test_every_query_name_is_an_inventory_row():
    rows = {name.split("_")[0] for name in QUERIES}
    wanted = {
        "a": 9, "b": 14, "c": 5, "d": 1, "e": 6, "f": 15, "g": 6, "h": 12, "i": 6, "j": 5, "k": 7, "l": 3,
    }
    assert {f"{letter}{i}" for letter, count in wanted.items() for i in range(1, count + 1)} <= rows
