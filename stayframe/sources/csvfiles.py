"""CSV in and out: gzip, header, quoted fields with line breaks, a doubled quote as escape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    *,
    sep: str = ",",
    null_value: str = "",
    repartition: int | None = None,
    multi_line: bool = True,
    mode: str = "PERMISSIVE",
    corrupt_column: str | None = None,
) -> DataFrame:
    """Scan CSV files on a path shared by all executors; without a schema the types are inferred (one more pass).

    With ``multi_line`` a field may span lines, so a file cannot be split: one file is one task, and ``repartition``
    spreads its rows only afterwards. Without it an uncompressed file is read by as many tasks as its size asks for; a
    line break then always ends a row. Land the result as Parquet when it is read more than once.

    A field that equals ``null_value`` is null, quoted or not. ``mode`` says what becomes of malformed rows: PERMISSIVE
    keeps them with nulls, FAILFAST raises, DROPMALFORMED leaves them out. With ``corrupt_column`` (PERMISSIVE, and a
    schema) such a row's text is in a string column of that name, and null in all others.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("sep", sep)
        .option("nullValue", null_value)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("mode", mode)
    )
    if schema is None:
        if corrupt_column is not None:
            raise ValueError("a column for malformed rows needs a schema")
        frame = reader.option("inferSchema", True).csv(path)
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if corrupt_column is not None:
            wanted = T.StructType([*wanted.fields, T.StructField(corrupt_column, T.StringType())])
            # The header is checked against the data's columns only when there is no such column.
            reader = reader.option("columnNameOfCorruptRecord", corrupt_column).option("enforceSchema", True)
        else:
            reader = reader.option("enforceSchema", False)
        frame = reader.schema(wanted).csv(path)
    return frame.repartition(repartition) if repartition else frame


def write_csv(df: DataFrame, path: str, *, sep: str = ",", compression: str | None = None, null_value: str = "") -> None:
    """Write CSV with a header. An empty string reads back as null, unless ``null_value`` is some other text."""
    writer = (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("sep", sep)
        .option("nullValue", null_value)
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
