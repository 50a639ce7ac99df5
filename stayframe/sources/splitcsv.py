"""CSV files whose fields hold line breaks, read by as many tasks as their size asks for.

A line break ends a row only outside quotes, which a task that starts inside a file cannot see. So the files are read as
plain lines first, and the quotes of every byte range are counted: whether a range starts inside a quoted field is the
parity of the quotes before it. With that known every range is cut into rows on its own. What a row has in later ranges,
at most a piece of each, is joined on afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayframe.session import written

_RANGE = ["file", "block"]


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Physical lines in file order, with the file and the byte range they lie in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def quote_parities(lines: DataFrame) -> DataFrame:
    """``file``, ``block`` and ``quoted``: whether the range starts inside quotes. One row per range."""
    quotes = F.sum(F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit(""))))
    counted = lines.groupBy(*_RANGE).agg(quotes.alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("quotes").over(earlier), F.lit(0))
    first = Window.partitionBy("file").orderBy("block")
    return counted.select(*_RANGE, (before % 2 == 1).alias("quoted"), F.row_number().over(first).alias("number"))


def _cut(batches: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], tuple[bool, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (``part`` 0), and per range the piece before its first row (1: goes to an earlier one) and its open last row (2)."""
    schema = pa.schema([("file", pa.string()), ("number", pa.int32()), ("part", pa.int8()), ("text", pa.string())])
    current, number, quoted, head, pieces = None, 0, False, False, []

    def ended(last: bool) -> Iterator[tuple]:
        if pieces:
            yield (current[0], number, 1 if head else 2 if last and quoted else 0, "\n".join(pieces))

    for batch in batches:
        out = []
        for file, block, value in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (file, block) != current:
                if current is not None:
                    out += ended(True)
                current, pieces = (file, block), []
                quoted, number = starts[current]
                head = quoted
            pieces.append(value)
            if value.count('"') % 2:
                quoted = not quoted
            if not quoted:
                out += ended(False)
                pieces, head = [], False
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema=schema)
    if current is not None:
        rest = [dict(zip(schema.names, row, strict=True)) for row in ended(True)]
        yield pa.RecordBatch.from_pylist(rest, schema=schema)


def rows_of_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file``, ``number`` (of the range), and ``text`` of every row of CSV files; line breaks in quotes are part of it.

    Per byte range one row reaches the tasks of the second reading: its place and whether it starts inside quotes.
    """
    lines = _lines(spark, path)
    ranges = quote_parities(lines).collect()
    starts = {(row["file"], row["block"]): (row["quoted"], row["number"]) for row in ranges}
    shared = spark.sparkContext.broadcast(starts)
    cut = lines.mapInArrow(lambda batches: _cut(batches, shared.value), "file string, number int, part tinyint, text string")
    cut = written(cut, "csv-rows")
    # An open row takes the pieces that start the following ranges, up to the first range that holds a row's start.
    pieces = cut.where("part > 0")
    opened = Window.partitionBy("file").orderBy("number", F.col("part")).rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        pieces.withColumn("start", F.max(F.when(F.col("part") == 2, F.col("number"))).over(opened))
        .groupBy("file", "start")
        .agg(F.array_sort(F.collect_list(F.struct("number", "part", "text"))).alias("pieces"))
    )
    texts = F.array_join(F.transform("pieces", lambda piece: piece["text"]), "\n")
    whole = cut.where("part = 0").select("file", "number", "text")
    return whole.unionByName(joined.select("file", F.col("start").cast("int").alias("number"), texts.alias("text")))


def read_split_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    *,
    sep: str = ",",
    null_value: str = "",
    mode: str = "PERMISSIVE",
    corrupt_column: str | None = None,
) -> DataFrame:
    """Rows of CSV files with a header, as :func:`~stayframe.sources.csvfiles.read_csv` reads them, a file by many tasks.

    Quotes stand around fields, and doubled in them, as RFC 4180 wants; a lone quote inside a plain field would be taken for
    the start of a quoted one. Compressed files are not split. ``mode`` is PERMISSIVE or FAILFAST. A row that is the same
    text as its file's first row is taken for its header.
    """
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"no mode {mode!r} here")
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    read = wanted
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": null_value, "emptyValue": "", "mode": mode}
    if corrupt_column is not None:
        read = T.StructType([*wanted.fields, T.StructField(corrupt_column, T.StringType())])
        options["columnNameOfCorruptRecord"] = corrupt_column
    header = sep.join(field.name for field in wanted)
    plain = F.regexp_replace(F.regexp_replace("text", "\r$", ""), '"', "")
    # A blank line is no row.
    rows = rows_of_text(spark, path).where(~(F.col("number") == 1) | (plain != F.lit(header))).where(F.trim("text") != "")
    fields = ", ".join(f"`{field.name.replace('`', '``')}` {field.dataType.simpleString()}" for field in read)
    parsed = rows.select(F.from_csv(F.regexp_replace("text", "\r$", ""), fields, options).alias("row"))
    return parsed.select("row.*")
