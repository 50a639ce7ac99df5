"""From cleaned rows to model input: mean fill, split, categorical encoding, feature vector."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import FeatureHasher, Imputer, ImputerModel, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.functions.rows import POSITIONS, key_hash, key_position
from stayframe.operators.compiled import ExpressionColumns, bucket_sql, number, quoted
from stayframe.operators.joins import lookup
from stayframe.operators.numbering import number_within

# Fixed value: the test share of a split when none is given.
DEFAULT_TEST_SHARE = 0.25

# Width of hashed categories.
HASHED_FEATURES = 1024


def mean_fill(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, ImputerModel]:
    """Fill nulls (and NaN) with the column mean, in place; also returns the fitted imputer for other frames."""
    imputer = Imputer(strategy="mean", inputCols=list(columns), outputCols=list(columns)).fit(df)
    return imputer.transform(df), imputer


def fill_of(fill: ImputerModel, column: str) -> ExpressionColumns:
    """What a fitted fill does to one column alone."""
    mean = fill.surrogateDF.first()[column]
    return ExpressionColumns([column], {column: f"coalesce(nanvl(CAST({quoted(column)} AS DOUBLE), NULL), {number(mean)})"})


def key_split(
    df: DataFrame, key: str, test_share: float = DEFAULT_TEST_SHARE, seed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key, in millionths: the same rows on every run and partitioning.

    All rows of a key fall on the same side. Without a seed the key is an integer, and a null key is in training.
    To split one side again, give a seed: the unseeded hash is the one that chose the side.
    """
    held_out = round(test_share * POSITIONS)
    if not 0 < held_out < POSITIONS:
        raise ValueError(f"test_share {test_share} leaves one side empty")
    position = key_position(key) if seed is None else F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(POSITIONS))
    in_test = F.coalesce(position >= POSITIONS - held_out, F.lit(False))
    return df.where(~in_test), df.where(in_test)


def _narrowest(hashed: DataFrame, wanted: int, fetched: int = 10_000) -> tuple[int, list]:
    """The hash and keys of the ``wanted``-th smallest row: ranges are counted and narrowed until one holds few rows."""
    low, high = -(2**63), 2**63 - 1
    while True:
        inside = hashed.where(F.col("_h").between(low, high))
        width = (high - low) // 4096 + 1
        # Differences of longs may pass a long's range, so places are found in decimals.
        place = F.floor((F.col("_h").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
        counts = sorted((int(row["place"]), row["n"]) for row in inside.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect())
        for at, n in counts:
            if wanted <= n:
                break
            wanted -= n
        low, high = low + at * width, min(low + (at + 1) * width - 1, high)
        if n <= fetched or low == high:
            rows = hashed.where(F.col("_h").between(low, high)).orderBy(*hashed.columns).limit(wanted).collect()
            return rows[-1]["_h"], [value for name, value in rows[-1].asDict().items() if name != "_h"]


def exact_split(df: DataFrame, key: str, test_share: float, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``ceil(test_share * rows)`` test rows: those with the smallest hashes of a unique key.

    Independent of the partitioning, like :func:`key_split`; that one needs no pass over the rows, but its share is met
    about. Keys of equal hash go in their order, null first. Rows of a repeated key stay together, so with those the
    count may differ. Without a seed the hash is that of :func:`key_split`, for integer keys.
    """
    if not 0 < test_share < 1:
        raise ValueError(f"test_share {test_share} leaves one side empty")
    hashed = F.xxhash64(F.col(key), F.lit(seed)) if seed is not None else F.coalesce(key_hash(key), F.lit(0))
    rows = df.select(hashed.alias("_h"), F.col(key).alias("_key"))
    n = rows.count()
    wanted = math.ceil(round(test_share * n, 9))
    if not wanted:
        return df, df.limit(0)
    last, (last_key,) = _narrowest(rows, wanted)
    before = F.col(key).isNull() if last_key is None else F.coalesce(F.col(key) <= F.lit(last_key), F.lit(True))
    in_test = (hashed < last) | ((hashed == last) & before)
    return df.where(~in_test), df.where(in_test)


def random_split(df: DataFrame, test_share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) drawn at random. The draw follows the partitioning; :func:`key_split` does not."""
    train, test = df.randomSplit([1 - test_share, test_share], seed)
    return train, test


def feature_columns(df: DataFrame, label: str, without: Sequence[str] = ()) -> list[str]:
    return [name for name in df.columns if name != label and name not in without]


def assembler(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    """Columns to one vector column. Nulls fail at run time: fill or drop them first."""
    return VectorAssembler(inputCols=list(columns), outputCol=output)


def category_stages(columns: Sequence[str]) -> tuple[list, list[str]]:
    """Stages that one-hot encode string columns, null and unseen values as a category of their own; and the outputs.

    The categories of a column go to the driver: use it for columns whose values are known to be few, else
    :func:`hashed_categories` or :func:`category_codes`.
    """
    indexed = [f"{name}_index" for name in columns]
    encoded = [f"{name}_vector" for name in columns]
    return [
        StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded),
    ], encoded


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """``column``, ``code`` and ``n_rows`` of every value of a column: codes from 0 by falling frequency, then by value.

    For columns with any number of values: they are counted, ranked by ranges and kept as a table, none on the driver.
    Null has no code.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
    ranked = number_within(counted.withColumn("_order", -F.col("n_rows")), [], ["_order", column], "code")
    return ranked.select(column, (F.col("code") - 1).alias("code"), "n_rows")


def with_codes(df: DataFrame, codes: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with the code of ``column`` as ``into``; null for null and for values that have no code."""
    return lookup(df, codes.select(column, F.col("code").alias(into)), [column])


def hashed_categories(columns: Sequence[str], output: str, width: int = HASHED_FEATURES) -> list:
    """Stages that spread string columns with any number of values over a vector of fixed width. A null is nothing.

    Each value becomes one of ``width`` buckets first, so that what the vector holds for it can be listed.
    """
    buckets = {f"{name}_bucket": f"CAST({bucket_sql(quoted(name), width)} AS STRING)" for name in columns}
    return [ExpressionColumns(columns, buckets), FeatureHasher(inputCols=list(buckets), outputCol=output, numFeatures=width)]


def first_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first ``n`` rows in an order; end it with a key, so that ties do not make the result vary."""
    return df.orderBy(*order).limit(n)
