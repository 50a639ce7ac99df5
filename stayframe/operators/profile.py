"""Counts, means, summary statistics and data profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayframe.session import written

# Measures that are whole numbers.
COUNTS = ("count", "n_rows", "n_null", "distinct_estimate")
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
# Estimated quantiles miss a rank by one part in this many at most.
ACCURACY = 10_000
# Values between two bounds are counted in this many equal ranges per round.
RANGES = 4_096


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if isinstance(field.dataType, T.NumericType)]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _per_column(df: DataFrame, statistics: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One aggregate for all columns, then one row per column: ``{column: {statistic: SQL expression}}``.

    SQL text, because a wide table has hundreds of these expressions, and each would be several calls to the JVM.
    """
    aggregates, rows = [], []
    for i, (name, measures) in enumerate(statistics.items()):
        aggregates += [f"{expression} AS `{i}_{measure}`" for measure, expression in measures.items()]
        fields = ", ".join(f"'{measure}', `{i}_{measure}`" for measure in measures)
        rows.append(f"named_struct('column_name', {_text(name)}, {fields})")
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


def column_info(df: DataFrame) -> DataFrame:
    """Position, type and non-null count of every column, and the number of rows."""
    return _per_column(
        df,
        {
            name: {"position": str(i), "type": _text(kind), "non_null": f"count({_quoted(name)})", "n_rows": "count(*)"}
            for i, (name, kind) in enumerate(df.dtypes)
        },
    )


def mean_by_value(df: DataFrame, column: str, value: str, wanted: Sequence) -> DataFrame:
    """Mean of ``value`` where ``column`` has each wanted value: one row, one pass, no shuffle of rows."""
    return df.where(F.col(column).isin(*wanted)).agg(
        *[F.avg(F.when(F.col(column) == item, F.col(value))).alias(f"avg_{value}_{column}_{item}") for item in wanted]
    )


def mean_by_group(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows"), F.avg(value).alias(f"avg_{value}"))


def _finite(field: T.StructField) -> str:
    name = _quoted(field.name)
    if not isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return name
    return f"if(isnan({name}) OR abs({name}) = double('Infinity'), NULL, {name})"


def _kept_type(field: T.StructField) -> str:
    """The type that holds a column's values exactly: whole numbers share one, floating ones another."""
    if isinstance(field.dataType, T.IntegralType):
        return "bigint"
    return field.dataType.simpleString() if isinstance(field.dataType, T.DecimalType) else "double"


def _literal(value, kind: str) -> str:
    return f"CAST('{value!r}' AS DOUBLE)" if kind == "double" else f"CAST('{value}' AS {kind})"


def _limits(i: int, field: T.StructField, probabilities: Mapping[str, float]) -> dict[str, str]:
    """What one pass tells about the wanted ranks of a column: how many values there are, and bounds around each rank.

    ``percentile_approx`` misses a rank by one part in :data:`ACCURACY` at most; the bounds are two parts away.
    """
    finite = _finite(field)
    around = ", ".join(f"{min(1.0, max(0.0, p + step / ACCURACY))!r}D" for p in probabilities.values() for step in (-2, 2))
    infinite = {"below": "-Infinity", "above": "Infinity"} if _kept_type(field) == "double" else {}
    return {
        f"{i}_n": f"count({finite})",
        f"{i}_min": f"min({finite})",
        f"{i}_max": f"max({finite})",
        f"{i}_around": f"percentile_approx({finite}, array({around}), {ACCURACY})",
        **{f"{i}_{side}": f"count_if({_quoted(field.name)} = double('{value}'))" for side, value in infinite.items()},
    }


@dataclass(frozen=True)
class _Target:
    """A wanted rank among the values of a column from ``low`` to ``high``, counted in the span with that number."""

    column: int
    label: str
    rank: int
    low: object
    high: object
    span: int = -1


def _wanted(found: Row, i: int, kind: str, probabilities: Mapping[str, float]) -> tuple[dict[str, object], list[_Target]]:
    """Quantiles that are known after the first pass (none or infinite), and targets for the others."""
    known: dict[str, object] = {}
    targets = []
    n = found[f"{i}_n"]
    below, above = (found[f"{i}_below"], found[f"{i}_above"]) if kind == "double" else (0, 0)
    for k, (label, p) in enumerate(probabilities.items()):
        rank = max(1, math.ceil(p * (n + below + above)))
        if not n + below + above:
            known[label] = None
        elif rank <= below:
            known[label] = -math.inf
        elif rank > below + n:
            known[label] = math.inf
        else:
            low, high = found[f"{i}_around"][2 * k : 2 * k + 2]
            targets.append(_Target(i, label, rank - below, low, high))
    return known, targets


def _counted(df: DataFrame, fields: Sequence[T.StructField], spans: Sequence[tuple]) -> DataFrame:
    """(span, value columns, n): how often each value between a span's bounds occurs, and once, with null values, how many
    values lie below it. One pass; equal values are combined map-side. Values keep their types, one column per type."""
    kinds = sorted({_kept_type(field) for field in fields})
    cells = []
    for number, (column, low, high) in enumerate(spans):
        field = fields[column]
        kind = _kept_type(field)
        value = f"CAST({_finite(field)} AS {kind})"

        def cell(inside: str, number: int = number, kind: str = kind) -> str:
            values = ", ".join(f"'{k}', {inside if k == kind else f'CAST(NULL AS {k})'}" for k in kinds)
            return f"named_struct('span', {number}, {values})"

        cells.append(
            f"CASE WHEN {value} < {_literal(low, kind)} THEN {cell(f'CAST(NULL AS {kind})')} "
            f"WHEN {value} <= {_literal(high, kind)} THEN {cell(value)} END"
        )
    rows = df.selectExpr(f"inline(array_compact(array({', '.join(cells)})))")
    return rows.groupBy(*[f"`{name}`" for name in ("span", *kinds)]).agg(F.count("*").alias("n"))


def _narrowed(counted: DataFrame, kind: str, wanted: Mapping[int, _Target]) -> dict[int, _Target]:
    """The same targets, each with the bounds of the range that holds it and its rank in there."""
    cells = []
    for number, target in wanted.items():
        value, low, high = f"`{kind}`", _literal(target.low, kind), _literal(target.high, kind)
        if kind == "double":
            # Halves, so that the width of a span cannot overflow.
            share = f"(({value} / 2 - {low} / 2) / ({high} / 2 - {low} / 2))"
        else:
            wide = "DECIMAL(38, 0)" if kind == "bigint" else kind
            share = f"(double(CAST({value} AS {wide}) - {low}) / double(CAST({high} AS {wide}) - {low}))"
        # The lowest value is in the first range and the highest in the last, so every round tells values apart.
        place = f"if({value} = {high}, {RANGES - 1}, least(floor({share} * {RANGES}), {RANGES - 2}))"
        inside = f"span = {target.span} AND {value} BETWEEN {low} AND {high}"
        cells.append(f"if({inside}, named_struct('target', {number}, 'place', {place}, 'value', {value}, 'n', n), NULL)")
    rank = F.create_map(*[F.lit(x) for number, target in wanted.items() for x in (number, target.rank)])[F.col("target")]
    hits = (
        counted.selectExpr(f"inline(array_compact(array({', '.join(cells)})))")
        .groupBy("target", "place")
        .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        # At most RANGES rows per target.
        .withColumn("up_to", F.sum("n").over(Window.partitionBy("target").orderBy("place")))
        .where((rank <= F.col("up_to")) & (rank > F.col("up_to") - F.col("n")))
        .collect()
    )
    found = {}
    for hit in hits:
        target = wanted[hit["target"]]
        found[hit["target"]] = replace(target, rank=target.rank - (hit["up_to"] - hit["n"]), low=hit["low"], high=hit["high"])
    return found


def _exact(df: DataFrame, fields: Sequence[T.StructField], found: Row, probabilities: Mapping[str, float]) -> list[dict]:
    """Per field, the value of each quantile in the column's type, from what :func:`_limits` found."""
    values: list[dict] = []
    targets: list[_Target] = []
    for i, field in enumerate(fields):
        known, own = _wanted(found, i, _kept_type(field), probabilities)
        values.append(known)
        targets += own
    while targets:
        spans = list(dict.fromkeys((target.column, target.low, target.high) for target in targets))
        targets = [replace(target, span=spans.index((target.column, target.low, target.high))) for target in targets]
        counted = written(_counted(df, fields, spans), "quantile-counts")
        kinds = [name for name in counted.columns if name not in ("span", "n")]
        none = " AND ".join(f"`{kind}` IS NULL" for kind in kinds)
        sizes = counted.groupBy("span").agg(F.sum(F.expr(f"if({none}, n, 0)")).alias("below"), F.sum("n").alias("up_to"))
        size_of = {row["span"]: (row["below"], row["up_to"]) for row in sizes.collect()}
        missed = []
        for kind in kinds:
            waiting: dict[int, _Target] = {}
            for number, target in enumerate(targets):
                if _kept_type(fields[target.column]) != kind:
                    continue
                below, up_to = size_of.get(target.span, (0, 0))
                if below < target.rank <= up_to:
                    waiting[number] = replace(target, rank=target.rank - below)
                else:
                    missed.append(target)
            while waiting:
                for number, target in list(waiting.items()):
                    if target.low == target.high:
                        values[target.column][target.label] = target.low
                        del waiting[number]
                if waiting:
                    waiting = _narrowed(counted, kind, waiting)
        # Where the estimate's bounds did not hold the rank, the column's own bounds do.
        targets = [replace(t, low=found[f"{t.column}_min"], high=found[f"{t.column}_max"]) for t in missed]
    return values


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float] = QUARTILES) -> DataFrame:
    """Exact quantiles of number columns, one row per quantile and a column per input, in the input's type (whole numbers as
    bigint, floating ones as double): the smallest value that at least a share ``p`` of the values do not exceed. Nulls and
    NaN do not count; infinities are values.

    The rows are read twice: once for estimates, which bound each wanted rank, and once to count the few values between
    those bounds. The rest works on those counts. Only ranks and bounds reach the driver.
    """
    fields = [df.schema[name] for name in columns]
    expressions = {name: e for i, field in enumerate(fields) for name, e in _limits(i, field, probabilities).items()}
    values = _exact(df, fields, _first(df, expressions), probabilities)
    rows = [(label, *[own[label] for own in values]) for label in probabilities]
    kinds = ", ".join(f"{_quoted(field.name)} {_kept_type(field)}" for field in fields)
    return df.sparkSession.createDataFrame(rows, f"label string, {kinds}")


def _first(df: DataFrame, expressions: Mapping[str, str]) -> Row:
    return df.selectExpr(*[f"{expression} AS {_quoted(name)}" for name, expression in expressions.items()]).first()


def _described(df: DataFrame, measures: Mapping[str, Mapping[str, str]], quantiled: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """One row per column with its measures and, for ``quantiled`` ones, quantiles as doubles; two passes."""
    fields = [df.schema[name] for name in quantiled]
    expressions = {f"{name}.{measure}": e for name, own in measures.items() for measure, e in own.items()}
    limits = {name: e for i, field in enumerate(fields) for name, e in _limits(i, field, probabilities).items()}
    found = _first(df, {**expressions, **limits})
    exact = dict(zip(quantiled, _exact(df, fields, found, probabilities), strict=True))
    rows = [
        (name, *[found[f"{name}.{measure}"] for measure in own], *[_double(exact.get(name, {}).get(label)) for label in probabilities])
        for name, own in measures.items()
    ]
    kinds = [f"{measure} {'bigint' if measure in COUNTS else 'double'}" for measure in next(iter(measures.values()))]
    schema = ", ".join(["column_name string", *kinds, *[f"{label} double" for label in probabilities]])
    return df.sparkSession.createDataFrame(rows, schema)


def _double(value) -> float | None:
    return None if value is None else float(value)


def summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation, minimum, maximum and quartiles of number columns, one row per column.

    All but the count are doubles; :func:`quantiles` keeps the types. NaN counts as missing. Runs two passes.
    """
    columns = columns or numeric_columns(df)
    measures = {name: {"count": f"count({_present(df.schema[name])})", **_measures(df.schema[name])} for name in columns}
    return _described(df, measures, columns, QUARTILES)


def _present(field: T.StructField) -> str:
    """A column with NaN, like null, as missing."""
    name = _quoted(field.name)
    return f"nanvl({name}, NULL)" if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else name


def _measures(field: T.StructField) -> dict[str, str]:
    column = _present(field)
    return {
        "mean": f"double(avg({column}))",
        "stddev": f"double(stddev_samp({column}))",
        "min": f"double(min({column}))",
        "max": f"double(max({column}))",
    }


def text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, minimum and maximum in string order, which for money strings is not the order of the amounts."""
    return _per_column(
        df,
        {
            name: {of: f"{of}({_quoted(name)})" for of in ("count", "min", "max")}
            for name in columns
        },
    )


def profile(df: DataFrame, medians: bool = True) -> DataFrame:
    """One row per column: rows, missing values, estimated distinct values; for numbers also mean, stddev, min, max, median.

    NaN counts as missing. The medians are exact and take a second pass; all else is one. A table without columns has no
    rows here.
    """
    numbers = numeric_columns(df)
    missing = {measure: "double(NULL)" for measure in ("mean", "stddev", "min", "max")}
    measures = {
        field.name: {
            "n_rows": "count(*)",
            "n_null": f"count(*) - count({_present(field)})",
            "distinct_estimate": f"approx_count_distinct({_quoted(field.name)})",
            **(_measures(field) if field.name in numbers else missing),
        }
        for field in df.schema
    }
    return _described(df, measures, numbers if medians else [], {"median": 0.5} if medians else {})


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many distinct values each column has, nulls aside. Distinct values are combined map-side and spread by value."""
    cells = F.array(
        *[F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value")) for name in columns]
    )
    values = df.select(F.inline(cells)).distinct()
    return values.groupBy("column_name").agg(F.count("value").alias("n_distinct"))


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent values of each column, as strings; ties go to the smaller value.

    Counts are combined map-side, and Spark keeps ``k`` rows per column and task before the final ranking, so a column
    with many values does not meet in one task.
    """
    cells = F.array(
        *[F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value")) for name in columns]
    )
    counts = df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: A pair's variance below this share of its mean square is rounding: the column does not vary there.
LEAST_SPREAD = 1e-13


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``left_column``, ``right_column``, ``n_rows`` and ``correlation`` of every two number columns, in the frame's order.

    A pair counts the rows where both are there; NaN counts as missing, and so does an infinity. A first pass finds the
    means, which the values are taken from; a second adds up products of all pairs, as matrices per batch. Null for fewer
    than two rows, or where one column does not vary.
    """
    columns = list(columns or numeric_columns(df))
    schema = "left_column string, right_column string, n_rows long, correlation double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    present = [f"CAST({_present(df.schema[name])} AS DOUBLE)" for name in columns]
    finite = df.selectExpr(*[f"CASE WHEN abs({value}) < double('Infinity') THEN {value} END AS `{i}`" for i, value in enumerate(present)])
    means = finite.agg(*[F.avg(str(i)) for i in range(len(columns))]).first()
    shift = np.array([0.0 if mean is None else mean for mean in means])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, len(shift), len(shift)))
        for batch in batches:
            x = np.stack([column.to_numpy(zero_copy_only=False).astype(np.float64) for column in batch.columns], axis=1) - shift
            there = ~np.isnan(x)
            x, known = np.where(there, x, 0.0), there.astype(np.float64)
            # Of rows where both are there: how many, and sums of the left one, of its square, and of the product.
            sums += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        i, j = np.triu_indices(len(shift), 1)
        values = [sums[0][i, j], sums[1][i, j], sums[1][j, i], sums[2][i, j], sums[2][j, i], sums[3][i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *map(pa.array, values)], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    found = finite.mapInArrow(products, "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    total = found.groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")

    def spread(sum: str, squares: str) -> Column:
        variance = F.try_divide(squares, n) - F.try_divide(sum, n) * F.try_divide(sum, n)
        return F.when(variance > F.lit(LEAST_SPREAD) * F.try_divide(squares, n), variance)

    covariance = F.try_divide("xy", n) - F.try_divide("x", n) * F.try_divide("y", n)
    names = F.array(*map(F.lit, columns))
    return total.select(
        F.get(names, F.col("i").cast("int")).alias("left_column"),
        F.get(names, F.col("j").cast("int")).alias("right_column"),
        n.cast("long").alias("n_rows"),
        (covariance / F.sqrt(spread("x", "xx") * spread("y", "yy"))).alias("correlation"),
    )


def distributions(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-depth histograms: ``column_name``, ``bin`` (from 1), its largest value ``upper`` (double) and ``n_rows``.

    The bounds are exact quantiles; equal ones are one bin, so that a value is in one bin. Null and NaN are in none.
    """
    columns = list(columns or numeric_columns(df))
    shares = {f"q{k}": k / bins for k in range(1, bins)}
    found = quantiles(df, columns, {**shares, "last": 1.0}).collect()
    bounds = {name: sorted({float(row[name]) for row in found if row[name] is not None}) for name in columns}
    if not any(bounds.values()):
        return df.sparkSession.createDataFrame([], "column_name string, bin int, upper double, n_rows long")
    counts = []
    for i, name in enumerate(columns):
        value = f"CAST({_present(df.schema[name])} AS DOUBLE)"
        for k, high in enumerate(bounds[name]):
            above = f"{value} > {_double_text(bounds[name][k - 1])} AND " if k else ""
            counts.append(f"count(CASE WHEN {above}{value} <= {_double_text(high)} THEN 1 END) AS `{i}_{k}`")
    counted = df.selectExpr(*counts)
    rows = ", ".join(
        f"named_struct('column_name', {_text(name)}, 'bin', {k + 1}, 'upper', {_double_text(high)}, 'n_rows', `{i}_{k}`)"
        for i, name in enumerate(columns)
        for k, high in enumerate(bounds[name])
    )
    return counted.selectExpr(f"inline(array({rows}))")


def _double_text(value: float) -> str:
    return f"CAST('{value}' AS DOUBLE)" if math.isinf(value) else f"({value!r}D)"
