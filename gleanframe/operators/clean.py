"""Cleaning rules, each a function from a DataFrame to a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, FloatType, IntegralType, MapType, NumericType, StringType, StructType,
)

from gleanframe.functions.constants import (
    AGE_LIMIT, IMPUTED_TEXT, NON_NEGATIVE_KEYWORDS,
)
from gleanframe.functions.dates import parse_timestamp
from gleanframe.functions.text import (
    finite, null_tokens, parse_amount, parse_integer, parse_number, redact, strip, trim_and_null,
)
from gleanframe.operators.columns import (
    aggregate_row, as_double, fractional_columns, ident, nan_to_null, numeric_columns,
    text_columns,
)
from gleanframe.operators.quantiles import exact_quantiles, medians
from gleanframe.operators.ranks import first_per_key


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else ident(c) for c in df.columns])


def comparable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be grouped; maps become sorted entries."""
    c = ident(name)
    if isinstance(df.schema[name].dataType, MapType):
        return F.array_sort(F.map_entries(c))
    return c


def row_digest(df: DataFrame) -> Column:
    """128 bits that tell rows apart, so that counting copies need not move whole rows.

    A null counts by its place, and both zeros are one value, as grouping sees them.
    """
    parts = []
    for f in df.schema.fields:
        cell = comparable(df, f.name)
        if isinstance(f.dataType, (FloatType, DoubleType)):
            cell = cell + F.lit(0.0)
        parts += [cell.isNull(), cell]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


# ---- text ---------------------------------------------------------------------------------------

def trim_whitespace(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _replace(df, {c: strip(ident(c)) for c in columns or text_columns(df)})


def trim_and_null_tokens(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _replace(df, {c: trim_and_null(ident(c)) for c in columns or text_columns(df)})


def read_null_tokens(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Texts a CSV reader takes for missing become null."""
    return _replace(df, {c: null_tokens(ident(c)) for c in columns or text_columns(df)})


def redact_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _replace(df, {c: redact(ident(c)) for c in columns})


def coerce_currency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns of which at least half of the filled cells are amounts become double."""
    names = list(columns or text_columns(df))
    if not names:
        return df
    row = aggregate_row(df, [
        e for i, c in enumerate(names) for e in (
            F.count(ident(c)).alias(f"n{i}"), F.count(parse_amount(ident(c))).alias(f"k{i}"),
        )
    ])
    amounts = [c for i, c in enumerate(names) if row[f"n{i}"] and row[f"k{i}"] / row[f"n{i}"] >= 0.5]
    return _replace(df, {c: parse_amount(ident(c)) for c in amounts})


# ---- rows and columns ---------------------------------------------------------------------------

def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    row = aggregate_row(df, [
        F.count(as_double(df, c) if c in fractional_columns(df) else ident(c)).alias(c)
        for c in df.columns
    ])
    return df.select(*[ident(c) for c in df.columns if row[c]])


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Keep the first column of every name."""
    names = df.columns
    numbered = df.toDF(*[f"__c{i}" for i in range(len(names))])
    first = {}
    for i, name in enumerate(names):
        first.setdefault(name, i)
    return numbered.select(*[F.col(f"__c{i}").alias(name) for name, i in first.items()])


def deduplicate(
    df: DataFrame, keep: str | bool = "first", keys: Sequence[str] = (), order_by: Sequence[str] = (),
) -> DataFrame:
    """Drop copies of whole rows, or all but one row per key.

    Nulls are equal.  Whole-row copies are equal, so first and last give the same rows;
    ``keep=False`` drops every row that has a copy.  Copies combine before the shuffle.
    """
    if keys:
        if keep is False:
            single = df.groupBy(*[ident(c) for c in keys]).agg(
                F.count(F.lit(1)).alias("__n"),
                F.min(F.struct(*[ident(c) for c in df.columns])).alias("__row"),
            )
            return single.where("__n = 1").select("__row.*")
        return first_per_key(df, keys, order_by, descending=keep == "last")
    if keep is False:
        cells = [comparable(df, c).alias(f"__k{i}") for i, c in enumerate(df.columns)]
        maps = [c for c in df.columns if isinstance(df.schema[c].dataType, MapType)]
        counted = df.groupBy(*cells).agg(
            F.count(F.lit(1)).alias("__n"), *[F.first(ident(c)).alias(c) for c in maps]
        )
        return counted.where("__n = 1").select(*[
            ident(c) if c in maps else F.col(f"__k{i}").alias(c) for i, c in enumerate(df.columns)
        ])
    if any(isinstance(f.dataType, MapType) for f in df.schema.fields):
        keyed = df.select(
            *[ident(c) for c in df.columns],
            *[comparable(df, c).alias(f"__k{i}") for i, c in enumerate(df.columns)],
        )
        return keyed.dropDuplicates([f"__k{i}" for i in range(len(df.columns))]).select(
            *[ident(c) for c in df.columns]
        )
    return df.dropDuplicates()


# ---- ranges -------------------------------------------------------------------------------------

def _numeric(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, StringType):
        return parse_number(ident(name))
    return ident(name)


def non_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    new = {}
    for c in columns:
        number = _numeric(df, c)
        new[c] = F.when(number >= 0, number)
    return _replace(df, new)


def value_range(
    df: DataFrame, column: str, low: float | None = None, high: float | None = None,
) -> DataFrame:
    """Values outside [low, high] become null."""
    number = _numeric(df, column)
    inside = number.isNotNull()
    if low is not None:
        inside = inside & (number >= low)
    if high is not None:
        inside = inside & (number <= high)
    return _replace(df, {column: F.when(inside, number)})


def amount_columns(df: DataFrame) -> list[str]:
    """Columns whose name suggests an amount and whose values are numbers.

    A text column counts when at least half of its filled cells are numbers, so a name
    such as "country" is not wiped out for containing "count".
    """
    named = [c for c in df.columns if any(k in c.lower() for k in NON_NEGATIVE_KEYWORDS)]
    numeric = set(numeric_columns(df))
    texts = [c for c in named if c in text_columns(df)]
    if texts:
        row = aggregate_row(df, [
            e for i, c in enumerate(texts) for e in (
                F.count(ident(c)).alias(f"n{i}"), F.count(parse_number(ident(c))).alias(f"k{i}"),
            )
        ])
        numeric |= {c for i, c in enumerate(texts) if row[f"n{i}"] and row[f"k{i}"] / row[f"n{i}"] >= 0.5}
    return [c for c in named if c in numeric]


def guard_amounts(df: DataFrame) -> DataFrame:
    """Negative amounts become null, and ages beyond the limit too."""
    names = amount_columns(df)
    new = {}
    for c in names:
        number = _numeric(df, c)
        fits = number >= 0
        if "age" in c.lower():
            fits = fits & (number <= AGE_LIMIT)
        new[c] = F.when(fits, number)
    return _replace(df, new)


# ---- missing values -----------------------------------------------------------------------------

def infinities_to_null(df: DataFrame) -> DataFrame:
    return _replace(df, {c: finite(ident(c)) for c in fractional_columns(df)})


def _filled(df: DataFrame, name: str, value) -> Column:
    """Null cells get ``value``; an integer column becomes double, as its mean or median may be."""
    c = ident(name)
    if isinstance(df.schema[name].dataType, IntegralType) and isinstance(value, float):
        c = c.cast("double")
    return F.coalesce(c, F.lit(value))


def impute_all(df: DataFrame) -> DataFrame:
    """Numbers get their median (0 without any value), texts a fixed token."""
    df = infinities_to_null(df)
    names = [c for c in df.columns if c in numeric_columns(df) or c in text_columns(df)]
    if not names:
        return df
    row = aggregate_row(df, [F.count_if(ident(c).isNull()).alias(c) for c in names])
    gaps = [c for c in names if row[c]]
    middle = medians(df, [c for c in gaps if c in numeric_columns(df)])
    new = {}
    for c in gaps:
        if c in middle:
            new[c] = _filled(df, c, float(middle[c]) if middle[c] is not None else 0.0)
        else:
            new[c] = F.coalesce(ident(c), F.lit(IMPUTED_TEXT))
    return _replace(df, new)


def column_mode(df: DataFrame, column: str):
    """Most frequent value, the smallest among equals; None without values."""
    row = (
        nan_to_null(df.select(ident(column))).where(ident(column).isNotNull())
        .groupBy(ident(column)).agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), ident(column)).first()
    )
    return None if row is None else row[column]


def impute_column(df: DataFrame, column: str, strategy: str = "median", value=None) -> DataFrame:
    """Fill one column by median, mean, mode or a constant; unknown strategies do nothing."""
    is_number = isinstance(df.schema[column].dataType, NumericType)
    df = _replace(df, {column: finite(ident(column))}) if column in fractional_columns(df) else df
    fill = None
    if strategy == "median" and is_number:
        fill = medians(df, [column])[column]
    elif strategy == "mean" and is_number:
        fill = df.agg(F.avg(ident(column))).first()[0]
        fill = None if fill is None else float(fill)
    elif strategy == "mode":
        fill = column_mode(df, column)
    elif strategy == "constant":
        fill = value
    return df if fill is None else _replace(df, {column: _filled(df, column, fill)})


# ---- types --------------------------------------------------------------------------------------

def coerce_type(df: DataFrame, column: str, target: str) -> DataFrame:
    """integer, float, datetime or string; what does not parse becomes null."""
    c, is_text = ident(column), isinstance(df.schema[column].dataType, StringType)
    if target == "integer":
        if is_text:
            new = parse_integer(c)
        else:
            number = c.try_cast("double")
            new = F.when(number == F.floor(number), c.try_cast("bigint"))
    elif target == "float":
        new = parse_number(c) if is_text else c.try_cast("double")
    elif target == "datetime":
        new = parse_timestamp(c) if is_text else c.try_cast("timestamp")
    elif target == "string":
        nested = isinstance(df.schema[column].dataType, (ArrayType, MapType, StructType))
        new = F.to_json(c) if nested else c.cast("string")
    else:
        return df
    return _replace(df, {column: new})


# ---- outliers -----------------------------------------------------------------------------------

def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    out = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is not None:
            out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def clip_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Numbers beyond the quartile fences move onto them."""
    new = {}
    for c, (low, high) in iqr_bounds(df, columns or numeric_columns(df), k).items():
        number = as_double(df, c)
        new[c] = F.when(number < low, F.lit(low)).when(number > high, F.lit(high)).otherwise(number)
    return _replace(df, new)


def filter_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Rows with a number beyond its fences go; a null is no outlier."""
    keep = F.lit(True)
    for c, (low, high) in iqr_bounds(df, columns or numeric_columns(df), k).items():
        keep = keep & F.coalesce(as_double(df, c).between(low, high), F.lit(True))
    return df.where(keep)


def zscore_outliers(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows further than ``threshold`` sample deviations from the mean, with their score."""
    x = as_double(df, column)
    row = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).first()
    if not row["std"]:
        return df.withColumn("zscore", F.lit(None).cast("double")).where(F.lit(False))
    score = (x - F.lit(row["mean"])) / F.lit(row["std"])
    return df.withColumn("zscore", score).where(F.abs("zscore") > threshold)
