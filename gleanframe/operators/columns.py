"""Column classes, long form and chunked one-row aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import (
    DataType, DecimalType, DoubleType, FloatType, NumericType, StringType,
)

# keeps one generated aggregate class well below the JVM method limits
CHUNK = 120


def ident(name: str) -> Column:
    """Column by its exact name, also with dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def _named(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _named(df, lambda t: isinstance(t, NumericType))


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is not numeric; booleans belong here."""
    return _named(df, lambda t: not isinstance(t, NumericType))


def text_columns(df: DataFrame) -> list[str]:
    return _named(df, lambda t: isinstance(t, StringType))


def fractional_columns(df: DataFrame) -> list[str]:
    return _named(df, lambda t: isinstance(t, (FloatType, DoubleType)))


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric column as double with NaN taken for missing."""
    c = ident(name)
    t = df.schema[name].dataType
    if isinstance(t, (FloatType, DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN taken for missing, in its own type."""
    c = ident(name)
    if isinstance(df.schema[name].dataType, (FloatType, DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def as_text(df: DataFrame, name: str) -> Column:
    """Any column as text; nested ones as JSON."""
    t: DataType = df.schema[name].dataType
    c = present(df, name)
    if t.simpleString().startswith(("array", "map", "struct")):
        return F.to_json(c)
    if isinstance(t, DecimalType):
        return c.cast("string")
    return c.cast("string")


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles named x0, x1, …, short names for expressions in SQL text.

    Where an aggregate has hundreds of expressions, text builds them several times faster.
    """
    return df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])


def aggregate_row(df: DataFrame, exprs: Sequence[Column | str]) -> Row:
    """One-row aggregate; many expressions run in a few passes of bounded width."""
    values: dict[str, object] = {}
    for start in range(0, len(exprs), CHUNK):
        part = [F.expr(e) if isinstance(e, str) else e for e in exprs[start:start + CHUNK]]
        values.update(df.agg(*part).first().asDict())
    return Row(**values)


def long_aggregates(
    df: DataFrame, columns: Sequence[str], metrics: dict[str, tuple[str, object]],
) -> DataFrame:
    """One row per column, computed in one scan.

    ``metrics`` maps an output name to (type, function of the column name); each
    function gives an aggregate expression.
    """
    per_chunk = max(1, CHUNK // max(1, len(metrics)))
    frames = []
    for start in range(0, len(columns), per_chunk):
        part = list(columns[start:start + per_chunk])
        wide = df.agg(*[
            fn(name).cast(kind).alias(f"{metric}_{i}")
            for i, name in enumerate(part) for metric, (kind, fn) in metrics.items()
        ])
        rows = [
            F.struct(F.lit(name).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in metrics])
            for i, name in enumerate(part)
        ]
        frames.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, frames)


def unpivot_text(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """(keep…, column, value) with one row per cell that is not null."""
    cells = [F.struct(F.lit(c).alias("column"), as_text(df, c).alias("value")) for c in columns]
    return (
        df.select(*keep, F.explode(F.array(*cells)).alias("cell"))
        .select(*keep, "cell.column", "cell.value")
        .where(F.col("value").isNotNull())
    )


def unpivot_numbers(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """(keep…, column, value) as double, nulls and NaN left out."""
    cells = [F.struct(F.lit(c).alias("column"), as_double(df, c).alias("value")) for c in columns]
    return (
        df.select(*keep, F.explode(F.array(*cells)).alias("cell"))
        .select(*keep, "cell.column", "cell.value")
        .where(F.col("value").isNotNull())
    )
