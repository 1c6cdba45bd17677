"""Scaling and encoding as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, functions as F

from gleanframe.operators.columns import aggregate_row, as_double, ident, numeric_columns
from gleanframe.operators.lookup import attach
from gleanframe.operators.quantiles import exact_quantiles
from gleanframe.operators.ranks import positions

ONE_HOT_MOST = 200


def _scaled(df: DataFrame, shift: dict, width: dict, digits: int | None) -> DataFrame:
    cells = []
    for c in df.columns:
        if c in shift and shift[c] is not None:
            by = width[c] or 1.0
            z = (as_double(df, c) - F.lit(float(shift[c]))) / F.lit(float(by))
            cells.append((z if digits is None else F.round(z, digits)).alias(c))
        else:
            cells.append(ident(c))
    return df.select(*cells)


def scale_standard(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None,
) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    columns = list(columns or numeric_columns(df))
    row = aggregate_row(df, [
        e for i, c in enumerate(columns)
        for e in (F.avg(as_double(df, c)).alias(f"m{i}"), F.stddev_pop(as_double(df, c)).alias(f"s{i}"))
    ])
    return _scaled(
        df, {c: row[f"m{i}"] for i, c in enumerate(columns)},
        {c: row[f"s{i}"] for i, c in enumerate(columns)}, digits,
    )


def scale_minmax(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None,
) -> DataFrame:
    """Minimum to 0, maximum to 1."""
    columns = list(columns or numeric_columns(df))
    row = aggregate_row(df, [
        e for i, c in enumerate(columns)
        for e in (F.min(as_double(df, c)).alias(f"a{i}"), F.max(as_double(df, c)).alias(f"b{i}"))
    ])
    low = {c: row[f"a{i}"] for i, c in enumerate(columns)}
    width = {c: None if low[c] is None else row[f"b{i}"] - low[c] for i, c in enumerate(columns)}
    return _scaled(df, low, width, digits)


def scale_robust(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None,
) -> DataFrame:
    """(x - median) / interquartile range."""
    got = exact_quantiles(df, list(columns or numeric_columns(df)), [0.25, 0.5, 0.75])
    middle = {c: q[1] for c, q in got.items()}
    width = {c: None if q[0] is None else q[2] - q[0] for c, q in got.items()}
    return _scaled(df, middle, width, digits)


def encode_label(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add the 0-based place of each value among the sorted distinct values; null stays null.

    Works for any number of values: the places come from a distributed sort.
    """
    name = name or f"{column}_code"
    counted = (
        df.where(ident(column).isNotNull()).groupBy(ident(column)).agg(F.count(F.lit(1)).alias("n"))
    )
    return attach(df, positions(counted, [column], name=name), column)


def encode_onehot_vector(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add a sparse 0/1 vector with a place per distinct value, in sorted order; null is all zeros.

    Works for any number of values: a row holds one number and its place.
    """
    name = name or f"{column}_onehot"
    coded = encode_label(df, column, "__code")
    size = coded.agg(F.max("__code")).first()[0]
    coded = coded.withColumn("__code", F.coalesce("__code", F.lit((size or 0) + 1)).cast("double"))
    known = coded.where(ident(column).isNotNull())
    encoder = OneHotEncoder(inputCol="__code", outputCol=name, handleInvalid="keep", dropLast=True)
    if size is None:
        raise ValueError(f"{column} has no values")
    return encoder.fit(known).transform(coded).drop("__code")


def encode_onehot(df: DataFrame, column: str, most: int = ONE_HOT_MOST) -> DataFrame:
    """Replace a column by one 0/1 column per value, in sorted order.

    A table cannot get a column per value of a free text; that is refused, and
    :func:`encode_onehot_vector` covers such columns.
    """
    found = (
        df.where(ident(column).isNotNull()).select(ident(column)).distinct()
        .orderBy(ident(column)).limit(most + 1).collect()
    )
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values; use encode_onehot_vector")
    rest = [ident(c) for c in df.columns if c != column]
    flags = [
        F.coalesce((ident(column) == F.lit(r[0])).cast("int"), F.lit(0)).alias(f"{column}_{r[0]}")
        for r in found
    ]
    return df.select(*rest, *flags)
