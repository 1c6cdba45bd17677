"""Aggregate-only summary of a table as one JSON document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from gleanframe.functions.constants import SUMMARY_ID_KEYWORDS
from gleanframe.functions.stats import sample_std, skewness_adjusted
from gleanframe.operators.columns import (
    as_double, categorical_columns, long_aggregates, numeric_columns,
)
from gleanframe.operators.profile import (
    distinct_profile, null_profile, outlier_counts, quantiles, small_group_means,
)
from gleanframe.operators.relate import ranked_pairs
from gleanframe.operators.schema import safe_value_counts
from gleanframe.operators.trend import summary_trends
from gleanframe.plans.small import settled, together


def _statistics(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    moments = long_aggregates(df, numeric, {
        "mean": ("double", lambda c: F.round(F.avg(as_double(df, c)), 2)),
        "std": ("double", lambda c: F.round(sample_std(as_double(df, c)), 2)),
        "min": ("double", lambda c: F.round(F.min(as_double(df, c)), 2)),
        "max": ("double", lambda c: F.round(F.max(as_double(df, c)), 2)),
        "skewness": ("double", lambda c: F.round(skewness_adjusted(as_double(df, c)), 2)),
    })
    outliers = outlier_counts(df, numeric).select("column", F.col("outlier_count").alias("outliers_count"))
    middle = quantiles(df, numeric, 2).select("column", "median", "p10", "p90")
    # every side has one row per column
    return moments.join(F.broadcast(middle), "column").join(F.broadcast(outliers), "column")


def _categories(df: DataFrame) -> DataFrame:
    """(column, unique_count, null_count)."""
    # both sides have one row per column
    nulls = F.broadcast(null_profile(df).select("column", "null_count"))
    return distinct_profile(df).join(nulls, "column").select("column", F.col("distinct_count").alias("unique_count"), "null_count")


def summary_parts(df: DataFrame, order_by: Sequence[str]) -> dict[str, Callable[[], DataFrame]]:
    """How to compute each of the small frames of a summary; none holds a row of the table."""
    numeric, categorical = numeric_columns(df), categorical_columns(df)
    parts = {"nulls": lambda: null_profile(df).where("null_count > 0").select("column", "null_count")}
    if numeric:
        parts["stats"] = lambda: _statistics(df, numeric)
        parts["trends"] = lambda: summary_trends(df, order_by, numeric)
    if len(numeric) >= 2:
        parts["correlations"] = lambda: ranked_pairs(df, numeric, top=10, digits=3).select("col1", "col2", "value")
    if categorical:
        parts["categories"] = lambda: _categories(df.select(*[f"`{c}`" for c in categorical]))
        parts["value_counts"] = lambda: safe_value_counts(df)
        named = any(k in categorical[0].lower() for k in SUMMARY_ID_KEYWORDS)
        if numeric and not named:
            parts["groups"] = lambda: small_group_means(df, categorical[0], numeric[0])
    return parts


def safe_summary(df: DataFrame, name: str, order_by: Sequence[str]) -> DataFrame:
    """(document): one JSON text with aggregates only, never values that identify a row.

    The parts are a few rows per column, so one task gathers them.
    """
    numeric, categorical = numeric_columns(df), categorical_columns(df)
    parts = summary_parts(df, order_by)
    total, *frames = together(
        lambda: settled(df.agg(F.count(F.lit(1)).alias("total_rows"))),
        *[lambda make=make: settled(make()) for make in parts.values()],
    )
    out = total.select(
        F.lit(name).alias("dataset_name"), "total_rows", F.lit(len(df.columns)).alias("total_cols"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
        .alias("column_types"),
        F.array(*[F.lit(c) for c in numeric]).cast("array<string>").alias("numeric_columns"),
        F.array(*[F.lit(c) for c in categorical]).cast("array<string>").alias("categorical_columns"),
        F.lit(1).alias("__one"),
    )
    for part, frame in zip(parts, frames):
        packed = frame.agg(
            F.sort_array(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in frame.columns]))).alias(part)
        ).withColumn("__one", F.lit(1))
        out = out.join(F.broadcast(packed), "__one")
    total_nulls = F.aggregate("nulls", F.lit(0).cast("bigint"), lambda n, x: n + x["null_count"])
    out = out.withColumn("total_nulls", total_nulls)
    return out.select(F.to_json(F.struct(*[c for c in out.columns if c != "__one"])).alias("document"))
