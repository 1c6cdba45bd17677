"""Named analyses with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanframe.operators.profile import describe_numeric, segment_compare
from gleanframe.operators.relate import correlation_matrix, ranked_pairs
from gleanframe.operators.trend import resample, trend_fit, trend_forecast


def correlation_analysis(df: DataFrame, method: str = "pearson") -> DataFrame:
    """(section, col1, col2, value, abs_value, strength): the whole matrix, and the ranked top pairs."""
    matrix = correlation_matrix(df, method=method).select(
        F.lit("matrix").alias("section"), "col1", "col2", F.col("r").alias("value"), F.abs("r").alias("abs_value"),
        F.lit(None).cast("string").alias("strength"),
    )
    top = ranked_pairs(df, method=method).select(
        F.lit("top").alias("section"), "col1", "col2", "value", "abs_value", "strength",
    )
    return matrix.unionByName(top)


def trend_analysis(df: DataFrame, time: str, metric: str, freq: str | None = None) -> DataFrame:
    """(section, period, value, lower, upper, direction, slope, r_squared, p_value).

    One ``trend`` row with the fitted line, a ``history`` row per calendar bin with its mean, and
    a ``forecast`` row per step ahead with its band.
    """
    none, word = F.lit(None).cast("double"), F.lit(None).cast("string")
    fit = trend_fit(df, time, metric, freq).select(
        F.lit("trend").alias("section"), F.col("last_period").alias("period"), none.alias("value"), none.alias("lower"),
        none.alias("upper"), "direction", F.round("slope", 4).alias("slope"), F.round("r_squared", 4).alias("r_squared"),
        F.round("p_value", 4).alias("p_value"),
    )

    def rows(source: DataFrame, section: str, value: str, lower=none, upper=none) -> DataFrame:
        return source.select(
            F.lit(section).alias("section"), "period", F.round(value, 2).alias("value"), lower.alias("lower"), upper.alias("upper"),
            word.alias("direction"), none.alias("slope"), none.alias("r_squared"), none.alias("p_value"),
        )

    history = rows(resample(df, time, metric, freq), "history", "mean")
    ahead = trend_forecast(df, time, metric, freq)
    ahead = rows(ahead, "forecast", "predicted_mean", F.col("lower_95_ci"), F.col("upper_95_ci"))
    return fit.unionByName(history).unionByName(ahead)


def run_analysis(df: DataFrame, kind: str, params: dict | None = None) -> DataFrame:
    """descriptive_stats, correlation, trend or segment_compare; others describe the table."""
    p = params or {}
    if kind == "correlation":
        return correlation_analysis(df, p.get("method", "pearson"))
    if kind == "trend":
        for name in (p.get("time_column"), p.get("metric_column")):
            if name not in df.columns:
                raise ValueError(f"column {name!r} not found")
        return trend_analysis(df, p["time_column"], p["metric_column"])
    if kind == "segment_compare":
        return segment_compare(df, p["category_column"], p["metric_column"])
    return describe_numeric(df)
