"""Resampled trends, forecasts and trends over row order."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from gleanframe.functions.dates import bin_end, bin_index, bin_step, parse_timestamp
from gleanframe.functions.stats import fit_from_moments, with_p_value
from gleanframe.functions.text import finite
from gleanframe.operators.columns import as_double, ident, numeric_columns
from gleanframe.operators.quantiles import medians
from gleanframe.session import local_frame

# worker functions travel whole, so the package need not be installed on the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORECAST_STEPS = 6
MIN_POINTS = 6


@dataclass(frozen=True)
class Span:
    first: date
    last: date
    points: int
    freq: str


def _points(df: DataFrame, time: str, metric: str) -> DataFrame:
    t = ident(time)
    if isinstance(df.schema[time].dataType, StringType):
        t = parse_timestamp(t)
    return df.select(t.cast("timestamp").alias("t"), as_double(df, metric).alias("v")).dropna()


def time_span(df: DataFrame, time: str, metric: str) -> Span | None:
    """Range of the usable points and the bin width that suits it; None below three points."""
    micros = F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))
    row = _points(df, time, metric).agg(
        F.to_date(F.min("t")).alias("first"), F.to_date(F.max("t")).alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.floor(micros / 86_400_000_000).alias("days"),
    ).first()
    if row["n"] < 3:
        return None
    freq = "D" if row["days"] < 90 else "W" if row["days"] < 365 else "ME"
    return Span(row["first"], row["last"], row["n"], freq)


def _span(df: DataFrame, time: str, metric: str, freq: str | None, span: Span | None) -> Span:
    span = span or time_span(df, time, metric)
    if span is None:
        raise ValueError("a trend needs at least three points")
    return span if freq is None else replace(span, freq=freq)


def resample(
    df: DataFrame, time: str, metric: str, freq: str | None = None, span: Span | None = None,
) -> DataFrame:
    """(period, sum, mean, count) per day, week or month without gaps.

    An empty bin has sum 0, count 0 and no mean.  ``span`` hands in a known time range.
    """
    span = _span(df, time, metric, freq, span)
    freq, spark = span.freq, df.sparkSession
    ends = local_frame(spark, [(span.first, span.last)], "a date, b date")
    a, b = bin_end(F.col("a"), freq), bin_end(F.col("b"), freq)
    if freq == "ME":
        months = F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("INTERVAL 1 MONTH"))
        spine = ends.select(F.explode(months).alias("m")).select(F.last_day("m").alias("period"))
    else:
        step = F.expr(f"INTERVAL {7 if freq == 'W' else 1} DAY")
        spine = ends.select(F.explode(F.sequence(a, b, step)).alias("period"))
    binned = (
        _points(df, time, metric).groupBy(bin_end(F.col("t"), freq).alias("period"))
        .agg(F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.count("v").alias("count"))
    )
    # one row per calendar bin on both sides
    return spine.join(F.broadcast(binned), "period", "left").select(
        "period", F.coalesce("sum", F.lit(0.0)).alias("sum"), "mean",
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def trend_fit(
    df: DataFrame, time: str, metric: str, freq: str | None = None, p_below: float = 0.05,
    span: Span | None = None,
) -> DataFrame:
    """One row: least-squares line through the bin means over the bin index.

    Empty bins keep their place on the axis but are no points of the fit.
    """
    span = _span(df, time, metric, freq, span)
    freq = span.freq
    bins = resample(df, time, metric, span=span)
    first = bin_end(F.lit(span.first), freq)
    x = bin_index(F.col("period"), first, freq).cast("double")
    y = F.col("mean")
    moments = bins.select(x.alias("x"), y.alias("y"), "period").agg(
        F.count(F.lit(1)).alias("bins"), F.regr_count("y", "x").alias("n"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.avg(F.when(F.col("y").isNotNull(), F.col("x"))).alias("mx"), F.avg("y").alias("my"),
        F.max("period").alias("last_period"),
    )
    fit = fit_from_moments(F.col("n"), F.col("sxx"), F.col("syy"), F.col("sxy"))
    slope = F.coalesce(fit["slope"], F.lit(0.0))
    fitted = moments.select(
        F.lit(freq).alias("frequency"), "bins", "n", "last_period", slope.alias("slope"),
        (F.col("my") - slope * F.col("mx")).alias("intercept"), fit["r2"].alias("r_squared"),
        F.coalesce(fit["stderr"], F.lit(0.0)).alias("stderr"),
    )
    sure = F.col("p_value") < p_below
    return with_p_value(fitted).withColumn(
        "direction",
        F.when((F.col("slope") > 0) & sure, "up").when((F.col("slope") < 0) & sure, "down")
        .otherwise("flat"),
    )


def trend_summary(df: DataFrame, time: str, metric: str, freq: str | None = None) -> DataFrame:
    return trend_fit(df, time, metric, freq).select(
        "frequency", "bins", F.round("slope", 4).alias("slope"),
        F.round("intercept", 4).alias("intercept"), F.round("r_squared", 4).alias("r_squared"),
        F.round("stderr", 4).alias("stderr"),
    )


def trend_forecast(
    df: DataFrame, time: str, metric: str, freq: str | None = None, steps: int = FORECAST_STEPS,
) -> DataFrame:
    """(step, period, predicted_mean, lower_95_ci, upper_95_ci) after the last bin."""
    span = _span(df, time, metric, freq, None)
    freq = span.freq
    fit = trend_fit(df, time, metric, span=span)
    ahead = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    at = F.col("bins") + F.col("step") - 1
    predicted = F.round(F.col("intercept") + F.col("slope") * at, 2)
    half = F.greatest(
        F.col("stderr") * F.sqrt(1 + 1 / F.col("bins")), 0.05 * F.abs(F.col("predicted_mean"))
    )
    spread = F.round(1.96 * half, 2)
    return (
        ahead.withColumn("predicted_mean", predicted).withColumn("spread", spread)
        .select(
            F.col("step").cast("bigint").alias("step"),
            bin_step(F.col("last_period"), freq, F.col("step")).alias("period"), "predicted_mean",
            F.round(F.col("predicted_mean") - F.col("spread"), 2).alias("lower_95_ci"),
            F.round(F.col("predicted_mean") + F.col("spread"), 2).alias("upper_95_ci"),
        )
    )


# ---- trends over row order ----------------------------------------------------------------------

_RUNS = "place int, slice int, n bigint, ay double, syy double, sxy double, last double"


def _slice_moments(batches, k: int):
    """Centred moments of every column over the running number of its filled cells, within one sorted slice."""
    n = np.zeros(k, np.int64)
    ay, syy, sxy, last = np.zeros(k), np.zeros(k), np.zeros(k), np.full(k, np.nan)
    for batch in batches:
        for i in range(k):
            y = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
            y = y[~np.isnan(y)]
            m = len(y)
            if not m:
                continue
            with np.errstate(invalid="ignore"):
                mean = y.mean()
                dy, share = mean - ay[i], n[i] * m / (n[i] + m)
                # numbers run on, so the middles of both parts are half of all cells apart
                syy[i] += ((y - mean) ** 2).sum() + dy * dy * share
                sxy[i] += ((np.arange(m) - (m - 1) / 2) * (y - mean)).sum() + dy * (n[i] + m) / 2 * share
                ay[i] += dy * m / (n[i] + m)
            n[i] += m
            last[i] = y[-1]
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([
        pa.array(some, pa.int32()), pa.array(np.full(len(some), TaskContext.get().partitionId()), pa.int32()),
        pa.array(n[some]), *[pa.array(v[some]) for v in (ay, syy, sxy, last)],
    ], names=["place", "slice", "n", "ay", "syy", "sxy", "last"])


def index_fit(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per numeric column: a line through its values over their position.

    Positions count the filled cells of a column in ``order_by``, which has to be unique.  A
    column with an infinite cell has no line and no row.  The rows are sorted once for all
    columns, and none ever gets its position: each partition reduces every column to centred
    moments over local positions, and the few rows per column that remain are shifted and merged.
    """
    columns = list(columns or numeric_columns(df))
    order = [f"__o{i}" for i in range(len(order_by))]
    keyed = df.select(*[ident(c).alias(o) for c, o in zip(order_by, order)], *[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    k = len(columns)
    runs = ordered.mapInArrow(lambda batches: _slice_moments(batches, k), _RUNS)
    # from here on there is one row per column and partition
    w = Window.partitionBy("place")
    before = F.sum("n").over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(w)
    shifted = runs.select(
        "place", "slice", "n", "ay", "syy", "sxy", "last", total.alias("total"),
        (F.coalesce(before, F.lit(0)) + (F.col("n") - 1) / 2).alias("mx"),
        (F.sum(F.col("n") * F.col("ay")).over(w) / total).alias("mean"),
    )
    dx, dy = F.col("mx") - (F.col("total") - 1) / 2, F.col("ay") - F.col("mean")
    n = F.col("n").cast("double")
    merged = shifted.groupBy("place").agg(
        F.sum("n").alias("n"), F.max("mean").alias("mean"),
        F.sum(n * (n * n - 1) / 12 + n * dx * dx).alias("sxx"),
        F.sum(F.col("syy") + n * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + n * dx * dy).alias("sxy"),
        F.max_by("last", "slice").alias("last"),
    ).where((F.col("n") >= MIN_POINTS) & finite(F.col("syy")).isNotNull() & finite(F.col("sxy")).isNotNull())
    fit = fit_from_moments(F.col("n"), F.col("sxx"), F.col("syy"), F.col("sxy"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("place") + 1) if columns else F.lit("")
    return merged.select(
        name.alias("column"), "n", "mean", "last", "sxx", fit["slope"].alias("slope"),
        (F.col("mean") - fit["slope"] * (F.col("n") - 1) / 2).alias("intercept"),
        fit["r2"].alias("r_squared"), fit["stderr"].alias("stderr"),
    )


def index_trend(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None,
) -> DataFrame:
    """(column, n, slope, intercept, r_squared, stderr) over row order, rounded."""
    return index_fit(df, order_by, columns).select(
        "column", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"),
        F.round("r_squared", 4).alias("r_squared"), F.round("stderr", 6).alias("stderr"),
    )


def direction(
    slope: Column, p: Column, r2: Column, words: tuple[str, str, str], r2_from: float,
    strict: bool = False, p_below: float = 0.1,
) -> Column:
    """Class of a trend: significant by p or by R²."""
    strong = (r2 > r2_from) if strict else (r2 >= r2_from)
    sure = (p < p_below) | strong
    up, down, none = words
    return F.when((slope > 0) & sure, up).when((slope < 0) & sure, down).otherwise(none)


def index_projection(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None,
    with_median: bool = False,
) -> DataFrame:
    """Short and long projection per column with a prediction band and its class."""
    columns = list(columns or numeric_columns(df))
    fit = index_fit(df, order_by, columns)
    n, slope = F.col("n"), F.col("slope")
    shorter = F.greatest(F.lit(5), F.floor(n * 0.1)).cast("bigint")
    longer = F.greatest(F.lit(10), F.floor(n * 0.25)).cast("bigint")
    mid = (n - 1) / 2
    reach = (n + F.col("h_long") - mid) * (n + F.col("h_long") - mid)
    se = F.col("stderr") * F.sqrt(1 + 1 / n + reach / F.greatest(F.col("sxx"), F.lit(1e-9)))
    margin = F.round(1.96 * F.greatest(se, 0.05 * F.abs("mean")), 2)
    change = F.round((F.col("proj_long") - F.col("last")) / F.abs("last") * 100, 1)
    out = (
        with_p_value(fit)
        .withColumn("r2", F.round("r_squared", 4))
        .withColumn("h_short", shorter).withColumn("h_long", longer)
        .withColumn("proj_short", F.round(F.col("intercept") + slope * (n + F.col("h_short")), 2))
        .withColumn("proj_long", F.round(F.col("intercept") + slope * (n + F.col("h_long")), 2))
        .withColumn("margin", margin)
    )
    p, r2 = F.col("p_value"), F.col("r2")
    out = out.select(
        "column", "n",
        direction(slope, p, r2, ("increasing", "decreasing", "stable"), 0.2).alias("direction"),
        F.round(slope, 5).alias("slope"), r2.alias("r_squared"), F.round(p, 5).alias("p_value"),
        F.round("mean", 2).alias("current_mean"), F.round("last", 2).alias("current_last"),
        "proj_short", "proj_long", F.col("h_long").alias("forecast_steps"),
        F.round(F.col("proj_long") - F.col("margin"), 2).alias("ci_lower"),
        F.round(F.col("proj_long") + F.col("margin"), 2).alias("ci_upper"),
        F.when(F.abs("last") > 1e-9, change).otherwise(F.lit(0.0)).alias("pct_change"),
        F.round(slope / F.greatest(F.abs("mean"), F.lit(1e-6)) * 100, 3).alias("growth_rate_pct"),
        F.when((r2 >= 0.4) & (p < 0.05), "high").when(r2 >= 0.15, "medium").otherwise("low")
        .alias("confidence"),
    )
    if not with_median:
        return out
    middle = medians(df, columns)
    frame = local_frame(df.sparkSession, [(c, m) for c, m in middle.items()], "column string, median double"
    )
    # one row per column
    return out.join(F.broadcast(frame), "column", "left").withColumn(
        "current_median", F.round("median", 2)
    ).drop("median")


def top_trends(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, top: int = 5,
) -> DataFrame:
    """The clearest trends with their priority and predicted impact."""
    r2, change = F.col("r_squared"), F.abs("pct_change")
    return (
        index_projection(df, order_by, columns).orderBy(F.desc("r_squared"), "column").limit(top)
        .withColumn(
            "priority", F.when(r2 >= 0.35, "high").when(r2 >= 0.1, "medium").otherwise("low")
        )
        .withColumn(
            "impact_pct",
            F.when(change > 0.5, F.least(F.lit(45.0), F.round(change, 1))).otherwise(F.round(r2 * 30, 1)),
        )
    )


def trend_p_values(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None,
) -> DataFrame:
    """(column, t, p_value) of the slopes over row order."""
    return with_p_value(index_fit(df, order_by, columns)).select(
        "column", F.round(F.try_divide("slope", F.col("stderr")), 6).alias("t"),
        F.round("p_value", 6).alias("p_value"),
    )


def summary_trends(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None,
) -> DataFrame:
    """The chat summary's variant: ten steps ahead and its own wording."""
    fit = with_p_value(index_fit(df, order_by, columns), "p").withColumn("r2", F.round("r_squared", 3))
    words = ("upward", "downward", "stable")
    return fit.select(
        "column", F.round("slope", 4).alias("slope"), F.col("r2").alias("r_squared"),
        F.round("p", 4).alias("p_value"),
        direction(F.col("slope"), F.col("p"), F.col("r2"), words, 0.2, strict=True).alias("direction"),
        F.round("last", 2).alias("current_latest"),
        F.round(F.col("intercept") + F.col("slope") * (F.col("n") + 10), 2)
        .alias("projected_next_10_steps"),
    )
