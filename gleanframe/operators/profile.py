"""Column profiles, table quality and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, IntegralType, StringType, TimestampType

from gleanframe.functions.constants import HEALTH_MISSING_TEXTS
from gleanframe.functions.stats import skewness_adjusted
from gleanframe.functions.text import finite, sql_double
from gleanframe.operators.clean import iqr_bounds, row_digest
from gleanframe.operators.columns import (
    CHUNK, aggregate_row, as_double, as_text, categorical_columns, ident, long_aggregates, numbers,
    numeric_columns, present, text_columns, unpivot_numbers, unpivot_text,
)
from gleanframe.operators.quantiles import exact_quantiles, quantile_frame, upper_medians
from gleanframe.operators.ranks import grouped_quantiles
from gleanframe.session import local_frame

DIGITS = 4


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


# ---- completeness and copies --------------------------------------------------------------------

def null_profile(df: DataFrame) -> DataFrame:
    """(column, total_count, null_count, null_pct)."""
    n = F.count(F.lit(1))
    out = long_aggregates(df, df.columns, {
        "total_count": ("bigint", lambda c: n),
        "null_count": ("bigint", lambda c: n - F.count(present(df, c))),
    })
    return out.withColumn("null_pct", percent(F.col("null_count"), F.col("total_count")))


def _plain(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """A cell as a whole number, a fraction or a text, the other two null; different cells stay different.

    Numbers and times keep their eight bytes; texts of 64 bytes or more become the 64 digits of their SHA-256.
    """
    c, t = present(df, name), df.schema[name].dataType
    whole, real, text = (F.lit(None).cast(k) for k in ("bigint", "double", "string"))
    if isinstance(t, (IntegralType, BooleanType)):
        return c.cast("bigint"), real, text
    if isinstance(t, DateType):
        return F.unix_date(c).cast("bigint"), real, text
    if isinstance(t, TimestampType):
        return F.unix_micros(c), real, text
    if isinstance(t, (FloatType, DoubleType)):
        # adding zero makes one value of both zeros
        return whole, c.cast("double") + F.lit(0.0), text
    words = as_text(df, name)
    return whole, real, F.when(F.octet_length(words) < 64, words).otherwise(F.sha2(words.cast("binary"), 256))


def distinct_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, distinct_count) without nulls.

    Exact counts meet in two levels: copies of a value combine before the shuffle and
    every (column, value) is one row after it.
    """
    if approximate:
        return long_aggregates(df, df.columns, {
            "distinct_count": ("bigint", lambda c: F.approx_count_distinct(as_text(df, c), 0.02)),
        })
    none = local_frame(df.sparkSession, [(c,) for c in df.columns], "column string")
    cells = [
        F.struct(F.lit(i).alias("c"), *[v.alias(n) for n, v in zip(("whole", "real", "text"), _plain(df, c))])
        for i, c in enumerate(df.columns)
    ]
    filled = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where(
        "whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL"
    )
    names = F.array(*[F.lit(c) for c in df.columns])
    counted = (
        filled.groupBy("c", "whole", "real", "text").agg(F.lit(1).alias("one"))
        .groupBy("c").agg(F.count("one").alias("distinct_count"))
        .select(names[F.col("c")].alias("column"), "distinct_count")
    )
    # both sides have one row per column
    return none.join(F.broadcast(counted), "column", "left").select(
        "column", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count")
    )


def _distinct_rows(df: DataFrame, missing: Column) -> DataFrame:
    """(copies, gaps): one row per distinct row, with the missing cells of its copies."""
    return df.select(row_digest(df).alias("row"), missing.alias("gaps")).groupBy("row", "gaps").agg(
        F.count(F.lit(1)).alias("copies")
    )


def _sum(parts: Sequence[Column]) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + p
    return total


def table_quality(df: DataFrame) -> DataFrame:
    """One row: cells, completeness, copies and the quality score, from one grouping."""
    width = len(df.columns)
    gaps = _sum([F.when(present(df, c).isNull(), 1).otherwise(0) for c in df.columns])
    rows = _distinct_rows(df, gaps)
    got = rows.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("copies") * F.col("gaps")), F.lit(0)).alias("null_cells"),
    )
    cells = F.col("total_rows") * width
    complete = F.coalesce(F.try_divide((cells - F.col("null_cells")) * 100.0, cells), F.lit(100.0))
    copies = F.col("total_rows") - F.col("distinct_rows")
    rated = got.select(
        "total_rows", F.lit(width).cast("bigint").alias("total_columns"), "null_cells",
        (cells - F.col("null_cells")).alias("valid_cells"),
        F.round(complete, 2).alias("completeness_pct"),
        copies.alias("duplicate_rows"), percent(copies, F.col("total_rows")).alias("duplicate_pct"),
    )
    score = F.greatest(F.lit(0.0), F.col("completeness_pct") - F.col("duplicate_pct") * 0.5)
    return rated.withColumn("quality_score", F.round(score, 1))


def health_score(df: DataFrame) -> DataFrame:
    """(health_score, health_status) over all rows; some texts count as missing."""
    missing = []
    for c in df.columns:
        empty = present(df, c).isNull()
        if isinstance(df.schema[c].dataType, StringType):
            empty = empty | ident(c).isin(*HEALTH_MISSING_TEXTS)
        missing.append(F.when(empty, 1).otherwise(0))
    got = _distinct_rows(df, _sum(missing)).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("d"),
        F.coalesce(F.sum(F.col("copies") * F.col("gaps")), F.lit(0)).alias("gaps"),
    )
    cells = F.col("n") * len(df.columns)
    valid = F.coalesce(F.try_divide((cells - F.col("gaps")) * 100.0, cells), F.lit(100.0))
    ratio = F.coalesce(F.try_divide((F.col("n") - F.col("d")) * 1.0, F.col("n")), F.lit(0.0))
    scored = got.select(F.greatest(F.lit(0.0), valid - ratio * 30).alias("health"))
    return scored.select(
        F.round("health", 1).alias("health_score"),
        F.when(F.col("health") < 75, "Needs Cleaning").when(F.col("health") < 90, "Good")
        .otherwise("Excellent").alias("health_status"),
    )


# ---- numbers ------------------------------------------------------------------------------------

def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: moments, quartiles, outliers, skewness and null share.

    The quartiles come first.  Everything else is one scan of plain sums: powers of the
    distance from the median, which lies close enough to the mean to lose no digits.
    """
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    kept = [c for c in columns if quartiles[c][0] is not None]
    # a column whose middle is infinite is not shifted; its moments are not finite either way
    centres = [quartiles[c][1] if isfinite(quartiles[c][1]) else 0.0 for c in kept]
    shifted = numbers(df, kept).selectExpr(
        *[f"x{i}" for i in range(len(kept))],
        *[f"x{i} - {centre!r}D AS d{i}" for i, centre in enumerate(centres)],
    )
    frames = []
    for start in range(0, len(kept), CHUNK // 8):
        part = list(enumerate(kept))[start:start + CHUNK // 8]
        sums, rows = ["count(1) AS rows"], []
        for i, c in part:
            q1, q2, q3 = quartiles[c]
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            sums += [
                f"count(x{i}) AS n{i}", f"sum(d{i}) AS d1_{i}", f"sum(d{i} * d{i}) AS d2_{i}",
                f"sum(d{i} * d{i} * d{i}) AS d3_{i}", f"min(x{i}) AS min{i}", f"max(x{i}) AS max{i}",
                f"count_if(x{i} < {sql_double(low)} OR x{i} > {sql_double(high)}) AS out{i}",
            ]
            rows.append(F.struct(
                F.lit(c).alias("column"), "rows", F.col(f"n{i}").alias("count"),
                F.col(f"d1_{i}").alias("d1"), F.col(f"d2_{i}").alias("d2"), F.col(f"d3_{i}").alias("d3"),
                F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.lit(centres[i]).alias("centre"), F.lit(q1).alias("q25"),
                F.lit(q2).alias("q50"), F.lit(q3).alias("q75"), F.col(f"out{i}").alias("outliers_count"),
            ))
        wide = shifted.agg(*[F.expr(e) for e in sums])
        frames.append(wide.select(F.inline(F.array(*rows))))
    if not frames:
        return local_frame(df.sparkSession, [], (
            "column string, count bigint, mean double, std double, min double, max double, median double, "
            "q25 double, q75 double, iqr double, outliers_count bigint, skewness double, null_pct double"
        ))
    raw = reduce(DataFrame.unionByName, frames)
    n = F.col("count").cast("double")
    shift = F.col("d1") / n
    m2 = F.greatest(F.col("d2") - n * shift * shift, F.lit(0.0))
    m3 = F.col("d3") - 3 * shift * F.col("d2") + 2 * n * shift * shift * shift
    varies = F.col("min") < F.col("max")
    std = F.when((n > 1) & varies, F.sqrt(m2 / (n - 1))).otherwise(0.0)
    skew = F.when(
        (n > 2) & varies, F.sqrt(n) * m3 / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)
    ).otherwise(0.0)
    return raw.select(
        "column", "count",
        F.round(F.col("centre") + shift, DIGITS).alias("mean"), F.round(std, DIGITS).alias("std"),
        "min", "max", F.round("q50", DIGITS).alias("median"),
        F.round("q25", DIGITS).alias("q25"), F.round("q75", DIGITS).alias("q75"),
        F.round(F.col("q75") - F.col("q25"), DIGITS).alias("iqr"), "outliers_count",
        F.round(skew, DIGITS).alias("skewness"),
        percent(F.col("rows") - F.col("count"), F.col("rows")).alias("null_pct"),
    )


def quantiles(df: DataFrame, columns: Sequence[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """(column, p10, q25, median, q75, p90, iqr)."""
    probs = {"p10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9}
    got = quantile_frame(df, list(columns or numeric_columns(df)), probs)
    return got.select(
        "column", *[F.round(p, digits).alias(p) for p in probs],
        F.round(F.col("q75") - F.col("q25"), digits).alias("iqr"),
    )


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, outlier_count, outlier_pct) strictly outside the quartile fences."""
    columns = list(columns or numeric_columns(df))
    bounds = iqr_bounds(df, columns)

    def outside(c: str) -> Column:
        if c not in bounds:
            return F.count_if(F.lit(False))
        x, (low, high) = as_double(df, c), bounds[c]
        return F.count_if((x < F.lit(low)) | (x > F.lit(high)))

    got = long_aggregates(df, columns, {
        "values": ("bigint", lambda c: F.count(as_double(df, c))),
        "outlier_count": ("bigint", outside),
    })
    return got.select(
        "column", "outlier_count",
        percent(F.col("outlier_count"), F.col("values"), 1).alias("outlier_pct"),
    )


def box_plot_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, whisker_low, q25, median, q75, whisker_high): whiskers end at data points."""
    columns = list(columns or numeric_columns(df))
    got = exact_quantiles(df, columns, [0.25, 0.5, 0.75])

    def within(c: str) -> Column:
        q1, _, q3 = got[c]
        x = as_double(df, c)
        if q1 is None:
            return F.lit(None).cast("double")
        return F.when(x.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)), x)

    def q(i: int):
        return ("double", lambda c: F.round(F.lit(got[c][i]).cast("double"), DIGITS))

    return long_aggregates(df, columns, {
        "whisker_low": ("double", lambda c: F.min(within(c))),
        "q25": q(0), "median": q(1), "q75": q(2),
        "whisker_high": ("double", lambda c: F.max(within(c))),
    })


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return long_aggregates(df, list(columns or numeric_columns(df)), {
        "skewness": ("double", lambda c: F.round(skewness_adjusted(as_double(df, c)), DIGITS)),
    })


def kurtosis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population excess kurtosis, null without variation."""
    return long_aggregates(df, list(columns or numeric_columns(df)), {
        "kurtosis": ("double", lambda c: F.round(F.kurtosis(as_double(df, c)), DIGITS)),
    })


def describe_population(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The dashboard's variant: population deviation and the upper of two middle values."""
    columns = list(columns or numeric_columns(df))
    upper = upper_medians(df, columns)
    return long_aggregates(df, columns, {
        "count": ("bigint", lambda c: F.count(as_double(df, c))),
        "mean": ("double", lambda c: F.round(F.avg(as_double(df, c)), 2)),
        "median": ("double", lambda c: F.round(F.lit(upper[c]).cast("double"), 2)),
        "min": ("double", lambda c: F.round(F.min(as_double(df, c)), 2)),
        "max": ("double", lambda c: F.round(F.max(as_double(df, c)), 2)),
        "std": ("double", lambda c: F.round(F.stddev_pop(as_double(df, c)), 2)),
    })


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """(column, bin, low, high, count): equal widths from minimum to maximum, empty bins kept.

    The bins cover the finite cells.  Infinite ones are counted apart, in bin -1 below and bin
    ``bins`` above, which appear only if there are any.
    """
    columns = list(columns or numeric_columns(df))
    row = aggregate_row(df, [
        e for i, c in enumerate(columns) for e in (
            F.min(finite(as_double(df, c))).alias(f"lo{i}"), F.max(finite(as_double(df, c))).alias(f"hi{i}"),
        )
    ])
    edges = [
        (c, b, row[f"lo{i}"], row[f"hi{i}"])
        for i, c in enumerate(columns) if row[f"lo{i}"] is not None for b in range(bins)
    ]
    frame = local_frame(df.sparkSession, edges, "column string, bin bigint, lo double, hi double")
    limits = F.create_map(*[
        x for i, c in enumerate(columns) if row[f"lo{i}"] is not None
        for x in (F.lit(c), F.array(F.lit(row[f"lo{i}"]), F.lit(row[f"hi{i}"])))
    ] or [F.lit(""), F.array(F.lit(0.0))])
    cells = unpivot_numbers(df, columns).withColumn("limits", limits[F.col("column")])
    lo, hi, x = F.col("limits")[0], F.col("limits")[1], F.col("value")
    slot = F.least(F.floor(F.coalesce(F.try_divide((x - lo) * bins, hi - lo), F.lit(0.0))), F.lit(bins - 1))
    placed = F.when(x == float("inf"), bins).when(x == float("-inf"), -1).otherwise(slot)
    counted = (
        cells.select("column", placed.cast("bigint").alias("bin")).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    )
    step = (F.col("hi") - F.col("lo")) / bins
    # one row per column and bin on both sides
    got = frame.join(F.broadcast(counted), ["column", "bin"], "full").select(
        "column", "bin",
        F.round(F.col("lo") + F.col("bin") * step, DIGITS).alias("low"),
        F.round(F.col("lo") + (F.col("bin") + 1) * step, DIGITS).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
    edge = F.when(F.col("bin") < 0, F.lit(float("-inf"))).when(F.col("bin") >= bins, F.lit(float("inf")))
    return got.select("column", "bin", F.coalesce("low", edge).alias("low"), F.coalesce("high", edge).alias("high"), "count")


# ---- categories and texts -----------------------------------------------------------------------

def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or categorical_columns(df))
    return unpivot_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(column, rank, value, count); each partition passes on at most k rows per column."""
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return (
        value_counts(df, columns).withColumn("rank", F.row_number().over(w).cast("bigint"))
        .where(F.col("rank") <= k).select("column", "rank", "value", "count")
    )


def top_category(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, unique_count, top_category, top_frequency, dominance_pct)."""
    got = value_counts(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.min(F.struct((-F.col("count")).alias("n"), "value")).alias("top"),
        F.sum("count").alias("filled"),
    )
    return got.select(
        "column", "unique_count", F.col("top.value").alias("top_category"),
        (-F.col("top.n")).alias("top_frequency"),
        F.round(-F.col("top.n") * 100.0 / F.col("filled"), 1).alias("dominance_pct"),
    )


def string_lengths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, avg_string_length, max_string_length)."""
    return long_aggregates(df, list(columns or text_columns(df)), {
        "avg_string_length": ("double", lambda c: F.round(F.avg(F.length(ident(c))), 2)),
        "max_string_length": ("bigint", lambda c: F.max(F.length(ident(c)))),
    })


def segment_stats(df: DataFrame, category: str, metric: str, digits: int = 4) -> DataFrame:
    """(segment, count, mean, median) of a metric per category, nulls left out."""
    rows = df.select(
        ident(category).cast("string").alias("segment"), as_double(df, metric).alias("value")
    ).where(F.col("segment").isNotNull())
    stats = rows.groupBy("segment").agg(F.count("value").alias("count"), F.avg("value").alias("mean"))
    middle = grouped_quantiles(rows, ["segment"], "value", {"median": 0.5})
    return stats.join(middle, "segment", "left").select(
        "segment", "count", F.round("mean", digits).alias("mean"),
        F.round("median", digits).alias("median"),
    )


def segment_compare(df: DataFrame, category: str, metric: str) -> DataFrame:
    """Segment statistics with each mean's distance from the overall mean in percent."""
    overall = df.agg(F.avg(as_double(df, metric))).first()[0]
    base = F.lit(overall).cast("double")
    return segment_stats(df, category, metric, 6).select(
        "segment", "count", F.round("mean", DIGITS).alias("mean"),
        F.round("median", DIGITS).alias("median"),
        F.round((F.col("mean") - base) / F.greatest(F.abs(base), F.lit(1e-9)) * 100, 2)
        .alias("vs_overall_pct"),
    )


def small_group_means(
    df: DataFrame, category: str, metric: str, most: int = 10, shown: int = 5,
) -> DataFrame:
    """(segment, mean, count) of the first groups by name; nothing beyond ``most`` groups."""
    rows = df.select(
        ident(category).cast("string").alias("segment"), as_double(df, metric).alias("value")
    ).where(F.col("segment").isNotNull())
    # the first groups by name, one more than allowed, show whether there are too many
    groups = rows.groupBy("segment").agg(
        F.round(F.avg("value"), 2).alias("mean"), F.count("value").alias("count")
    ).orderBy("segment").limit(most + 1)
    w = Window.partitionBy(F.lit(0))
    ranked = groups.select(
        "*", F.count(F.lit(1)).over(w).alias("groups"),
        F.row_number().over(w.orderBy("segment")).alias("rank"),
    )
    return ranked.where((F.col("groups") <= most) & (F.col("rank") <= shown)).select(
        "segment", "mean", "count"
    )


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: counts for all, statistics for numbers, lengths and the ten top values for texts.

    Top values are JSON text, most frequent first; :func:`table_quality` sums up the table.
    """
    numeric, texts = numeric_columns(df), text_columns(df)
    base = null_profile(df).join(F.broadcast(distinct_profile(df)), "column")
    kind = F.when(F.col("column").isin(*numeric), "numeric") if numeric else F.when(F.lit(False), "")
    out = base.withColumn("type", kind.otherwise("categorical"))
    # every side below has one row per column
    if numeric:
        stats = describe_numeric(df, numeric).select(
            "column", "min", "max", "mean", "std", "median", "q25", "q75", "iqr",
            F.col("outliers_count").alias("outlier_count"),
        )
        out = out.join(F.broadcast(stats), "column", "left")
    if texts:
        out = out.join(F.broadcast(string_lengths(df, texts)), "column", "left")
        ranked = F.sort_array(F.collect_list(F.struct("rank", "value", "count")))
        shown = F.to_json(F.transform(ranked, lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))))
        tops = top_values(df, texts).groupBy("column").agg(shown.alias("top_values"))
        out = out.join(F.broadcast(tops), "column", "left")
    return out
