"""Findings, recommendations and the full table report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from threading import RLock

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.operators.columns import categorical_columns, numeric_columns
from gleanframe.operators.profile import describe_numeric, percent, table_quality, top_category
from gleanframe.operators.relate import cohort_uplift, driver_scenario, pearson_pairs, ranked_pairs
from gleanframe.operators.trend import top_trends
from gleanframe.plans.small import settled, together
from gleanframe.session import local_frame

STRONG_PAIR = 0.5
OUTLIER_SHARE = 2.5
DOMINANCE = 70.0
OUTLIER_MIN_VALUES = 5


class _once(cached_property):
    """A cached property that a second thread waits for instead of computing it again."""

    def __get__(self, instance, owner=None):
        if instance is None:
            return self
        with instance.locks[self.attrname]:
            return super().__get__(instance, owner)


@dataclass(frozen=True)
class Facts:
    """Metrics of one table that several parts of a report share, each computed once."""

    df: DataFrame
    locks: dict[str, RLock] = field(
        default_factory=lambda: {n: RLock() for n in ("quality", "stats", "categories", "pairs")}
    )

    @cached_property
    def numeric(self) -> list[str]:
        return numeric_columns(self.df)

    @cached_property
    def categorical(self) -> list[str]:
        return categorical_columns(self.df)

    @_once
    def quality(self) -> DataFrame:
        return settled(table_quality(self.df))

    @_once
    def stats(self) -> DataFrame:
        return settled(describe_numeric(self.df, self.numeric))

    @cached_property
    def outliers(self) -> DataFrame:
        """Outlier counts of columns with enough values for them to mean something."""
        return self.stats.where(F.col("count") > OUTLIER_MIN_VALUES).select(
            "column", F.col("outliers_count").alias("outlier_count"),
            percent(F.col("outliers_count"), F.col("count"), 1).alias("outlier_pct"),
        )

    @_once
    def categories(self) -> DataFrame:
        return settled(top_category(self.df, self.categorical))

    @_once
    def pairs(self) -> DataFrame:
        return settled(pearson_pairs(self.df, self.numeric))

    def gather(self, *more: Callable[[], DataFrame]) -> list[DataFrame]:
        """Compute every metric, and further small frames, side by side."""
        jobs = [lambda: self.quality]
        if self.numeric:
            jobs.append(lambda: self.stats)
        if self.categorical:
            jobs.append(lambda: self.categories)
        if len(self.numeric) >= 2:
            jobs.append(lambda: self.pairs)
        return together(*more, *jobs)[:len(more)]


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _unfold(frame: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """(…, label, value): one row per named number of every row."""
    cells = F.array(*[F.struct(F.lit(c).alias(label), F.col(c).cast("double").alias("value")) for c in names])
    kept = [c for c in frame.columns if c not in names]
    return frame.select(*kept, F.explode(cells).alias("x")).select(*kept, "x.*")


def _finding(kind: str, subject: Column, value: Column, text: Column, severity: str) -> list[Column]:
    return [
        F.lit(kind).alias("kind"), subject.cast("string").alias("subject"),
        value.cast("double").alias("value"), F.lit(severity).alias("severity"), text.alias("text"),
    ]


def findings(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """(kind, subject, value, severity, text): what stands out in a table."""
    if facts is None:
        facts = Facts(df)
        facts.gather()
    frames = []
    if len(facts.numeric) >= 2:
        strongest = ranked_pairs(df, at_least=STRONG_PAIR, top=1, digits=3, pairs=facts.pairs)
        kind = F.when(F.col("value") > 0, "positive").otherwise("inverse")
        frames.append(strongest.select(*_finding(
            "correlation", F.concat_ws(" ~ ", "col1", "col2"), F.col("value"),
            F.format_string("%s and %s move together (r = %+.3f, %s)", "col1", "col2", "value", kind),
            "high",
        )))
    if facts.numeric:
        frames.append(facts.outliers.where(F.col("outlier_pct") > OUTLIER_SHARE).select(*_finding(
            "outliers", F.col("column"), F.col("outlier_pct"),
            F.format_string("%s has %d outliers (%.1f%%)", "column", "outlier_count", "outlier_pct"),
            "medium",
        )))
        total = facts.outliers.agg(F.sum("outlier_count").alias("n")).where("n > 0")
        frames.append(total.select(*_finding(
            "outlier_total", F.lit("table"), F.col("n"),
            F.format_string("bound %d outliers before modelling", "n"), "medium",
        )))
    if facts.categorical:
        dominant = facts.categories.where(F.col("dominance_pct") >= DOMINANCE)
        frames.append(dominant.select(*_finding(
            "dominance", F.col("column"), F.col("dominance_pct"),
            F.format_string("%s is mostly %s (%.1f%%)", "column", "top_category", "dominance_pct"),
            "medium",
        )))
    frames.append(facts.quality.select(*_finding(
        "completeness", F.lit("table"), F.col("completeness_pct"),
        F.format_string(
            "%d rows and %d columns, %.2f%% of the cells filled", "total_rows", "total_columns",
            "completeness_pct",
        ),
        "info",
    )))
    frames.append(facts.quality.where("duplicate_rows > 0").select(*_finding(
        "duplicates", F.lit("table"), F.col("duplicate_rows"),
        F.format_string("remove %d copies of rows (%.2f%%)", "duplicate_rows", "duplicate_pct"), "high",
    )))
    frames.append(facts.quality.where("null_cells > 0").select(*_finding(
        "nulls", F.lit("table"), F.col("null_cells"),
        F.format_string("fill %d missing cells", "null_cells"), "medium",
    )))
    return _stack(frames)


def recommendations(df: DataFrame, order_by: Sequence[str], facts: Facts | None = None) -> DataFrame:
    """(id, kind, priority, impact_pct, confidence, timeline, text) from trends, drivers and cohorts."""
    facts = facts or Facts(df)
    jobs = []

    def record(name: Column, kind: str, priority, impact, confidence, timeline, text) -> list[Column]:
        return [
            name.alias("id"), F.lit(kind).alias("kind"), priority.alias("priority"),
            impact.alias("impact_pct"), confidence.alias("confidence"), timeline.alias("timeline"),
            text.alias("text"),
        ]

    if facts.numeric:
        jobs.append(lambda: top_trends(df, order_by, facts.numeric).select(*record(
            F.concat(F.lit("trend_"), "column"), "trend", F.col("priority"), F.col("impact_pct"),
            F.col("confidence"), F.format_string("next %d periods", "forecast_steps"),
            F.format_string(
                "%s is %s: %.2f now, %.2f ahead [%.2f, %.2f]", "column", "direction", "current_last",
                "proj_long", "ci_lower", "ci_upper",
            ),
        )))
    if len(facts.numeric) >= 2:
        size = F.abs("r")
        jobs.append(lambda: driver_scenario(df, facts.numeric, pairs=facts.pairs).select(*record(
            F.concat_ws("_", F.lit("corr"), "col1", "col2"), "driver",
            F.when(size >= 0.7, "high").otherwise("medium"),
            F.least(F.lit(40.0), F.round(size * 35, 1)),
            F.when(size >= 0.75, "high").otherwise("medium"), F.lit("immediate"),
            F.format_string("+10%% of %s goes with %+.1f%% of %s", "col1", "delta_pct", "col2"),
        )))
    if facts.numeric and facts.categorical:
        jobs.append(lambda: cohort_uplift(df).select(*record(
            F.concat_ws("_", F.lit("cohort"), "category", "metric"), "cohort", F.col("priority"),
            F.least(F.lit(35.0), F.round(F.col("gap_pct") * 0.5, 1)),
            F.when(F.col("segments") >= 3, "high").otherwise("medium"), F.lit("medium term"),
            F.format_string(
                "%s: %s is %.1f%% above %s", "category", "top_segment", "gap_pct", "bottom_segment"
            ),
        )))
    if not jobs:
        return local_frame(df.sparkSession, [], (
            "id string, kind string, priority string, impact_pct double, confidence string, "
            "timeline string, text string"
        ))
    return _stack(together(*[lambda job=job: settled(job()) for job in jobs]))


def kpi_cards(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """(card, value): rows, columns, completeness, quality, outliers and up to five mean bars.

    A bar's width is its mean against the largest one, between 8 and 100.
    """
    if facts is None:
        facts = Facts(df)
        together(lambda: facts.quality, *([lambda: facts.stats] if facts.numeric else []))
    cards = _unfold(
        facts.quality.select("total_rows", "total_columns", "completeness_pct", "quality_score"),
        ["total_rows", "total_columns", "completeness_pct", "quality_score"], "card",
    )
    if not facts.numeric:
        return cards
    outliers = facts.outliers.agg(F.coalesce(F.sum("outlier_count"), F.lit(0)).cast("double").alias("value"))
    means = facts.stats.where(F.col("count") > OUTLIER_MIN_VALUES).select("column", F.round("mean", 2).alias("mean"))
    largest = F.lit(max([abs(r["mean"]) for r in means.collect()] + [1.0]))
    width = F.least(F.lit(100.0), F.greatest(F.lit(8.0), F.abs("mean") / largest * 100))
    bars = means.where(F.col("column").isin(*facts.numeric[:5])).select(
        F.concat(F.lit("bar_"), "column").alias("card"), F.round(width, 2).alias("value")
    )
    return _stack([cards, outliers.select(F.lit("outliers").alias("card"), "value"), bars])


def feature_insights(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """(subject, metric, value): moments of numbers, dominance of categories."""
    facts = facts or Facts(df)
    frames = []
    if facts.numeric:
        stats = facts.stats.where(F.col("count") > OUTLIER_MIN_VALUES).select(
            F.col("column").alias("subject"),
            *[F.round(c, 2).alias(c) for c in ("mean", "std", "min", "max")], "outliers_count",
        )
        frames.append(_unfold(stats, ["mean", "std", "min", "max", "outliers_count"], "metric"))
    if facts.categorical:
        tops = facts.categories.select(
            F.col("column").alias("subject"), "unique_count", "top_frequency", "dominance_pct"
        )
        frames.append(_unfold(tops, ["unique_count", "top_frequency", "dominance_pct"], "metric"))
    return _stack(frames)


def table_report(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """(section, subject, metric, value): everything the report of a table states in numbers."""
    facts = Facts(df)
    advised = facts.gather(lambda: recommendations(df, order_by, facts))[0]
    overview = _unfold(facts.quality, facts.quality.columns, "metric").select(
        F.lit("overview").alias("section"), F.lit("table").alias("subject"), "metric", "value"
    )
    insights = feature_insights(df, facts).select(F.lit("feature").alias("section"), "subject", "metric", "value")
    found = findings(df, facts).select(
        F.lit("finding").alias("section"), "subject", F.col("kind").alias("metric"), "value"
    )
    advice = advised.select(
        F.lit("recommendation").alias("section"), F.col("id").alias("subject"),
        F.col("kind").alias("metric"), F.col("impact_pct").cast("double").alias("value"),
    )
    return _stack([overview, insights, found, advice])
