"""Resampled trends, forecasts and trends over row order."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.operators import trend
from gleanframe.registry.base import per_column, query, table
from gleanframe.registry.fixtures import ENDLESS_ORDERS, SPARSE_EVENTS, endless_orders, sparse_events
from gleanframe.session import scratch_path
from gleanframe.streaming import live

DAY = "CAST(ts AS DATE)"
WEEK = "CAST(date_trunc('week', o_orderdate) AS DATE) + 6"
MONTH = "last_day(o_orderdate)"


def p_value_sql(t, v):
    """Two-sided p-value of Student's t by Simpson's rule; a scalar subquery."""
    density = f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * pow(1 + pow(abs({t}) * k / 4000.0, 2) / {v}, -({v} + 1) / 2.0)"
    weight = "CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT greatest(0.0, 1 - 2 * sum({weight} * {density}) * abs({t}) / 12000.0) FROM (SELECT range AS k FROM range(4001)))"


def _bins(ctes, source, period, metric, spine):
    return f"""
WITH {ctes} binned AS (SELECT {period} AS period, sum({metric}) AS s, avg({metric}) AS m, count({metric}) AS n FROM {source} GROUP BY 1),
spine AS ({spine}),
bins AS (SELECT spine.period, coalesce(s, 0.0) AS s, m, coalesce(n, 0) AS n, row_number() OVER (ORDER BY spine.period) - 1 AS i
  FROM spine LEFT JOIN binned ON spine.period = binned.period)"""


_DAILY_SPINE = "SELECT CAST(unnest(generate_series((SELECT min(period) FROM binned), (SELECT max(period) FROM binned), INTERVAL 1 DAY)) AS DATE) AS period"
_WEEKLY_SPINE = _DAILY_SPINE.replace("1 DAY", "7 DAY")
_MONTHLY_SPINE = """SELECT last_day(CAST(unnest(generate_series(date_trunc('month', (SELECT min(period) FROM binned)),
  date_trunc('month', (SELECT max(period) FROM binned)), INTERVAL 1 MONTH)) AS DATE)) AS period"""

DAILY = _bins("", "events", DAY, "value", _DAILY_SPINE)
SPARSE_DAILY = _bins(SPARSE_EVENTS + ",", "sparse_events", DAY, "value", _DAILY_SPINE)
WEEKLY = _bins("", "orders", WEEK, "o_totalprice", _WEEKLY_SPINE)
MONTHLY = _bins("", "orders", MONTH, "o_totalprice", _MONTHLY_SPINE)
_SERIES = " SELECT period, round(s, 2) AS sum, round(m, 6) AS mean, n AS count FROM bins"


def _rounded(bins):
    return bins.select("period", F.round("sum", 2).alias("sum"), F.round("mean", 6).alias("mean"), "count")


@query("resample_daily", DAILY + _SERIES)
def resample_daily(spark, folder):
    return _rounded(trend.resample(table(spark, folder, "events"), "ts", "value"))


@query("resample_gaps", SPARSE_DAILY + _SERIES)
def resample_gaps(spark, folder):
    return _rounded(trend.resample(sparse_events(spark, folder), "ts", "value"))


@query("resample_weekly", WEEKLY + _SERIES.replace("round(m, 6)", "round(m + 1e-7, 4)"))
def resample_weekly(spark, folder):
    """Means of cents over a few dozen orders end in halves; a nudge makes both engines round them alike."""
    bins = trend.resample(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "W")
    return bins.select("period", F.round("sum", 2).alias("sum"), F.round(F.col("mean") + 1e-7, 4).alias("mean"), "count")


@query("resample_monthly", MONTHLY + _SERIES)
def resample_monthly(spark, folder):
    return _rounded(trend.resample(table(spark, folder, "orders"), "o_orderdate", "o_totalprice"))


_FIT = """, fit AS (
  SELECT count(*) AS bins, regr_count(m, i) AS n, regr_slope(m, i) AS slope, regr_intercept(m, i) AS intercept,
    least(coalesce(regr_sxy(m, i) * regr_sxy(m, i) / nullif(regr_sxx(m, i) * regr_syy(m, i), 0), 0), 1) AS r2, regr_syy(m, i) AS syy,
    regr_sxx(m, i) AS sxx, max(period) AS last_period FROM bins),
line AS (SELECT *, sqrt(greatest((1 - r2) * syy / (sxx * (n - 2)), 0)) AS stderr FROM fit)"""


def _fit_sql(bins, freq):
    return bins + _FIT + f"""
SELECT '{freq}' AS frequency, bins, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r_squared,
  round(stderr, 4) AS stderr FROM line"""


@query("trend_fit", _fit_sql(MONTHLY, "ME"))
def trend_fit(spark, folder):
    return trend.trend_summary(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")


@query("trend_direction", MONTHLY + _FIT + f""", p AS (SELECT *, {p_value_sql("slope / stderr", "(CAST(n AS DOUBLE) - 2)")} AS p FROM line)
SELECT round(p, 6) AS p_value, CASE WHEN slope > 0 AND p < 0.05 THEN 'up' WHEN slope < 0 AND p < 0.05 THEN 'down' ELSE 'flat' END AS direction
FROM p""")
def trend_direction(spark, folder):
    got = trend.trend_fit(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")
    return got.select(F.round("p_value", 6).alias("p_value"), "direction")


@query("trend_fit_gaps", _fit_sql(SPARSE_DAILY, "D"))
def trend_fit_gaps(spark, folder):
    return trend.trend_summary(sparse_events(spark, folder), "ts", "value")


def _forecast_sql(bins, date):
    return bins + _FIT + f""", ahead AS (
  SELECT line.*, k AS step, round(intercept + slope * (bins + k - 1), 2) AS predicted FROM line, (SELECT unnest(range(1, 7)) AS k)),
spread AS (SELECT *, round(1.96 * greatest(stderr * sqrt(1 + 1.0 / bins), 0.05 * abs(predicted)), 2) AS w FROM ahead)
SELECT step, {date} AS period, predicted AS predicted_mean, round(predicted - w, 2) AS lower_95_ci, round(predicted + w, 2) AS upper_95_ci FROM spread"""


_NEXT_MONTH = "CAST(last_period + to_months(CAST(step AS INTEGER)) AS DATE)"


@query("trend_forecast", _forecast_sql(MONTHLY, _NEXT_MONTH))
def trend_forecast(spark, folder):
    return trend.trend_forecast(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")


@query("trend_forecast_weekly", _forecast_sql(WEEKLY, "CAST(last_period + CAST(step * 7 AS INTEGER) AS DATE)"))
def trend_forecast_weekly(spark, folder):
    return trend.trend_forecast(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "W")


@query("trend_forecast_daily", _forecast_sql(DAILY, "CAST(last_period + CAST(step AS INTEGER) AS DATE)"))
def trend_forecast_daily(spark, folder):
    return trend.trend_forecast(table(spark, folder, "events"), "ts", "value")


TREND_ANALYSIS = f"""
WITH ahead AS ({_forecast_sql(DAILY, "CAST(last_period + CAST(step AS INTEGER) AS DATE)")}),
fitted AS ({DAILY + _FIT} SELECT *, {p_value_sql("slope / stderr", "(CAST(n AS DOUBLE) - 2)")} AS p FROM line), history AS ({DAILY} SELECT period, m FROM bins)
SELECT 'trend' AS section, last_period AS period, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper,
  CASE WHEN slope > 0 AND p < 0.05 THEN 'up' WHEN slope < 0 AND p < 0.05 THEN 'down' ELSE 'flat' END AS direction,
  round(slope, 4) AS slope, round(r2, 4) AS r_squared, round(p, 4) AS p_value FROM fitted
UNION ALL SELECT 'history', period, round(m, 2), NULL, NULL, NULL, NULL, NULL, NULL FROM history
UNION ALL SELECT 'forecast', period, predicted_mean, lower_95_ci, upper_95_ci, NULL, NULL, NULL, NULL FROM ahead"""


# ---- row order ----------------------------------------------------------------------------------

EVENT_NUMBERS = ["event_id", "user_id", "value"]


def index_fit_sql(columns, source, order):
    """CTEs up to ``line``: a line per column over the positions of its filled cells."""
    cell = f"SELECT '{{c}}' AS col, CAST({{c}} AS DOUBLE) AS y, {order} FROM {source} WHERE {{c}} IS NOT NULL"
    return f"""
cells AS ({per_column(columns, cell)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY {order}) - 1 AS x FROM cells),
fit AS (SELECT col, count(*) AS n, avg(y) AS mean, arg_max(y, x) AS last, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS slope,
  regr_intercept(y, x) AS intercept, least(regr_r2(y, x), 1.0) AS r2, regr_syy(y, x) AS syy FROM numbered GROUP BY col HAVING count(*) >= 6),
line AS (SELECT *, sqrt(greatest((1 - r2) * syy / (sxx * (n - 2)), 0)) AS stderr FROM fit)"""


def projection_sql(columns, source, order):
    """CTEs up to ``numbers``: the projection of every column."""
    return f"""{index_fit_sql(columns, source, order)}, reach AS (
  SELECT *, greatest(5, CAST(floor(n * 0.1) AS BIGINT)) AS hs, greatest(10, CAST(floor(n * 0.25) AS BIGINT)) AS hl FROM line),
proj AS (
  SELECT *, round(intercept + slope * (n + hs), 2) AS proj_short, round(intercept + slope * (n + hl), 2) AS proj_long,
    round(1.96 * greatest(stderr * sqrt(1 + 1.0 / n + pow(n + hl - (n - 1) / 2.0, 2) / greatest(sxx, 0.000000001)), 0.05 * abs(mean)), 2) AS margin
  FROM reach),
numbers AS (
  SELECT col AS "column", n, round(slope, 5) AS slope, round(r2, 4) AS r_squared, round(mean, 2) AS current_mean, round(last, 2) AS current_last,
    proj_short, proj_long, hl AS forecast_steps, round(proj_long - margin, 2) AS ci_lower, round(proj_long + margin, 2) AS ci_upper,
    CASE WHEN abs(last) > 0.000000001 THEN round((proj_long - last) / abs(last) * 100, 1) ELSE 0.0 END AS pct_change,
    round(slope / greatest(abs(mean), 0.000001) * 100, 3) AS growth_rate_pct FROM proj)"""


INDEX_FIT = index_fit_sql(EVENT_NUMBERS, "events", "ts, event_id")
INDEX_PROJECTION = "WITH " + projection_sql(EVENT_NUMBERS, "events", "ts, event_id")
TOP_TRENDS = """
SELECT "column", r_squared, pct_change, CASE WHEN r_squared >= 0.35 THEN 'high' WHEN r_squared >= 0.1 THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN abs(pct_change) > 0.5 THEN least(45.0, round(abs(pct_change), 1)) ELSE round(r_squared * 30, 1) END AS impact_pct
FROM numbers ORDER BY r_squared DESC, "column" LIMIT 5"""


@query("index_trend", f"""
WITH {INDEX_FIT} SELECT col AS "column", n, round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r_squared,
  round(stderr, 6) AS stderr FROM line""")
def index_trend(spark, folder):
    return trend.index_trend(table(spark, folder, "events"), ["ts", "event_id"])


_NUMBERS = [
    "column", "n", "slope", "r_squared", "current_mean", "current_last", "proj_short", "proj_long", "forecast_steps", "ci_lower",
    "ci_upper", "pct_change", "growth_rate_pct",
]


# beyond sixty standard errors the p-value is 0 in all digits shown
_P_VALUE = f"CASE WHEN slope = 0 THEN 1.0 WHEN stderr = 0 OR abs(slope / stderr) > 60 THEN 0.0 ELSE {p_value_sql('slope / stderr', '(CAST(n AS DOUBLE) - 2)')} END"
_CLASSES = f""", sure AS (SELECT col AS "column", slope AS s, round(r2, 4) AS r2, {_P_VALUE} AS p FROM line)
SELECT numbers.*, round(p, 5) AS p_value, CASE WHEN s > 0 AND (p < 0.1 OR r2 >= 0.2) THEN 'increasing'
  WHEN s < 0 AND (p < 0.1 OR r2 >= 0.2) THEN 'decreasing' ELSE 'stable' END AS direction,
  CASE WHEN r2 >= 0.4 AND p < 0.05 THEN 'high' WHEN r2 >= 0.15 THEN 'medium' ELSE 'low' END AS confidence FROM numbers JOIN sure USING ("column")"""


@query("index_projection", INDEX_PROJECTION + _CLASSES)
def index_projection(spark, folder):
    got = trend.index_projection(table(spark, folder, "events"), ["ts", "event_id"])
    return got.select(*_NUMBERS, "p_value", "direction", "confidence")


# a column with an infinite cell has no line, so only these are left
_SOUND = ["o_orderkey", "twice"]


@query("index_trend_inf", f"""
WITH {ENDLESS_ORDERS}, {index_fit_sql(_SOUND, "endless_orders", "o_orderkey")}
SELECT col AS "column", n, round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r_squared, round(stderr, 6) AS stderr FROM line""")
def index_trend_inf(spark, folder):
    return trend.index_trend(endless_orders(spark, folder), ["o_orderkey"])


@query("top_trends_inf", f"WITH {ENDLESS_ORDERS}, " + projection_sql(_SOUND, "endless_orders", "o_orderkey") + TOP_TRENDS)
def top_trends_inf(spark, folder):
    got = trend.top_trends(endless_orders(spark, folder), ["o_orderkey"])
    return got.select("column", "r_squared", "pct_change", "priority", "impact_pct")


@query("top_trends", INDEX_PROJECTION + TOP_TRENDS)
def top_trends(spark, folder):
    got = trend.top_trends(table(spark, folder, "events"), ["ts", "event_id"])
    return got.select("column", "r_squared", "pct_change", "priority", "impact_pct")


@query("trend_pvalues", "WITH " + index_fit_sql(["user_id", "value"], "events", "ts, event_id") + f"""
SELECT col AS "column", round(slope / stderr, 6) AS t, round({p_value_sql("slope / stderr", "(CAST(n AS DOUBLE) - 2)")}, 6) AS p_value FROM line""")
def trend_pvalues(spark, folder):
    return trend.trend_p_values(table(spark, folder, "events"), ["ts", "event_id"], ["user_id", "value"])


@query("stream_kpi", """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def stream_kpi(spark, folder):
    """Daily cards per event type, from a stream over the event files."""
    schema = table(spark, folder, "events").schema
    # the source reads a folder; a glob picks the one file out of it
    source = live.read_growing(spark, f"{folder}/events*.parquet", schema)
    timed = source.withColumn("ts", F.col("ts").cast("timestamp"))
    return _shown_cards(live.run_available(timed, "ts", "event_type", "value"))


def _shown_cards(cards):
    return cards.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total")
    )


@query("stream_kpi_late", """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def stream_kpi_late(spark, folder):
    """The same cards from many files in an order that has nothing to do with time, a few a batch."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "late-events")
    events.repartition(20, F.xxhash64("event_id")).sortWithinPartitions(F.desc("ts")).write.parquet(path)
    source = live.read_growing(spark, path, events.schema, files_per_trigger=5)
    return _shown_cards(live.run_available(source, "ts", "event_type", "value"))
