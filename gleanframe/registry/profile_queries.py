"""Profiles and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.operators import clean, profile
from gleanframe.registry.base import LINEITEM_NUMBERS, per_column, query, table
from gleanframe.registry.fixtures import (
    DIRTY_COLUMNS, DIRTY_CUSTOMER, ENDLESS_ORDERS, SPARSE_ORDERS, dirty_customer, endless_orders, sparse_orders,
)

SPARSE_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

_DESCRIBE = """
SELECT column_name AS "column", n AS "count", round(mean, 4) AS mean, round(coalesce(std, 0), 4) AS std, lo AS min, hi AS max,
  round(q2, 4) AS median, round(q1, 4) AS q25, round(q3, 4) AS q75, round(q3 - q1, 4) AS iqr, outliers AS outliers_count,
  round(skew, 4) AS skewness, round((total - n) * 100.0 / total, 2) AS null_pct
FROM (
  SELECT s.column_name, s.n, s.mean, s.std, s.lo, s.hi, s.q1, s.q2, s.q3, s.total,
    CASE WHEN s.n <= 2 THEN 0.0 ELSE coalesce(s.skew, 0.0) END AS skew, s.outliers
  FROM ({parts}) s
)"""


def _describe_sql(columns, source, ctes=""):
    part = f"""
SELECT '{{c}}' AS column_name, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS lo, max(x) AS hi,
  any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, skewness(x) AS skew, count(*) AS total,
  count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT CAST({{c}} AS DOUBLE) AS x FROM {source}),
  (SELECT quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({{c}} AS DOUBLE), 0.5) AS q2,
     quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3 FROM {source})"""
    return f"{ctes} {_DESCRIBE.format(parts=per_column(columns, part))}"


@query("describe_numeric", _describe_sql(LINEITEM_NUMBERS, "lineitem"))
def describe_numeric(spark, folder):
    return profile.describe_numeric(table(spark, folder, "lineitem"))


@query(
    "describe_numeric_nulls",
    _describe_sql(["o_orderkey", "o_custkey", "o_totalprice"], "sparse_orders", "WITH" + SPARSE_ORDERS),
)
def describe_numeric_nulls(spark, folder):
    return profile.describe_numeric(sparse_orders(spark, folder))


@query("null_profile", "WITH" + SPARSE_ORDERS + per_column(SPARSE_COLUMNS, """
SELECT '{c}' AS "column", count(*) AS total_count, count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM sparse_orders"""))
def null_profile(spark, folder):
    return profile.null_profile(sparse_orders(spark, folder))


@query("distinct_profile", "WITH" + SPARSE_ORDERS + per_column(SPARSE_COLUMNS, """
SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_count FROM sparse_orders"""))
def distinct_profile(spark, folder):
    return profile.distinct_profile(sparse_orders(spark, folder))


_GAPS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in DIRTY_COLUMNS)
_QUALITY = f"""
WITH {DIRTY_CUSTOMER}, counted AS (
  SELECT count(*) AS n, CAST(sum({_GAPS}) AS BIGINT) AS gaps,
    (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) AS d FROM dirty_customer
), rated AS (
  SELECT n AS total_rows, CAST(7 AS BIGINT) AS total_columns, gaps AS null_cells, n * 7 - gaps AS valid_cells,
    round((n * 7 - gaps) * 100.0 / (n * 7), 2) AS completeness_pct, n - d AS duplicate_rows,
    round((n - d) * 100.0 / n, 2) AS duplicate_pct FROM counted
)
SELECT *, round(greatest(0.0, completeness_pct - duplicate_pct * 0.5), 1) AS quality_score FROM rated"""


@query("table_quality", _QUALITY)
def table_quality(spark, folder):
    return profile.table_quality(dirty_customer(spark, folder))


_HEALTH_GAPS = " + ".join(
    f"(CASE WHEN {c} IS NULL" + ("" if c in ("id", "age") else f" OR {c} IN ('', 'NaN', 'null', 'None')")
    + " THEN 1 ELSE 0 END)" for c in DIRTY_COLUMNS
)


@query("health_score", f"""
WITH {DIRTY_CUSTOMER}, counted AS (
  SELECT count(*) AS n, sum({_HEALTH_GAPS}) AS gaps,
    (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) AS d FROM dirty_customer
), scored AS (
  SELECT greatest(0.0, (n * 7 - gaps) * 100.0 / (n * 7) - (n - d) * 1.0 / n * 30) AS health FROM counted
)
SELECT round(health, 1) AS health_score,
  CASE WHEN health < 75 THEN 'Needs Cleaning' WHEN health < 90 THEN 'Good' ELSE 'Excellent' END AS health_status
FROM scored""")
def health_score(spark, folder):
    return profile.health_score(dirty_customer(spark, folder))


@query("quantiles", per_column(LINEITEM_NUMBERS, """
SELECT '{c}' AS "column", round(quantile_cont(CAST({c} AS DOUBLE), 0.1), 4) AS p10,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, round(quantile_cont(CAST({c} AS DOUBLE), 0.9), 4) AS p90,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS iqr FROM lineitem"""))
def quantiles(spark, folder):
    return profile.quantiles(table(spark, folder, "lineitem"))


@query("outlier_counts", per_column(["event_id", "user_id", "value"], """
SELECT '{c}' AS "column", count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count,
  round(count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) * 100.0 / count(x), 1) AS outlier_pct
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM events),
  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM events)"""))
def outlier_counts(spark, folder):
    return profile.outlier_counts(table(spark, folder, "events"))


@query("skewness_adj", per_column(["event_id", "user_id", "value"], """
SELECT '{c}' AS "column", round(skewness(CAST({c} AS DOUBLE)), 4) AS skewness FROM events"""))
def skewness_adj(spark, folder):
    return profile.skewness(table(spark, folder, "events"))


@query("kurtosis", per_column(["event_id", "user_id", "value"], """
SELECT '{c}' AS "column", round(kurtosis_pop(CAST({c} AS DOUBLE)), 4) AS kurtosis FROM events"""))
def kurtosis(spark, folder):
    return profile.kurtosis(table(spark, folder, "events"))


@query("box_plot_stats", per_column(["event_id", "user_id", "value"], """
SELECT '{c}' AS "column", min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  round(any_value(q1), 4) AS q25, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q75,
  max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM events),
  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2,
     quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM events)"""))
def box_plot_stats(spark, folder):
    return profile.box_plot_stats(table(spark, folder, "events"))


@query("describe_population", per_column(LINEITEM_NUMBERS, """
SELECT '{c}' AS "column", count({c}) AS "count", round(avg(CAST({c} AS DOUBLE)), 2) AS mean,
  round((SELECT x FROM (SELECT CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {c}) AS i FROM lineitem)
         WHERE i = (SELECT count(*) // 2 + 1 FROM lineitem)), 2) AS median,
  round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max,
  round(stddev_pop(CAST({c} AS DOUBLE)), 2) AS std FROM lineitem"""))
def describe_population(spark, folder):
    return profile.describe_population(table(spark, folder, "lineitem"))


@query("histogram", per_column(["event_id", "user_id", "value"], """
SELECT '{c}' AS "column", b AS bin, round(lo + b * ((hi - lo) / 10), 4) AS low, round(lo + (b + 1) * ((hi - lo) / 10), 4) AS high,
  (SELECT count(*) FROM events WHERE least(CAST(floor((CAST({c} AS DOUBLE) - lo) * 10 / (hi - lo)) AS BIGINT), 9) = b) AS "count"
FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM events), (SELECT range AS b FROM range(10))"""))
def histogram(spark, folder):
    return profile.histogram(table(spark, folder, "events"))


_ENDLESS = ["total", "mostly", "twice"]


@query("histogram_inf", f"WITH {ENDLESS_ORDERS} " + per_column(_ENDLESS, """
SELECT '{c}' AS "column", b AS bin, round(lo + b * ((hi - lo) / 10), 4) AS low, round(lo + (b + 1) * ((hi - lo) / 10), 4) AS high,
  (SELECT count(*) FROM endless_orders WHERE isfinite({c}) AND least(CAST(floor(({c} - lo) * 10 / (hi - lo)) AS BIGINT), 9) = b) AS "count"
FROM (SELECT min({c}) FILTER (isfinite({c})) AS lo, max({c}) FILTER (isfinite({c})) AS hi FROM endless_orders), (SELECT range AS b FROM range(10))
UNION ALL SELECT '{c}', CASE WHEN {c} > 0 THEN 10 ELSE -1 END, {c}, {c}, count(*) FROM endless_orders WHERE isinf({c}) GROUP BY {c}"""))
def histogram_inf(spark, folder):
    return profile.histogram(endless_orders(spark, folder), _ENDLESS)


@query("describe_inf", f"WITH {ENDLESS_ORDERS} " + per_column(_ENDLESS, """
SELECT '{c}' AS "column", count({c}) AS "count", round(quantile_cont({c}, 0.5), 4) AS median, min({c}) AS min, max({c}) AS max,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75,
  CASE WHEN count(*) FILTER (isinf({c})) = 0 THEN round(sum({c}) FILTER (isfinite({c})) / count({c}), 2) END AS finite_mean FROM endless_orders"""))
def describe_inf(spark, folder):
    got = profile.describe_numeric(endless_orders(spark, folder), _ENDLESS)
    mean = F.when(F.abs("mean") < float("inf"), F.round("mean", 2))
    return got.select("column", "count", "median", "min", "max", "q25", "q75", F.nanvl(mean, F.lit(None).cast("double")).alias("finite_mean"))


_LONG_TEXT = "SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS val FROM {t} WHERE {c} IS NOT NULL"
_DIRTY_TEXT = ["name", "balance_text", "segment", "email", "empty_col"]


@query("top_category", f"""
WITH {DIRTY_CUSTOMER}, cells AS ({per_column(_DIRTY_TEXT, _LONG_TEXT.replace('{t}', 'dirty_customer'))}),
counted AS (SELECT col, val, count(*) AS n FROM cells GROUP BY col, val),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rn, count(*) OVER (PARTITION BY col) AS u,
  sum(n) OVER (PARTITION BY col) AS filled FROM counted)
SELECT col AS "column", u AS unique_count, val AS top_category, n AS top_frequency, round(n * 100.0 / filled, 1) AS dominance_pct
FROM ranked WHERE rn = 1""")
def top_category(spark, folder):
    return profile.top_category(dirty_customer(spark, folder))


@query("top_values", f"""
WITH cells AS ({per_column(["p_name", "p_brand", "p_type"], _LONG_TEXT.replace('{t}', 'part'))}),
counted AS (SELECT col, val, count(*) AS n FROM cells GROUP BY col, val)
SELECT col AS "column", rn AS rank, val AS value, n AS "count"
FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rn FROM counted) WHERE rn <= 10""")
def top_values(spark, folder):
    return profile.top_values(table(spark, folder, "part"))


@query("string_lengths", per_column(["text", "lang", "source"], """
SELECT '{c}' AS "column", round(avg(length({c})), 2) AS avg_string_length, max(length({c})) AS max_string_length FROM documents"""))
def string_lengths(spark, folder):
    return profile.string_lengths(table(spark, folder, "documents"))


@query("segment_stats", """
SELECT o_orderpriority AS segment, count(o_totalprice) AS "count", round(avg(o_totalprice), 4) AS mean,
  round(median(o_totalprice), 4) AS median FROM orders GROUP BY o_orderpriority""")
def segment_stats(spark, folder):
    return profile.segment_stats(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")


@query("segment_compare", """
SELECT o_orderpriority AS segment, count(o_totalprice) AS "count", round(avg(o_totalprice), 4) AS mean,
  round(median(o_totalprice), 4) AS median,
  round((round(avg(o_totalprice), 6) - (SELECT avg(o_totalprice) FROM orders)) / (SELECT abs(avg(o_totalprice)) FROM orders) * 100, 2)
    AS vs_overall_pct FROM orders GROUP BY o_orderpriority""")
def segment_compare(spark, folder):
    return profile.segment_compare(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")


@query("group_means", """
SELECT o_orderstatus AS segment, round(avg(o_totalprice), 2) AS mean, count(o_totalprice) AS "count"
FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus LIMIT 5""")
def group_means(spark, folder):
    return profile.small_group_means(table(spark, folder, "orders"), "o_orderstatus", "o_totalprice")


def _profile_sql():
    numeric = ["o_orderkey", "o_custkey", "o_totalprice"]
    texts = ["o_orderstatus", "o_orderpriority"]
    number = """
SELECT '{c}' AS "column", count(*) AS total_count, count(*) - count(x) AS null_count,
  round((count(*) - count(x)) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT x) AS distinct_count, 'numeric' AS type,
  min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(any_value(q2), 4) AS median,
  round(any_value(q1), 4) AS q25, round(any_value(q3), 4) AS q75, round(any_value(q3 - q1), 4) AS iqr,
  count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count,
  CAST(NULL AS DOUBLE) AS avg_string_length, CAST(NULL AS BIGINT) AS max_string_length, CAST(NULL AS VARCHAR) AS top_values
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM sparse_orders),
  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2,
     quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM sparse_orders)"""
    other = """
SELECT '{c}' AS "column", count(*) AS total_count, count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS distinct_count, 'categorical' AS type,
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, """
    text = other + """round(avg(length({c})), 2), max(length({c})), (SELECT CAST(to_json(list({'value': v, 'count': n} ORDER BY n DESC, v)) AS VARCHAR)
  FROM (SELECT {c} AS v, count(*) AS n FROM sparse_orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 10)) FROM sparse_orders"""
    plain = other + "NULL, NULL, NULL FROM sparse_orders"
    return f"WITH {SPARSE_ORDERS} " + "\nUNION ALL\n".join([
        per_column(numeric, number), per_column(texts, text), per_column(["o_orderdate"], plain),
    ])


@query("profile_table", _profile_sql())
def profile_table(spark, folder):
    return profile.profile_table(sparse_orders(spark, folder))


@query("outliers_zscore", """
SELECT event_id, value, round((value - m) / s, 6) AS zscore FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
WHERE abs((value - m) / s) > 3""")
def outliers_zscore(spark, folder):
    got = clean.zscore_outliers(table(spark, folder, "events"), "value")
    return got.select("event_id", "value", F.round("zscore", 6).alias("zscore"))
