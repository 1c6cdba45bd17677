"""Findings, recommendations and whole reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.plans import analyses, report, summary
from gleanframe.registry.base import per_column, query, table
from gleanframe.registry.fixtures import REPORT_NUMBERS, REPORT_ORDERS, REPORT_TEXTS, endless_orders, report_orders
from gleanframe.registry.profile_queries import _describe_sql
from gleanframe.registry.relate_queries import _pairs
from gleanframe.registry.trend_queries import TREND_ANALYSIS, projection_sql

ALL = [*REPORT_NUMBERS, *REPORT_TEXTS]
_GAPS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in ALL)
_NUMBER = """
SELECT '{c}' AS col, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS lo, max(x) AS hi,
  count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM report_orders),
  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM report_orders)"""

_FACTS = f"""
WITH {REPORT_ORDERS}, counted AS (
  SELECT count(*) AS n, CAST(sum({_GAPS}) AS BIGINT) AS gaps, (SELECT count(*) FROM (SELECT DISTINCT * FROM report_orders)) AS d FROM report_orders),
quality AS (
  SELECT n AS total_rows, 6 AS total_columns, gaps AS null_cells, n * 6 - gaps AS valid_cells,
    round((n * 6 - gaps) * 100.0 / (n * 6), 2) AS completeness_pct, n - d AS duplicate_rows, round((n - d) * 100.0 / n, 2) AS duplicate_pct,
    round(greatest(0.0, round((n * 6 - gaps) * 100.0 / (n * 6), 2) - round((n - d) * 100.0 / n, 2) * 0.5), 1) AS quality_score FROM counted),
num AS ({per_column(REPORT_NUMBERS, _NUMBER)}),
texts AS ({per_column(REPORT_TEXTS, "SELECT '{c}' AS col, {c} AS val FROM report_orders WHERE {c} IS NOT NULL")}),
cat AS (
  SELECT * FROM (SELECT col, val, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rn, count(*) OVER (PARTITION BY col) AS u,
    round(n * 100.0 / sum(n) OVER (PARTITION BY col), 1) AS dom FROM (SELECT col, val, count(*) AS n FROM texts GROUP BY col, val)) WHERE rn = 1),
pairs AS ({_pairs(REPORT_NUMBERS, 'report_orders')}),
findings AS (
  SELECT * FROM (SELECT 'correlation' AS kind, col1 || ' ~ ' || col2 AS subject, round(r, 3) AS value, 'high' AS severity FROM pairs WHERE abs(r) >= 0.5
    ORDER BY abs(round(r, 3)) DESC, col1, col2 LIMIT 1)
  UNION ALL SELECT 'outliers', col, round(outliers * 100.0 / n, 1), 'medium' FROM num WHERE round(outliers * 100.0 / n, 1) > 2.5
  UNION ALL SELECT 'outlier_total', 'table', t, 'medium' FROM (SELECT CAST(sum(outliers) AS DOUBLE) AS t FROM num) WHERE t > 0
  UNION ALL SELECT 'dominance', col, dom, 'medium' FROM cat WHERE dom >= 70.0
  UNION ALL SELECT 'completeness', 'table', completeness_pct, 'info' FROM quality
  UNION ALL SELECT 'duplicates', 'table', duplicate_rows, 'high' FROM quality WHERE duplicate_rows > 0
  UNION ALL SELECT 'nulls', 'table', null_cells, 'medium' FROM quality WHERE null_cells > 0)"""


@query("findings", _FACTS + " SELECT kind, subject, CAST(value AS DOUBLE) AS value, severity FROM findings")
def findings(spark, folder):
    return report.findings(report_orders(spark, folder)).select("kind", "subject", "value", "severity")


def _cohort(category):
    return f"""
SELECT 'cohort_{category}_spend' AS id, count(*) AS segments, round((max(m) - min(m)) / greatest(abs(min(m)), 0.000001) * 100, 1) AS gap
FROM (SELECT {category}, count(spend) AS k, avg(spend) AS m FROM report_orders WHERE {category} IS NOT NULL GROUP BY {category})
WHERE k >= greatest(3, CAST(floor((SELECT count(*) FROM report_orders) * 0.03) AS BIGINT)) HAVING count(*) >= 2"""


# r² of 0.4 or more over this many rows always has p below 0.05, so no p-value is needed
_ADVICE = f""", {projection_sql(REPORT_NUMBERS, 'report_orders', 'o_orderkey')},
strongest AS (SELECT col1, col2, round(r, 3) AS r FROM pairs WHERE abs(r) >= 0.45 ORDER BY abs(round(r, 3)) DESC, col1, col2 LIMIT 4),
cohorts AS ({_cohort('tier')} UNION ALL {_cohort('priority')}),
advice AS (
  SELECT * FROM (SELECT 'trend_' || "column" AS id, 'trend' AS kind,
    CASE WHEN r_squared >= 0.35 THEN 'high' WHEN r_squared >= 0.1 THEN 'medium' ELSE 'low' END AS priority,
    CASE WHEN abs(pct_change) > 0.5 THEN least(45.0, round(abs(pct_change), 1)) ELSE round(r_squared * 30, 1) END AS impact_pct,
    CASE WHEN r_squared >= 0.4 THEN 'high' WHEN r_squared >= 0.15 THEN 'medium' ELSE 'low' END AS confidence
    FROM numbers ORDER BY r_squared DESC, "column" LIMIT 5)
  UNION ALL SELECT 'corr_' || col1 || '_' || col2, 'driver', CASE WHEN abs(r) >= 0.7 THEN 'high' ELSE 'medium' END,
    least(40.0, round(abs(r) * 35, 1)), CASE WHEN abs(r) >= 0.75 THEN 'high' ELSE 'medium' END FROM strongest
  UNION ALL SELECT id, 'cohort', CASE WHEN gap > 30 THEN 'high' ELSE 'medium' END, least(35.0, round(gap * 0.5, 1)),
    CASE WHEN segments >= 3 THEN 'high' ELSE 'medium' END FROM cohorts WHERE gap > 15)"""


@query("recommendations", _FACTS + _ADVICE + " SELECT id, kind, priority, CAST(impact_pct AS DOUBLE) AS impact_pct, confidence FROM advice")
def recommendations(spark, folder):
    got = report.recommendations(report_orders(spark, folder), ["o_orderkey"])
    return got.select("id", "kind", "priority", "impact_pct", "confidence")


_OVERVIEW = " UNION ALL ".join(
    f"SELECT 'overview' AS section, 'table' AS subject, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM quality"
    for c in ("total_rows", "total_columns", "null_cells", "valid_cells", "completeness_pct", "duplicate_rows", "duplicate_pct", "quality_score")
)
_FEATURES = " UNION ALL ".join(
    [f"SELECT 'feature', col, '{m}', {e} FROM num" for m, e in {
        "mean": "round(round(mean, 4), 2)", "std": "round(round(std, 4), 2)", "min": "round(lo, 2)", "max": "round(hi, 2)",
        "outliers_count": "outliers"}.items()]
    + [f"SELECT 'feature', col, '{m}', {e} FROM cat" for m, e in {
        "unique_count": "u", "top_frequency": "n", "dominance_pct": "dom"}.items()]
)
_REPORT = f"""
SELECT section, subject, metric, CAST(value AS DOUBLE) AS value FROM ({_OVERVIEW} UNION ALL {_FEATURES}
  UNION ALL SELECT 'finding', subject, kind, value FROM findings
  UNION ALL SELECT 'recommendation', id, kind, impact_pct FROM advice)"""


@query("table_report", _FACTS + _ADVICE + _REPORT)
def table_report(spark, folder):
    return report.table_report(report_orders(spark, folder), ["o_orderkey"])


@query("kpi_cards", _FACTS + """
SELECT card, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'total_rows' AS card, CAST(total_rows AS DOUBLE) AS value FROM quality UNION ALL SELECT 'total_columns', total_columns FROM quality
  UNION ALL SELECT 'completeness_pct', completeness_pct FROM quality UNION ALL SELECT 'quality_score', quality_score FROM quality
  UNION ALL SELECT 'outliers', sum(outliers) FROM num
  UNION ALL SELECT 'bar_' || col, round(least(100, greatest(8, abs(round(mean, 2)) / (SELECT greatest(max(abs(round(mean, 2))), 1) FROM num) * 100)), 2) FROM num)""")
def kpi_cards(spark, folder):
    return report.kpi_cards(report_orders(spark, folder))


@query("safe_summary")
def safe_summary(spark, folder):
    return summary.safe_summary(report_orders(spark, folder), "orders", ["o_orderkey"])


@query("summary_groups", f"""
WITH {REPORT_ORDERS} SELECT tier AS segment, round(avg(spend), 2) AS mean, count(spend) AS "count" FROM report_orders GROUP BY tier ORDER BY tier LIMIT 5""")
def summary_groups(spark, folder):
    return summary.summary_parts(report_orders(spark, folder), ["o_orderkey"])["groups"]()


@query("summary_correlations", f"""
WITH {REPORT_ORDERS}, pairs AS ({_pairs(REPORT_NUMBERS, 'report_orders')})
SELECT col1, col2, round(r, 3) AS value FROM pairs WHERE r IS NOT NULL ORDER BY abs(round(r, 3)) DESC, col1, col2 LIMIT 10""")
def summary_correlations(spark, folder):
    return summary.summary_parts(report_orders(spark, folder), ["o_orderkey"])["correlations"]()


_AMOUNTS = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("summary_categories", f"WITH {REPORT_ORDERS} " + per_column(REPORT_TEXTS, """
SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count, count(*) - count({c}) AS null_count FROM report_orders"""))
def summary_categories(spark, folder):
    return summary.summary_parts(report_orders(spark, folder), ["o_orderkey"])["categories"]()


@query("summary_nulls", f"""
WITH {REPORT_ORDERS} SELECT CAST(sum({" + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in REPORT_NUMBERS + REPORT_TEXTS)}) AS BIGINT)
  AS total_nulls FROM report_orders""")
def summary_nulls(spark, folder):
    document = summary.safe_summary(report_orders(spark, folder), "orders", ["o_orderkey"])
    return document.select(F.get_json_object("document", "$.total_nulls").cast("bigint").alias("total_nulls"))


@query("run_analysis_correlation", f"""
WITH all_pairs AS ({_pairs(_AMOUNTS, "orders")}), mirrored AS (
  SELECT col1, col2, r FROM all_pairs UNION ALL SELECT col2, col1, r FROM all_pairs
  UNION ALL SELECT c, c, 1.0 FROM (VALUES {", ".join(f"('{c}')" for c in _AMOUNTS)}) AS t(c)),
top AS (SELECT col1, col2, round(r, 4) AS value FROM all_pairs WHERE r IS NOT NULL ORDER BY abs(round(r, 4)) DESC, col1, col2 LIMIT 15)
SELECT 'matrix' AS section, col1, col2, round(CAST(r AS DOUBLE), 4) AS value, abs(round(CAST(r AS DOUBLE), 4)) AS abs_value,
  CAST(NULL AS VARCHAR) AS strength FROM mirrored
UNION ALL SELECT 'top', col1, col2, value, abs(value), CASE WHEN abs(value) >= 0.7 THEN 'strong' WHEN abs(value) >= 0.4 THEN 'moderate'
  ELSE 'weak' END FROM top""")
def run_analysis_correlation(spark, folder):
    return analyses.run_analysis(table(spark, folder, "orders"), "correlation", {"method": "pearson"})


@query("run_analysis_default", _describe_sql(_AMOUNTS, "orders"))
def run_analysis_default(spark, folder):
    return analyses.run_analysis(table(spark, folder, "orders"), "unknown")


@query("run_analysis_segment", """
SELECT l_returnflag AS segment, count(l_quantity) AS "count", round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median,
  round((round(avg(l_quantity), 6) - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT abs(avg(l_quantity)) FROM lineitem) * 100, 2)
    AS vs_overall_pct FROM lineitem GROUP BY l_returnflag""")
def run_analysis_segment(spark, folder):
    params = {"category_column": "l_returnflag", "metric_column": "l_quantity"}
    return analyses.run_analysis(table(spark, folder, "lineitem"), "segment_compare", params)


@query("run_analysis_trend", TREND_ANALYSIS)
def run_analysis_trend(spark, folder):
    params = {"time_column": "ts", "metric_column": "value"}
    return analyses.run_analysis(table(spark, folder, "events"), "trend", params)


@query("report_inf")
def report_inf(spark, folder):
    """The whole report of a table with infinite cells."""
    return report.table_report(endless_orders(spark, folder), ["o_orderkey"])
