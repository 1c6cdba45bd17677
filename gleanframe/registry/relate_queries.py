"""Correlations, drivers and cohorts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gleanframe.operators import relate
from gleanframe.registry.base import LINEITEM_NUMBERS, per_column, query, table
from gleanframe.registry.fixtures import ENDLESS_ORDERS, SPARSE_ORDERS, endless_orders, sparse_orders

_R = "regr_sxy({y}, {x}) / nullif(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0)"


def _r(a, b):
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return _R.format(x=x, y=y)


def _pairs(columns, source, digits=None):
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, {_r(a, b)} AS r FROM {source}" for a, b in combinations(columns, 2)
    )


def _matrix(columns, source, pairs):
    diagonal = per_column(
        columns, f"SELECT '{{c}}' AS col1, '{{c}}' AS col2, CASE WHEN min({{c}}) < max({{c}}) THEN 1.0 END AS r FROM {source}"
    )
    return f"""
pairs AS ({pairs}), matrix AS (
  SELECT * FROM pairs UNION ALL SELECT col2, col1, r FROM pairs UNION ALL {diagonal})
SELECT col1, col2, round(CAST(r AS DOUBLE), 4) AS r FROM matrix"""


@query("corr_pearson", "WITH" + _matrix(LINEITEM_NUMBERS, "lineitem", _pairs(LINEITEM_NUMBERS, "lineitem")))
def corr_pearson(spark, folder):
    return relate.correlation_matrix(table(spark, folder, "lineitem"))


_SPARSE = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("corr_pearson_nulls", f"WITH {SPARSE_ORDERS}," + _matrix(_SPARSE, "sparse_orders", _pairs(_SPARSE, "sparse_orders")))
def corr_pearson_nulls(spark, folder):
    return relate.correlation_matrix(sparse_orders(spark, folder))


_ENDLESS = ["o_orderkey", "total", "mostly", "twice"]
_ONLY_FINITE = "finite_orders AS (SELECT " + ", ".join(
    f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN {c} END AS {c}" for c in _ENDLESS) + " FROM endless_orders)"


@query("corr_pearson_inf", f"WITH {ENDLESS_ORDERS}, {_ONLY_FINITE}," + _matrix(_ENDLESS, "finite_orders", _pairs(_ENDLESS, "finite_orders")))
def corr_pearson_inf(spark, folder):
    """Infinite cells count as missing."""
    return relate.correlation_matrix(endless_orders(spark, folder))


def _spearman(columns, source):
    def one(a, b):
        def rank(c):
            return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
        return (
            f"SELECT '{a}' AS col1, '{b}' AS col2, {_r('ra', 'rb')} AS r FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb "
            f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        )
    return "\nUNION ALL\n".join(one(a, b) for a, b in combinations(columns, 2))


_PRICED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_spearman", "WITH" + _matrix(_PRICED, "lineitem", _spearman(_PRICED, "lineitem")))
def corr_spearman(spark, folder):
    return relate.correlation_matrix(table(spark, folder, "lineitem"), _PRICED, "spearman")


@query("corr_spearman_nulls", f"WITH {SPARSE_ORDERS}," + _matrix(_SPARSE, "sparse_orders", _spearman(_SPARSE, "sparse_orders")))
def corr_spearman_nulls(spark, folder):
    return relate.correlation_matrix(sparse_orders(spark, folder), _SPARSE, "spearman")


@query("corr_spearman_inf", f"WITH {ENDLESS_ORDERS}, {_ONLY_FINITE}," + _matrix(_ENDLESS, "finite_orders", _spearman(_ENDLESS, "finite_orders")))
def corr_spearman_inf(spark, folder):
    return relate.correlation_matrix(endless_orders(spark, folder), _ENDLESS, "spearman")


@query("corr_kendall", """
WITH g AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY ALL),
p AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM g a, g b),
t AS (SELECT sum(n) AS n FROM g), tx AS (SELECT sum(n * (n - 1)) / 2 AS k FROM (SELECT sum(n) AS n FROM g GROUP BY x)),
ty AS (SELECT sum(n * (n - 1)) / 2 AS k FROM (SELECT sum(n) AS n FROM g GROUP BY y))
SELECT 'l_quantity' AS col1, 'l_discount' AS col2,
  round(CAST(p.s / sqrt((t.n * (t.n - 1) / 2 - tx.k) * (t.n * (t.n - 1) / 2 - ty.k)) AS DOUBLE), 6) AS r FROM p, t, tx, ty""")
def corr_kendall(spark, folder):
    got = relate.kendall(table(spark, folder, "lineitem"), "l_quantity", "l_discount")
    return got.select("col1", "col2", F.round("r", 6).alias("r"))


_STRENGTH = "CASE WHEN abs(value) >= 0.7 THEN 'strong' WHEN abs(value) >= 0.4 THEN 'moderate' ELSE 'weak' END"


@query("top_correlations", f"""
WITH pairs AS ({_pairs(LINEITEM_NUMBERS, 'lineitem')}), v AS (SELECT col1, col2, round(r, 4) AS value FROM pairs WHERE r IS NOT NULL)
SELECT col1, col2, value, abs(value) AS abs_value, {_STRENGTH} AS strength FROM v ORDER BY abs(value) DESC, col1, col2 LIMIT 15""")
def top_correlations(spark, folder):
    return relate.ranked_pairs(table(spark, folder, "lineitem"))


def _related_lines(spark, folder):
    """Line items with derived amounts, so that some columns really depend on each other."""
    li = table(spark, folder, "lineitem")
    return li.select(
        "l_quantity", (F.col("l_quantity") * 3 + F.col("l_linenumber")).alias("weight"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), "l_extendedprice",
        (F.lit(100) - F.col("l_linenumber") * 7 - F.col("l_quantity") * 0.1).alias("margin"),
    )


_RELATED = """
related AS (SELECT l_quantity, l_quantity * 3 + l_linenumber AS weight, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice,
  100 - l_linenumber * 7 - l_quantity * CAST(0.1 AS DOUBLE) AS margin FROM lineitem)"""
_RELATED_COLUMNS = ["l_quantity", "weight", "revenue", "l_extendedprice", "margin"]


@query("corr_threshold", f"""
WITH {_RELATED}, pairs AS ({_pairs(_RELATED_COLUMNS, 'related')}), v AS (SELECT col1, col2, round(r, 3) AS value FROM pairs WHERE abs(r) >= 0.5)
SELECT col1, col2, value, abs(value) AS abs_value, {_STRENGTH} AS strength FROM v""")
def corr_threshold(spark, folder):
    return relate.ranked_pairs(_related_lines(spark, folder), at_least=0.5, top=None, digits=3)


def _driver(a, b):
    return f"""
SELECT '{a}' AS col1, '{b}' AS col2, {_r(a, b)} AS r, regr_slope({b}, {a}) AS slope, regr_intercept({b}, {a}) AS intercept, avg({a}) AS m1,
  avg({b}) AS m2, stddev_samp({a}) AS s1, stddev_samp({b}) AS s2 FROM related"""


DRIVERS = f"""
WITH {_RELATED}, fits AS ({" UNION ALL ".join(_driver(a, b) for a, b in combinations(_RELATED_COLUMNS, 2))}),
base AS (SELECT col1, col2, round(r, 3) AS r, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(m1, 2) AS mean1,
  round(m2, 2) AS mean2, round(s1, 2) AS std1, round(s2, 2) AS std2 FROM fits WHERE abs(r) >= 0.45 ORDER BY abs(round(r, 3)) DESC, col1, col2 LIMIT 4),
sim AS (SELECT *, round(mean1 * CAST(1.10 AS DOUBLE), 2) AS scenario FROM base),
pred AS (SELECT *, round(intercept + slope * scenario, 2) AS predicted FROM sim)
SELECT col1, col2, r, round(r * r, 3) AS r_squared, slope, intercept, mean1, mean2, std1, std2, scenario, predicted,
  round((predicted - mean2) / greatest(abs(mean2), 0.000000001) * 100, 1) AS delta_pct FROM pred"""


@query("driver_scenario", DRIVERS)
def driver_scenario(spark, folder):
    return relate.driver_scenario(_related_lines(spark, folder))


@query("cohort_uplift", """
WITH g AS (SELECT p_type AS segment, count(p_size) AS n, avg(CAST(p_size AS DOUBLE)) AS m FROM part GROUP BY p_type),
k AS (SELECT * FROM g WHERE n >= greatest(3, CAST(floor((SELECT count(*) FROM part) * 0.03) AS BIGINT))),
e AS (SELECT (SELECT segment FROM k ORDER BY m DESC, segment LIMIT 1) AS top_segment, max(m) AS t,
  (SELECT segment FROM k ORDER BY m, segment LIMIT 1) AS bottom_segment, min(m) AS b, count(*) AS segments FROM k)
SELECT 'p_type' AS category, 'p_size' AS metric, top_segment, round(t, 2) AS top_mean, bottom_segment, round(b, 2) AS bottom_mean,
  (SELECT round(avg(CAST(p_size AS DOUBLE)), 2) FROM part) AS overall_mean, segments,
  round((t - b) / greatest(abs(b), 0.000001) * 100, 1) AS gap_pct,
  CASE WHEN round((t - b) / greatest(abs(b), 0.000001) * 100, 1) > 30 THEN 'high' ELSE 'medium' END AS priority FROM e WHERE segments >= 2""")
def cohort_uplift(spark, folder):
    return relate.cohort_uplift(table(spark, folder, "part"), ["p_type"], "p_size", report_gap=None)
