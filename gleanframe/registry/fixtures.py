"""Derived tables with the faults the clean test tables lack, in Spark and in SQL.

They keep every row of their source and add faults by integer arithmetic on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanframe.registry.base import table

DIRTY_COLUMNS = ["id", "name", "balance_text", "age", "segment", "email", "empty_col"]


def _copies(key: Column) -> Column:
    """Every fiftieth row twice, in the one scan of all rows."""
    return F.explode(F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")


def dirty_customer(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with padding, null tokens, currency text, odd ages, copies and empty rows."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    rows = table(spark, folder, "customer").select(
        _copies(k), k.alias("id"),
        F.when(k % 11 == 0, "N/A").when(k % 7 == 0, F.concat(F.lit("  "), "c_name", F.lit(" ")))
        .otherwise(F.col("c_name")).alias("name"),
        F.when(k % 13 == 0, "null").when(k % 19 == 0, "abc")
        .otherwise(F.concat(F.lit("$"), F.floor("c_acctbal").cast("string"))).alias("balance_text"),
        F.when(k % 17 == 0, None).otherwise((k % 140 - 5).cast("double")).alias("age"),
        F.when(k % 23 == 0, None).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")).alias("email"),
        none.alias("empty_col"),
    ).drop("copy")
    empty = spark.range(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionAll(empty)


DIRTY_CUSTOMER = """
dirty_rows AS (
  SELECT c_custkey AS id,
    CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' ELSE c_name END AS name,
    CASE WHEN c_custkey % 13 = 0 THEN 'null' WHEN c_custkey % 19 = 0 THEN 'abc'
         ELSE '$' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS balance_text,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 140 - 5 AS DOUBLE) END AS age,
    CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS segment,
    'u' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
    CAST(NULL AS VARCHAR) AS empty_col
  FROM customer
), dirty_customer AS (
  SELECT * FROM dirty_rows
  UNION ALL SELECT * FROM dirty_rows WHERE id % 50 = 0
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM range(3)
)"""


def sparse_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with missing totals and customers."""
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(k % 15 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        F.when(k % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate", "o_orderpriority",
    )


SPARSE_ORDERS = """
sparse_orders AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 15 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders
)"""


def sparse_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with three days without any."""
    return table(spark, folder, "events").where(~F.dayofmonth("ts").isin(5, 6, 20))


SPARSE_EVENTS = """
sparse_events AS (SELECT * FROM events WHERE day(ts) NOT IN (5, 6, 20))"""


def typed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a code, a date text that hardly repeats, and a flag."""
    stamp = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("order_code"),
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("stamp_text"),
        (F.col("o_orderkey") % 2 == 0).alias("is_even"),
        F.concat(
            F.lit("+1 555 "), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
        ).alias("contact"),
    )


TYPED_ORDERS = """
typed_orders AS (
  SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority,
    'O-' || CAST(o_orderkey AS VARCHAR) AS order_code,
    strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS stamp_text,
    o_orderkey % 2 = 0 AS is_even,
    '+1 555 ' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS contact
  FROM orders
)"""


REPORT_NUMBERS = ["spend", "o_orderkey", "tax", "bonus"]
REPORT_TEXTS = ["tier", "priority"]


def report_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a driven column, outliers, a dominant category, gaps and copies."""
    k = F.col("o_orderkey")
    spend = F.col("o_totalprice") * (1 + (k % 10) * 0.1)
    return table(spark, folder, "orders").select(
        _copies(k), F.when(k % 11 != 0, spend).alias("spend"), "o_orderkey",
        (spend * 0.25 + k % 7).alias("tax"),
        F.when(k % 20 == 0, F.lit(5000.0)).otherwise((k % 40).cast("double")).alias("bonus"),
        F.when(k % 10 < 8, "standard").otherwise(F.concat(F.lit("top "), "o_orderstatus")).alias("tier"),
        F.col("o_orderpriority").alias("priority"),
    ).drop("copy")


REPORT_ORDERS = """
report_rows AS (
  SELECT CASE WHEN o_orderkey % 11 <> 0 THEN s END AS spend, o_orderkey, s * CAST(0.25 AS DOUBLE) + o_orderkey % 7 AS tax,
    CASE WHEN o_orderkey % 20 = 0 THEN 5000.0::DOUBLE ELSE CAST(o_orderkey % 40 AS DOUBLE) END AS bonus,
    CASE WHEN o_orderkey % 10 < 8 THEN 'standard' ELSE 'top ' || o_orderstatus END AS tier, o_orderpriority AS priority
  FROM (SELECT *, o_totalprice * (1 + (o_orderkey % 10) * CAST(0.1 AS DOUBLE)) AS s FROM orders)
), report_orders AS (SELECT * FROM report_rows UNION ALL SELECT * FROM report_rows WHERE o_orderkey % 50 = 0)"""


def endless_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with infinite totals in both directions and a column whose middle is infinite."""
    k = F.col("o_orderkey")
    inf, low = F.lit(float("inf")), F.lit(float("-inf"))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.when(k % 100 == 0, inf).when(k % 100 == 1, low).otherwise(F.col("o_totalprice")).alias("total"),
        F.when(k % 3 != 0, inf).otherwise(k.cast("double")).alias("mostly"), (F.col("o_totalprice") * 2 + k % 5).alias("twice"),
        F.col("o_orderpriority").alias("priority"),
    )


ENDLESS_ORDERS = """
endless_orders AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 100 = 1 THEN '-Infinity'::DOUBLE
      ELSE o_totalprice END AS total,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Infinity'::DOUBLE ELSE CAST(o_orderkey AS DOUBLE) END AS mostly,
    o_totalprice * 2 + o_orderkey % 5 AS twice, o_orderpriority AS priority
  FROM orders)"""
