"""Nearest neighbours: retrieval by cosine and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.operators.nearest import cosine_nearest, impute_knn
from gleanframe.registry.base import query, table


@query("embedding_top_k", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS c FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor((2 - 2 * c) * 1e9 + 0.5), vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(c, 6) AS cosine FROM ranked WHERE rank <= 10""")
def embedding_top_k(spark, folder):
    """The ten nearest of all vectors to every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings")
    got = cosine_nearest(vectors, 10, id="vec_id", vector="embedding", queries=vectors.where("vec_id % 20 = 0"))
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


@query("impute_knn", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS cust,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price FROM orders),
r AS (SELECT min(cust) AS lo1, max(cust) - min(cust) AS w1, min(day) AS lo2, max(day) - min(day) AS w2 FROM o WHERE cust IS NOT NULL AND day IS NOT NULL),
s AS (SELECT o_orderkey, price, (cust - lo1) / w1 AS a, (day - lo2) / w2 AS b FROM o, r WHERE cust IS NOT NULL AND day IS NOT NULL),
p AS (SELECT q.o_orderkey, d.price, row_number() OVER (PARTITION BY q.o_orderkey
    ORDER BY floor(((q.a - d.a) * (q.a - d.a) + (q.b - d.b) * (q.b - d.b)) * 1e9 + 0.5), d.o_orderkey) AS rank
  FROM s AS q JOIN s AS d ON q.price IS NULL AND d.price IS NOT NULL),
f AS (SELECT o_orderkey, avg(price) AS near FROM p WHERE rank <= 5 GROUP BY o_orderkey)
SELECT o_orderkey, cust, day, round(coalesce(price, near, (SELECT avg(price) FROM o)), 4) AS price FROM o LEFT JOIN f USING (o_orderkey)""")
def impute_knn_orders(spark, folder):
    """Order totals, one in eleven missing, from the five nearest orders by customer and day."""
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders").select(
        k, F.when(k % 97 != 0, F.col("o_custkey").cast("double")).alias("cust"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double").alias("day"),
        F.when(k % 11 != 0, F.col("o_totalprice")).alias("price"),
    )
    return impute_knn(orders, "price", ["cust", "day"], "o_orderkey").withColumn("price", F.round("price", 4))
