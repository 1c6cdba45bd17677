"""Ownership, versions, usage and conversations on stand-in tables.

User = customer, project = nation, dataset = order, version = line of an order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.operators import catalog, usage
from gleanframe.plans.rules import Rule
from gleanframe.plans.versions import Store
from gleanframe.registry.base import query, table
from gleanframe.registry.fixtures import DIRTY_CUSTOMER, dirty_customer
from gleanframe.session import scratch_path

# written out once more, so that a wrong character in the library shows
# fixed values: characters that count as white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


@query("ownership_chain", """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, o_orderpriority, c_name, n_name, r_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def ownership_chain(spark, folder):
    return catalog.ownership_chain([
        (table(spark, folder, "lineitem"), "", "l_orderkey"),
        (table(spark, folder, "orders"), "o_orderkey", "o_custkey"),
        (table(spark, folder, "customer"), "c_custkey", "c_nationkey"),
        (table(spark, folder, "nation"), "n_nationkey", "n_regionkey"),
        (table(spark, folder, "region"), "r_regionkey", None),
    ]).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "o_orderpriority", "c_name", "n_name", "r_name"
    )


@query("usage_by_user", """
WITH sizes AS (
  SELECT o_custkey, CAST(sum(CAST(l_quantity AS BIGINT) * 4096) AS BIGINT) AS bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey
), counted AS (
  SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS datasets,
    (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS reports,
    coalesce(bytes, 0) AS storage_bytes FROM customer LEFT JOIN sizes ON c_custkey = o_custkey
)
SELECT *, round(storage_bytes / 1048576.0, 2) AS storage_mb, round(storage_bytes / 1073741824.0, 4) AS storage_gb FROM counted""")
def usage_by_user(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    one = F.count(F.lit(1))
    sized = lines.select("l_orderkey", (F.col("l_quantity").cast("bigint") * 4096).alias("size"))
    owned = sized.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    got = catalog.count_children(table(spark, folder, "customer").select("c_custkey"), "c_custkey", {
        "datasets": (orders, "o_custkey", one),
        "reports": (orders.where(F.col("o_orderstatus") == "F"), "o_custkey", one),
        "storage_bytes": (owned, "o_custkey", F.sum("size")),
    })
    return got.select("*", *usage.storage_columns(F.col("storage_bytes")))


@query("entities_with_child", "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def entities_with_child(spark, folder):
    open_orders = table(spark, folder, "orders").where(F.col("o_orderstatus") == "P")
    return catalog.entities_with_child(table(spark, folder, "customer"), "c_custkey", open_orders, "o_custkey")


@query("conversation_threads", """
SELECT p.conv_id, p.turns, c.turn, c.role, c.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS position
FROM conversations c JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) p ON p.conv_id = c.conv_id""")
def conversation_threads(spark, folder):
    messages = table(spark, folder, "conversations")
    parents = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    children = messages.withColumnRenamed("conv_id", "thread_id")
    return catalog.threads(parents, "conv_id", children, "thread_id", ["turn"])


def _messages_as_versions(spark, folder):
    """Messages as versions of a conversation: each follows the one before it."""
    m = table(spark, folder, "conversations")
    return m.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("version_id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id"),
        "conv_id", F.col("turn").alias("version_number"), F.col("role").alias("stage"),
        F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_version"),
    )


@query("version_lineage", """
WITH RECURSIVE v AS (
  SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations
), walk AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth FROM v WHERE parent IS NULL OR parent NOT IN (SELECT id FROM v)
  UNION ALL SELECT v.id, w.root, w.depth + 1 FROM v JOIN walk w ON v.parent = w.id
)
SELECT id AS version_id, root, depth FROM walk""")
def version_lineage(spark, folder):
    return catalog.version_lineage(_messages_as_versions(spark, folder), "version_id", "parent_id")


@query("delete_version", """
SELECT conv_id, turn AS version_number, CASE WHEN turn > 0 AND NOT (turn - 1 = 1 AND n > 1) THEN turn - 1 END AS parent_version
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE NOT (turn = 1 AND n > 1)""")
def delete_version(spark, folder):
    rows = _messages_as_versions(spark, folder).select("conv_id", "version_number", "parent_version")
    return catalog.delete_version(rows, "conv_id", "version_number", "parent_version", 1)


@query("purge_cascade", """
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def purge_cascade(spark, folder):
    deleted = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return catalog.purge_cascade({"versions": (lines, "l_orderkey")}, deleted, "o_orderkey")["versions"]


@query("latest_per_key", """
SELECT conv_id, turn AS version_number, role AS stage, n AS versions FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
WHERE rn = 1""")
def latest_per_key(spark, folder):
    return catalog.latest_per_key(_messages_as_versions(spark, folder), "conv_id", "version_number", ["stage"])


@query("resolve_version", """
SELECT conv_id, turn AS version_number, role AS stage FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn = 2 DESC, turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def resolve_version(spark, folder):
    return catalog.resolve_versions(_messages_as_versions(spark, folder), "conv_id", "version_number", 2, ["stage"])


@query("version_append", f"""
WITH {DIRTY_CUSTOMER}, n AS (SELECT count(*) AS n FROM dirty_customer)
SELECT 'customers' AS dataset_id, v AS version_number, CASE WHEN v = 1 THEN 'raw' ELSE 'cleaned' END AS stage,
  CASE WHEN v = 1 THEN n ELSE (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) END AS row_count,
  CASE WHEN v = 2 THEN 1 END::BIGINT AS parent_version, true AS has_size,
  'id bigint, name string, balance_text string, age double, segment string, email string, empty_col string' AS columns
FROM n, (VALUES (1::BIGINT), (2)) AS t(v)""")
def version_append(spark, folder):
    """Raw customers become version 1, their cleaned form version 2 with version 1 as parent."""
    store = Store(spark, scratch_path(spark, "versions"))
    first = store.append(dirty_customer(spark, folder), "customers", "raw")
    store.clean("customers", [Rule("deduplicate")], version=first)
    return store.versions("customers").select(
        "dataset_id", "version_number", "stage", "row_count", "parent_version",
        ((F.col("byte_size") > 0) & F.col("created_at").isNotNull()).alias("has_size"), "columns",
    )


@query("token_usage", f"""
SELECT conv_id, count(*) AS messages, CAST(sum(CASE WHEN length(text) > 0 THEN greatest(100, CAST(floor(
  CASE WHEN bare = '' THEN 0 ELSE len(regexp_split_to_array(bare, '[{WHITE_SPACE}]+')) END * CAST(1.4 AS DOUBLE)) AS BIGINT)) ELSE 0 END) AS BIGINT) AS tokens
FROM (SELECT *, trim(text, '{WHITE_SPACE}') AS bare FROM conversations WHERE role = 'assistant') GROUP BY conv_id""")
def token_usage(spark, folder):
    return usage.token_usage(table(spark, folder, "conversations"), "conv_id")


def _usage_json(spark, folder):
    """Events with a usage record of each shape: a total, two parts, one part, a null total, none."""
    k = F.col("event_id")
    record = (
        F.when(k % 5 == 0, F.format_string('{"total_tokens": %d}', k))
        .when(k % 5 == 1, F.format_string('{"input_tokens": %d, "output_tokens": %d}', k, k % 7))
        .when(k % 5 == 2, F.format_string('{"output_tokens": %d}', k))
        .when(k % 5 == 3, F.lit('{"total_tokens": null}'))
    )
    return table(spark, folder, "events").select(
        "user_id", F.lit("assistant").alias("role"), F.col("props").alias("text"), record.alias("token_usage")
    )


@query("token_usage_records", """
SELECT user_id, count(*) AS messages, CAST(sum(CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id + event_id % 7 WHEN 2 THEN event_id
  WHEN 3 THEN 0 ELSE 100 END) AS BIGINT) AS tokens FROM events GROUP BY user_id""")
def token_usage_records(spark, folder):
    return usage.token_usage(_usage_json(spark, folder), "user_id", usage="token_usage")


@query("token_cost", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE round(event_id * 10 * CASE WHEN event_type = 'click' THEN 0.0000001::DOUBLE ELSE 0.000002::DOUBLE END
  + user_id * 10 * CASE WHEN event_type = 'click' THEN 0.0000004::DOUBLE ELSE 0.00001::DOUBLE END, 6) END AS cost FROM events""")
def token_cost(spark, folder):
    rows = table(spark, folder, "events").withColumn(
        "plan", F.when(F.col("event_type") == "click", "light").when(F.col("event_type") == "error", "unknown").otherwise("full")
    ).withColumn("tokens_in", F.col("event_id") * 10).withColumn("tokens_out", F.col("user_id") * 10)
    return usage.token_cost(rows, "tokens_in", "tokens_out", "plan").select("event_id", "cost")


@query("quota_status", """
WITH used AS (
  SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS tokens, CAST(sum(o_orderkey * 8192) AS BIGINT) AS bytes,
    count(*) FILTER (o_orderstatus = 'F') AS reports, count(*) AS datasets FROM orders GROUP BY o_custkey)
SELECT *, least(100.0, round(tokens * 100.0 / 200000, 1)) AS tokens_pct,
  least(100.0, round((bytes / 1073741824.0) * 100.0 / 2, 1)) AS storage_pct,
  least(100.0, round(reports * 100.0 / 50, 1)) AS reports_pct, least(100.0, round(datasets * 100.0 / 100, 1)) AS datasets_pct FROM used""")
def quota_status(spark, folder):
    k = F.col("o_orderkey")
    used = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.sum(k).alias("tokens"), F.sum(k * 8192).alias("bytes"),
        F.count_if(F.col("o_orderstatus") == "F").alias("reports"), F.count(F.lit(1)).alias("datasets"),
    )
    return usage.quota_status(used, "tokens", "bytes", "reports", "datasets")


@query("usage_summary", f"""
WITH live AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'),
spoken AS (SELECT conv_id, sum(CASE WHEN length(text) > 0 THEN greatest(100, CAST(floor(
    CASE WHEN bare = '' THEN 0 ELSE len(regexp_split_to_array(bare, '[{WHITE_SPACE}]+')) END * CAST(1.4 AS DOUBLE)) AS BIGINT)) ELSE 0 END) AS tokens
  FROM (SELECT *, trim(text, '{WHITE_SPACE}') AS bare FROM conversations WHERE role = 'assistant') GROUP BY conv_id),
used AS (SELECT c_custkey,
  (SELECT count(*) FROM live WHERE o_custkey = c_custkey) AS datasets_uploaded,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS projects_count,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW') AS reports_generated,
  CAST(coalesce((SELECT sum(CAST(l_quantity AS BIGINT) * 1048576) FROM lineitem JOIN live ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey), 0) AS BIGINT) AS storage_bytes,
  CAST(coalesce((SELECT sum(tokens) FROM spoken WHERE conv_id % 50 = c_custkey), 0) AS BIGINT) AS ai_tokens FROM customer)
SELECT *, least(100.0, round(ai_tokens * 100.0 / 200000, 1)) AS tokens_pct, least(100.0, round((storage_bytes / 1073741824.0) * 100.0 / 2, 1)) AS storage_pct,
  least(100.0, round(reports_generated * 100.0 / 50, 1)) AS reports_pct, least(100.0, round(datasets_uploaded * 100.0 / 100, 1)) AS datasets_pct,
  round(storage_bytes / 1048576.0, 2) AS storage_mb, round(storage_bytes / 1073741824.0, 4) AS storage_gb, TIMESTAMP '2024-05-19 23:59:59' AS resets_at FROM used""")
def usage_summary(spark, folder):
    """Orders as datasets, urgent ones as projects and low ones as reports, line items as versions."""
    orders, talks = table(spark, folder, "orders"), table(spark, folder, "conversations")
    day, none, status = F.col("o_orderdate"), F.lit(None).cast("string"), F.col("o_orderstatus")
    owner = F.col("o_custkey").alias("created_by")
    return usage.usage_summary(
        table(spark, folder, "customer"), "c_custkey", now=F.lit("2024-05-15 10:00:00").cast("timestamp_ntz"),
        datasets=orders.select(F.col("o_orderkey").alias("dataset_id"), owner, F.when(status == "P", day).alias("deleted_at")),
        versions=table(spark, folder, "lineitem").select(
            F.col("l_orderkey").alias("dataset_id"), (F.col("l_quantity").cast("bigint") * 1048576).alias("byte_size")
        ),
        projects=orders.where("o_orderpriority = '1-URGENT'").select(owner, F.when(status == "F", day).alias("archived_at")),
        conversations=talks.select(F.col("conv_id").alias("conversation_id"), (F.col("conv_id") % 50).alias("created_by")).distinct(),
        messages=talks.select(F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), none.alias("token_usage")),
        reports=orders.where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("generated_by")),
    )


@query("conversation_list", """
SELECT conv_id, (SELECT text FROM conversations u WHERE u.conv_id = c.conv_id AND role = 'user' ORDER BY turn LIMIT 1) AS first_user_message,
  substring((SELECT text FROM conversations u WHERE u.conv_id = c.conv_id ORDER BY turn DESC LIMIT 1), 1, 90) AS last_message_preview,
  count(*) AS message_count FROM conversations c GROUP BY conv_id ORDER BY conv_id DESC LIMIT 50""")
def conversation_list(spark, folder):
    return usage.conversation_list(table(spark, folder, "conversations"))


@query("quota_reset", """
SELECT event_id, CAST(CAST(ts - INTERVAL 1 HOUR AS DATE) + CAST(7 - dayofweek(ts - INTERVAL 1 HOUR) AS INTEGER) AS TIMESTAMP)
  + INTERVAL '23 hours 59 minutes 59 seconds' AS resets_at FROM events""")
def quota_reset(spark, folder):
    """When the quotas of each event's moment start anew."""
    now = F.col("ts").cast("timestamp_ntz")
    return table(spark, folder, "events").select("event_id", usage.next_reset(now).alias("resets_at"))
