"""Previews, searches, sorting, pages and row positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.operators import view
from gleanframe.registry.base import query, table

# written out once more, so that a wrong word in the library shows
# fixed values: prompt fragments that are off topic
OFF_TOPIC_KEYWORDS = (
    "joke", "weather", "poem", "recipe", "song", "who is the president", "capital of", "movie",
    "sports", "football", "cricket", "translate to french", "translate to spanish", "who are you",
    "write code for flappy bird", "minecraft", "play game",
)
EVENTS = "event_id, ts, user_id, event_type, value, props"


@query("preview", """
SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, user_id, event_type, value, props FROM events ORDER BY ts, event_id LIMIT 50""")
def preview(spark, folder):
    return view.preview(table(spark, folder, "events"), ["ts", "event_id"])


@query("preview_size", "SELECT count(*) AS total_rows, count(*) > 50 AS sampled FROM events")
def preview_size(spark, folder):
    return view.preview_size(table(spark, folder, "events"))


@query("search_rows", " OR ".join([
    "SELECT * FROM customer WHERE contains(lower(CAST(c_custkey AS VARCHAR)), '77')",
    *[f"contains(lower(CAST({c} AS VARCHAR)), '77')" for c in ("c_name", "c_nationkey", "c_mktsegment")],
    r"contains(regexp_replace(CAST(c_acctbal AS VARCHAR), '\.0$', ''), '77')",
]))
def search_rows(spark, folder):
    return view.search_rows(table(spark, folder, "customer"), "77")


@query("search_digits", """
SELECT * FROM (SELECT c_custkey, c_custkey / 7.0::DOUBLE AS part, c_custkey * 1e9 AS large FROM customer)
WHERE contains(CAST(c_custkey AS VARCHAR), '428571') OR contains(CAST(part AS VARCHAR), '428571') OR contains(CAST(c_custkey AS VARCHAR) || '000000000', '428571')""")
def search_digits(spark, folder):
    """A term that only shows beyond the tenth digit of many numbers."""
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select("c_custkey", (k / F.lit(7.0)).alias("part"), (k * F.lit(1e9)).alias("large"))
    return view.search_rows(rows, "428571")


@query("sort_rows", "SELECT * FROM part ORDER BY lower(p_name) DESC NULLS LAST, p_partkey LIMIT 100")
def sort_rows(spark, folder):
    return view.sort_rows(table(spark, folder, "part"), "p_name", ascending=False, ties=["p_partkey"], limit=100)


@query("paginate", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def paginate(spark, folder):
    return view.paginate(table(spark, folder, "orders"), ["o_orderkey"], page=3)


@query("page_after", "SELECT * FROM orders WHERE o_orderkey > 59 ORDER BY o_orderkey LIMIT 20")
def page_after(spark, folder):
    return view.page_after(table(spark, folder, "orders"), "o_orderkey", 59)


@query("page_count", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS total_pages FROM orders")
def page_count(spark, folder):
    return view.page_count(table(spark, folder, "orders"))


@query("row_index", f"SELECT {EVENTS}, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events")
def row_index(spark, folder):
    return view.row_index(table(spark, folder, "events"), ["ts", "event_id"])


@query("select_rows", f"""
SELECT {EVENTS} FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i IN (0, 7, 499, 900)""")
def select_rows(spark, folder):
    return view.select_rows(table(spark, folder, "events"), ["ts", "event_id"], [0, 7, 499, 900])


@query("search_entities", "SELECT * FROM supplier WHERE contains(lower(s_name), '#00000001')")
def search_entities(spark, folder):
    return view.search_entities(table(spark, folder, "supplier"), ["s_name"], " #00000001 ")


@query("active_entities", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'""")
def active_entities(spark, folder):
    rows = table(spark, folder, "orders").withColumn(
        "deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    )
    got = view.active_entities(rows, deleted="deleted_at", where={"o_orderpriority": "1-URGENT", "o_orderstatus": "ALL"})
    return got.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("audit_log_page", f"SELECT {EVENTS} FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def audit_log_page(spark, folder):
    return view.audit_log_page(table(spark, folder, "events"), "ts", "event_id", ("event_type", "error"), page=2)


@query("flag_off_topic", "SELECT conv_id, turn, " + " OR ".join(
    f"contains(lower(text), '{k}')" for k in OFF_TOPIC_KEYWORDS) + " AS off_topic FROM conversations")
def flag_off_topic(spark, folder):
    return view.flag_off_topic(table(spark, folder, "conversations"), "text").select("conv_id", "turn", "off_topic")
