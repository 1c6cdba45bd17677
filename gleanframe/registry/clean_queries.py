"""Cleaning, coercion, governance and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.operators import clean, scale, schema
from gleanframe.plans import rules
from gleanframe.plans.versions import Store
from gleanframe.registry.base import query, table
from gleanframe.registry.fixtures import (
    DIRTY_COLUMNS, DIRTY_CUSTOMER, TYPED_ORDERS, dirty_customer, typed_orders,
)
from gleanframe.session import scratch_path

# the rules' own words, written out once more so that a wrong one in the library shows
# fixed values: cell texts a CSV reader takes for missing; the empty text is no cell here
CSV_NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# fixed values: cell texts the trim rule turns into null
CLEAN_NULL_TOKENS = (
    "null", "None", "N/A", "n/a", "undefined", "nan", "NaN", "?", "#N/A", "-", "none",
)
# fixed values: characters that count as white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# fixed values: patterns for personal data, each for a whole cell
PII_PATTERNS = {
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "phone": r"^\+?[\d\s\-\(\)]{7,15}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "credit_card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
}
TEXTS = ["name", "balance_text", "segment", "email", "empty_col"]
MASK = "••••••••"
_NUM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _in(tokens):
    return ", ".join("'" + t + "'" for t in tokens)


def _strip(c):
    return f"trim({c}, '{WHITE_SPACE}')"


def _rewrite(new: dict[str, str], source="dirty_customer"):
    return "SELECT " + ", ".join(f"{new[c]} AS {c}" if c in new else c for c in DIRTY_COLUMNS) + f" FROM {source}"


def _dirty(body):
    return f"WITH {DIRTY_CUSTOMER} {body}"


@query("clean_trim", _dirty(_rewrite({c: _strip(c) for c in TEXTS})))
def clean_trim(spark, folder):
    return clean.trim_whitespace(dirty_customer(spark, folder))


_TRIMMED = {c: f"CASE WHEN {_strip(c)} NOT IN ({_in(CLEAN_NULL_TOKENS)}) THEN {_strip(c)} END" for c in TEXTS}


@query("clean_null_tokens", _dirty(_rewrite(_TRIMMED)))
def clean_null_tokens(spark, folder):
    return clean.trim_and_null_tokens(dirty_customer(spark, folder))


@query("null_token_scan", _dirty(_rewrite(
    {c: f"CASE WHEN {c} NOT IN ({_in(CSV_NULL_TOKENS)}) THEN {c} END" for c in TEXTS})))
def null_token_scan(spark, folder):
    return clean.read_null_tokens(dirty_customer(spark, folder))


_ANY = " OR ".join(f"{c} IS NOT NULL" for c in DIRTY_COLUMNS)


@query("clean_drop_empty_rows", _dirty(f"SELECT * FROM dirty_customer WHERE {_ANY}"))
def clean_drop_empty_rows(spark, folder):
    return clean.drop_empty_rows(dirty_customer(spark, folder))


@query("clean_drop_empty_cols", _dirty("SELECT id, name, balance_text, age, segment, email FROM dirty_customer"))
def clean_drop_empty_cols(spark, folder):
    return clean.drop_empty_columns(dirty_customer(spark, folder))


@query("clean_non_negative", _dirty(_rewrite({"age": "CASE WHEN age >= 0 THEN age END"})))
def clean_non_negative(spark, folder):
    return clean.non_negative(dirty_customer(spark, folder), ["age"])


@query("clean_value_range", _dirty(_rewrite({"age": "CASE WHEN age <= 120 THEN age END"})))
def clean_value_range(spark, folder):
    return clean.value_range(dirty_customer(spark, folder), "age", high=120)


@query("clean_guard_amounts", _dirty(_rewrite({"age": "CASE WHEN age BETWEEN 0 AND 120 THEN age END"})))
def clean_guard_amounts(spark, folder):
    return clean.guard_amounts(dirty_customer(spark, folder))


@query("clean_dedup", _dirty("SELECT DISTINCT * FROM dirty_customer"))
def clean_dedup(spark, folder):
    return clean.deduplicate(dirty_customer(spark, folder))


@query("clean_dedup_keep_none", _dirty(
    f"SELECT {', '.join(DIRTY_COLUMNS)} FROM dirty_customer GROUP BY {', '.join(DIRTY_COLUMNS)} HAVING count(*) = 1"))
def clean_dedup_keep_none(spark, folder):
    return clean.deduplicate(dirty_customer(spark, folder), keep=False)


@query("clean_dedup_by_key", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def clean_dedup_by_key(spark, folder):
    return clean.deduplicate(
        table(spark, folder, "orders"), keys=["o_custkey", "o_orderpriority"], order_by=["o_orderdate", "o_orderkey"]
    )


def _with_infinities(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(k % 9 == 0, F.lit(float("inf"))).when(k % 9 == 4, F.lit(float("-inf")))
        .when(k % 9 == 7, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
    )


@query("clean_inf_to_null", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 NOT IN (0, 4, 7) THEN o_totalprice END AS price FROM orders""")
def clean_inf_to_null(spark, folder):
    return clean.infinities_to_null(_with_infinities(spark, folder))


def _filled(source, tail=""):
    texts = {c: f"coalesce({c}, 'N/A')" for c in TEXTS}
    texts["age"] = f"coalesce(age, (SELECT median(age) FROM {source}))"
    texts["id"] = f"coalesce(CAST(id AS DOUBLE), (SELECT median(CAST(id AS DOUBLE)) FROM {source}))"
    return _rewrite(texts, source) + tail


@query("clean_impute_all", _dirty(_filled("dirty_customer")))
def clean_impute_all(spark, folder):
    return clean.impute_all(dirty_customer(spark, folder))


@query("impute_median", _dirty(_rewrite({"age": "coalesce(age, (SELECT median(age) FROM dirty_customer))"})))
def impute_median(spark, folder):
    return clean.impute_column(dirty_customer(spark, folder), "age", "median")


@query("impute_mean", _dirty(_rewrite({"age": "round(coalesce(age, (SELECT avg(age) FROM dirty_customer)), 6)"})))
def impute_mean(spark, folder):
    return clean.impute_column(dirty_customer(spark, folder), "age", "mean").withColumn("age", F.round("age", 6))


@query("impute_mode", _dirty(_rewrite({
    "segment": "coalesce(segment, (SELECT segment FROM dirty_customer WHERE segment IS NOT NULL GROUP BY segment "
    "ORDER BY count(*) DESC, segment LIMIT 1))"})))
def impute_mode(spark, folder):
    return clean.impute_column(dirty_customer(spark, folder), "segment", "mode")


@query("impute_constant", _dirty(_rewrite({"segment": "coalesce(segment, 'OTHER')"})))
def impute_constant(spark, folder):
    return clean.impute_column(dirty_customer(spark, folder), "segment", "constant", "OTHER")


def _numeric_text(spark, folder):
    """Order totals as text in the spellings a number can have, and some it cannot."""
    k, p = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    text = (
        F.when(k % 10 == 1, F.concat(F.lit(" "), p, F.lit(" "))).when(k % 10 == 2, F.concat(p, F.lit(".0")))
        .when(k % 10 == 3, F.concat(p, F.lit(".5"))).when(k % 10 == 4, "1e3").when(k % 10 == 5, "1d")
        .when(k % 10 == 6, "0x10").when(k % 10 == 7, "-").when(k % 10 == 8, "nan").otherwise(p)
    )
    return table(spark, folder, "orders").select("o_orderkey", text.alias("price"))


_NUMERIC_TEXT = """
numeric_text AS (
  SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN ' ' || p || ' ' WHEN 2 THEN p || '.0' WHEN 3 THEN p || '.5' WHEN 4 THEN '1e3'
    WHEN 5 THEN '1d' WHEN 6 THEN '0x10' WHEN 7 THEN '-' WHEN 8 THEN 'nan' ELSE p END AS price
  FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS p FROM orders))"""


@query("coerce_integer", f"""
WITH {_NUMERIC_TEXT}, parsed AS (
  SELECT o_orderkey, CASE WHEN regexp_matches(trim(price), '{_NUM}') THEN TRY_CAST(trim(price) AS DOUBLE) END AS x FROM numeric_text)
SELECT o_orderkey, CASE WHEN x = floor(x) THEN CAST(x AS BIGINT) END AS price FROM parsed""")
def coerce_integer(spark, folder):
    return clean.coerce_type(_numeric_text(spark, folder), "price", "integer")


@query("coerce_float", f"""
WITH {_NUMERIC_TEXT}
SELECT o_orderkey, CASE WHEN regexp_matches(trim(price), '{_NUM}') THEN TRY_CAST(trim(price) AS DOUBLE) END AS price FROM numeric_text""")
def coerce_float(spark, folder):
    return clean.coerce_type(_numeric_text(spark, folder), "price", "float")


@query("coerce_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def coerce_string(spark, folder):
    return clean.coerce_type(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "string")


def _date_text(spark, folder):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(k % 5 == 0, F.date_format(d, "yyyy/MM/dd")).when(k % 5 == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(k % 5 == 2, F.lit("not a date")).when(k % 5 == 3, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    return table(spark, folder, "orders").select("o_orderkey", text.alias("placed"))


@query("coerce_datetime", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 2 THEN o_orderdate END AS placed FROM orders""")
def coerce_datetime(spark, folder):
    got = clean.coerce_type(_date_text(spark, folder), "placed", "datetime")
    return got.withColumn("placed", F.col("placed").cast("timestamp_ntz"))


_AMOUNT = rf"trim(regexp_replace(regexp_replace({_strip('balance_text')}, '^[\$€£¥]', ''), '[,%]', '', 'g'))"


@query("coerce_currency", _dirty(_rewrite(
    {"balance_text": f"CASE WHEN regexp_matches({_AMOUNT}, '{_NUM}') THEN TRY_CAST({_AMOUNT} AS DOUBLE) END"})))
def coerce_currency(spark, folder):
    return clean.coerce_currency(dirty_customer(spark, folder))


_STEPS = f"""
trimmed AS ({_rewrite(_TRIMMED)}),
guarded AS ({_rewrite({"age": "CASE WHEN age BETWEEN 0 AND 120 THEN age END"}, "trimmed")}),
kept AS (SELECT DISTINCT * FROM guarded WHERE {_ANY})"""


@query("clean_default_rules", _dirty(", " + _STEPS + _rewrite({
    **{c: f"coalesce({c}, 'N/A')" for c in TEXTS}, "age": "coalesce(age, (SELECT median(age) FROM kept))",
}, "kept")))
def clean_default_rules(spark, folder):
    return rules.apply_rules(dirty_customer(spark, folder))


@query("clean_rule_list", _dirty(
    "SELECT DISTINCT id, " + _TRIMMED["name"] + " AS name, age, coalesce(segment, 'OTHER') AS segment, email FROM dirty_customer "
    f"WHERE {_ANY}"))
def clean_rule_list(spark, folder):
    """A list with table and column rules, an unknown type and a missing column."""
    todo = [
        rules.Rule("drop_empty_rows"), rules.Rule("trim_whitespace", "name", {"null_tokens": True}),
        rules.Rule("no_such_rule"), rules.Rule("impute_nulls", "no_such_column"),
        rules.Rule("impute_nulls", "segment", {"strategy": "constant", "value": "OTHER"}),
        rules.Rule("deduplicate", params={"keep": "first"}),
    ]
    rows = dirty_customer(spark, folder).select("id", "name", "age", "segment", "email")
    return rules.apply_rules(rows, todo)


_FENCES = """
fences AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"""


@query("clip_outliers_iqr", f"""
WITH {_FENCES} SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, fences""")
def clip_outliers_iqr(spark, folder):
    got = clean.clip_outliers(table(spark, folder, "events").select("event_id", "value"), ["value"])
    return got.withColumn("value", F.round("value", 6))


@query("filter_outliers_iqr", f"WITH {_FENCES} SELECT event_id, value FROM events, fences WHERE value BETWEEN lo AND hi")
def filter_outliers_iqr(spark, folder):
    return clean.filter_outliers(table(spark, folder, "events").select("event_id", "value"), ["value"])


@query("mask_pii", _dirty(_rewrite({"email": f"CASE WHEN email <> '' THEN '{MASK}' ELSE email END"})))
def mask_pii(spark, folder):
    return schema.mask_pii(dirty_customer(spark, folder))


_KINDS = [
    r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\+?\(?\d{3}\)?[ -]\d{3}[ -]\d{4}",
]
_BARE = "text"
for _kind in _KINDS:
    _BARE = f"regexp_replace({_BARE}, '{_kind}', '{MASK}', 'g')"


@query("redact_text", f"SELECT doc_id, {_BARE} AS text FROM documents")
def redact_text(spark, folder):
    return clean.redact_text(table(spark, folder, "documents").select("doc_id", "text"), ["text"])


_PADDED = " OR ".join(f"coalesce({_strip(c)} <> {c}, FALSE)" for c in TEXTS)


@query("suggest_rules", _dirty(f"""
SELECT 'drop_empty_rows' AS rule, count(*) FILTER (NOT ({_ANY})) AS affected_rows FROM dirty_customer
UNION ALL SELECT 'trim_whitespace', count(*) FILTER ({_PADDED}) FROM dirty_customer
UNION ALL SELECT 'deduplicate', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) FROM dirty_customer"""))
def suggest_rules(spark, folder):
    return rules.suggest_rules(dirty_customer(spark, folder))


# ---- types and personal data --------------------------------------------------------------------

_TYPED = ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "order_code", "stamp_text", "is_even", "contact"]


def _type_case(c):
    if c in ("o_orderkey", "o_totalprice", "o_orderdate", "is_even"):
        kind = {"o_orderkey": "integer", "o_totalprice": "float", "o_orderdate": "datetime", "is_even": "boolean"}[c]
        return f"'{kind}'"
    return f"""(SELECT CASE WHEN count(DISTINCT {c}) <= 30 OR count(DISTINCT {c}) * 1.0 / count({c}) < 0.2 THEN 'categorical'
      WHEN (SELECT count(TRY_CAST(s AS TIMESTAMP)) * 1.0 / count(*) FROM (
        SELECT {c} AS s FROM typed_orders WHERE {c} IS NOT NULL)) >= 0.8 THEN 'datetime' ELSE 'string' END FROM typed_orders)"""


@query("infer_types", f"WITH {TYPED_ORDERS} " + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST({i + 1} AS BIGINT) AS ordinal, {_type_case(c)} AS inferred_type"
    for i, c in enumerate(_TYPED)))
def infer_types(spark, folder):
    return schema.infer_types(typed_orders(spark, folder))


_HEADER = " OR ".join(f"contains(lower(column_name), '{k}')" for k in (
    "email", "phone", "mobile", "ssn", "social_security", "credit_card", "card_number", "passport", "password", "ip_address",
    "first_name", "last_name", "full_name", "address", "zipcode"))


@query("pii_columns", _dirty("""
SELECT column_name AS "column", __HEADER__ AS is_pii, filled FROM (""".replace("__HEADER__", _HEADER) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS filled FROM dirty_customer" for c in DIRTY_COLUMNS) + ")"))
def pii_columns(spark, folder):
    return schema.pii_columns(dirty_customer(spark, folder))


@query("pii_value_rates", f"WITH {TYPED_ORDERS} " + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{name}' AS pattern, count(*) FILTER (trim({c}) <> '' AND regexp_matches(trim({c}), '{p}')) AS matches, "
    f"count(*) FILTER (trim({c}) <> '') AS filled, "
    f"round(count(*) FILTER (trim({c}) <> '' AND regexp_matches(trim({c}), '{p}')) * 1.0 / count(*) FILTER (trim({c}) <> ''), 4) AS rate "
    "FROM typed_orders"
    for c in ["o_orderpriority", "order_code", "stamp_text", "contact"] for name, p in PII_PATTERNS.items()))
def pii_value_rates(spark, folder):
    return schema.pii_value_rates(typed_orders(spark, folder))


def _pii_case(c):
    rate = ", ".join(
        f"count(*) FILTER (s <> '' AND regexp_matches(s, '{p}')) * 1.0 / count(*) FILTER (s <> '')" for p in PII_PATTERNS.values())
    return (
        f"(SELECT coalesce(greatest({rate}), 0) >= 0.5 FROM "
        f"(SELECT trim(CAST({c} AS VARCHAR)) AS s FROM typed_orders))"
    )


@query("column_catalog", f"WITH {TYPED_ORDERS} " + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST({i + 1} AS BIGINT) AS ordinal, {_type_case(c)} AS inferred_type, {_pii_case(c)} AS is_pii"
    for i, c in enumerate(_TYPED)))
def column_catalog(spark, folder):
    return schema.column_catalog(typed_orders(spark, folder))


@query("version_columns", f"WITH {TYPED_ORDERS} " + "\nUNION ALL\n".join(
    f"SELECT CAST(v AS BIGINT) AS version_number, '{c}' AS \"column\", CAST({i + 1} AS BIGINT) AS ordinal, {_type_case(c)} AS inferred_type, {_pii_case(c)} AS is_pii FROM range(1, 3) AS t(v)"
    for i, c in enumerate(_TYPED)))
def version_columns(spark, folder):
    """Schema rows of a version and of its unchanged child."""
    store = Store(spark, scratch_path(spark, "store"))
    first = store.append(typed_orders(spark, folder), "orders", "raw")
    store.append(store.load("orders", first), "orders", "cleaned", first)
    return store.columns("orders").drop("storage_type")


def _late_sql(c):
    rate = ", ".join(
        f"count(*) FILTER (s <> '' AND regexp_matches(s, '{p}')) * 1.0 / count(*) FILTER (s <> '')" for p in PII_PATTERNS.values())
    return (
        f"SELECT '{c}' AS column_name, (SELECT coalesce(greatest({rate}), 0) >= 0.5 FROM "
        f"(SELECT trim(CAST({c} AS VARCHAR)) AS s FROM late_customer)) AS by_value"
    )


_LATE = """late_customer AS (SELECT c_custkey, c_name AS full_name, c_acctbal,
  CASE WHEN c_custkey > 25 THEN 'u' || c_custkey || '@example.com' END AS contact FROM customer)"""


def _late_customer(spark, folder):
    """Customers whose addresses only show after the first rows, under a header that says nothing."""
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("full_name"), "c_acctbal",
        F.when(k > 25, F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com"))).alias("contact"),
    )


@query("column_catalog_late", f"""
WITH {_LATE}, found AS ({" UNION ALL ".join(_late_sql(c) for c in ("c_custkey", "full_name", "c_acctbal", "contact"))})
SELECT column_name AS "column", by_value OR {_HEADER} AS is_pii FROM found""")
def column_catalog_late(spark, folder):
    return schema.column_catalog(_late_customer(spark, folder)).select("column", "is_pii")


@query("mask_pii_late", f"""
WITH {_LATE} SELECT c_custkey, '{MASK}' AS full_name, c_acctbal,
  CASE WHEN contact IS NOT NULL THEN '{MASK}' END AS contact FROM late_customer""")
def mask_pii_late(spark, folder):
    return schema.mask_pii(_late_customer(spark, folder))


@query("safe_value_counts", _dirty(""", cells AS (
  SELECT 'name' AS col, name AS val FROM dirty_customer WHERE name IS NOT NULL
  UNION ALL SELECT 'balance_text', balance_text FROM dirty_customer WHERE balance_text IS NOT NULL
  UNION ALL SELECT 'segment', segment FROM dirty_customer WHERE segment IS NOT NULL
), counted AS (SELECT col, val, count(*) AS n FROM cells GROUP BY col, val),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rn, count(*) OVER (PARTITION BY col) AS u FROM counted)
SELECT col AS "column", val AS value, n AS "count" FROM ranked WHERE u <= 25 AND rn <= 5"""))
def safe_value_counts(spark, folder):
    return schema.safe_value_counts(dirty_customer(spark, folder))


# ---- scaling and encoding -----------------------------------------------------------------------

@query("scale_standard", """
SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders,
  (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)""")
def scale_standard(spark, folder):
    return scale.scale_standard(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 6)


@query("scale_minmax", """
SELECT o_orderkey, round((o_totalprice - a) / (b - a), 6) AS o_totalprice FROM orders,
  (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)""")
def scale_minmax(spark, folder):
    return scale.scale_minmax(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 6)


@query("scale_robust", """
SELECT o_orderkey, round((o_totalprice - q2) / (q3 - q1), 6) AS o_totalprice FROM orders,
  (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2,
     quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)""")
def scale_robust(spark, folder):
    return scale.scale_robust(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 6)


@query("encode_label", """
SELECT p_partkey, p_name, (SELECT count(DISTINCT q.p_name) FROM part q WHERE q.p_name < p.p_name) AS p_name_code FROM part p""")
def encode_label(spark, folder):
    return scale.encode_label(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name")


@query("encode_onehot", "SELECT o_orderkey, " + ", ".join(
    f"CAST(o_orderstatus = '{s}' AS INTEGER) AS o_orderstatus_{s}" for s in "FOP") + " FROM orders")
def encode_onehot(spark, folder):
    return scale.encode_onehot(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


