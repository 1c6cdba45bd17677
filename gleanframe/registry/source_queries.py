"""Readers and writers, run over files that Spark writes from the test tables."""

from __future__ import annotations

import io
import sys
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanframe.registry.base import query, table
from gleanframe.registry.fixtures import DIRTY_COLUMNS, DIRTY_CUSTOMER, dirty_customer
from gleanframe.session import scratch_path
from gleanframe.sources import sinks, tables, workbooks

MESSY_HEADER = "c_custkey,c_name,c_acctbal,c_mktsegment"


def _messy_csv(spark, folder) -> str:
    """Customers as CSV lines, some of them too long, too short, or quoted with commas inside."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 1, F.concat(F.lit('"'), "c_name", F.lit(', ""Inc"""'))).otherwise(F.col("c_name"))
    full = F.concat_ws(",", k.cast("string"), name, F.col("c_acctbal").cast("decimal(12,2)").cast("string"), "c_mktsegment")
    line = (
        F.when(k % 10 == 3, F.concat(full, F.lit(",surplus"))).when(k % 10 == 7, F.concat(full, F.lit(",")))
        .when(k % 10 == 5, F.concat_ws(",", k.cast("string"), name)).otherwise(full)
    )
    path = scratch_path(spark, "messy-csv")
    table(spark, folder, "customer").select(line.alias("value")).write.text(path)
    return path


@query("scan_csv_skip_bad", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 4 = 1 THEN c_name || ', "Inc"' ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 10 <> 5 THEN CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) END AS c_acctbal,
  CASE WHEN c_custkey % 10 <> 5 THEN c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey % 10 NOT IN (3, 7)""")
def scan_csv_skip_bad(spark, folder):
    path = _messy_csv(spark, folder)
    return tables.scan_csv(spark, path, columns=MESSY_HEADER.split(","), header=False)


@query("scan_csv_multiline", """
SELECT CAST(c_custkey AS VARCHAR) AS "cust
key", CASE c_custkey % 4 WHEN 0 THEN c_name || chr(10) || 'second, line' WHEN 1 THEN chr(10) || '"' || c_name || '"' || chr(10) || chr(10)
  WHEN 2 THEN c_name || ' 5" pipe' ELSE c_name END AS "name, full", CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) AS balance
FROM customer""")
def scan_csv_multiline(spark, folder):
    """Line breaks, separators and quotes inside cells and inside the names of the header."""
    k, path = F.col("c_custkey"), scratch_path(spark, "multiline-csv")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit('"'), "c_name", F.lit('\nsecond, line"')))
        .when(k % 4 == 1, F.concat(F.lit('"\n""'), "c_name", F.lit('""\n\n"')))
        .when(k % 4 == 2, F.concat("c_name", F.lit(' 5" pipe'))).otherwise(F.col("c_name"))
    )
    row = F.concat_ws(",", k.cast("string"), name, F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    block = table(spark, folder, "customer").groupBy(F.floor(k / 1000).alias("part")).agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    # a thousand customers a file, each file with the header
    block.repartitionByRange(8, "part").select(F.concat(F.lit('"cust\nkey","name, full",balance\n'), "rows").alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)
    return tables.scan_csv(spark, path, multi_line=True)


@query("load_csv_typed", """
SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def load_csv_typed(spark, folder):
    path = scratch_path(spark, "customer-csv")
    sinks.write_csv(table(spark, folder, "customer"), path)
    return tables.load_table(spark, path, "csv")


@query("sink_csv_roundtrip", f"WITH {DIRTY_CUSTOMER}" + " SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DIRTY_COLUMNS)
       + " FROM dirty_customer")
def sink_csv_roundtrip(spark, folder):
    """Rows written as CSV and read back as text, padding, empty rows and all."""
    path = scratch_path(spark, "dirty-csv")
    sinks.write_csv(dirty_customer(spark, folder), path)
    return tables.scan_csv(spark, path)


@query("scan_csv_headers", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey FROM customer""")
def scan_csv_headers(spark, folder):
    """A folder whose files name their columns in different orders, and not the same ones."""
    path, k = scratch_path(spark, "two-headers"), F.col("c_custkey")
    customers = table(spark, folder, "customer")
    sinks.write_csv(customers.where(k % 3 != 0).select("c_custkey", "c_name", "c_mktsegment"), f"{path}/part=a")
    sinks.write_csv(customers.where(k % 3 == 0).select("c_nationkey", "c_name", "c_custkey"), f"{path}/part=b")
    return tables.scan_csv(spark, f"{path}/*")


@query("sink_parquet_roundtrip", "SELECT * FROM orders")
def sink_parquet_roundtrip(spark, folder):
    path = scratch_path(spark, "orders-parquet")
    sinks.write_parquet(table(spark, folder, "orders"), path)
    return tables.load_table(spark, path, "parquet")


@query("sink_json_roundtrip", "SELECT * FROM events")
def sink_json_roundtrip(spark, folder):
    path = scratch_path(spark, "events-json")
    rows = table(spark, folder, "events")
    sinks.write_json(rows, path)
    return tables.scan_json(spark, path, lines=True, schema=rows.schema)


@query("scan_json", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def scan_json(spark, folder):
    """One array of records per file."""
    path = scratch_path(spark, "nation-json")
    record = F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey"))
    arrays = table(spark, folder, "nation").select(F.concat(F.lit("["), record, F.lit("]")).alias("value"))
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return tables.load_table(spark, path, "json")


@query("table_fingerprint")
def table_fingerprint(spark, folder):
    return sinks.table_fingerprint(table(spark, folder, "orders"))


# the function below travels to the workers whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _text_cell(place: str, value: str) -> str:
    return f'<c r="{place}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def _one_workbook(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of at most 500 customers as the bytes of a workbook."""
    header = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    lines = [header, *pdf[header].astype(str).values.tolist()]
    rows = "".join(
        f'<row r="{i + 1}">' + "".join(_text_cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(line)) + "</row>"
        for i, line in enumerate(lines)
    )
    return _packed_book(pdf, rows)


def _packed_book(pdf: pd.DataFrame, rows: str, styles: str | None = None) -> pd.DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", (
            f'<workbook xmlns="{_SHEET}" xmlns:r="{_REL}"><sheets><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>'
        ))
        book.writestr("xl/_rels/workbook.xml.rels", (
            f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>'
        ))
        if styles is not None:
            book.writestr("xl/styles.xml", styles)
        book.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{_SHEET}"><sheetData>{rows}</sheetData></worksheet>')
    return pd.DataFrame({"path": [f"block-{pdf['block'].iloc[0]:012d}.xlsx"], "content": [out.getvalue()]})


@query("scan_workbooks", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""")
def scan_workbooks(spark, folder):
    """Customers in workbooks of up to 500 rows each; bytes as a binary file source gives them."""
    blocks = table(spark, folder, "customer").withColumn("block", F.floor(F.col("c_custkey") / 500))
    files = blocks.groupBy("block").applyInPandas(_one_workbook, "path string, content binary")
    return workbooks.read_workbooks(files)


def _dated_workbook(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of orders with their day, their day and time, and their price, as numbers that only styles tell apart."""
    first, days = pd.Timestamp(1899, 12, 30), pd.to_datetime(pdf["o_orderdate"])
    day = (days.dt.normalize() - first).dt.days
    lines = zip(pdf["o_orderkey"], day, day + (pdf["o_orderkey"] % 24) / 24, pdf["o_orderkey"] % 1000 + 40_000)
    rows = '<row r="1">' + "".join(_text_cell(f"{c}1", n) for c, n in zip("ABCD", ("o_orderkey", "day", "moment", "amount"))) + "</row>"
    rows += "".join(
        f'<row r="{i}"><c r="A{i}"><v>{key}</v></c><c r="B{i}" s="1"><v>{d}</v></c><c r="C{i}" s="2"><v>{m!r}</v></c>'
        f'<c r="D{i}" s="3"><v>{a}</v></c></row>' for i, (key, d, m, a) in enumerate(lines, 2)
    )
    return _packed_book(pdf, rows, (
        f'<styleSheet xmlns="{_SHEET}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/>'
        '<numFmt numFmtId="165" formatCode="[Red]0.00&quot; days&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    ))


@query("scan_workbooks_dates", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 24 > 0 THEN ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00:00' ELSE '' END AS moment,
  CAST(o_orderkey % 1000 + 40000 AS VARCHAR) AS amount FROM orders""")
def scan_workbooks_dates(spark, folder):
    """Numbers in date formats come back as dates, others as numbers."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    blocks = orders.withColumn("block", F.floor(F.col("o_orderkey") / 5000))
    return workbooks.read_workbooks(blocks.groupBy("block").applyInPandas(_dated_workbook, "path string, content binary"))
