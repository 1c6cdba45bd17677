"""Tolerant readers for CSV, JSON, Parquet and workbook files."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleanframe.functions.text import INTEGER, null_tokens, parse_amount, strip
from gleanframe.operators.columns import aggregate_row, ident, nan_to_null, text_columns
from gleanframe.session import local_frame, materialise
from gleanframe.sources.records import block_states, split_records
from gleanframe.sources.workbooks import scan_workbooks

_BAD = "__bad_record"

# fixed values: file endings and their formats; anything else is read as CSV
FORMATS = {
    "csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl",
    "parquet": "parquet", "xlsx": "xlsx", "xls": "xls",
}


def format_of(path: str) -> str:
    ending = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)
    return FORMATS.get(ending[-1].lower(), "csv") if len(ending) == 2 else "csv"


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, head): the first line of every file that is not blank."""
    lines = spark.read.text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_block_start").alias("start"),
    ).where((F.col("start") == 0) & (F.trim("value") != ""))
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))


def _headers(heads: DataFrame, sep: str) -> tuple[list[list[str]], DataFrame]:
    """The distinct headers, the most common first, and the number of each file's header.

    Only distinct headers reach the driver, however many files there are.
    """
    counted = heads.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    found = [r["head"] for r in counted.orderBy(F.desc("n"), "head").collect()]
    names = [next(csv.reader(io.StringIO(h), delimiter=sep), []) for h in found]
    number = F.coalesce(*[F.when(F.col("head") == h, F.lit(i)) for i, h in enumerate(found)]) if found else F.lit(0)
    return names, heads.select("file", number.alias("header"))


def scan_csv(
    spark: SparkSession, path: str, *, sep: str = ",", columns: list[str] | None = None,
    header: bool = True, multi_line: bool = False,
) -> DataFrame:
    """All columns as text; lines with too many fields are skipped, short ones padded with null.

    Whether a line is too long is decided on its raw text, so an empty surplus field counts
    too.  Blank lines are skipped, before a header as well.  ``multi_line`` reads line breaks
    inside quotes, in header names too; files are split all the same, at the price of a pass
    that finds how each block begins.  Files of a folder are matched by the names in their
    headers, not by position; a column that a file lacks is null there.
    """
    blocks = block_states(spark, path, sep) if multi_line else None
    files = None
    if columns is not None or not header:
        layouts = [list(columns)] if columns is not None else [_counted_names(spark, path, sep, blocks)]
    else:
        if blocks is not None:
            heads = blocks.where("start = 0").select("file", F.regexp_replace("head", "\r$", "").alias("head"))
            if not heads.where("head IS NULL").isEmpty():
                # a header that crosses blocks is whole only among the records
                first = split_records(spark, path, sep, blocks).where("first")
                heads = materialise(first.select("file", F.regexp_replace("value", "\r$", "").alias("head")), "csv-heads")
        else:
            heads = _first_lines(spark, path)
        layouts, files = _headers(heads, sep)
        if not layouts:
            return local_frame(spark, [], StructType())
    if len(layouts) > 1:
        for names in layouts:
            if len(set(names)) < len(names):
                raise ValueError(f"files with different headers, one of which repeats a name: {names}")
    width = max(map(len, layouts))
    rows = _parsed(spark, path, sep, width, header, blocks)
    outside_quotes = F.regexp_replace(F.col(_BAD), '"([^"]|"")*"', "")
    fields = F.length(outside_quotes) - F.length(F.replace(outside_quotes, F.lit(sep), F.lit(""))) + 1
    if len(layouts) == 1:
        kept = rows.where(F.col(_BAD).isNull() | (fields <= width))
        return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(layouts[0])])
    # a record that fits the widest header may still be too long for its own
    own = F.element_at(F.array(*[F.lit(len(names)) for names in layouts]), F.col("header") + 1)
    kept = rows.join(files, "file").where(F.coalesce(fields, F.lit(width)) <= own)
    everything = list(dict.fromkeys(n for names in layouts for n in names))
    return kept.select(*[
        F.coalesce(*[
            F.when(F.col("header") == i, F.col(f"c{names.index(n)}")) for i, names in enumerate(layouts) if n in names
        ]).alias(n) for n in everything
    ])


def _counted_names(spark: SparkSession, path: str, sep: str, blocks: DataFrame | None) -> list[str]:
    """Names by position for files without a header, as many as the first record has fields."""
    heads = blocks.where("start = 0 AND head IS NOT NULL") if blocks is not None else _first_lines(spark, path)
    first = heads.orderBy("file").select("head").first()
    return [f"_c{i}" for i in range(len(next(csv.reader(io.StringIO(first["head"]), delimiter=sep), [])))] if first else []


def _parsed(
    spark: SparkSession, path: str, sep: str, width: int, header: bool, blocks: DataFrame | None,
) -> DataFrame:
    """(file, c0, c1, …, bad record) of every record but the headers; bad ones have not just ``width`` fields."""
    fields = [StructField(f"c{i}", StringType()) for i in range(width)]
    schema = StructType([*fields, StructField(_BAD, StringType())])
    options = {
        "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD,
        # a pruned parser would not see the surplus fields
        "columnPruning": "false",
    }
    if blocks is None:
        rows = spark.read.schema(schema).options(**options, header=header, enforceSchema=True).csv(path)
        return rows.select(F.xxhash64("_metadata.file_path").alias("file"), *schema.names)
    records = split_records(spark, path, sep, blocks)
    records = records.where(~F.col("first")) if header else records
    text = F.regexp_replace("value", "\r$", "")
    ddl = ", ".join(f"`{f.name}` string" for f in schema)
    return records.select("file", text.alias("value")).where(F.trim("value") != "").select(
        "file", F.from_csv("value", ddl, options).alias("r"),
    ).select("file", "r.*")


def settle_types(df: DataFrame) -> DataFrame:
    """Give text columns the type their cells show, in one scan for all columns.

    Null tokens become null first.  A column becomes boolean when every cell is true or
    false, and a number when at least half of its cells are (currency signs, thousands
    commas and percent signs do not count); cells that are none become null.
    """
    names = text_columns(df)
    if not names:
        return df
    df = df.select(*[
        null_tokens(ident(c)).alias(c) if c in names else ident(c) for c in df.columns
    ])
    flag = r"^(True|TRUE|true|False|FALSE|false)$"
    row = aggregate_row(df, [
        e for i, c in enumerate(names) for e in (
            F.count(ident(c)).alias(f"n{i}"),
            F.count(parse_amount(ident(c))).alias(f"num{i}"),
            F.count_if(strip(ident(c)).rlike(INTEGER) & strip(ident(c)).try_cast("bigint").isNotNull())
            .alias(f"int{i}"),
            F.count_if(ident(c).rlike(flag)).alias(f"flag{i}"),
        )
    ])
    new = {}
    for i, c in enumerate(names):
        n = row[f"n{i}"]
        if n and row[f"flag{i}"] == n:
            new[c] = F.lower(ident(c)).try_cast("boolean")
        elif n and row[f"int{i}"] == n:
            new[c] = strip(ident(c)).try_cast("bigint")
        elif n and row[f"num{i}"] / n >= 0.5:
            new[c] = parse_amount(ident(c))
    return df.select(*[new[c].alias(c) if c in new else ident(c) for c in df.columns])


def scan_json(spark: SparkSession, path: str, *, lines: bool = False, schema=None) -> DataFrame:
    """An array of records per file, or one record per line.

    Only the line form lets Spark split a file.
    """
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def load_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read a table by its format, or the ending of its path; unknown endings are CSV."""
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    if fmt in ("json", "jsonl"):
        return settle_types(nan_to_null(scan_json(spark, path, lines=fmt == "jsonl", **options)))
    if fmt == "xls":
        raise ValueError(f"{path}: the old binary workbook format is not read; save it as xlsx")
    if fmt == "xlsx":
        return settle_types(scan_workbooks(spark, path, **options))
    return settle_types(scan_csv(spark, path, **options))
