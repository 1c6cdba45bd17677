"""Logical types, likely personal data and the column catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType,
    TimestampNTZType, TimestampType,
)

from gleanframe.functions.constants import (
    PII_HEADER_KEYWORDS, PII_PATTERNS, SUMMARY_ID_KEYWORDS,
)
from gleanframe.functions.dates import parse_timestamp
from gleanframe.functions.text import mask, strip
from gleanframe.operators.columns import (
    aggregate_row, as_text, categorical_columns, ident, long_aggregates, text_columns,
    unpivot_text,
)
from gleanframe.session import local_frame

CATEGORY_VALUES = 30
CATEGORY_RATIO = 0.2
# beyond these a 2 % sketch error cannot change the answer
CLEAR_VALUES = 100
CLEAR_RATIOS = (0.15, 0.26)


def _is_category(df: DataFrame, names: Sequence[str]) -> dict[str, bool | None]:
    """Whether text columns are categorical; None for a column without values.

    Sketches settle the clear cases in one scan without a shuffle of values; only
    columns near a limit are counted exactly.
    """
    if not names:
        return {}
    row = aggregate_row(df, [
        e for i, c in enumerate(names) for e in (
            F.count(ident(c)).alias(f"n{i}"),
            F.approx_count_distinct(ident(c), 0.02).alias(f"d{i}"),
        )
    ])
    out: dict[str, bool | None] = {}
    close = []
    for i, c in enumerate(names):
        n, d = row[f"n{i}"], row[f"d{i}"]
        if n == 0:
            out[c] = None
        elif d > CLEAR_VALUES and d / n > CLEAR_RATIOS[1]:
            out[c] = False
        elif d / n < CLEAR_RATIOS[0]:
            out[c] = True
        else:
            close.append((c, n))
    if close:
        counted = (
            unpivot_text(df, [c for c, _ in close]).groupBy("column", "value").agg(F.lit(1).alias("one"))
            .groupBy("column").agg(F.count("one").alias("d"))
        )
        distinct = {r["column"]: r["d"] for r in counted.collect()}
        for c, n in close:
            out[c] = distinct[c] <= CATEGORY_VALUES or distinct[c] / n < CATEGORY_RATIO
    return out


def _date_columns(df: DataFrame, names: Sequence[str]) -> set[str]:
    """Columns of which eight in ten filled cells are dates, over all rows in one scan."""
    if not names:
        return set()
    row = aggregate_row(df, [
        F.try_divide(F.count(parse_timestamp(ident(c))), F.count(ident(c))).alias(f"s{i}") for i, c in enumerate(names)
    ])
    return {c for i, c in enumerate(names) if row[f"s{i}"] is not None and row[f"s{i}"] >= 0.8}


def logical_types(df: DataFrame) -> dict[str, str]:
    """integer, float, boolean, datetime, categorical or string for every column."""
    out: dict[str, str] = {}
    texts = _is_category(df, text_columns(df))
    dates = _date_columns(df, [c for c, category in texts.items() if category is False])
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, IntegralType):
            out[f.name] = "integer"
        elif isinstance(t, (FloatType, DoubleType, DecimalType)):
            out[f.name] = "float"
        elif isinstance(t, BooleanType):
            out[f.name] = "boolean"
        elif isinstance(t, (TimestampType, TimestampNTZType, DateType)):
            out[f.name] = "datetime"
        elif isinstance(t, StringType) and texts[f.name]:
            out[f.name] = "categorical"
        elif isinstance(t, StringType) and texts[f.name] is False:
            out[f.name] = "datetime" if f.name in dates else "string"
        else:
            out[f.name] = "string"
    return out


def infer_types(df: DataFrame) -> DataFrame:
    """(column, ordinal, inferred_type), ordinals from 1."""
    types = logical_types(df)
    rows = [(c, i + 1, types[c]) for i, c in enumerate(df.columns)]
    return local_frame(df.sparkSession, rows, "column string, ordinal bigint, inferred_type string")


def pii_headers(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(k in c.lower() for k in PII_HEADER_KEYWORDS)]


# lengths of the texts that a pattern can match, and a character they have
_REACH = {"email": (6, None, "@"), "phone": (7, 16, None), "ssn": (11, 11, "-"), "credit_card": (16, 19, None), "ip_address": (7, 15, ".")}


def _fits(text: Column, name: str) -> Column:
    """Whether a text matches a pattern; most are told by their length, without the pattern."""
    least, most, needed = _REACH[name]
    size = F.length(text)
    near = size >= least if most is None else size.between(least, most)
    if needed is not None:
        near = near & F.contains(text, F.lit(needed))
    return near & text.rlike(PII_PATTERNS[name])


def _number_fits(n: Column) -> list[Column]:
    """The patterns that the text of a whole number can match: telephone and card, by its digits."""
    phone = n.between(10**6, 10**15 - 1) | n.between(-(10**14) + 1, -(10**5))
    return [phone, n.between(10**15, 10**16 - 1)]


def pii_by_value(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns where half of the filled cells of all rows fit one pattern.

    Fractions, times of day and booleans have texts that fit none.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    never = (FloatType, DoubleType, BooleanType, TimestampType, TimestampNTZType)
    columns = [c for c in columns if not isinstance(kinds[c], never) and getattr(kinds[c], "scale", 0) <= 0]
    if not columns:
        return []
    whole = {c for c in columns if isinstance(kinds[c], IntegralType)}
    cells = df.select(*[(ident(c).cast("bigint") if c in whole else strip(as_text(df, c))).alias(f"c{i}") for i, c in enumerate(columns)])
    exprs = []
    for i, c in enumerate(columns):
        cell = F.col(f"c{i}")
        filled = cell.isNotNull() if c in whole else cell != ""
        hits = _number_fits(cell) if c in whole else [_fits(cell, p) for p in PII_PATTERNS]
        exprs.append(F.try_divide(F.greatest(*[F.count_if(filled & h) for h in hits]), F.count_if(filled)).alias(f"s{i}"))
    row = aggregate_row(cells, exprs)
    return [c for i, c in enumerate(columns) if row[f"s{i}"] is not None and row[f"s{i}"] >= 0.5]


def pii_suspects(df: DataFrame) -> list[str]:
    by_name = pii_headers(df.columns)
    by_value = pii_by_value(df, [c for c in df.columns if c not in by_name])
    return [c for c in df.columns if c in by_name or c in by_value]


def pii_columns(df: DataFrame) -> DataFrame:
    """(column, is_pii, filled): whether the header alone marks a column, and how many cells that covers."""
    hits = pii_headers(df.columns)
    counted = long_aggregates(df, df.columns, {"filled": ("bigint", lambda c: F.count(ident(c)))})
    return counted.select("column", F.col("column").isin(hits).alias("is_pii"), "filled")


def pii_value_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, pattern, matches, filled, rate) over every row, not a sample."""
    columns = list(columns if columns is not None else text_columns(df))

    def filled(c: str):
        return strip(as_text(df, c)) != ""

    metrics = {"filled": ("bigint", lambda c: F.count_if(filled(c)))}
    for name, pattern in PII_PATTERNS.items():
        metrics[name] = (
            "bigint", lambda c, p=pattern: F.count_if(filled(c) & strip(as_text(df, c)).rlike(p))
        )
    wide = long_aggregates(df, columns, metrics)
    cells = [F.struct(F.lit(p).alias("pattern"), F.col(p).alias("matches")) for p in PII_PATTERNS]
    return (
        wide.select("column", "filled", F.explode(F.array(*cells)).alias("x"))
        .select(
            "column", "x.pattern", "x.matches", "filled",
            F.round(F.try_divide("x.matches", F.col("filled")), 4).alias("rate"),
        )
    )


def column_catalog(df: DataFrame) -> DataFrame:
    """(column, ordinal, inferred_type, is_pii)."""
    types, suspects = logical_types(df), set(pii_suspects(df))
    rows = [(c, i + 1, types[c], c in suspects) for i, c in enumerate(df.columns)]
    return local_frame(df.sparkSession, rows, "column string, ordinal bigint, inferred_type string, is_pii boolean"
    )


def safe_value_counts(df: DataFrame, top: int = 5, most: int = 25) -> DataFrame:
    """(column, value, count): frequent values of columns that cannot identify a person.

    A column with more than ``most`` values shows itself by having a row of that rank,
    so no separate distinct count is needed.
    """
    columns = [
        c for c in categorical_columns(df) if not any(k in c.lower() for k in SUMMARY_ID_KEYWORDS)
    ]
    schema = "column string, value string, count bigint"
    if not columns:
        return local_frame(df.sparkSession, [], schema)
    counts = unpivot_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most + 1)
    values = F.max("rank").over(Window.partitionBy("column"))
    return (
        ranked.withColumn("values", values)
        .where((F.col("values") <= most) & (F.col("rank") <= top))
        .select("column", "value", "count")
    )


def mask_pii(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace filled cells of the given, or all suspected, columns by a fixed mask."""
    hidden = set(columns if columns is not None else pii_suspects(df))
    return df.select(*[
        mask(as_text(df, c)).alias(c) if c in hidden else ident(c) for c in df.columns
    ])
