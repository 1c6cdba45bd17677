"""Previews, searches, sorting and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from gleanframe.functions.constants import OFF_TOPIC_KEYWORDS
from gleanframe.functions.text import contains_any, finite
from gleanframe.operators.columns import as_text, fractional_columns, ident
from gleanframe.operators.ranks import positions

PREVIEW_ROWS = 50
PAGE_ROWS = 20
PAGE_ROWS_MAX = 100


def preview(df: DataFrame, order_by: Sequence[str], limit: int = PREVIEW_ROWS) -> DataFrame:
    """First rows with non-finite numbers as null and timestamps as ISO text."""
    cells = []
    for f in df.schema.fields:
        c = ident(f.name)
        if f.name in fractional_columns(df):
            c = finite(c)
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            exact = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            c = F.when(exact.endswith(".000000"), whole).otherwise(exact)
        elif isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cells.append(c.alias(f.name))
    return df.orderBy(*[ident(c) for c in order_by]).limit(limit).select(*cells)


def preview_size(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """(total_rows, sampled) that go with a preview."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total_rows"), (n > limit).alias("sampled"))


def shown(df: DataFrame, column: str) -> Column:
    """A cell as a reader sees it: all digits of a number, without exponent and without a trailing ``.0``.

    Only numbers beyond 20 digits before or 18 after the point keep their exponent.
    """
    c = ident(column)
    if column not in fractional_columns(df):
        return as_text(df, column)
    text = c.cast("string")
    exact = text.try_cast("decimal(38,18)")
    kept = exact.isNotNull() & (exact.cast("double") == c)
    plain = F.regexp_replace(exact.cast("string"), r"\.?0+$", "")
    return F.when(text.contains("E"), F.when(kept, plain).otherwise(text)).otherwise(F.regexp_replace(text, r"\.0$", ""))


def search_rows(df: DataFrame, term: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any cell contains the literal term, in any case; a blank term keeps all rows."""
    if not term.strip():
        return df
    hit: Column = F.lit(False)
    for c in columns or df.columns:
        hit = hit | F.coalesce(F.lower(shown(df, c)).contains(term.lower()), F.lit(False))
    return df.where(hit)


def sort_key(df: DataFrame, column: str, ascending: bool = True) -> Column:
    """Nulls last in both directions, text in any case."""
    c = ident(column)
    if isinstance(df.schema[column].dataType, StringType):
        c = F.lower(c)
    return c.asc_nulls_last() if ascending else c.desc_nulls_last()


def sort_rows(
    df: DataFrame, column: str, ascending: bool = True, ties: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    out = df.orderBy(sort_key(df, column, ascending), *[ident(c) for c in ties])
    return out if limit is None else out.limit(limit)


def clamp_page(page: int, page_size: int) -> tuple[int, int]:
    return max(1, page), min(PAGE_ROWS_MAX, max(1, page_size))


def paginate(
    df: DataFrame, order_by: Sequence[str | Column], page: int = 1, page_size: int = PAGE_ROWS,
) -> DataFrame:
    """One page in a fixed order.

    Only the rows up to the page take part in the top-n.  For deep pages use
    :func:`page_after`, which filters on the last key instead of skipping rows.
    """
    page, size = clamp_page(page, page_size)
    keys = [ident(o) if isinstance(o, str) else o for o in order_by]
    return df.orderBy(*keys).offset((page - 1) * size).limit(size)


def page_after(
    df: DataFrame, key: str, last, page_size: int = PAGE_ROWS, descending: bool = False,
) -> DataFrame:
    """The page that follows the row whose unique ``key`` is ``last``; the filter reaches the scan."""
    _, size = clamp_page(1, page_size)
    c = ident(key)
    rest = df if last is None else df.where(c < F.lit(last) if descending else c > F.lit(last))
    return rest.orderBy(c.desc() if descending else c.asc()).limit(size)


def page_count(df: DataFrame, page_size: int = PAGE_ROWS) -> DataFrame:
    """(total, total_pages), at least one page."""
    _, size = clamp_page(1, page_size)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total"), F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint").alias("total_pages")
    )


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    return positions(df, order_by, name=name)


def select_rows(df: DataFrame, order_by: Sequence[str], indices: Sequence[int]) -> DataFrame:
    """Rows at the given 0-based positions of the order, whose columns identify a row.

    Only the order columns are sorted; the few wanted keys then fetch their rows.
    """
    keys = row_index(df.select(*[ident(c) for c in order_by]), order_by, "__index")
    wanted = keys.where(F.col("__index").isin(*indices)).select(
        *[ident(c).alias(f"__o{i}") for i, c in enumerate(order_by)]
    )
    same = F.lit(True)
    for i, c in enumerate(order_by):
        same = same & ident(c).eqNullSafe(F.col(f"__o{i}"))
    # at most one row per wanted position
    return df.join(F.broadcast(wanted), same, "left_semi")


def search_entities(df: DataFrame, columns: Sequence[str], term: str) -> DataFrame:
    """Entities of which one of the name columns contains the trimmed term."""
    return search_rows(df, term.strip(), columns)


def active_entities(
    df: DataFrame, *, deleted: str | None = None, owner: tuple[str, object] | None = None,
    where: dict[str, object] | None = None,
) -> DataFrame:
    """Rows that are not soft-deleted, of one owner, with optional equality filters."""
    if deleted is not None:
        df = df.where(ident(deleted).isNull())
    if owner is not None:
        df = df.where(ident(owner[0]) == F.lit(owner[1]))
    for column, wanted in (where or {}).items():
        if wanted is not None and wanted != "ALL":
            df = df.where(ident(column) == F.lit(wanted))
    return df


def audit_log_page(
    df: DataFrame, time: str, key: str, action: tuple[str, str | None] = ("", None),
    page: int = 1, page_size: int = 50,
) -> DataFrame:
    """Newest entries first, of one action or of all."""
    column, wanted = action
    if wanted is not None:
        df = df.where(ident(column) == wanted)
    return paginate(df, [ident(time).desc(), ident(key).desc()], page, page_size)


def flag_off_topic(df: DataFrame, column: str, name: str = "off_topic") -> DataFrame:
    return df.withColumn(name, contains_any(F.trim(ident(column)), OFF_TOPIC_KEYWORDS))
