"""Writers, and an order-free fingerprint of a table's content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanframe.operators.clean import comparable
from gleanframe.operators.columns import ident


# timestamps as JSON text, with all digits
_MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; padding inside cells is kept.  An empty text and null are the same empty cell."""
    (
        df.write.option("header", True).option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line, null fields kept."""
    df.select(F.to_json(F.struct(*[ident(c) for c in df.columns]), {
        "ignoreNullFields": "false", "timestampFormat": _MOMENT, "timestampNTZFormat": _MOMENT,
    })).write.text(path)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, checksum): equal for equal rows in any order and partitioning.

    Every row has its SHA-256; four 60-bit parts of it are summed modulo 2^60, so copies
    count and the fold is a plain aggregate.
    """
    cells = F.struct(*[comparable(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    row = F.sha2(F.to_json(cells, {
        "ignoreNullFields": "false", "timestampFormat": _MOMENT, "timestampNTZFormat": _MOMENT,
    }), 256)
    parts = [F.conv(F.substring(row, 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = [
        F.pmod(F.coalesce(F.sum(p), F.lit(0).cast("decimal(30,0)")), F.lit(2**60).cast("decimal(30,0)"))
        for p in parts
    ]
    names = F.concat_ws("|", F.lit(",".join(df.columns)), *[s.cast("decimal(20,0)").cast("string") for s in sums])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(names, 256).alias("checksum"))
