"""Attach per-value results to rows, whatever the share of one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from gleanframe.operators.columns import ident

# a lookup of at most this many rows and bytes of text is sent to every executor
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
# a value with more than 1/HOT_SHARE of all rows is salted; there are fewer than HOT_SHARE of them
HOT_SHARE = 1000
SALTS = 64


def _text_bytes(df: DataFrame) -> Column:
    """Bytes of a row beyond its fixed-width cells."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(ident(f.name)), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(ident(f.name))), F.lit(0))
    return total


def attach(
    df: DataFrame, lookup: DataFrame, value: str, *, weight: str = "n",
    broadcast_rows: int = BROADCAST_ROWS, size: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Left join ``lookup`` (unique ``value``, ``weight`` = its rows in ``df``) on ``value``.

    The lookup is measured first, unless its (rows, total weight, bytes of text) are given
    as ``size``.  A small one is broadcast.  A large one is joined by shuffle, and its hot
    values, fewer than ``HOT_SHARE`` by construction, are spread over ``SALTS`` partitions
    on both sides; copies of one whole row share a salt and are left to the skew join.
    """
    payload = [c for c in lookup.columns if c not in (value, weight)]
    right = lookup.select(
        ident(value).alias("__value"), ident(weight).alias("__weight"), *[ident(c) for c in payload]
    )
    rows, total, text = size or right.agg(
        F.count(F.lit(1)), F.sum("__weight"), F.coalesce(F.sum(_text_bytes(right)), F.lit(0))
    ).first()
    if rows <= broadcast_rows and text <= BROADCAST_BYTES:
        joined = df.join(F.broadcast(right), ident(value) == F.col("__value"), "left")
        return joined.drop("__value", "__weight")
    is_hot = F.col("__weight") > F.lit(total / HOT_SHARE)
    hot = right.where(is_hot).select(F.col("__value").alias("__hot"))
    spread = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = right.withColumn("__salt", F.explode(spread)).drop("__weight")
    # the salt follows from the row itself, so a task that runs again repeats it;
    # rows without a value match nothing and spread over all salts
    own_salt = F.pmod(F.xxhash64(*[ident(c) for c in df.columns], F.lit(17)), F.lit(SALTS)).cast("int")
    left = df.join(F.broadcast(hot), ident(value) == F.col("__hot"), "left").withColumn(
        "__own", F.when(F.col("__hot").isNotNull() | ident(value).isNull(), own_salt).otherwise(F.lit(0))
    )
    match = (ident(value) == F.col("__value")) & (F.col("__own") == F.col("__salt"))
    return left.join(salted, match, "left").drop("__value", "__hot", "__own", "__salt")
