"""Positions and running counts in a global order, with no task holding a whole group.

Rows are range-partitioned on (group, order), so a group that holds a third of the
table spreads over many partitions.  Each partition numbers its own rows, and the
counts of the partitions before it (one row per partition and group) shift them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanframe.operators.columns import ident
from gleanframe.session import materialise

_SLOT, _SLICE = "__slot", "__slice"
# rows of a group whose values one buffer may hold
GROUP_ROWS = 50_000
# monotonically_increasing_id keeps the partition number above this bit
_SLOT_BITS = 33


def _sliced(df: DataFrame, by: Sequence[str], order: Sequence[Column], label: str) -> DataFrame:
    """Globally sorted rows with their slot, written once so that every use sees one layout."""
    keys = [*[ident(c) for c in by], *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    slotted = ordered.withColumn(_SLOT, F.monotonically_increasing_id())
    return materialise(slotted, label).withColumn(
        _SLICE, F.shiftright(_SLOT, _SLOT_BITS).cast("int")
    )


def _slice_starts(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each slice within its group; a group has one row per slice."""
    w = Window.partitionBy(*[ident(c) for c in by] or [F.lit(0)]).orderBy(_SLICE)
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return spans.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", total)


def positions(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "position",
) -> DataFrame:
    """Add the 0-based position of each row within its ``by`` group.

    ``order`` has to be unique within a group for a repeatable result.
    """
    order = [ident(o) if isinstance(o, str) else o for o in order]
    rows = _sliced(df, by, order, "positions")
    spans = rows.groupBy(*[ident(c) for c in by], _SLICE).agg(
        F.min(_SLOT).alias("first"), F.count(F.lit(1)).alias("n")
    )
    starts = _slice_starts(spans, by).select(
        *[ident(c).alias(f"__by{i}") for i, c in enumerate(by)],
        F.col(_SLICE).alias("__in"), "first", "before",
    )
    match = F.col(_SLICE) == F.col("__in")
    for i, c in enumerate(by):
        match = match & ident(c).eqNullSafe(F.col(f"__by{i}"))
    if not by:
        # one row per partition of the sort
        starts = F.broadcast(starts)
    return rows.join(starts, match).select(
        *[ident(c) for c in df.columns],
        (F.col("before") + F.col(_SLOT) - F.col("first")).alias(name),
    )


def running_sums(
    df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str],
) -> DataFrame:
    """Add ``before_x`` and ``total_x`` for every column ``x`` of ``sums``.

    ``order`` has to be unique within a ``by`` group; ``before`` covers the rows of the
    group that come earlier.
    """
    keys = [ident(c) for c in by]
    rows = _sliced(df, by, [ident(order)], "running-sums")
    spans = rows.groupBy(*keys, _SLICE).agg(*[F.sum(ident(s)).alias(f"__n_{s}") for s in sums])
    across = Window.partitionBy(*keys or [F.lit(0)])
    earlier = across.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(
        *[ident(c).alias(f"__by{i}") for i, c in enumerate(by)],
        F.col(_SLICE).alias("__in"),
        *[F.coalesce(F.sum(f"__n_{s}").over(earlier), F.lit(0)).alias(f"__before_{s}") for s in sums],
        *[F.sum(f"__n_{s}").over(across).alias(f"total_{s}") for s in sums],
    )
    local = (
        Window.partitionBy(*keys, _SLICE).orderBy(ident(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    match = F.col(_SLICE) == F.col("__in")
    for i, c in enumerate(by):
        match = match & (ident(c) == F.col(f"__by{i}"))
    if not by:
        # one row per partition of the sort
        starts = F.broadcast(starts)
    numbered = rows.select("*", *[F.sum(ident(s)).over(local).alias(f"__within_{s}") for s in sums])
    return numbered.join(starts, match).select(
        *[ident(c) for c in df.columns],
        *[
            (F.col(f"__before_{s}") + F.col(f"__within_{s}") - ident(s)).alias(f"before_{s}")
            for s in sums
        ],
        *[f"total_{s}" for s in sums],
    )


def running_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by…, value, n, before, total): one row per distinct value of a group.

    ``before`` counts the rows with a smaller value, ``total`` all rows of the group.
    Copies are counted before the sort, so a hot value is a single row in it.
    """
    keys = [ident(c) for c in by]
    counted = (
        df.where(ident(value).isNotNull()).groupBy(*keys, ident(value))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return running_sums(counted, by, value, ["n"]).withColumnsRenamed(
        {"before_n": "before", "total_n": "total"}
    )


def _ranked_quantiles(rows: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles per group from running counts over the global order of (group, value)."""
    aggs, outs = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(hit, ident(value))).alias(f"{name}_{side}"))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        # as the built-in percentile interpolates, infinities included
        between = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
        outs.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    keys = [ident(c) for c in by]
    counted = running_counts(rows, by, value)
    return counted.groupBy(*keys).agg(F.max("total").alias("total"), *aggs).select(*keys, *outs)


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], *, limit: int = GROUP_ROWS,
) -> DataFrame:
    """(by…, one interpolated quantile per name), exact, for groups of any size.

    Groups are counted first.  Those of at most ``limit`` rows fit the buffer of the built-in
    percentile; larger ones are sorted across partitions.  Null groups are left out.
    """
    keys = [ident(c) for c in by]
    rows = df.select(*keys, ident(value).cast("double").alias(value)).dropna()
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*keys)
    wanted = F.percentile(ident(value), F.array(*[F.lit(float(p)) for p in probs.values()])).alias("__q")

    def picked(some: DataFrame) -> DataFrame:
        return some.groupBy(*keys).agg(wanted).select(
            *keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)]
        )

    if large.isEmpty():
        return picked(rows)
    large = materialise(large, "large-groups")
    return picked(rows.join(large, list(by), "left_anti")).unionByName(
        _ranked_quantiles(rows.join(large, list(by), "left_semi"), by, value, probs)
    )


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False,
) -> DataFrame:
    """One row per key: the first (or last) in ``order``, ties by the other columns.

    A minimum over structs combines before the shuffle, so a key with many copies
    never lands in one task as a window partition would.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[ident(c) for c in [*order, *rest]])
    picked = (F.max if descending else F.min)(packed).alias("__row")
    got = df.groupBy(*[ident(c) for c in keys]).agg(picked)
    return got.select(*[
        ident(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns
    ])
