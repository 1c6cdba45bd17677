"""Exact quantiles of whole columns without collecting a column anywhere.

A built-in exact percentile keeps every distinct value of a column in the buffer of one
task.  Here that is used only on an interval that is proven small by a count.  To get
there, mergeable sketches propose two values around each wanted rank, and one scan counts
the rows below and up to those values, which either answers the rank or narrows its
interval.  Every scan is one aggregate with a tiny shuffle, the driver holds a few numbers
per column, and a sketch that misses only costs another round: the counts decide.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil, floor, inf

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.operators.columns import CHUNK, aggregate_row, as_double, numbers
from gleanframe.session import local_frame

# rows an interval may hold when its values are picked exactly
PICK_ROWS = 50_000
SKETCH_K = 4096
# about twice the rank error of such a sketch
SKETCH_MARGIN = 0.0015
# tasks that merge the sketches of all scan tasks before the last merge
MERGE_FANOUT = 64


@dataclass
class _Target:
    """A wanted 0-based rank of ``column``, whose value lies between two bounds.

    A bound is (value, whether the value itself belongs to the interval).
    """

    column: str
    rank: int
    below: int               # rows before the interval
    under: int               # rows up to its end
    low: tuple[float, bool] = (-inf, False)
    high: tuple[float, bool] = (inf, False)
    value: float | None = None

    @property
    def inside(self) -> int:
        return self.under - self.below

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high

    def learn(self, value: float, included: bool, rows: int) -> None:
        """Use that ``rows`` rows are below ``value``, or up to it where ``included``."""
        if self.rank < rows:
            # of two bounds at one value the open one is tighter
            if (value, included) < self.high:
                self.high, self.under = (value, included), rows
        elif (value, included) > (self.low[0], not self.low[1]):
            self.low, self.below = (value, not included), rows
        if self.low == (value, True) and self.high == (value, True):
            self.value = value


def _within(interval: tuple) -> Column:
    column, (low, with_low), (high, with_high) = interval
    tests = []
    if low != -inf:
        tests.append(f"{column} {'>=' if with_low else '>'} {low!r}D")
    if high != inf:
        tests.append(f"{column} {'<=' if with_high else '<'} {high!r}D")
    # without a bound only the infinities are outside
    inside = " AND ".join(tests) or f"abs({column}) < double('Infinity')"
    return F.expr(f"IF({inside}, {column}, NULL)")


def _sketch(
    df: DataFrame, values: Sequence[Column], probs: Sequence[Sequence[float]],
    counts: Sequence[Column] = (),
) -> tuple[list[list[float]], list[int]]:
    """Approximate quantiles of each expression, and sums of counts, from one scan.

    Sketches merge in two levels, so no task takes in one sketch per task of a large scan.
    """
    slim = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)], *df.columns)
    part = slim.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_FANOUT)).alias("salt")).agg(
        *[F.kll_sketch_agg_double(f"v{i}", SKETCH_K).alias(f"s{i}") for i in range(len(values))],
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(values))],
        *[c.alias(f"k{i}") for i, c in enumerate(counts)],
    )
    merged = part.agg(
        *[F.kll_merge_agg_double(f"s{i}").alias(f"s{i}") for i in range(len(values))],
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(values))],
        *[F.coalesce(F.sum(f"k{i}"), F.lit(0)).alias(f"k{i}") for i in range(len(counts))],
    )
    row = merged.select(
        *[
            F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(
                f"s{i}", F.array(*[F.lit(float(p)) for p in probs[i]])
            )).alias(f"q{i}") for i in range(len(values))
        ],
        *[f"k{i}" for i in range(len(counts))],
    ).first()
    quantiles = [list(row[f"q{i}"] or []) for i in range(len(values))]
    return quantiles, [row[f"k{i}"] for i in range(len(counts))]


def _around(at: float) -> list[float]:
    return [max(0.0, at - SKETCH_MARGIN), min(1.0, at + SKETCH_MARGIN)]


def _locate(df: DataFrame, targets: list[_Target], pairs: dict[str, list[float]]) -> None:
    """Count the rows up to the first and below the second value of each pair, and tell the targets."""
    asked = sorted({
        (c, v, i % 2 == 0) for c, values in pairs.items() for i, v in enumerate(values)
    })
    row = aggregate_row(df, [
        f"count_if({c} {'<=' if included else '<'} {v!r}D) AS k{i}"
        for i, (c, v, included) in enumerate(asked)
    ])
    for i, (c, v, included) in enumerate(asked):
        for t in targets:
            if t.column == c and t.value is None:
                t.learn(v, included, row[f"k{i}"])


def _pick(df: DataFrame, targets: list[_Target], limit: int) -> None:
    """Answer targets whose interval is small with an exact percentile of its inside."""
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault(t.interval, []).append(t)
    todo = list(groups.items())
    while todo:
        # the buffers of one pass stay within a few intervals of the allowed size
        part, rows = [], 0
        while todo and len(part) < CHUNK and (not part or rows + todo[0][1][0].inside <= 8 * limit):
            part.append(todo.pop(0))
            rows += part[-1][1][0].inside
        used = F.lit(False)
        for interval, _ in part:
            used = used | _within(interval).isNotNull()
        slim = df.where(used).select(*[_within(k).alias(f"v{i}") for i, (k, _) in enumerate(part)])
        exprs = []
        for i, (_, group) in enumerate(part):
            # half a rank beyond the wanted one keeps rounding away from its neighbours
            at = [(t.rank - t.below + 0.5) / t.inside for t in group]
            fractions = ", ".join(f"{a!r}D" for a in at)
            exprs.append(F.expr(
                f"percentile_disc(array({fractions})) WITHIN GROUP (ORDER BY v{i})"
            ).alias(f"q{i}"))
        row = slim.agg(*exprs).first()
        for i, (_, group) in enumerate(part):
            for t, v in zip(group, row[f"q{i}"]):
                t.value = float(v)


def order_statistics(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]],
    hints: Sequence[float], *, limit: int = PICK_ROWS,
) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column its number of values and the values at the 0-based ranks that ``ranks`` names.

    ``ranks`` gets the number of values; ``hints`` are the quantiles those ranks lie at.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    names = {c: f"x{i}" for i, c in enumerate(columns)}
    slim, xs = numbers(df, columns), list(names.values())
    sides = [p for h in hints for p in _around(h)]
    per_pass = max(1, CHUNK // 5)
    proposals: dict[str, list[float]] = {}
    counted: dict[str, tuple[int, int, int]] = {}
    for start in range(0, len(xs), per_pass):
        part = xs[start:start + per_pass]
        finite = [F.when(F.abs(F.col(x)) != inf, F.col(x)) for x in part]
        counts = [
            e for x in part
            for e in (F.count(x), F.count_if(F.col(x) == -inf), F.count_if(F.col(x) == inf))
        ]
        found, sums = _sketch(slim, finite, [sides] * len(part), counts)
        for i, x in enumerate(part):
            proposals[x], counted[x] = found[i], tuple(sums[3 * i:3 * i + 3])
    targets: list[_Target] = []
    for x in xs:
        n, low, high = counted[x]
        for r in sorted(set(ranks(n))) if n else []:
            t = _Target(x, r, low, n - high)
            if r < low:
                t.value = -inf
            elif r >= n - high:
                t.value = inf
            targets.append(t)

    def unsettled(large: bool) -> list[_Target]:
        return [t for t in targets if t.value is None and (t.inside > limit) == large]

    if wide := unsettled(True):
        _locate(slim, wide, {x: proposals[x] for x in {t.column for t in wide}})
    while wide := unsettled(True):
        intervals: dict[tuple, list[float]] = {}
        for t in wide:
            intervals.setdefault(t.interval, []).extend(_around((t.rank - t.below + 0.5) / t.inside))
        found, _ = _sketch(slim, [_within(k) for k in intervals], list(intervals.values()))
        proposed: dict[str, list[float]] = {}
        for (x, _, _), values in zip(intervals, found):
            proposed.setdefault(x, []).extend(values)
        _locate(slim, wide, proposed)
    _pick(slim, unsettled(False), limit)
    return {
        c: (counted[x][0], {t.rank: t.value for t in targets if t.column == x}) for c, x in names.items()
    }


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, limit: int = PICK_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, nulls and NaN left out."""
    probs = [float(p) for p in probs]

    def ranks(n: int) -> list[int]:
        return [r for p in probs for r in (floor(p * (n - 1)), ceil(p * (n - 1)))]

    out: dict[str, list[float | None]] = {}
    for c, (n, values) in order_statistics(df, columns, ranks, probs, limit=limit).items():
        out[c] = []
        for p in probs:
            at = p * (n - 1)
            if not n:
                out[c].append(None)
                continue
            low, high = values[floor(at)], values[ceil(at)]
            out[c].append(low if low == high else (ceil(at) - at) * low + (at - floor(at)) * high)
    return out


def medians(df: DataFrame, columns: Sequence[str], **options) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5], **options).items()}


def upper_medians(df: DataFrame, columns: Sequence[str], **options) -> dict[str, float | None]:
    """The upper of the two middle values where their number is even."""
    got = order_statistics(df, columns, lambda n: [n // 2], [0.5], **options)
    return {c: values.get(n // 2) for c, (n, values) in got.items()}


def quantile_frame(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], **options,
) -> DataFrame:
    """(column, one double per named probability) as a small DataFrame."""
    got = exact_quantiles(df, columns, list(probs.values()), **options)
    schema = "column string, " + ", ".join(f"`{n}` double" for n in probs)
    return local_frame(df.sparkSession, [(c, *got[c]) for c in columns], schema)


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float],
) -> dict[str, list[float | None]]:
    """Sketch answers from one scan, for callers that accept a small rank error."""
    values = [as_double(df, c) for c in columns]
    found, _ = _sketch(df, values, [list(probs)] * len(values))
    return {c: q or [None] * len(probs) for c, q in zip(columns, found)}
