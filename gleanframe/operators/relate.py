"""Correlations, driver scenarios and cohort uplift."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanframe.functions.stats import correlation_strength
from gleanframe.functions.text import finite
from gleanframe.operators.columns import (
    CHUNK, aggregate_row, as_double, categorical_columns, ident, numbers, numeric_columns,
)
from gleanframe.session import local_frame, materialise

# worker functions travel whole, so the package need not be installed on the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_PAIRS = 15
# columns beyond which pairs are summed as matrix products, in one scan
WIDE = 40
# rows of partial sums that one group adds up
MERGED = 32
# rows of equal values that a task holds at a time
RUN_ROWS = 1 << 17


def _pair_frame(df: DataFrame, pairs: Sequence[tuple[str, str]], exprs: Sequence[Column]) -> DataFrame:
    """(col1, col2, r): one aggregate expression per pair, in one scan per chunk."""
    frames, width = [], CHUNK // 3
    for start in range(0, len(pairs), width):
        part = list(zip(pairs, exprs))[start:start + width]
        wide = df.agg(*[e.alias(f"r{i}") for i, (_, e) in enumerate(part)])
        rows = [
            F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.col(f"r{i}").alias("r"))
            for i, ((a, b), _) in enumerate(part)
        ]
        frames.append(wide.select(F.inline(F.array(*rows))))
    if not frames:
        return local_frame(df.sparkSession, [], "col1 string, col2 string, r double")
    return reduce(DataFrame.unionByName, frames)


def _finite_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as x0, x1, … with infinities taken for missing, as a coefficient cannot use them."""
    return numbers(df, columns).select(*[finite(F.col(f"x{i}")).alias(f"x{i}") for i in range(len(columns))])


def _wide_pairs(slim: DataFrame, columns: list[str], centres: list[float], fixed: set[int]) -> DataFrame:
    """Every pair's coefficient from one scan: each task sums matrix products of its rows.

    Row i of a task's sums holds, against every column j, the rows both have, and the sums of
    x_i, x_j, their squares and their product over these rows.  They are added up in levels, so
    that no group has more than ``MERGED`` such rows however many tasks there are.
    """
    k, names = len(columns), ["n", "sx", "sy", "sxx", "syy", "sxy"]
    schema = "part bigint, i int, " + ", ".join(f"{c} array<double>" for c in names)

    def frame(part: int, rows: Sequence[int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([part] * len(rows), pa.int64()), pa.array(rows, pa.int32()), *[pa.array(t.tolist(), pa.list_(pa.float64())) for t in total],
        ], names=["part", "i", *names])

    def sums(batches):
        total = np.zeros((len(names), k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)
            here = np.isfinite(x)
            x, m = np.where(here, x - centres, 0.0), here.astype(float)
            first, square = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, first, first.T, square, square.T, x.T @ x])
        yield frame(TaskContext.get().partitionId(), range(k), total)

    def added(group: pa.Table) -> np.ndarray:
        return np.stack([np.array(group.column(c).to_pylist()).sum(0) for c in names])

    def merge(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([frame(group.column("part")[0].as_py() // MERGED, [group.column("i")[0].as_py()], added(group)[:, None])])

    def finish(group: pa.Table) -> pa.Table:
        i = group.column("i")[0].as_py()
        n, sx, sy, sxx, syy, sxy = added(group)
        with np.errstate(all="ignore"):
            left, right = sxx - sx * sx / n, syy - sy * sy / n
            r = (sxy - sx * sy / n) / np.sqrt(left * right)
        later = [j for j in range(i + 1, k)]
        fine = [None if j in fixed or i in fixed or not np.isfinite(r[j]) else float(r[j]) for j in later]
        return pa.table({
            "col1": pa.array([columns[i]] * len(later), pa.string()), "col2": pa.array([columns[j] for j in later], pa.string()),
            "r": pa.array(fine, pa.float64()),
        })

    return merged_levels(slim.mapInArrow(sums, schema), scan_tasks(slim), merge, schema).groupBy("i").applyInArrow(
        finish, "col1 string, col2 string, r double",
    )


def scan_tasks(df: DataFrame) -> int:
    """Number of tasks that read ``df``."""
    return df.rdd.getNumPartitions()


def merged_levels(sums: DataFrame, tasks: int, merge, schema: str) -> DataFrame:
    """Rows of (part, i, …), one per task and i, merged until at most ``MERGED`` parts are left.

    ``merge`` makes one row of a group's, with the part ``part // MERGED``.
    """
    while tasks > MERGED:
        sums = sums.groupBy("i", F.floor(F.col("part") / MERGED).alias("level")).applyInArrow(merge, schema)
        tasks = -(-tasks // MERGED)
    return sums


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col1, col2, r) for each pair of numeric columns, over the rows where both have a value.

    Columns without nulls are centred on their mean first, so that a pair costs one plain
    sum; a pair with nulls has its own means and takes the general form.
    """
    columns = list(columns or numeric_columns(df))
    slim = _finite_numbers(df, columns)
    row = aggregate_row(slim, ["count(1) AS rows", *[
        e for i in range(len(columns)) for e in (
            f"count(x{i}) AS n{i}", f"avg(x{i}) AS mean{i}", f"min(x{i}) < max(x{i}) AS varies{i}",
        )
    ]])
    n = row["rows"]
    full = {i for i in range(len(columns)) if row[f"n{i}"] == n and row[f"varies{i}"]}
    fixed = {i for i in range(len(columns)) if not row[f"varies{i}"]}
    centred = slim.selectExpr("*", *[f"x{i} - {row[f'mean{i}']!r}D AS d{i}" for i in sorted(full)])
    pairs = list(combinations(range(len(columns)), 2))
    if len(columns) > WIDE:
        centres = [row[f"mean{i}"] or 0.0 for i in range(len(columns))]
        return _wide_pairs(slim, columns, centres, fixed)

    def r(i: int, j: int) -> str:
        if i in fixed or j in fixed:
            return "CAST(NULL AS DOUBLE)"
        if i in full and j in full:
            # the products with the sums take away what rounding left of the means
            def moment(a: int, b: int) -> str:
                return f"(sum(d{a} * d{b}) - sum(d{a}) * sum(d{b}) / {n})"
            return f"try_divide({moment(i, j)}, sqrt({moment(i, i)} * {moment(j, j)}))"
        return f"try_divide(regr_sxy(x{j}, x{i}), sqrt(regr_sxx(x{j}, x{i}) * regr_syy(x{j}, x{i})))"

    return _pair_frame(
        centred, [(columns[i], columns[j]) for i, j in pairs], [F.expr(r(i, j)) for i, j in pairs]
    )


_RANKED = "row bigint, key int, slice int, lo bigint, len bigint, edge double"


def _local_ranks(batches):
    """Sorted cells (key, value, row) of one slice: where the run of a cell's value starts within its key, and its length.

    Runs that touch a border of the slice's share of a key carry their value, as they may go on beyond it.  A run
    of more than ``RUN_ROWS`` comes in pieces that carry it too, so that a task holds no more than that and a batch.
    """
    part = TaskContext.get().partitionId()
    held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
    # the key of the last row given out, the rows of its share so far, and the value if its run is cut
    at, done, cut = None, 0, None

    def ranked(key, value, row, last):
        """Rows of whole runs, the last of which ends its share or its piece if ``last``."""
        nonlocal at, done, cut
        starts, ends = (np.array(x) for x in zip(*_runs(key, value)))
        first, after = (np.array(x) for x in zip(*_runs(key)))
        share = np.searchsorted(first, starts, "right") - 1
        base = np.where((share == 0) & (key[0] == at), done, 0)
        lo = base + starts - first[share]
        # a share ends where the next row has another key
        edge = (lo == 0) | ((ends == after[share]) & (last | (share < len(first) - 1)))
        edge[0] |= cut is not None and (key[0], value[0]) == cut
        of = np.repeat(np.arange(len(starts)), ends - starts)
        at, done = key[-1], int(lo[-1] + ends[-1] - starts[-1])
        for a in range(0, len(row), 1 << 16):
            some = of[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([
                pa.array(row[a:a + (1 << 16)]), pa.array(key[a:a + (1 << 16)], pa.int32()), pa.array(np.full(len(some), part), pa.int32()),
                pa.array(lo[some]), pa.array((ends - starts)[some]), pa.array(value[starts][some], mask=~edge[some]),
            ], names=["row", "key", "slice", "lo", "len", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        key, value, row = held
        # the last run may go on in the next batch
        start = _runs(key, value)[-1][0]
        if start:
            yield from ranked(key[:start], value[:start], row[:start], key[start] != key[start - 1])
            cut = None
        held = [h[start:] for h in held]
        if len(held[0]) > RUN_ROWS:
            yield from ranked(*held, True)
            cut, held = (held[0][0], held[1][0]), [h[:0] for h in held]
    if len(held[0]):
        yield from ranked(*held, True)


def average_ranks(cells: DataFrame) -> DataFrame:
    """(row, key, rank) of (key, value, row): 1-based average ranks of the values of every key.

    All keys go through one range sort, which splits a value with any share of the rows.  A task
    ranks its own range batch by batch; what lies before it, and runs that cross a border, are told
    by at most two rows per range and key and one per ``RUN_ROWS`` of a long run.
    """
    order = ["key", "value", "row"]
    runs = materialise(
        cells.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_local_ranks, _RANKED), "rank-runs",
    )
    spans = runs.groupBy("key", "slice").agg(F.max(F.col("lo") + F.col("len")).alias("n"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("key", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    borders = runs.where("edge IS NOT NULL").groupBy("key", "slice", "lo").agg(F.max("len").alias("len"), F.max("edge").alias("edge"))
    run = Window.partitionBy("key", "edge")
    borders = borders.join(spans, ["key", "slice"]).select(
        "key", "slice", "lo", F.min(F.col("before") + F.col("lo")).over(run).alias("base"), F.sum("len").over(run).alias("all"),
    )
    known = runs.join(F.broadcast(spans), ["key", "slice"]).join(F.broadcast(borders), ["key", "slice", "lo"], "left")
    start, length = F.coalesce("base", F.col("before") + F.col("lo")), F.coalesce("all", "len")
    return known.select("row", "key", (start + (length + 1) / 2).alias("rank"))


def spearman_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rank correlation with average ranks, over the rows where both have a value.

    Cells of all columns are ranked in one sort and brought back to their rows in one grouping.
    A column without nulls has the same ranks in every pair; only a partner with nulls asks for
    ranks among the rows it shares.
    """
    columns = list(columns or numeric_columns(df))
    places = range(len(columns))
    pairs = list(combinations(places, 2))
    if not pairs:
        return _pair_frame(df, [], [])
    slim = materialise(_finite_numbers(df, columns).withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    row = aggregate_row(slim, ["count(1) AS rows", *[
        e for i in places for e in (f"count(x{i}) AS n{i}", f"coalesce(min(x{i}) < max(x{i}), false) AS varies{i}")
    ]])
    gappy = {i for i in places if row[f"n{i}"] < row["rows"]}

    def needed(i: int, partner: int) -> str:
        return f"r{i}_{partner}" if partner in gappy else f"r{i}"

    sources = {}
    for i, j in pairs:
        for a, b in ((i, j), (j, i)):
            sources[needed(a, b)] = f"IF(x{b} IS NULL, NULL, x{a})" if b in gappy else f"x{a}"
    # adding zero makes one of both zeros
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(f"{e} + 0D").alias("value")) for k, e in enumerate(sources.values())])
    ranks = average_ranks(slim.select("row", F.explode(cells).alias("c")).select("c.key", "c.value", "row").where("value IS NOT NULL"))
    ranked = ranks.groupBy("row").agg(*[F.expr(f"max(IF(key = {k}, rank, NULL))").alias(name) for k, name in enumerate(sources)])
    if len(pairs) > CHUNK // 3:
        # the products take more than one scan
        ranked = materialise(ranked, "ranks")
    if not gappy and len(columns) > WIDE:
        fixed = {i for i in places if not row[f"varies{i}"]}
        return _wide_pairs(ranked.select(*[f"r{i}" for i in places]), columns, [row["rows"] / 2] * len(columns), fixed)

    def r(i: int, j: int) -> str:
        a, b = needed(i, j), needed(j, i)
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        # ranks run from 1 to the number of rows, so half of that is a good centre
        dx, dy = [f"IF({both}, {k} - {row['rows'] / 2!r}D, NULL)" for k in (a, b)]

        def moment(a: str, b: str) -> str:
            return f"(sum({a} * {b}) - try_divide(sum({a}) * sum({b}), count({dx})))"
        varies = f"min({dx}) < max({dx}) AND min({dy}) < max({dy})"
        return f"IF({varies}, try_divide({moment(dx, dy)}, sqrt({moment(dx, dx)} * {moment(dy, dy)})), NULL)"

    return _pair_frame(
        ranked, [(columns[i], columns[j]) for i, j in pairs], [F.expr(r(i, j)) for i, j in pairs]
    )


def weighted_inversions(keys: np.ndarray, n: np.ndarray) -> int:
    """Sum of n_i * n_j over all i < j with keys_i > keys_j, by merging ever longer sorted runs."""
    m, total = len(keys), 0
    if m < 2:
        return 0
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    # products that could leave 64 bits are summed as Python integers
    kind = np.int64 if int(n.sum()) < 1 << 31 else object
    place, width, n = np.arange(m), 1, n.astype(np.int64)
    while width < m:
        pair = place // (2 * width)
        left = place // width % 2 == 0
        order = np.argsort(pair * m + rank, kind="stable")
        rank, n, left = rank[order], n[order], left[order]
        smaller = np.cumsum(np.where(left, n, 0))
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        before = np.concatenate([[0], smaller])[first]
        all_left = smaller[np.append(first[1:], m) - 1] - before
        greater = np.where(left, 0, all_left[pair] - (smaller - before[pair]))
        total += int((greater.astype(kind) * n.astype(kind)).sum())
        width *= 2
    return total


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of every run of rows equal in all keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], len(new)]))


_COUNTED = "pair int, slot bigint, n bigint, bucket int, inversions string"


def _in_buckets(batches):
    """Rows of one range of (y, x), in this order: the bucket of each, and the inversions of their places by (x, y)."""
    bucket, batches = TaskContext.get().partitionId(), list(batches)
    if not batches:
        return
    pair, slot, n = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(3))
    del batches
    for a, b in _runs(pair):
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(pair[a:b], pair[a]), pa.int32()), pa.array(np.append(slot[a:b], 0), pa.int64(), mask=np.arange(b - a + 1) == b - a),
            pa.array(np.append(n[a:b], 0)), pa.array(np.full(b - a + 1, bucket), pa.int32()),
            pa.array([None] * (b - a) + [str(weighted_inversions(slot[a:b], n[a:b]))], pa.string()),
        ], names=["pair", "slot", "n", "bucket", "inversions"])


_CELLS = "pair int, slice int, bucket int, n bigint, inversions string"


def _in_slices(batches):
    """Rows of whole slices by their place: rows per bucket, and the inversions of buckets within each slice."""
    batches = list(batches)
    if not batches:
        return
    pair, part, bucket, n = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1, 3, 4))
    del batches
    for a, b in _runs(part, pair):
        buckets, at = np.unique(bucket[a:b], return_inverse=True)
        rows = np.zeros(len(buckets), np.int64)
        np.add.at(rows, at, n[a:b])
        k = len(buckets) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(k, pair[a]), pa.int32()), pa.array(np.full(k, part[a]), pa.int32()),
            pa.array([*buckets.tolist(), None], pa.int32()), pa.array([*rows.tolist(), 0], pa.int64()),
            pa.array([None] * (k - 1) + [str(weighted_inversions(bucket[a:b], n[a:b]))], pa.string()),
        ], names=["pair", "slice", "bucket", "n", "inversions"])


def _discordant(counted: DataFrame) -> DataFrame:
    """(pair, d): discordant rows of (pair, x, y, n), the rows of each distinct (x, y).

    In the order of (x, y), a discordant pair is an inversion of the order of (y, x); ties are
    none, as both orders agree on them.  The first order is cut into slices, the second into
    buckets, ranges that split a value with any share of the rows.  Inversions within a bucket, and
    between buckets within a slice, are counted by merging in one task each; what is left lies in
    different slices and buckets, for which the rows per (slice, bucket) are enough.
    """
    order, across = ["pair", "x", "y"], ["pair", "y", "x"]
    placed = materialise(
        counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slot", F.monotonically_increasing_id()),
        "kendall-order",
    )
    bucketed = placed.repartitionByRange(*across).sortWithinPartitions(*across).select("pair", "slot", "n")
    bucketed = materialise(bucketed.mapInArrow(_in_buckets, _COUNTED), "kendall-buckets")
    inside = bucketed.where("inversions IS NOT NULL").select("pair", F.col("inversions").cast("decimal(38,0)").alias("d"))
    rows = bucketed.where("inversions IS NULL").select("pair", F.shiftright("slot", 33).cast("int").alias("slice"), "slot", "bucket", "n")
    cells = materialise(
        rows.repartition("slice").sortWithinPartitions("slice", "slot").mapInArrow(_in_slices, _CELLS), "kendall-cells",
    )
    within = cells.where("inversions IS NOT NULL").select("pair", F.col("inversions").cast("decimal(38,0)").alias("d"))
    cells = cells.where("inversions IS NULL").select("pair", "slice", "bucket", "n")
    # every (slice, bucket) of a pair: the squared number of partitions, whatever the rows
    spine = cells.select("pair", "slice").distinct().join(cells.select("pair", "bucket").distinct(), "pair")
    dense = spine.join(cells, ["pair", "slice", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("decimal(19,0)"))
    earlier = Window.partitionBy("pair", "bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("pair", "slice").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    grid = dense.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("decimal(19,0)")).withColumn(
        "greater", F.coalesce(F.sum("before").over(above), F.lit(0)).cast("decimal(19,0)"),
    ).select("pair", (F.col("greater") * F.col("n")).cast("decimal(38,0)").alias("d"))
    return inside.unionByName(within).unionByName(grid).groupBy("pair").agg(F.sum("d").cast("double").alias("d"))


def kendall_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col1, col2, r): tau-b of every pair of numeric columns, exact, without forming pairs of rows.

    All pairs of columns go through the same few sorts.
    """
    columns = list(columns or numeric_columns(df))
    places = list(combinations(range(len(columns)), 2))
    schema = "col1 string, col2 string, r double"
    if not places:
        return local_frame(df.sparkSession, [], schema)
    slim = _finite_numbers(df, columns)
    cells = F.array(*[
        F.struct(F.lit(k).alias("pair"), F.col(f"x{i}").alias("x"), F.col(f"x{j}").alias("y")) for k, (i, j) in enumerate(places)
    ])
    counted = materialise(
        slim.select(F.explode(cells).alias("c")).select("c.*").dropna().groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")),
        "kendall-rows",
    )

    def ties(by: list[str], name: str) -> DataFrame:
        n = F.col("n").cast("decimal(19,0)")
        groups = counted.groupBy("pair", *by).agg(F.sum("n").alias("n")) if by != ["x", "y"] else counted
        return groups.groupBy("pair").agg((F.sum(n * (n - 1)).cast("double") / 2).alias(name), F.sum("n").alias(f"rows_{name}"))

    found = ties(["x"], "tie_x").join(ties(["y"], "tie_y"), "pair").join(ties(["x", "y"], "tie_xy"), "pair").join(
        _discordant(counted), "pair", "left",
    )
    total = F.col("rows_tie_x") * (F.col("rows_tie_x") - F.lit(1.0)) / 2
    base = F.sqrt((total - F.col("tie_x")) * (total - F.col("tie_y")))
    concordant_less = total - F.col("tie_x") - F.col("tie_y") + F.col("tie_xy") - 2 * F.coalesce("d", F.lit(0.0))
    tau = {r["pair"]: r["r"] for r in found.select("pair", F.try_divide(concordant_less, base).alias("r")).collect()}
    # one row per pair of columns
    return local_frame(df.sparkSession, [(columns[i], columns[j], tau.get(k)) for k, (i, j) in enumerate(places)], schema)


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """(col1, col2, r): tau-b of two columns."""
    return kendall_pairs(df, [a, b])


METHODS = {"pearson": pearson_pairs, "spearman": spearman_pairs, "kendall": kendall_pairs}


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", digits: int = 4,
) -> DataFrame:
    """(col1, col2, r) for every ordered pair; the diagonal is 1, or null without variation."""
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return local_frame(df.sparkSession, [], "col1 string, col2 string, r double")
    pairs = METHODS[method](df, columns)
    flipped = F.array(
        F.struct(F.col("col1"), F.col("col2")), F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2"))
    )
    both = pairs.select(F.explode(flipped).alias("p"), "r").select("p.col1", "p.col2", "r")
    diagonal = _pair_frame(
        numbers(df, columns), [(c, c) for c in columns],
        [F.expr(f"IF(min(x{i}) < max(x{i}), 1.0D, NULL)") for i in range(len(columns))],
    )
    return both.unionByName(diagonal).select("col1", "col2", F.round("r", digits).alias("r"))


def ranked_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", *,
    at_least: float = 0.0, top: int | None = TOP_PAIRS, digits: int = 4, pairs: DataFrame | None = None,
) -> DataFrame:
    """Pairs by falling |r| with their strength; undefined pairs are left out.

    ``pairs`` hands in coefficients that are known already.
    """
    r = F.round("r", digits)
    out = (pairs if pairs is not None else METHODS[method](df, columns)).where(
        F.col("r").isNotNull() & (F.abs("r") >= at_least)
    ).select(
        "col1", "col2", r.alias("value"), F.abs(r).alias("abs_value"),
        correlation_strength(r).alias("strength"),
    )
    if top is None:
        return out
    return out.orderBy(F.desc("abs_value"), "col1", "col2").limit(top)


def driver_scenario(
    df: DataFrame, columns: Sequence[str] | None = None, at_least: float = 0.45, top: int = 4,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """For the strongest pairs: the line col2 on col1 and the effect of col1 rising by 10 %."""
    columns = list(columns or numeric_columns(df))
    slim = df.select(*[as_double(df, c).alias(c) for c in columns])
    found = ranked_pairs(df, columns, at_least=at_least, top=top, digits=3, pairs=pairs).collect()
    schema = (
        "col1 string, col2 string, r double, r_squared double, slope double, intercept double, "
        "mean1 double, mean2 double, std1 double, std2 double, scenario double, predicted double, "
        "delta_pct double"
    )
    if not found:
        return local_frame(df.sparkSession, [], schema)
    frames = []
    for p in found:
        x, y = ident(p["col1"]), ident(p["col2"])
        fits = F.regr_count(y, x) >= 3
        frames.append(F.struct(
            F.lit(p["col1"]).alias("col1"), F.lit(p["col2"]).alias("col2"), F.lit(p["value"]).alias("r"),
            F.when(fits, F.try_divide(F.regr_sxy(y, x), F.regr_sxx(y, x))).alias("slope"),
            F.when(fits, F.regr_intercept(y, x)).alias("intercept"),
            F.avg(x).alias("mean1"), F.avg(y).alias("mean2"),
            F.stddev_samp(x).alias("std1"), F.stddev_samp(y).alias("std2"),
        ))
    wide = slim.agg(*[f.alias(f"p{i}") for i, f in enumerate(frames)])
    rows = wide.select(F.explode(F.array(*[f"p{i}" for i in range(len(frames))])).alias("p")).select("p.*")
    rounded = rows.select(
        "col1", "col2", "r", F.round(F.col("r") * F.col("r"), 3).alias("r_squared"),
        F.round(F.coalesce("slope", F.lit(0.0)), 4).alias("slope"),
        F.round(F.coalesce("intercept", F.lit(0.0)), 4).alias("intercept"),
        *[F.round(c, 2).alias(c) for c in ("mean1", "mean2", "std1", "std2")],
    ).withColumn("scenario", F.round(F.col("mean1") * 1.10, 2)).withColumn(
        "predicted", F.round(F.col("intercept") + F.col("slope") * F.col("scenario"), 2)
    )
    base = F.greatest(F.abs("mean2"), F.lit(1e-9))
    return rounded.withColumn(
        "delta_pct", F.round((F.col("predicted") - F.col("mean2")) / base * 100, 1)
    )


def cohort_uplift(
    df: DataFrame, categories: Sequence[str] | None = None, metric: str | None = None,
    report_gap: float | None = 15.0,
) -> DataFrame:
    """Best against worst segment of up to two categories; small segments are left out.

    ``report_gap=None`` keeps every category with two large enough segments.
    """
    categories = list(categories if categories is not None else categorical_columns(df)[:2])
    numeric = numeric_columns(df)
    schema = (
        "category string, metric string, top_segment string, top_mean double, bottom_segment string, "
        "bottom_mean double, overall_mean double, segments bigint, gap_pct double, priority string"
    )
    if not categories or not (metric or numeric):
        return local_frame(df.sparkSession, [], schema)
    metric = metric or numeric[0]
    value = as_double(df, metric)
    base = df.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).first()
    least = max(3, int(base["n"] * 0.03))
    cells = [
        F.struct(F.lit(c).alias("category"), ident(c).cast("string").alias("segment")) for c in categories
    ]
    means = (
        df.select(value.alias("value"), F.explode(F.array(*cells)).alias("c"))
        .select("c.category", "c.segment", "value").where(F.col("segment").isNotNull())
        .groupBy("category", "segment").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
        .where((F.col("n") >= least) & F.col("mean").isNotNull())
    )
    # at most 33 segments of a category hold 3 % of the rows each
    ends = means.groupBy("category").agg(
        F.min(F.struct((-F.col("mean")).alias("m"), "segment")).alias("top"),
        F.min(F.struct(F.col("mean").alias("m"), "segment")).alias("bottom"),
        F.count(F.lit(1)).alias("segments"),
    ).where(F.col("segments") >= 2)
    floor_ = F.greatest(F.abs("bottom.m"), F.lit(1e-6))
    gap = F.round((-F.col("top.m") - F.col("bottom.m")) / floor_ * 100, 1)
    out = ends.select(
        "category", F.lit(metric).alias("metric"), F.col("top.segment").alias("top_segment"),
        F.round(-F.col("top.m"), 2).alias("top_mean"), F.col("bottom.segment").alias("bottom_segment"),
        F.round("bottom.m", 2).alias("bottom_mean"),
        F.round(F.lit(base["mean"]).cast("double"), 2).alias("overall_mean"), "segments",
        gap.alias("gap_pct"),
    ).withColumn("priority", F.when(F.col("gap_pct") > 30, "high").otherwise("medium"))
    return out if report_gap is None else out.where(F.col("gap_pct") > report_gap)
