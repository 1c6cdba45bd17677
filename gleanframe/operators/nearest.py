"""Exact nearest neighbours: rows are dealt to the cells of pivots, distance bounds decide which cells a query visits.

A query first searches the cell of its own pivot, which gives it a distance within which its
neighbours must lie.  The triangle inequality then rules out every cell that lies farther away, and
only the others are searched.  Pivots change how much is searched, never the answer.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanframe.functions.text import finite
from gleanframe.operators.columns import as_double, ident
from gleanframe.session import free, local_frame, materialise

# worker functions take their helpers along; executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# numbers in the table of pivots, which travels to every task (16 MB)
PIVOT_NUMBERS = 2_000_000
MOST_PIVOTS = 4096
# rows of a cell, and queries, that one task compares at a time
BLOCK = 4096
# numbers of one matrix of a worker (8 MB)
MATRIX_NUMBERS = 1 << 20
# distances count in billionths, so that the last bits of a sum never decide an order
UNITS = 1e9
# what rounding may add to a distance bound
SLACK = 1e-6

_FOUND = "query_id bigint, id bigint, units double, distance2 double"


@dataclass(frozen=True)
class Cells:
    """Pivots with the number of their rows and the nearest and farthest of them; nothing grows with the table."""

    pivots: np.ndarray
    counts: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of two small matrices, right but for rounding."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _size(vectors: np.ndarray) -> float:
    """The longest of some vectors, which the rounding of their distances grows with."""
    return float(np.sqrt((vectors * vectors).sum(1).max()))


def _at_once(width: int) -> int:
    """Rows of this many numbers that one matrix may have."""
    return max(1, MATRIX_NUMBERS // max(1, width))


def _with_ties(away: np.ndarray) -> np.ndarray:
    """A distance beyond which no row ties with one at the given distance."""
    return np.sqrt(np.square(away) + 2.0 / UNITS)


def _pivots(rows: DataFrame) -> np.ndarray:
    """Rows with the least hashes, as many as the square root of the rows, within fixed sizes."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"), F.min(F.size("vector")).alias("least")).first()
    if not size["n"]:
        return np.zeros((0, 0))
    if size["dim"] != size["least"]:
        raise ValueError("vectors of different lengths")
    many = max(1, min(MOST_PIVOTS, PIVOT_NUMBERS // max(1, size["dim"]), ceil(size["n"] ** 0.5)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").select("vector").limit(many).collect()
    return np.unique(np.array([r["vector"] for r in drawn], dtype=np.float64), axis=0)


def _place(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, vector, cell, reach): each row with its nearest pivot and the distance to it."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            step = _at_once(max(pivots.shape))
            for start in range(0, len(whole), step):
                batch = whole.iloc[start:start + step]
                away = _distances(_matrix(batch["vector"]), pivots)
                cell = away.argmin(1)
                yield batch.assign(cell=cell.astype(np.int32), reach=away[np.arange(len(batch)), cell])

    return rows.mapInPandas(place, "id bigint, vector array<double>, cell int, reach double")


def _bounds(away: np.ndarray, cells: Cells, k: int) -> np.ndarray:
    """Per query a distance within which at least k rows lie, from the sizes of the cells alone."""
    reach = away + cells.farthest[None, :]
    order = reach.argsort(1)
    filled = cells.counts[order].cumsum(1) >= k
    first = filled.argmax(1)
    at = reach[np.arange(len(away)), order[np.arange(len(away)), first]]
    return np.where(filled.any(1), at, np.inf)


def _visits(queries: DataFrame, cells: Cells, k: int, home: bool) -> DataFrame:
    """(query_id, vector, cell): the cells a query has to see, its own or all others its bound leaves."""
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            # the matrix of queries and pivots stays within some megabytes
            step = _at_once(max(cells.pivots.shape))
            for start in range(0, len(whole), step):
                batch = whole.iloc[start:start + step]
                own_vectors = _matrix(batch["vector"])
                away = _distances(own_vectors, cells.pivots)
                own = away.argmin(1)
                if home:
                    q, c = np.arange(len(batch)), own
                else:
                    bound = _with_ties(np.minimum(_bounds(away, cells, k), batch["bound"].fillna(np.inf).to_numpy(np.float64)))
                    scale = _size(own_vectors) + _size(cells.pivots)
                    # rows of a cell lie between its nearest and farthest reach from the pivot
                    least = np.maximum(away - cells.farthest[None, :], cells.nearest[None, :] - away)
                    # and none of them is nearer to the query's pivot than to its own; pivots side by side tell nothing
                    gap = _distances(cells.pivots[own], cells.pivots)
                    edge = (away ** 2 - away[np.arange(len(batch)), own][:, None] ** 2) / np.where(gap > 1e-3 * scale, 2.0 * gap, np.inf)
                    least = np.maximum(least, edge)
                    seen = least <= bound[:, None] + SLACK * scale
                    seen[np.arange(len(batch)), own] = False
                    q, c = np.nonzero(seen)
                names, vectors = batch["query_id"].to_numpy(), batch["vector"].to_numpy()
                # every visit takes its vector along, and a query may see all cells
                some = _at_once(cells.pivots.shape[1])
                for cut in range(0, len(q), some):
                    at = q[cut:cut + some]
                    yield pd.DataFrame({"query_id": names[at], "vector": vectors[at], "cell": c[cut:cut + some].astype(np.int32)})

    return queries.mapInPandas(visit, "query_id bigint, vector array<double>, cell int")


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, added up in the order of the dimensions."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        step = a[:, d] - b[:, d]
        total += step * step
    return total


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int, others: bool) -> pd.DataFrame:
    """The k nearest of a block of rows to each query of a block, ties by id."""
    parts = []
    vectors, ids = _matrix(rows["vector"]), rows["id"].to_numpy()
    # the query itself may be one of the rows
    many = k + 1 if others else k
    step = _at_once(max(vectors.shape))
    for start in range(0, len(queries), step):
        asked = queries.iloc[start:start + step]
        own, names = _matrix(asked["vector"]), asked["query_id"].to_numpy()
        away = _distances(own, vectors)
        if away.shape[1] > many:
            last = np.partition(away, many - 1, axis=1)[:, many - 1]
        else:
            last = np.full(len(own), np.inf)
        # whoever may be among the nearest is measured once more without cancellation
        q, r = np.nonzero(away <= _with_ties(last)[:, None] + SLACK * (_size(own) + _size(vectors)))
        if others:
            apart = names[q] != ids[r]
            q, r = q[apart], r[apart]
        some, found = _at_once(vectors.shape[1]), []
        for cut in range(0, len(q), some):
            cq, cr = q[cut:cut + some], r[cut:cut + some]
            squares = _exact(own[cq], vectors[cr])
            found.append(pd.DataFrame({
                "query_id": names[cq], "id": ids[cr], "units": np.floor(squares * UNITS + 0.5), "distance2": squares,
            }))
        if found:
            # ties leave here, so that a block keeps k rows a query
            nearest_first = pd.concat(found).sort_values(["query_id", "units", "id"], kind="stable")
            parts.append(nearest_first.groupby("query_id", sort=False).head(k))
    if not parts:
        return pd.DataFrame({"query_id": [], "id": [], "units": [], "distance2": []})
    return pd.concat(parts)


def _search(visits: DataFrame, placed: DataFrame, cells: Cells, k: int, others: bool) -> DataFrame:
    """(query_id, id, units, distance2): the k nearest rows of every block of every visited cell.

    A cell is a grid of blocks of rows and of queries, so neither a crowded cell nor a cell that all
    queries visit is one task's work.
    """
    asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    sizes = [(c, ceil(int(cells.counts[c]) / BLOCK), ceil(n / BLOCK)) for c, n in asked.items() if cells.counts[c]]
    # one row per pivot
    grid = F.broadcast(local_frame(placed.sparkSession, sizes, "cell int, row_blocks int, query_blocks int"))
    rows = placed.join(grid, "cell").select(
        "cell", "id", "vector", F.pmod(F.xxhash64("id"), F.col("row_blocks")).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"),
    )
    queries = visits.join(grid, "cell").select(
        "cell", "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb"),
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "units": [], "distance2": []})
        return _best(left, right, k, others)

    keys = ["cell", "rb", "qb"]
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(search, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("units", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(
    rows: DataFrame, queries: DataFrame, k: int, *, id: str = "id", vector: str = "vector", query_id: str = "id", others: bool = False,
) -> DataFrame:
    """(query_id, rank, id, distance2): the k rows at the least distance from each query, ties by smaller id.

    ``others`` leaves out the row whose id is the query's.  Ids are unique whole numbers.  Rows and
    queries whose id or vector is null, empty or has a null or non-finite cell take no part; a query
    has fewer than k rows only if there are no more.  Distances that agree to a billionth are ties.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    sound = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) == F.lit(False)

    def taken(df: DataFrame, key: str) -> DataFrame:
        return df.select(ident(key).cast("bigint").alias("id"), ident(vector).cast("array<double>").alias("vector")).where(
            F.col("id").isNotNull() & (F.size("vector") > 0) & sound
        )

    spark = rows.sparkSession
    usable = taken(rows, id)
    pivots = _pivots(usable)
    nothing = local_frame(spark, [], "query_id bigint, rank int, id bigint, distance2 double")
    if not len(pivots):
        return nothing
    placed = materialise(_place(usable, pivots), "cells")
    counts, low, high = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi")).collect():
        counts[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["lo"], r["hi"]
    cells = Cells(pivots, counts, low, high)
    # one row more makes up for a query that is itself among the rows counted
    enough = k + 1 if others else k
    asked = taken(queries, query_id).withColumnRenamed("id", "query_id")
    near = materialise(_ranked(_search(_visits(asked, cells, enough, True), placed, cells, k, others), k).drop("rank"), "near")
    reached = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance2").alias("most"))
    bounded = asked.join(reached.where(F.col("n") >= k), "query_id", "left").select("query_id", "vector", F.sqrt("most").alias("bound"))
    visits = materialise(_visits(bounded, cells, enough, False), "visits")
    far = _search(visits, placed, cells, k, others)
    best = materialise(_ranked(near.unionByName(far), k).select("query_id", "rank", "id", "distance2"), "nearest")
    free(placed, near, visits)
    return best


def cosine_nearest(
    df: DataFrame, k: int, *, id: str, vector: str, queries: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, id, cosine): the k other rows with the largest cosine, ties by smaller id.

    Vectors of length one are as far apart as their cosine is small, so this is :func:`nearest` on
    them.  Zero vectors take no part.
    """
    def unit(rows: DataFrame) -> DataFrame:
        vec = ident(vector).cast("array<double>")
        length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
        return rows.select(ident(id).alias("id"), vec.alias("v"), length.alias("length")).where("length > 0").select(
            "id", F.transform("v", lambda x: x / F.col("length")).alias("vector")
        )

    found = nearest(unit(df), unit(df if queries is None else queries), k, others=True)
    return found.select("query_id", "rank", "id", (1.0 - F.col("distance2") / 2.0).alias("cosine"))


def impute_knn(df: DataFrame, column: str, features: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """Nulls and NaN of a numeric column filled with its mean over the k nearest rows that have it.

    Distance is Euclidean over the features, each scaled to 0..1 by its range among the rows that have
    all features; a feature without range counts nothing.  Ties go to the smaller ``key``, a unique whole
    number.  A row that lacks a feature gets the mean of the column, a column without values stays null.
    The column comes back as double; every row and every other column stays.
    """
    cell = as_double(df, column)
    points = [finite(as_double(df, f)) for f in features]
    whole = F.lit(True)
    for p in points:
        whole = whole & p.isNotNull()
    ranges = df.agg(
        F.avg(cell).alias("mean"),
        *[e for i, p in enumerate(points) for e in (F.min(F.when(whole, p)).alias(f"lo{i}"), F.max(F.when(whole, p)).alias(f"hi{i}"))],
    ).first()

    def scaled(i: int, p: Column) -> Column:
        low, high = ranges[f"lo{i}"], ranges[f"hi{i}"]
        return F.lit(0.0) if low is None or low == high else (p - low) / F.lit(high - low)

    placed = df.where(whole).select(ident(key).cast("bigint").alias("id"), F.array(*[scaled(i, p) for i, p in enumerate(points)]).alias("vector"), cell.alias("value"))
    donors = placed.where("value IS NOT NULL")
    found = nearest(donors, placed.where("value IS NULL"), k)
    filled = found.join(donors.select("id", "value"), "id").groupBy("query_id").agg(F.avg("value").alias("__near"))
    out = df.withColumn("__cell", cell).withColumn("__key", F.when(F.col("__cell").isNull(), ident(key).cast("bigint")))
    # rows that keep their value have no partner; salted keys would gain nothing, as the key is unique
    kept = out.where("__cell IS NOT NULL").withColumn("__near", F.lit(None).cast("double"))
    joined = out.where("__cell IS NULL").join(filled.withColumnRenamed("query_id", "__key"), "__key", "left")
    both = kept.unionByName(joined)
    return both.select(*[
        F.coalesce("__cell", "__near", F.lit(ranges["mean"]).cast("double")).alias(c) if c == column else ident(c) for c in df.columns
    ])
