"""Nearest neighbours against brute force, with crowded cells, ties, gaps and odd sizes."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from gleanframe.operators import nearest as near

ROWS = "id long, vector array<double>"


def brute(rows, queries, k, others=False):
    out = set()
    for q, a in queries:
        units = sorted(
            (np.floor(sum((x - y) * (x - y) for x, y in zip(a, b)) * near.UNITS + 0.5), i) for i, b in rows if not (others and i == q)
        )
        out |= {(q, rank, i) for rank, (_, i) in enumerate(units[:k], 1)}
    return out


def found(frame):
    return {(r["query_id"], r["rank"], r["id"]) for r in frame.collect()}


def points(seed, n, dim, spread=1.0, shift=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim)) * 10
    return [(i, [float(v) for v in centres[i % 5] + shift + rng.normal(size=dim) * spread]) for i in range(n)]


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_equals_brute_force(spark, shift):
    rows = points(1, 300, 4, shift=shift)
    queries = [(i + 1000, v) for i, v in points(2, 40, 4, 8.0, shift)]
    got = near.nearest(spark.createDataFrame(rows, ROWS), spark.createDataFrame(queries, ROWS), 6)
    assert found(got) == brute(rows, queries, 6)


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(3)
    # a third of the rows are one point, the rest lie on a grid full of ties
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [float(v) for v in rng.integers(0, 6, 2)]) for i in range(240)]
    frame = spark.createDataFrame(rows, ROWS)
    assert found(near.nearest(frame, frame, 5, others=True)) == brute(rows, rows, 5, others=True)


def test_farther_cells_are_left_out(spark):
    rows = spark.createDataFrame(points(4, 400, 3, 0.5), ROWS)
    usable = rows.selectExpr("id", "vector")
    pivots = near._pivots(usable)
    placed = near._place(usable, pivots).toPandas()
    by = placed.groupby("cell")["reach"]
    index = np.arange(len(pivots))
    cells = near.Cells(
        pivots, by.size().reindex(index, fill_value=0).to_numpy(), by.min().reindex(index).to_numpy(), by.max().reindex(index).to_numpy(),
    )
    queries = placed.rename(columns={"id": "query_id"}).assign(bound=0.3)[["query_id", "vector", "bound"]]
    asked = spark.createDataFrame([(int(a), [float(x) for x in v], b) for a, v, b in queries.itertuples(index=False)], "query_id long, vector array<double>, bound double")
    assert near._visits(asked, cells, 1, False).count() < 400 * len(pivots) / 4


def test_rows_that_take_no_part(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (None, [0.0, 0.0]), (7, [])]
    frame = spark.createDataFrame(rows, ROWS)
    assert found(near.nearest(frame, frame, 5)) == {(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)}
    assert found(near.nearest(frame.limit(0), frame, 5)) == set()
    assert found(near.nearest(frame, frame.limit(0), 5)) == set()
    assert found(near.nearest(frame.where("id = 1"), frame.where("id = 1"), 2, others=True)) == set()


def test_bad_arguments(spark):
    frame = spark.createDataFrame([(1, [0.0]), (2, [1.0, 2.0])], ROWS)
    with pytest.raises(ValueError):
        near.nearest(frame, frame, 1)
    with pytest.raises(ValueError):
        near.nearest(frame, frame, 0)


def test_cosine_ignores_length(spark):
    rows = [(1, [2.0, 0.0]), (2, [9.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0]), (6, [-1.0, 0.0])]
    got = near.cosine_nearest(spark.createDataFrame(rows, ROWS), 4, id="id", vector="vector", queries=spark.createDataFrame(rows[:1], ROWS))
    want = [(1, 2, 1.0), (2, 5, 0.5 ** 0.5), (3, 3, 0.0), (4, 6, -1.0)]
    got = sorted((r["rank"], r["id"], r["cosine"]) for r in got.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_imputation(spark):
    rows = [(1, 0.0, 0.0, 10.0), (2, 1.0, 0.0, 20.0), (3, 10.0, 0.0, 90.0), (4, 0.4, 0.0, None), (5, None, 0.0, None), (6, 9.0, None, 40.0), (7, 9.5, 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "k long, a double, flat double, v double")
    got = {r["k"]: r["v"] for r in near.impute_knn(df, "v", ["a", "flat"], "k", 2).collect()}
    # row 5 lacks a feature and takes the mean of the column; row 6 is no donor
    assert got == {1: 10.0, 2: 20.0, 3: 90.0, 4: 15.0, 5: 40.0, 6: 40.0, 7: 55.0}
    plan = near.impute_knn(df, "v", ["a"], "k", 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    none = df.where("k = 5")
    assert near.impute_knn(none, "v", ["a"], "k").collect()[0]["v"] is None
    assert near.impute_knn(df.limit(0), "v", ["a"], "k").columns == df.columns


class Captured:
    """Stands for a DataFrame and gives back the function that its tasks would run."""

    def mapInPandas(self, fn, schema):
        return fn


@pytest.mark.parametrize("width", [2, 64])
def test_workers_hold_some_megabytes_with_the_most_pivots(width):
    draw = np.random.default_rng(3)
    pivots = draw.random((near.MOST_PIVOTS, width))
    batch = pd.DataFrame({"id": range(4000), "vector": list(draw.random((4000, width)))})
    cells = near.Cells(pivots, np.full(len(pivots), 100), np.zeros(len(pivots)), np.full(len(pivots), 9.0))
    asked = batch.rename(columns={"id": "query_id"}).assign(bound=100.0).iloc[:600]
    row = pd.DataFrame({"id": range(4096), "vector": [np.ones(width)] * 4096})

    def peak(run):
        tracemalloc.start()
        got = run()
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return got, most

    placed, most = peak(lambda: pd.concat(near._place(Captured(), pivots)(iter([batch]))))
    assert most < 150 and len(placed) == 4000 and placed["id"].tolist() == list(range(4000))
    away = near._distances(np.stack(batch["vector"].to_numpy()), pivots)
    # a batch of another length may change the last bits of a distance, never by more than this
    assert np.abs(placed["reach"].to_numpy() - away.min(1)).max() < 1e-6
    del away

    def visits():
        return sum(near._at_once(width) >= len(f) and len(f) for f in near._visits(Captured(), cells, 5, False)(iter([asked])))

    seen, most = peak(visits)
    assert most < 150 and seen == 600 * (len(pivots) - 1)
    # all rows tie for all queries
    best, most = peak(lambda: near._best(row.rename(columns={"id": "query_id"}).iloc[:2000], row, 5, True))
    assert most < 300 and len(best) == 10_000
