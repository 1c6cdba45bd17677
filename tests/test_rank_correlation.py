"""Rank correlations without pairs of rows, against all pairs of rows and plain ranks."""

import itertools
import math
import random

import numpy as np
import pytest

from gleanframe.operators import relate


def tau_b(rows):
    rows = [r for r in rows if all(v is not None and math.isfinite(v) for v in r)]
    score = tie_x = tie_y = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        score += (a > c) * (b > d) + (a < c) * (b < d) - (a > c) * (b < d) - (a < c) * (b > d)
        tie_x, tie_y = tie_x + (a == c), tie_y + (b == d)
    total = len(rows) * (len(rows) - 1) / 2
    base = math.sqrt((total - tie_x) * (total - tie_y))
    return score / base if base else None


def test_inversions():
    draw = np.random.default_rng(1)
    for m in (0, 1, 2, 3, 17, 200):
        keys, n = draw.integers(0, 9, m), draw.integers(1, 4, m)
        want = sum(int(n[i] * n[j]) for i in range(m) for j in range(i + 1, m) if keys[i] > keys[j])
        assert relate.weighted_inversions(keys, n) == want
        huge = n.astype(np.int64) << 33
        assert relate.weighted_inversions(keys, huge) == want << 66


@pytest.mark.parametrize("values", [3, 40, 100_000])
def test_tau_equals_all_pairs(spark, values):
    draw = random.Random(values)
    data = [
        tuple(None if draw.random() < 0.05 else float(draw.randrange(values)) if c else 1.0 if draw.random() < 0.4 else draw.random() for c in range(3))
        for _ in range(400)
    ] + [(math.inf, 1.0, math.nan), (7.0, 7.0, 7.0)] * 2
    df = spark.createDataFrame(data, "a double, b double, c double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["col1"], r["col2"]): r["r"] for r in relate.kendall_pairs(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for (i, a), (j, b) in itertools.combinations(enumerate("abc"), 2):
        assert got[a, b] == pytest.approx(tau_b([(r[i], r[j]) for r in data]), abs=1e-12)


def test_tau_without_variation(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "a double, b double, c double")
    assert [r["r"] for r in relate.kendall_pairs(df).collect()] == [None, None, None]
    assert relate.kendall_pairs(df.limit(0)).count() == 3 and relate.kendall_pairs(df, ["a"]).count() == 0


def rank_r(rows):
    rows = [r for r in rows if all(v is not None and math.isfinite(v) for v in r)]
    def ranks(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]
    x, y = (np.array(ranks(c)) for c in zip(*rows))
    x, y = x - x.mean(), y - y.mean()
    base = math.sqrt((x @ x) * (y @ y))
    return x @ y / base if base else None


@pytest.mark.parametrize("gaps", [0, 0.1])
def test_spearman_equals_plain_ranks(spark, gaps):
    draw = random.Random(8)
    data = [
        (draw.choice([1.0, 1.0, 1.0, 2.0, -0.0, 0.0]), draw.random(), None if draw.random() < gaps else float(draw.randrange(9)), 5.0)
        for _ in range(300)
    ]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["col1"], r["col2"]): r["r"] for r in relate.spearman_pairs(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for (i, a), (j, b) in itertools.combinations(enumerate("abcd"), 2):
        want = rank_r([(r[i], r[j]) for r in data])
        assert got[a, b] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_a_hot_value_is_ranked_over_many_slices(spark):
    cells = spark.range(4000).selectExpr("0 AS key", "CAST(IF(id % 3 = 0, 7, id) AS DOUBLE) AS value", "id AS row")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = {r["row"]: r["rank"] for r in relate.average_ranks(cells).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    values = [7 if i % 3 == 0 else i for i in range(4000)]
    place = sorted(values)
    assert all(ranks[i] == place.index(v) + (place.count(v) + 1) / 2 for i, v in list(enumerate(values))[::41])


def test_ranks_come_batch_by_batch(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(relate, "RUN_ROWS", 50)
    monkeypatch.setattr(relate, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    cells = sorted((k, float(v), k * 10_000 + i) for k in range(3) for i, v in enumerate([*range(300), *[77] * 600, *[300] * 45, *[5] * 50, *[6] * 51]))
    taken = []

    def batches():
        for a in range(0, len(cells), 17):
            taken.append(a)
            part = list(zip(*cells[a:a + 17]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1]), pa.array(part[2])], names=["key", "value", "row"])

    behind, out = 0, []
    for got in relate._local_ranks(batches()):
        out += got.to_pylist()
        behind = max(behind, 17 * len(taken) - len(out))
    assert behind <= 50 + 3 * 17 and [r["row"] for r in out] == [c[2] for c in cells]
    runs = {}
    for r, (k, v, _) in zip(out, cells):
        runs.setdefault((k, v), {})[r["lo"]] = (r["len"], r["edge"])
    for (k, v), pieces in runs.items():
        values = [c[1] for c in cells if c[0] == k]
        assert min(pieces) == sum(x < v for x in values) and sum(n for n, _ in pieces.values()) == values.count(v)
        assert len(pieces) == 1 or all(edge == v for _, edge in pieces.values())


def test_ranks_of_runs_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(relate, "RUN_ROWS", 100)
    cells = spark.range(4000).selectExpr("CAST(id % 2 AS INT) AS key", "CAST(IF(id % 3 = 0, 7, id) AS DOUBLE) AS value", "id AS row")
    ranks = {r["row"]: r["rank"] for r in relate.average_ranks(cells).collect()}
    for key in (0, 1):
        values = [7 if i % 3 == 0 else i for i in range(key, 4000, 2)]
        place = sorted(values)
        assert all(ranks[i] == place.index(v) + (place.count(v) + 1) / 2 for i, v in list(zip(range(key, 4000, 2), values))[::41])


def test_wide_spearman_and_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(relate, "MERGED", 2)
    monkeypatch.setattr(relate, "WIDE", 3)
    draw = np.random.default_rng(4)
    data = draw.normal(size=(200, 6)).round(1)
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in names)).repartition(9)
    assert relate.scan_tasks(df) == 9
    for pairs in (relate.pearson_pairs(df), relate.spearman_pairs(df)):
        plan = pairs._jdf.queryExecution().toString()
        got = {(r["col1"], r["col2"]): r["r"] for r in pairs.collect()}
        assert len(got) == 15 and plan.count("FlatMapGroupsInArrow") > 1
    for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
        assert got[a, b] == pytest.approx(rank_r(list(zip(data[:, i], data[:, j]))), abs=1e-9)


def test_no_group_sees_more_than_the_fixed_number_of_rows(spark):
    seen = []
    rows = spark.createDataFrame([(p, i) for p in range(500) for i in range(3)], "part bigint, i int")

    def merge(group):
        import pyarrow as pa
        assert group.num_rows <= 32
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // 32]), "i": pa.array([group.column("i")[0].as_py()], pa.int32())})

    left = relate.merged_levels(rows, 500, merge, "part bigint, i int")
    assert sorted((r["part"], r["i"]) for r in left.collect()) == [(p, i) for p in range(16) for i in range(3)] and not seen
