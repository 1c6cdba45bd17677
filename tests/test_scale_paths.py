"""The paths that large tables take, forced on small ones and held against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanframe.operators import lookup, profile, quantiles, ranks, relate, trend


def _interpolated(values, p):
    x = np.sort(values)
    at = p * (len(x) - 1)
    low, high = x[int(np.floor(at))], x[int(np.ceil(at))]
    return low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    n = 5000
    d = pd.DataFrame({
        "smooth": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 50, n)),
        "wild": np.where(rng.random(n) < 0.1, np.inf, np.where(rng.random(n) < 0.1, -np.inf, rng.lognormal(size=n) * 1e9)),
        "fixed": np.full(n, 3.0),
        "ramp": np.arange(n, dtype=float),
    })
    d.loc[rng.random(n) < 0.2, "smooth"] = np.nan
    return d, spark.createDataFrame(d)


@pytest.mark.parametrize("limit,sketch_k", [(10**6, 4096), (200, 4096), (10, 64), (1, 64)])
def test_quantiles_are_exact_at_every_limit(numbers, monkeypatch, limit, sketch_k):
    """A coarse sketch proposes poor intervals; the counts still lead to the exact value."""
    monkeypatch.setattr(quantiles, "SKETCH_K", sketch_k)
    d, df = numbers
    probs = [0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1]
    got = quantiles.exact_quantiles(df, list(d.columns), probs, limit=limit)
    for c in d.columns:
        for p, v in zip(probs, got[c]):
            want = _interpolated(d[c].dropna().to_numpy(), p)
            assert v == want or (np.isnan(v) and np.isnan(want))


def test_upper_median_of_an_even_number(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    assert quantiles.upper_medians(df, ["v"]) == {"v": 3.0}
    assert quantiles.medians(df, ["v"]) == {"v": 2.5}


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    assert quantiles.exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


def test_positions_of_a_hot_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"g{i % 50}", int(v)) for i, v in enumerate(rng.permutation(3000))]
    got = ranks.positions(spark.createDataFrame(rows, "g string, v long"), ["v"], by=["g"]).toPandas()
    got = got.sort_values(["g", "v"])
    assert (got["position"] == got.groupby("g").cumcount()).all()
    assert len(got) == 3000


def test_running_counts_and_group_medians(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"g": np.where(rng.random(4000) < 0.5, "hot", "cold"), "v": rng.integers(0, 40, 4000).astype(float)})
    df = spark.createDataFrame(d)
    got = ranks.running_counts(df, ["g"], "v").toPandas()
    for r in got.itertuples():
        same = d[d.g == r.g]["v"]
        assert r.before == (same < r.v).sum() and r.n == (same == r.v).sum() and r.total == len(same)
    d["g"] = np.where(rng.random(4000) < 0.1, "few", d["g"])
    df = spark.createDataFrame(d).unionAll(spark.createDataFrame([(None, 1.0), ("hot", None)], "g string, v double"))
    for limit in (10**6, 1000, 0):
        got = ranks.grouped_quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.1}, limit=limit).collect()
        assert {r["g"]: r["m"] for r in got} == d.groupby("g")["v"].median().to_dict()
        assert {r["g"]: r["p"] for r in got} == pytest.approx(d.groupby("g")["v"].quantile(0.1).to_dict())


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_attach_salts_hot_values(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(lookup, "HOT_SHARE", 4)
    rows = [(i, "hot" if i % 2 else f"v{i % 97}") for i in range(2000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id long, v string")
    table = df.where("v IS NOT NULL").groupBy("v").count().select("v", F.col("count").alias("n"), (F.col("count") * 2).alias("twice"))
    got = lookup.attach(df, table, "v", broadcast_rows=broadcast_rows)
    assert got.columns == ["id", "v", "twice"]
    want = pd.DataFrame(rows, columns=["id", "v"])
    size = want.groupby("v").size()
    found = {r["id"]: r["twice"] for r in got.collect()}
    assert len(found) == 2001 and got.count() == 2001
    assert all(found[r.id] == (None if r.v is None else 2 * size[r.v]) for r in want.itertuples())


@pytest.mark.parametrize("partitions", [1, 11])
def test_spearman_with_gaps(spark, partitions):
    rng = np.random.default_rng(4)
    d = pd.DataFrame(rng.integers(0, 9, (400, 3)).astype(float), columns=list("abc"))
    d["b"] += d["a"] * 2
    d.loc[rng.random(400) < 0.2, "c"] = np.nan
    got = {(r["col1"], r["col2"]): r["r"] for r in relate.spearman_pairs(spark.createDataFrame(d).repartition(partitions)).collect()}
    for a, b in itertools.combinations("abc", 2):
        both = d[[a, b]].dropna().rank()
        assert got[a, b] == pytest.approx(both[a].corr(both[b]), abs=1e-12)


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"a": rng.integers(0, 12, 150), "b": rng.integers(0, 9, 150)}).astype(float)
    d["b"] += d["a"] // 2
    s, tx, ty, n = 0, 0, 0, len(d)
    for i in range(n):
        for j in range(i):
            x, y = np.sign(d.a[i] - d.a[j]), np.sign(d.b[i] - d.b[j])
            s, tx, ty = s + x * y, tx + (x == 0), ty + (y == 0)
    total = n * (n - 1) / 2
    got = relate.kendall(spark.createDataFrame(d), "a", "b").first()["r"]
    assert got == pytest.approx(s / np.sqrt((total - tx) * (total - ty)), abs=1e-12)


def test_index_fit_over_many_partitions(spark):
    rng = np.random.default_rng(6)
    y = 5 + 0.3 * np.arange(800) + rng.normal(size=800)
    y[rng.random(800) < 0.1] = np.nan
    d = pd.DataFrame({"k": np.arange(800), "y": y}).sample(frac=1, random_state=0)
    row = trend.index_fit(spark.createDataFrame(d).repartition(13), ["k"], ["y"]).first()
    kept = y[~np.isnan(y)]
    slope, intercept = np.polyfit(np.arange(len(kept)), kept, 1)
    assert row["n"] == len(kept) and row["last"] == kept[-1]
    assert row["slope"] == pytest.approx(slope, rel=1e-9) and row["intercept"] == pytest.approx(intercept, rel=1e-9)


def test_columns_with_infinite_cells_have_no_trend(spark):
    rows = [(i, float(i), float("inf") if i == 17 else float(i % 7), None if i % 2 else 3.0 * i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, up double, endless double, gaps double").repartition(7)
    fit = {r["column"]: r for r in trend.index_fit(df, ["k"], ["up", "endless", "gaps"]).collect()}
    assert set(fit) == {"up", "gaps"} and fit["up"]["slope"] == pytest.approx(1.0) and fit["gaps"]["slope"] == pytest.approx(6.0)
    assert fit["gaps"]["n"] == 100 and fit["gaps"]["last"] == 594.0
    top = trend.top_trends(df, ["k"], ["up", "endless", "gaps"]).collect()
    assert [r["column"] for r in top] == ["gaps", "up"] and all(r["r_squared"] == 1.0 for r in top)
    plan = trend.index_fit(df, ["k"], ["up", "endless", "gaps"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1


def test_lineage_with_one_hot_parent(spark, monkeypatch):
    from gleanframe.operators import catalog, lookup

    # a shuffled, salted lookup: one root with a third of all rows as children, a star on a non-root, a chain
    rows = [(0, None)] + [(i, 0) for i in range(1, 120)] + [(i, 5) for i in range(120, 220)] + [(i, i - 1) for i in range(220, 300)] + [(999, 12345)]
    df = spark.createDataFrame(rows, "v long, p long")
    real = lookup.attach
    monkeypatch.setattr(catalog, "attach", lambda *a, **k: real(*a, **{**k, "broadcast_rows": 0}))
    parents, want = dict(rows), {}
    for v in parents:
        at, steps = v, 0
        while parents[at] in parents:
            at, steps = parents[at], steps + 1
        want[v] = (at, steps)
    assert {r["v"]: (r["root"], r["depth"]) for r in catalog.version_lineage(df, "v", "p").collect()} == want


def test_distinct_counts_of_every_type(spark):
    from decimal import Decimal
    import datetime as dt

    long = "x" * 70
    rows = [
        (1, 0.0, "a", long, True, dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 1), Decimal("1.10"), [1], 1.5),
        (1, -0.0, "A", long + "y", False, dt.date(2020, 1, 2), dt.datetime(2020, 1, 1, 1), Decimal("1.1"), [1, 2], 1.5),
        (None, float("nan"), "", long, None, None, None, None, None, None),
        (2, 1e300, None, None, True, dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 2), Decimal("2"), [1], float("inf")),
    ]
    df = spark.createDataFrame(rows, "i int, d double, t string, l string, b boolean, day date, ts timestamp, dec decimal(9,2), arr array<int>, f float")
    got = {r["column"]: r["distinct_count"] for r in profile.distinct_profile(df).collect()}
    assert got == {"i": 2, "d": 2, "t": 3, "l": 2, "b": 2, "day": 2, "ts": 2, "dec": 2, "arr": 2, "f": 2}
