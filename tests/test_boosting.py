"""Boosting with several classes against a plain version on raw values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.operators import boosting, ml


def plain(x, y, classes, rounds, rate=0.1, depth=3):
    """Probabilities after some rounds, every midpoint of every feature tried in every node."""
    scores = np.tile(np.log(np.bincount(y, minlength=classes) / len(y)), (len(y), 1))

    def softmax(s):
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def grow(rows, residual, level, out):
        r = residual[rows]
        weight = (np.abs(r) * (1 - np.abs(r))).sum()
        out[rows] = 0.0 if weight < 1e-150 else (classes - 1) / classes * r.sum() / weight
        if level == depth:
            return
        best, at = 0.0, None
        for f in range(x.shape[1]):
            known = np.unique(x[rows, f])
            for cut in (known[:-1] + known[1:]) / 2:
                low = x[rows, f] <= cut
                a, b = r[low], r[~low]
                gain = len(a) * len(b) / len(r) * (a.mean() - b.mean()) ** 2
                if gain > best * (1 + 1e-9) and gain > 1e-12 * len(r):
                    best, at = gain, (f, cut)
        if at:
            low = x[rows, at[0]] <= at[1]
            grow(rows[low], residual, level + 1, out)
            grow(rows[~low], residual, level + 1, out)

    for _ in range(rounds):
        p = softmax(scores)
        steps = np.zeros_like(scores)
        for k in range(classes):
            grow(np.arange(len(y)), (y == k) - p[:, k], 0, steps[:, k])
        scores += rate * steps
    return softmax(scores)


@pytest.fixture(scope="module")
def flowers(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, 160)
    # few distinct values, so that no two cuts part the rows alike and both versions know the same ones
    x = np.stack([y + rng.integers(0, 4, 160), (y % 2) * 3 + rng.integers(0, 5, 160), rng.integers(0, 6, 160)], 1).astype(float)
    rows = [(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int"), x, y


@pytest.mark.parametrize("cells", [1_000_000, 1])
def test_equals_plain_boosting(flowers, monkeypatch, cells):
    # scores are written every two rounds, and with one cell every class takes its own turn
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    monkeypatch.setattr(boosting, "HISTOGRAM_CELLS", cells)
    df, x, y = flowers
    model = boosting.fit(df, ["a", "b", "c"], "y", 4, rounds=5 if cells > 1 else 2)
    out = df.repartition(3)
    for stage in model.stages():
        out = stage.transform(out)
    got = out.orderBy("id").collect()
    probability = np.array([r["probability"] for r in got])
    want = plain(x, y, 4, 5 if cells > 1 else 2)
    assert np.allclose(probability, want, atol=1e-9) and np.allclose(probability.sum(1), 1.0)
    assert [int(r["prediction"]) for r in got] == list(probability.argmax(1))
    assert abs(sum(model.importances) - 1.0) < 1e-9 and model.importances[0] == max(model.importances)


def test_cuts(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("many"), (F.col("id") % 3).cast("double").alias("few"), F.lit(1.0).alias("one"))
    many, few, one = boosting.bin_edges(df, ["many", "few", "one"])
    assert len(many) == 31 and abs(many[15] - 5000) < 50 and few == [0.5, 1.5] and one == []


def test_every_class_needs_rows(flowers):
    with pytest.raises(ValueError):
        boosting.fit(flowers[0].where("y < 3"), ["a"], "y", 4, rounds=1)


def test_trained_model_keeps(flowers, monkeypatch, tmp_path):
    monkeypatch.setattr(ml, "BOOSTS", 4)
    df = flowers[0].select("id", F.when(F.col("id") % 9 != 0, F.col("a")).alias("a"), F.concat(F.lit("t"), F.col("b").cast("string")).alias("b"), "y")
    df = df.withColumn("y", F.concat(F.lit("class "), "y"))
    got = ml.train(df, "gradient_boosting_classifier", "y", ["a", "b"], ["id"])
    assert got.classes == [f"class {k}" for k in range(4)] and got.metrics.first()["accuracy"] > 0.5
    assert {r["feature"] for r in got.importance.collect()} == {"a", "b"}
    # values and columns that training never saw
    odd = df.select("id", F.lit("new").alias("b")).orderBy("id").limit(3)
    assert {r["prediction"] for r in ml.score(got, odd).collect()} <= set(got.classes)
    ml.save(got, str(tmp_path / "model"))
    again = ml.load(str(tmp_path / "model")).transform(df).orderBy("id").select("__predicted").collect()
    assert again == got.model.transform(df).orderBy("id").select("__predicted").collect()


def test_scans_read_what_the_bins_tell_apart(flowers, monkeypatch):
    df, _, _ = flowers
    copies = df.crossJoin(df.sparkSession.range(20).select(F.col("id").alias("copy")))
    seen, write = [], boosting.materialise

    def counted(rows, label):
        out = write(rows, label)
        seen.append((out.count(), out.agg(F.sum("n")).first()[0]))
        return out

    monkeypatch.setattr(boosting, "materialise", counted)
    once = boosting.fit(df, ["a", "b", "c"], "y", 4, rounds=2)
    many = boosting.fit(copies, ["a", "b", "c"], "y", 4, rounds=2)
    assert seen == [(df.select("a", "b", "c", "y").distinct().count(), 160), (seen[0][0], 3200)]
    for a, b in zip(once.rounds, many.rounds):
        for s, t in zip(a, b):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and s.value == pytest.approx(t.value)
