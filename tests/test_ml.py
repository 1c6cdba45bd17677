"""Models on constructed signals: thresholds, not exact values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.operators import ml
from gleanframe.operators.clean import column_mode


@pytest.fixture(scope="module")
def houses(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        size, kind = float(rng.uniform(30, 200)), ["flat", "house", "loft"][i % 3]
        price = 3 * size + {"flat": 0, "house": 60, "loft": 120}[kind] + float(rng.normal())
        rows.append((i, size if i % 17 else None, kind if i % 23 else None, price if i % 50 else None, "dear" if price > 350 else "cheap"))
    df = spark.createDataFrame(rows, "id long, size double, kind string, price double, class string")
    return df.where(F.col("size").isNotNull())


@pytest.mark.parametrize("kind", ["linear_regression", "ridge", "gradient_boosting_regressor", "random_forest_regressor"])
def test_regressors_find_the_signal(houses, kind, monkeypatch):
    if "forest" in kind or "boosting" in kind:
        monkeypatch.setattr(ml, "TREES", 10)
        monkeypatch.setattr(ml, "BOOSTS", 20)
    got = ml.train(houses, kind, "price", ["size", "kind"], ["id"])
    row = got.metrics.first()
    assert row["r2_score"] > 0.8 and row["train_samples"] > row["test_samples"] > 0
    assert got.importance.first()["feature"] == "size"


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "gradient_boosting_classifier"])
def test_classifiers_find_the_signal(houses, kind, monkeypatch):
    monkeypatch.setattr(ml, "TREES", 10)
    monkeypatch.setattr(ml, "BOOSTS", 10)
    got = ml.train(houses, kind, "class", ["size", "kind"], ["id"])
    assert got.classes == ["cheap", "dear"] and got.metrics.first()["accuracy"] > 0.85
    scored = ml.score(got, houses.select("id", "size"))
    assert {r["prediction"] for r in scored.collect()} <= {"cheap", "dear"}


def test_three_classes_boosted(houses, monkeypatch):
    monkeypatch.setattr(ml, "BOOSTS", 5)
    rows = houses.withColumn("level", F.when(F.col("size") < 80, "s").when(F.col("size") < 140, "m").otherwise("l"))
    got = ml.train(rows, "gradient_boosting_classifier", "level", ["size"], ["id"])
    assert got.classes == ["l", "m", "s"] and got.metrics.first()["accuracy"] > 0.85


def test_ridge_equals_its_closed_form(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    rows = ml.fit_preprocessing(df, ["a", "b"]).transform(df).withColumn("__label", F.col("y"))
    fitted = ml._regressor("ridge", rows).fit(rows)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(fitted.coefficients.toArray(), want, atol=1e-8)


def test_unseen_and_missing_categories(houses):
    model = ml.fit_preprocessing(houses, ["kind"])
    codes = model.transform(houses.sparkSession.createDataFrame([("flat",), ("igloo",), (None,)], "kind string"))
    usual = float(["flat", "house", "loft"].index(column_mode(houses, "kind")))
    assert [r["features"][0] for r in codes.collect()] == [0.0, -1.0, usual]


def test_split_is_stable(spark):
    df = spark.range(1000)
    a, b = ml.split_rows(df, ["id"])
    c, _ = ml.split_rows(df.repartition(7), ["id"])
    assert {r.id for r in a.collect()} == {r.id for r in c.collect()}
    assert a.count() + b.count() == 1000 and 150 < b.count() < 250


def test_clusters_and_persistence(spark, tmp_path):
    rows = [(float(i % 2 * 10 + i % 5 * 0.1), float(i % 2 * -10)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = ml.train(df, "k_means")
    row = got.metrics.first()
    assert row["n_clusters"] == ml.cluster_count(40) == 4 and row["silhouette_score"] > 0.5
    assert ml.cluster_sizes(got, df).agg(F.sum("count")).first()[0] == 40
    ml.save(got, str(tmp_path / "model"))
    again = ml.load(str(tmp_path / "model")).transform(df).select("prediction").collect()
    assert again == got.model.transform(df).select("prediction").collect()


def test_refusals(houses):
    with pytest.raises(ValueError):
        ml.train(houses, "boosted_trees", "price")
    with pytest.raises(ValueError):
        ml.train(houses, "ridge", "no_such_target", ["size"])
    with pytest.raises(ValueError):
        ml.train(houses.limit(5), "ridge", "price", ["size"])


def test_more_rows_spread_over_more_partitions(spark, monkeypatch):
    df = spark.range(1000).withColumn("x", F.lit(1.0))
    assert ml.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    packed = df.coalesce(1)
    assert ml.dealt_finely(packed, 1000, 2) is packed
    monkeypatch.setattr(ml, "PARTITION_CELLS", 50)
    sizes = ml.dealt_finely(packed, 1000, 2).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 40 and max(r["count"] for r in sizes) <= 50
    spread = ml.spread(df)
    assert spread.rdd.getNumPartitions() == 40 and spread.count() == 1000
    assert ml.spread(df.limit(0)).count() == 0
