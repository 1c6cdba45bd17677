"""The forest on alike rows against Spark's trees on the rows themselves."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from gleanframe.operators import forest, ml


@pytest.fixture(scope="module")
def lots(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        a, b = int(rng.integers(0, 9)), int(rng.integers(0, 5))
        rows.append((i, float(a), float(b), float(3 * a - (b == 2) * 7 + rng.integers(0, 6))))
    return spark.createDataFrame(rows, "id long, a double, b double, y double")


def _cells(alike, times):
    return alike.groupBy("x0", "x1").agg(F.sum(F.col("n") * times).alias("w"), F.sum(F.col("n") * times * F.col("label")).alias("s"))


def test_a_tree_equals_the_tree_of_all_rows(lots, monkeypatch):
    # the first tree takes every row once, the second takes those with an even label twice
    uses = [F.lit(1.0), F.when(F.col("label") % 2 == 0, 2.0).otherwise(0.0)]

    def bootstrap(alike, cells, trees, seed):
        parts = [_cells(alike, u).where("w > 0").withColumn("tree", F.lit(t)) for t, u in enumerate(uses)]
        return parts[0].unionAll(parts[1])

    monkeypatch.setattr(forest, "bootstrap", bootstrap)
    got = lots
    grown = forest.fit(lots, ["a", "b"], "y", 1500, trees=2, depth=4, seed=1)
    for stage in grown.stages():
        got = stage.transform(got)
    want = []
    even = lots.where("y % 2 = 0")
    for t, rows in enumerate([lots, even.unionAll(even)]):
        points = rows.select(array_to_vector(F.array("a", "b")).alias("__cells"), "y")
        plain = RandomForestRegressor(
            featuresCol="__cells", labelCol="y", predictionCol=f"plain{t}", numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=4,
        ).fit(points)
        assert plain.totalNumNodes == grown.trees[t].totalNumNodes > 20
        assert np.allclose(plain.featureImportances.toArray(), grown.trees[t].featureImportances.toArray())
        want.append(plain)
        got = plain.transform(got)
    for r in got.collect():
        assert r["__tree0"] == pytest.approx(r["plain0"]) and r["__tree1"] == pytest.approx(r["plain1"])
        assert r["prediction"] == pytest.approx((r["plain0"] + r["plain1"]) / 2)


def test_draws_are_those_of_a_bootstrap(spark):
    alike = spark.range(400).select(
        (F.col("id") % 3).cast("double").alias("x0"), F.lit(0.0).alias("x1"), F.col("id").cast("double").alias("label"),
        (1 + F.col("id") % 2 * 6).alias("n"),
    )
    cells, order = ["x0", "x1"], ["tree", "x0"]
    whole = forest.bootstrap(alike, cells, 50, 7).orderBy(*order).collect()
    dealt = forest.bootstrap(alike.repartition(5, "label"), cells, 50, 7).orderBy(*order).collect()
    assert whole == dealt and len(whole) == 150
    assert {r["tree"]: r["w"] for r in whole} != {r["tree"]: r["w"] for r in forest.bootstrap(alike, cells, 50, 8).collect()}
    # one combination for each row, so that its own draws are seen
    single = forest.bootstrap(alike.withColumn("x0", F.col("label")), cells, 200, 7).collect()
    assert all(r["s"] == r["w"] * r["x0"] for r in single)
    for odd, n in ((0, 1), (1, 7)):
        w = np.zeros(200 * 200)
        drawn = [r["w"] for r in single if r["x0"] % 2 == odd]
        w[:len(drawn)] = drawn
        assert abs(w.mean() - n) < 0.05 * n and abs(w.var() - n) < 0.05 * n


def test_trees_read_what_differs(lots, monkeypatch):
    written, write = [], forest.materialise

    def counted(rows, label):
        written.append((out := write(rows, label)).count())
        return out

    monkeypatch.setattr(forest, "materialise", counted)
    monkeypatch.setattr(ml, "TREES", 6)
    trained = []
    for copies in (1, 20):
        rows = lots.crossJoin(lots.sparkSession.range(copies).select(F.col("id").alias("copy")))
        trained.append(ml.train(rows, "random_forest_regressor", "y", ["a", "b"], ["id"]))
    few, many = (t.metrics.first() for t in trained)
    assert many["train_samples"] == 20 * few["train_samples"]
    groups, drawn, more_groups, more_drawn = written
    assert groups == more_groups and drawn <= more_drawn == 6 * 9 * 5
    assert few["r2_score"] > 0.9 and many["r2_score"] == pytest.approx(few["r2_score"], abs=0.01)
    assert [r["feature"] for r in trained[1].importance.collect()] == ["a", "b"]


def test_same_quality_as_spark_on_the_rows(lots, monkeypatch):
    monkeypatch.setattr(ml, "TREES", 20)
    got = ml.train(lots, "random_forest_regressor", "y", ["a", "b"], ["id"])
    monkeypatch.setattr(forest, "ROWS_ALIKE", 1_000_000)
    plain = ml.train(lots, "random_forest_regressor", "y", ["a", "b"], ["id"])
    assert len(got.model.stages) == len(plain.model.stages) + 21
    assert got.metrics.first()["r2_score"] == pytest.approx(plain.metrics.first()["r2_score"], abs=0.01)
    shares = [{r["feature"]: r["importance"] for r in t.importance.collect()} for t in (got, plain)]
    assert shares[0]["a"] == pytest.approx(shares[1]["a"], abs=0.03)


def test_others_are_left_to_spark(lots):
    assert forest.fit(lots, ["a", "id"], "y", 1500, trees=2, depth=3, seed=1) is None
    endless = lots.withColumn("y", F.when(F.col("id") == 3, float("inf")).otherwise(F.col("y")))
    assert forest.fit(endless, ["a", "b"], "y", 1500, trees=2, depth=3, seed=1) is None


def test_saved_forest_scores_alike(lots, monkeypatch, tmp_path):
    monkeypatch.setattr(ml, "TREES", 3)
    odd = lots.withColumn("b", F.concat(F.lit("kind "), F.col("b").cast("int"))).withColumn("a", F.when(F.col("id") % 40 != 0, F.col("a")))
    got = ml.train(odd, "random_forest_regressor", "y", ["a", "b"], ["id"])
    ml.save(got, str(tmp_path / "model"))
    again = ml.load(str(tmp_path / "model")).transform(odd).orderBy("id").select("prediction").collect()
    assert again == got.model.transform(odd).orderBy("id").select("prediction").collect()
    unseen = ml.score(got, odd.limit(5).select("id", F.lit("new").alias("b")))
    assert unseen.count() == 5 and unseen.where("prediction IS NULL").count() == 0
