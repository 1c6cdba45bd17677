"""Model quality from tables of labels and predictions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.operators.columns import ident
from gleanframe.operators.ranks import running_sums


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: R², RMSE, MAE, MAPE in percent over non-zero labels, explained variance."""
    y, p = ident(label).cast("double"), ident(prediction).cast("double")
    e = y - p
    got = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(y != 0, F.abs(e / F.when(y != 0, y)))).alias("mape"),
        F.var_pop(y).alias("vy"), F.var_pop(e).alias("ve"),
    )

    def share(part: Column) -> Column:
        # a constant label is explained fully by an exact prediction and not at all otherwise
        exact = F.when(part == 0, 1.0).otherwise(0.0)
        return F.round(F.coalesce(1 - F.try_divide(part, F.col("vy")), exact), 4)

    return got.select(
        share(F.col("mse")).alias("r2_score"), F.round(F.sqrt("mse"), 4).alias("rmse"),
        F.round("mae", 4).alias("mae"),
        F.round(F.coalesce("mape", F.lit(0.0)) * 100, 2).alias("mape_pct"),
        share(F.col("ve")).alias("explained_variance"), F.col("n").alias("test_samples"),
    )


def class_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, support, predicted, hits) from the confusion counts."""
    confusion = df.groupBy(
        ident(label).cast("string").alias("y"), ident(prediction).cast("string").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    n, hit = F.col("n"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y").alias("class"), n.alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("p").alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("hits")),
    )
    return confusion.select(F.explode(sides).alias("s")).select("s.*").groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction",
) -> DataFrame:
    """One row: accuracy, balanced accuracy and support-weighted F1, precision and recall."""
    precision = F.coalesce(F.try_divide("hits", F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    per_class = class_counts(df, label, prediction).select(
        "class", "support", "hits", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return F.round(F.sum(F.col(c) * F.col("support")) / n, 4)

    return per_class.agg(
        F.round(F.sum("hits") / n, 4).alias("accuracy"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 4).alias("balanced_accuracy"),
        weighted("f1").alias("f1_score"), weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        F.count_if(F.col("support") > 0).alias("classes"), n.alias("test_samples"),
    )


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by the rank sum, ties half; null with one class only."""
    counted = df.groupBy(ident(score).cast("double").alias("score")).agg(
        F.count_if(ident(label) == 1).alias("pos"), F.count_if(ident(label) != 1).alias("neg")
    )
    ranked = running_sums(counted, [], "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    total = F.sum("pos").cast("double") * F.max("total_neg")
    return ranked.agg(F.round(F.try_divide(wins, total), 6).alias("auc"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(class, count)."""
    return df.groupBy(ident(column).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))


def calinski_harabasz(df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """One row: between-cluster over within-cluster variance, each per degree of freedom.

    One pass of vector summaries per cluster; the sums over clusters run on k rows.
    """
    stats = df.groupBy(ident(cluster)).agg(
        Summarizer.metrics("count", "mean", "variance").summary(ident(features)).alias("s")
    )
    per = stats.select(
        F.col("s.count").alias("n"), vector_to_array(F.col("s.mean")).alias("mean"),
        F.aggregate(vector_to_array(F.col("s.variance")), F.lit(0.0), lambda a, v: a + v).alias("var"),
    )
    # between = sum n |m|^2 - N |M|^2, with M the mean of all rows: one row per dimension
    dims = per.select("n", F.posexplode("mean").alias("d", "m")).groupBy("d").agg(
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nm2"),
        F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum("n").alias("rows"),
    ).agg(F.sum(F.col("nm2") - F.col("nm") * F.col("nm") / F.col("rows")).alias("between"))
    within = per.agg(
        F.sum(F.col("var") * (F.col("n") - 1)).alias("within"), F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("k"),
    )
    ratio = F.try_divide(
        F.col("between") * (F.col("rows") - F.col("k")), F.col("within") * (F.col("k") - 1)
    )
    one = F.lit(1).alias("one")
    # one row on each side
    return within.withColumn("one", one).join(F.broadcast(dims.withColumn("one", one)), "one").select(
        F.col("k").alias("n_clusters"), F.col("rows").alias("total_samples"),
        F.round(ratio, 2).alias("calinski_harabasz_score"),
    )
