"""Models and their metrics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gleanframe.operators import metrics, ml
from gleanframe.registry.base import query, table


def _guesses(spark, folder):
    """A deterministic prediction for every line item, regression and classes alike."""
    li, k = table(spark, folder, "lineitem"), F.col("l_orderkey") + F.col("l_linenumber")
    return li.select(
        (F.col("l_quantity") - F.col("l_linenumber")).alias("label"), (F.col("l_quantity") + k % 5 - 4).alias("prediction"),
        F.col("l_returnflag").alias("actual"),
        F.when(k % 3 == 0, "A").when(k % 7 == 0, "N").when(k % 11 == 0, "X").otherwise(F.col("l_returnflag")).alias("guess"),
        (F.col("l_linestatus") == "O").cast("int").alias("is_open"), (k % 101).cast("double").alias("score"),
    )


_GUESSES = """
guesses AS (
  SELECT l_quantity - l_linenumber AS label, l_quantity + k % 5 - 4 AS prediction, l_returnflag AS actual,
    CASE WHEN k % 3 = 0 THEN 'A' WHEN k % 7 = 0 THEN 'N' WHEN k % 11 = 0 THEN 'X' ELSE l_returnflag END AS guess,
    CAST(l_linestatus = 'O' AS INTEGER) AS is_open, CAST(k % 101 AS DOUBLE) AS score
  FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem))"""


@query("metrics_regression", f"""
WITH {_GUESSES} SELECT round(1 - avg(pow(label - prediction, 2)) / var_pop(label), 4) AS r2_score, round(sqrt(avg(pow(label - prediction, 2))), 4) AS rmse,
  round(avg(abs(label - prediction)), 4) AS mae, round(avg(abs((label - prediction) / label)) FILTER (label <> 0) * 100, 2) AS mape_pct,
  round(1 - var_pop(label - prediction) / var_pop(label), 4) AS explained_variance, count(*) AS test_samples FROM guesses""")
def metrics_regression(spark, folder):
    return metrics.regression_metrics(_guesses(spark, folder))


@query("metrics_classification", f"""
WITH {_GUESSES}, c AS (SELECT DISTINCT actual AS k FROM guesses UNION SELECT DISTINCT guess FROM guesses),
s AS (SELECT k, (SELECT count(*) FROM guesses WHERE actual = k) AS support, (SELECT count(*) FROM guesses WHERE guess = k) AS predicted,
  (SELECT count(*) FROM guesses WHERE guess = k AND actual = k) AS hits FROM c),
m AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM s),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM m)
SELECT round(sum(hits) / sum(support), 4) AS accuracy, round(avg(r) FILTER (support > 0), 4) AS balanced_accuracy,
  round(sum(f1 * support) / sum(support), 4) AS f1_score, round(sum(p * support) / sum(support), 4) AS precision,
  round(sum(r * support) / sum(support), 4) AS recall, count(*) FILTER (support > 0) AS classes, CAST(sum(support) AS BIGINT) AS test_samples FROM f""")
def metrics_classification(spark, folder):
    return metrics.classification_metrics(_guesses(spark, folder), "actual", "guess")


@query("metrics_auc", f"""
WITH {_GUESSES}, r AS (SELECT is_open, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM guesses)
SELECT round((sum(rk) FILTER (is_open = 1) - count(*) FILTER (is_open = 1) * (count(*) FILTER (is_open = 1) + 1) / 2.0)
  / (count(*) FILTER (is_open = 1) * 1.0 * count(*) FILTER (is_open = 0)), 6) AS auc FROM r""")
def metrics_auc(spark, folder):
    return metrics.auc(_guesses(spark, folder), "is_open", "score")


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("cluster")
    )


@query("metrics_calinski", """
WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
g AS (SELECT label, d, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM x GROUP BY label, d),
t AS (SELECT d, avg(v) AS m FROM x GROUP BY d),
s AS (SELECT (SELECT sum(w) FROM g) AS within, (SELECT sum(g.n * pow(g.m - t.m, 2)) FROM g JOIN t ON g.d = t.d) AS between,
  (SELECT count(DISTINCT label) FROM embeddings) AS k, (SELECT count(*) FROM embeddings) AS n)
SELECT k AS n_clusters, n AS total_samples, round((between / (k - 1)) / (within / (n - k)), 2) AS calinski_harabasz_score FROM s""")
def metrics_calinski(spark, folder):
    return metrics.calinski_harabasz(_vectors(spark, folder))


@query("class_distribution", 'SELECT CAST(label AS VARCHAR) AS "class", count(*) AS "count" FROM embeddings GROUP BY label')
def class_distribution(spark, folder):
    return metrics.distribution(table(spark, folder, "embeddings"), "label")


@query("score_fallback", """
SELECT s_suppkey, s_nationkey, s_acctbal, round((coalesce(s_suppkey, 0) + coalesce(s_nationkey, 0) + coalesce(s_acctbal, 0)) / 3, 2) AS prediction FROM supplier""")
def score_fallback(spark, folder):
    return ml.score_fallback(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))


@query("score_fallback_ramp", """
SELECT n_name, CAST(1.0 + (row_number() OVER (ORDER BY n_name) - 1) * 0.5 AS DOUBLE) AS prediction FROM nation""")
def score_fallback_ramp(spark, folder):
    return ml.score_fallback(table(spark, folder, "nation").select("n_name"), order_by=["n_name"])


def _lines(spark, folder):
    return table(spark, folder, "lineitem").withColumn(
        "charge", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    )


_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def _rated_documents(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id", "n_chars", "lang", "source", F.length("text").alias("length"),
        F.size(F.split("text", r"\s+")).alias("words"), "quality",
    )


@query("ml_prepare")
def ml_prepare(spark, folder):
    lines = _lines(spark, folder)
    prepared = ml.fit_preprocessing(lines, _LINE_FEATURES).transform(lines)
    return prepared.select("l_orderkey", "l_linenumber", F.col("features").cast("string").alias("features"))


def _fold(key: str) -> str:
    return f"CAST('0x' || substr(md5({key} || '|42'), 1, 8) AS BIGINT) % 5"


@query("ml_split", f"SELECT o_orderkey, CASE WHEN {_fold('o_orderkey')} = 0 THEN 'test' ELSE 'train' END AS side FROM orders")
def ml_split(spark, folder):
    train, test = ml.split_rows(table(spark, folder, "orders"), ["o_orderkey"])
    return train.select("o_orderkey", F.lit("train").alias("side")).unionAll(
        test.select("o_orderkey", F.lit("test").alias("side"))
    )


def _regression(name, kind):
    @query(name)
    def run(spark, folder):
        return ml.train(_lines(spark, folder), kind, "charge", _LINE_FEATURES).metrics
    return run


_regression("ml_linear", "linear_regression")
_regression("ml_ridge", "ridge")


# with one feature, least squares has a closed form
_LINE = f"""
WITH rows AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x, o_totalprice + 10 * o_custkey AS y, {_fold('o_orderkey')} AS fold FROM orders),
line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM rows WHERE fold <> 0),
guessed AS (SELECT *, a + b * x AS p FROM rows, line)"""


def _line_rows(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 10 * F.col("o_custkey")).alias("target"))


@query("ml_linear_line", f"""{_LINE}, t AS (SELECT * FROM guessed WHERE fold = 0)
SELECT round(1 - avg(pow(y - p, 2)) / var_pop(y), 4) AS r2_score, round(sqrt(avg(pow(y - p, 2))), 2) AS rmse, round(avg(abs(y - p)), 2) AS mae,
  round(avg(abs((y - p) / y)) * 100, 2) AS mape_pct, round(1 - var_pop(y - p) / var_pop(y), 4) AS explained_variance,
  count(*) AS test_samples, (SELECT count(*) FROM rows WHERE fold <> 0) AS train_samples FROM t""")
def ml_linear_line(spark, folder):
    got = ml.train(_line_rows(spark, folder), "linear_regression", "target", ["o_custkey"], ["o_orderkey"]).metrics
    return got.withColumn("rmse", F.round("rmse", 2)).withColumn("mae", F.round("mae", 2))


@query("ml_score_line", f"{_LINE} SELECT o_orderkey, round(round(p, 4), 1) AS prediction FROM guessed")
def ml_score_line(spark, folder):
    rows = _line_rows(spark, folder)
    model = ml.train(rows, "linear_regression", "target", ["o_custkey"], ["o_orderkey"])
    return ml.score(model, rows).select("o_orderkey", F.round("prediction", 1).alias("prediction"))


def _part_regression(name, kind):
    @query(name)
    def run(spark, folder):
        parts = table(spark, folder, "part")
        return ml.train(parts, kind, "p_retailprice", ["p_size", "p_brand", "p_type"], ["p_partkey"]).metrics
    return run


_part_regression("ml_rf_reg", "random_forest_regressor")
_part_regression("ml_gbt_reg", "gradient_boosting_regressor")


def _classification(name, kind):
    @query(name)
    def run(spark, folder):
        rows = _rated_documents(spark, folder)
        return ml.train(rows, kind, "quality", ["n_chars", "lang", "source", "length", "words"], ["doc_id"]).metrics
    return run


_classification("ml_logistic", "logistic_regression")
_classification("ml_rf_clf", "random_forest_classifier")
_classification("ml_gbt_clf", "gradient_boosting_classifier")


def _spread_vectors(spark, folder):
    """One column per element of the longest vector."""
    vectors = table(spark, folder, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    return vectors.select(*[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(width)])


@query("ml_kmeans")
def ml_kmeans(spark, folder):
    rows = _spread_vectors(spark, folder)
    return ml.train(rows, "kmeans").metrics


@query("metrics_clustering")
def metrics_clustering(spark, folder):
    rows = _spread_vectors(spark, folder)
    return ml.cluster_sizes(ml.train(rows, "kmeans"), rows)


@query("ml_importance")
def ml_importance(spark, folder):
    return ml.train(_lines(spark, folder), "linear_regression", "charge", _LINE_FEATURES).importance


@query("ml_score")
def ml_score(spark, folder):
    """Scores for every line, with one feature missing from the scoring rows."""
    lines = _lines(spark, folder)
    model = ml.train(lines, "linear_regression", "charge", _LINE_FEATURES)
    return ml.score(model, lines.select("l_orderkey", "l_linenumber", *[c for c in _LINE_FEATURES if c != "l_tax"]))


@query("ml_gbt_multi")
def ml_gbt_multi(spark, folder):
    """Four classes: the language of a document from its sizes and source."""
    rows = _rated_documents(spark, folder)
    return ml.train(rows, "gradient_boosting_classifier", "lang", ["n_chars", "source", "length", "words"], ["doc_id"]).metrics
