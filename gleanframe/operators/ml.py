"""Training and scoring of the listed model kinds with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    IndexToString, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from gleanframe.functions.text import sql_double
from gleanframe.operators import boosting, forest
from gleanframe.operators.columns import as_double, ident
from gleanframe.operators.metrics import (
    calinski_harabasz, classification_metrics, distribution, regression_metrics,
)
from gleanframe.operators.profile import top_category
from gleanframe.operators.quantiles import medians
from gleanframe.operators.ranks import positions
from gleanframe.session import local_frame, materialise

SEED = 42
MIN_ROWS = 8
TREES, DEPTH, BOOSTS = 100, 12, 100
# statistics of one group of tree nodes; more memory means fewer passes over the rows
NODE_MEMORY_MB = 1024
# cells of one partition of the training rows
PARTITION_CELLS = 4_000_000
# labels of an ordinal code travel to every task; wider columns go through encode_label first
MOST_LABELS = 100_000

REGRESSORS = ("linear_regression", "ridge", "random_forest_regressor", "gradient_boosting_regressor")
CLASSIFIERS = (
    "logistic_regression", "random_forest", "random_forest_classifier", "gradient_boosting_classifier",
)
CLUSTERERS = ("kmeans", "k_means")


@dataclass
class Trained:
    kind: str
    model: PipelineModel
    features: list[str]
    metrics: DataFrame
    importance: DataFrame | None = None
    classes: list[str] = field(default_factory=list)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def feature_columns(df: DataFrame, target: str | None, wanted: Sequence[str] = ()) -> list[str]:
    """Wanted columns that exist, or all but the target."""
    return [c for c in (wanted or df.columns) if c in df.columns and c != target]


def split_features(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    numeric = [c for c in features if isinstance(df.schema[c].dataType, NumericType)]
    return numeric, [c for c in features if c not in numeric]


def preprocessing(df: DataFrame, features: Sequence[str]) -> list:
    """Stages that give ``features``: filled and scaled numbers, then ordinal codes.

    Numbers are filled with their median and scaled; other columns are filled with their
    most frequent value and coded in sorted order, -1 for values not seen in training.
    All stages save with the model.
    """
    numeric, other = split_features(df, features)
    stages, parts = [], []
    fills = []
    if numeric:
        middle = medians(df, numeric)
        for i, c in enumerate(numeric):
            q, fill = _quoted(c), middle[c] if middle[c] is not None else 0.0
            number = f"CAST({q} AS DOUBLE)"
            fills.append(f"COALESCE(IF(ISNAN({number}), NULL, {number}), {sql_double(fill)}) AS __num{i}")
    texts = df.select(*[ident(c).cast("string").alias(c) for c in other])
    tops = {r["column"]: r for r in top_category(texts, other).collect()} if other else {}
    for i, c in enumerate(other):
        if c in tops and tops[c]["unique_count"] > MOST_LABELS:
            raise ValueError(f"{c} has {tops[c]['unique_count']} values; apply encode_label first")
        top = tops[c]["top_category"] if c in tops else ""
        quoted = "'" + top.replace("\\", "\\\\").replace("'", "\\'") + "'"
        fills.append(f"COALESCE(CAST({_quoted(c)} AS STRING), {quoted}) AS __cat{i}")
    stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__"))
    if numeric:
        stages += [
            VectorAssembler(inputCols=[f"__num{i}" for i in range(len(numeric))], outputCol="__numbers"),
            StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True),
        ]
        parts.append("__scaled")
    if other:
        stages.append(StringIndexer(
            inputCols=[f"__cat{i}" for i in range(len(other))], outputCols=[f"__idx{i}" for i in range(len(other))],
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ))
        stages.append(("codes", len(other)))
        parts += [f"__code{i}" for i in range(len(other))]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def fit_preprocessing(df: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Fit the stages; the code of an unseen value is known only after the labels are."""
    fitted, rows = [], df
    for stage in preprocessing(df, features):
        if isinstance(stage, tuple):
            labels = next(m for m in fitted if hasattr(m, "labelsArray")).labelsArray
            # a fresh expression also drops the nominal metadata, so trees see ordered codes
            cells = ", ".join(
                f"IF(__idx{i} >= {len(known)}, -1.0D, __idx{i} + 0.0D) AS __code{i}" for i, known in enumerate(labels)
            )
            stage = SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__")
        model = stage.fit(rows) if hasattr(stage, "fit") else stage
        fitted.append(model)
        rows = model.transform(rows)
    return PipelineModel(fitted)


def held_out(key: Sequence[str], folds: int = 5) -> Column:
    """Whether a row is one of the tested, one in ``folds``, by the MD5 of its key's text.

    The same row lands on the same side in every run, under any partitioning and in any engine.
    """
    text = F.concat_ws("|", *[F.coalesce(ident(c).cast("string"), F.lit("")) for c in key], F.lit(str(SEED)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % folds == 0


def split_rows(df: DataFrame, key: Sequence[str], folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, test), four fifths to one."""
    tested = held_out(key, folds)
    return df.where(~tested), df.where(tested)


def partitions_for(df: DataFrame, rows: int, columns: int) -> int:
    """One partition per core, or as many more as keep each within ``PARTITION_CELLS``."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows * columns // PARTITION_CELLS))


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core; a table of few files would train on few of them.

    More rows make more partitions, not larger ones.
    """
    return df.repartition(partitions_for(df, df.count(), len(df.columns)))


def dealt_finely(points: DataFrame, rows: int, columns: int) -> DataFrame:
    """Points in partitions that do not grow with the table, whatever the files they are read from pack together."""
    many = partitions_for(points, rows, columns)
    return points.repartition(many) if many > points.sparkSession.sparkContext.defaultParallelism else points


def _regressor(kind: str, train: DataFrame):
    if kind == "linear_regression":
        return LinearRegression(labelCol="__label")
    if kind == "ridge":
        # Spark averages the loss and scales the penalty by the label's deviation
        row = train.agg(F.stddev_pop("__label").alias("s"), F.count(F.lit(1)).alias("n")).first()
        return LinearRegression(
            labelCol="__label", solver="normal", regParam=(row["s"] or 0.0) / row["n"],
            elasticNetParam=0.0, standardization=False,
        )
    if kind == "random_forest_regressor":
        return RandomForestRegressor(
            labelCol="__label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="all",
            maxMemoryInMB=NODE_MEMORY_MB,
        )
    return GBTRegressor(labelCol="__label", maxIter=BOOSTS, stepSize=0.1, maxDepth=3, seed=SEED)


def _classifier(kind: str, rows: int):
    if kind == "logistic_regression":
        return LogisticRegression(
            labelCol="__label", maxIter=1000, regParam=1.0 / rows, elasticNetParam=0.0,
            standardization=False,
        )
    if kind == "gradient_boosting_classifier":
        return GBTClassifier(labelCol="__label", maxIter=BOOSTS, stepSize=0.1, maxDepth=3, seed=SEED)
    return RandomForestClassifier(
        labelCol="__label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=NODE_MEMORY_MB
    )


def _falling(df: DataFrame, names: list[str], values: Sequence[float]) -> DataFrame:
    rows = sorted(((n, round(float(v), 4)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))
    return local_frame(df.sparkSession, rows, "feature string, importance double")


def _importance(df: DataFrame, names: list[str], model) -> DataFrame | None:
    """(feature, importance) falling: tree importances, or the shares of |coefficient|."""
    if hasattr(model, "featureImportances"):
        values = [float(v) for v in model.featureImportances.toArray()]
    elif hasattr(model, "coefficients") and not hasattr(model, "numClasses"):
        sizes = [abs(float(v)) for v in model.coefficients]
        values = [v / (sum(sizes) or 1.0) for v in sizes]
    else:
        return None
    return _falling(df, names, values)


def train(
    df: DataFrame, kind: str, target: str | None = None, features: Sequence[str] = (),
    key: Sequence[str] = (),
) -> Trained:
    """Fit one of the listed kinds and rate it on the held-out fifth.

    ``key`` identifies a row for the split; without it the features and target do.
    """
    kind = kind.lower()
    if kind not in REGRESSORS + CLASSIFIERS + CLUSTERERS:
        raise ValueError(f"unsupported model kind {kind!r}")
    names = feature_columns(df, target, features)
    if not names:
        raise ValueError("no feature columns")
    numeric, other = split_features(df, names)
    ordered = numeric + other
    if kind in CLUSTERERS:
        return train_clusters(df, names)
    if target is None or target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    is_regression = kind in REGRESSORS
    label = as_double(df, target) if isinstance(df.schema[target].dataType, NumericType) else ident(target)
    used = df.where(label.isNotNull()).select(
        *[ident(c) for c in dict.fromkeys([*names, *key])],
        (label.cast("double") if is_regression else ident(target).cast("string")).alias("__target"),
    )
    # the rows are read many times, so they are spread and dealt to their side once
    rows = materialise(spread(used.withColumn("__held_out", held_out(list(key) or [*names, "__target"]))), "training")
    sizes = {r["__held_out"]: r["count"] for r in rows.groupBy("__held_out").count().collect()}
    if sum(sizes.values()) < MIN_ROWS:
        raise ValueError("too few rows with a target")
    train_rows, test_rows = rows.where("NOT __held_out").drop("__held_out"), rows.where("__held_out").drop("__held_out")
    trained_on = sizes.get(False, 0)
    prepared = fit_preprocessing(train_rows, names)
    classes: list[str] = []
    grown: boosting.Boosted | forest.Forest | None = None
    # trees cut the filled numbers where they would cut the scaled ones
    cells = [f"__num{i}" for i in range(len(numeric))] + [f"__code{i}" for i in range(len(other))]
    if is_regression:
        labelled = prepared.transform(train_rows).withColumn("__label", F.col("__target"))
        if kind == "random_forest_regressor":
            grown = forest.fit(labelled, cells, "__label", trained_on, trees=TREES, depth=DEPTH, seed=SEED)
        if grown is None:
            estimator = _regressor(kind, labelled)
        tail = []
    else:
        coder = StringIndexer(
            inputCol="__target", outputCol="__label", stringOrderType="alphabetAsc",
        ).fit(train_rows)
        classes = list(coder.labels)
        labelled = coder.transform(prepared.transform(train_rows))
        if kind == "gradient_boosting_classifier" and len(classes) > 2:
            grown = boosting.fit(labelled, cells, "__label", len(classes), rounds=BOOSTS)
        else:
            estimator = _classifier(kind, trained_on)
        tail = [IndexToString(inputCol="prediction", outputCol="__predicted", labels=classes)]
    if grown is not None:
        model = PipelineModel([*prepared.stages, *grown.stages(), *tail])
        importance = _falling(df, ordered, grown.importances)
    else:
        points = dealt_finely(labelled.select("features", "__label"), trained_on, len(names) + 1).persist()
        fitted = estimator.fit(points)
        points.unpersist()
        model = PipelineModel([*prepared.stages, fitted, *tail])
        importance = _importance(df, ordered, fitted)
    scored = model.transform(test_rows)
    if is_regression:
        metrics = regression_metrics(scored, "__target", "prediction")
    else:
        metrics = classification_metrics(scored, "__target", "__predicted")
    metrics = metrics.withColumn("train_samples", F.lit(trained_on).cast("bigint"))
    return Trained(kind, model, names, metrics, importance, classes)


def cluster_count(rows: int) -> int:
    return min(4, max(2, rows // 10))


def train_clusters(df: DataFrame, features: Sequence[str], starts: int = 10) -> Trained:
    """K-means on the prepared features; the best of several starts by its cost.

    Each start costs a full fit on the prepared points.
    """
    names = list(features)
    rows = spread(materialise(df.select(*[ident(c) for c in names]), "clusters"))
    n = rows.count()
    k = cluster_count(n)
    prepared = fit_preprocessing(rows, names)
    points = prepared.transform(rows).select("features").persist()
    fits = [KMeans(k=k, seed=SEED + i).fit(points) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    scored = best.transform(points)
    silhouette = ClusteringEvaluator().evaluate(scored) if n > k else 0.0
    points.unpersist()
    metrics = calinski_harabasz(scored, "features", "prediction").withColumn(
        "silhouette_score", F.round(F.lit(silhouette), 4)
    )
    return Trained("kmeans", PipelineModel([*prepared.stages, best]), names, metrics)


def cluster_sizes(trained: Trained, df: DataFrame) -> DataFrame:
    return distribution(trained.model.transform(df), "prediction")


def add_missing_features(df: DataFrame, features: Sequence[str], like: DataFrame | None = None) -> DataFrame:
    """Columns that scoring rows lack come in as null."""
    for c in features:
        if c not in df.columns:
            kind = like.schema[c].dataType if like is not None else "double"
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df


def score(trained: Trained, df: DataFrame) -> DataFrame:
    """Rows with a ``prediction``: rounded numbers, class names, or cluster numbers."""
    wide = add_missing_features(df, trained.features)
    out = trained.model.transform(wide)
    if trained.classes:
        prediction = F.col("__predicted")
    elif trained.kind == "kmeans":
        prediction = F.col("prediction")
    else:
        prediction = F.round("prediction", 4)
    return out.select(*[ident(c) for c in df.columns], prediction.alias("prediction"))


def save(trained: Trained, path: str) -> None:
    trained.model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_fallback(df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Mean over the numeric fields, nulls as 0; a row ramp where there is no number."""
    numeric = [
        c for c in (columns or df.columns) if isinstance(df.schema[c].dataType, NumericType)
    ]
    if numeric:
        total = F.lit(0.0)
        for c in numeric:
            total = total + F.coalesce(as_double(df, c), F.lit(0.0))
        return df.withColumn("prediction", F.round(total / len(numeric), 2))
    ranked = positions(df, list(order_by) or df.columns, name="__i")
    return ranked.withColumn("prediction", F.round(1.0 + F.col("__i") * 0.5, 2)).drop("__i")
