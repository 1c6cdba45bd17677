"""A random forest of regression trees whose cost follows the different rows, not the number of rows.

Rows equal in all features and the label become one with their number n: a bootstrap takes n such rows Poisson(n) times
together.  A cut compares weights and sums of labels alone, so the drawn rows of equal features go into a tree as one row
with their number and mean label: the tree has the cuts and values that the rows themselves would give it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from gleanframe.operators.columns import ident
from gleanframe.session import free, materialise

# worker functions take their helpers along; executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# with fewer rows for each combination of features, the draws of all trees take more storage than the trees gain
ROWS_ALIKE = 10
# rows of one task
TASK_ROWS = 250_000
# trees that grow side by side; one alone keeps few cores busy
TREES_AT_ONCE = 16


@dataclass
class Forest:
    columns: list[str]
    trees: list[RandomForestRegressionModel]

    @property
    def importances(self) -> list[float]:
        """Shares of the features in the gain of a tree, averaged over the trees that split."""
        total = sum(tree.featureImportances.toArray() for tree in self.trees)
        return list(total / (total.sum() or 1.0))

    def stages(self) -> list[Transformer]:
        """Stages that add ``prediction``, the mean over the trees."""
        steps = ", ".join(tree.getPredictionCol() for tree in self.trees)
        mean = f"aggregate(array({steps}), 0.0D, (s, x) -> s + x) / {len(self.trees)}"
        return [
            VectorAssembler(inputCols=self.columns, outputCol="__cells"), *self.trees,
            SQLTransformer(statement=f"SELECT *, {mean} AS prediction FROM __THIS__"),
        ]


def _tasks(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def bootstrap(alike: DataFrame, cells: list[str], trees: int, seed: int) -> DataFrame:
    """Per tree and combination of ``cells``: how many rows ``w`` a bootstrap takes, and the sum ``s`` of their labels.

    ``alike`` has ``n`` rows of each combination and ``label``.  A draw depends on these, the tree and the seed alone,
    so every partitioning gives the same ones.
    """
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            times = np.stack([
                np.random.Generator(np.random.Philox(key=int(k) & (2**64 - 1))).poisson(n, trees) for k, n in zip(batch["key"], batch["n"])
            ]).astype(np.float64)
            x = batch[cells].to_numpy()
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)])
            labels = batch["label"].to_numpy(np.float64)[:, None]
            yield batch[cells].iloc[first].assign(
                w=list(np.add.reduceat(times, first)), s=list(np.add.reduceat(times * labels, first)),
            )

    # sorted, a batch holds few combinations; ranges that go on within one spread a frequent one over tasks
    order = [*cells, "label"]
    dealt = alike.repartitionByRange(_tasks(alike, alike.count()), *order).sortWithinPartitions(*order)
    sums = dealt.withColumn("key", F.xxhash64(F.lit(seed), *order)).mapInPandas(
        draw, ", ".join(f"{c} double" for c in cells) + ", w array<double>, s array<double>",
    )
    each = sums.select(*cells, F.posexplode(F.arrays_zip("w", "s")).alias("tree", "x")).where("x.w > 0")
    return each.groupBy("tree", *cells).agg(F.sum("x.w").alias("w"), F.sum("x.s").alias("s"))


def fit(df: DataFrame, columns: Sequence[str], label: str, rows: int, *, trees: int, depth: int, seed: int) -> Forest | None:
    """Grow a forest on the ``rows`` rows of double columns without nulls, or none where few rows are alike or labels are infinite."""
    cells = [f"x{i}" for i in range(len(columns))]
    plain = df.select(*[ident(c).cast("double").alias(x) for c, x in zip(columns, cells)], ident(label).cast("double").alias("label"))
    alike = materialise(plain.groupBy(*cells, "label").agg(F.count(F.lit(1)).alias("n")), "forest")
    different = alike.select(*cells).distinct().count()
    # infinite labels have no mean to weigh
    if rows < ROWS_ALIKE * different or not alike.where(F.abs("label") == float("inf")).isEmpty():
        free(alike)
        return None
    drawn = bootstrap(alike, cells, trees, seed)
    # the rows of a tree lie together, so that its scans skip the others
    drawn = materialise(drawn.repartitionByRange(_tasks(alike, different * trees), "tree", *cells).sortWithinPartitions("tree"), "forest")
    sizes = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}

    def grow(tree: int) -> RandomForestRegressionModel:
        points = drawn.where(F.col("tree") == tree).select(
            array_to_vector(F.array(*cells)).alias("__cells"), (F.col("s") / F.col("w")).alias("label"), "w",
        )
        parts = -(-sizes[tree] // TASK_ROWS)
        # its bootstrap has been drawn
        return RandomForestRegressor(
            featuresCol="__cells", labelCol="label", weightCol="w", predictionCol=f"__tree{tree}", numTrees=1,
            bootstrap=False, featureSubsetStrategy="all", maxDepth=depth, seed=seed,
        ).fit(points.repartition(parts) if parts > 1 else points.coalesce(1))

    with ThreadPoolExecutor(min(TREES_AT_ONCE, df.sparkSession.sparkContext.defaultParallelism)) as pool:
        inherit = inheritable_thread_target(df.sparkSession)
        waiting = [pool.submit(inherit(grow), tree) for tree in sorted(sizes)]
        grown = [w.result() for w in waiting]
    free(alike, drawn)
    return Forest(list(columns), grown)
