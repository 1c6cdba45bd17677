"""Gradient boosting for any number of classes: softmax loss, one regression tree per class and round.

Features are cut into bins once, and rows equal in all bins and the label become one with their number: all trees
treat them alike, so a scan costs what the bins tell apart, not what the table holds.  A level of the trees of all classes costs one scan: every task adds up its
rows' gradients per (class, node, feature, bin), the sums meet in one grouping, and the driver sees one small
histogram, whose size depends on the model alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from gleanframe.operators.columns import aggregate_row, ident
from gleanframe.session import free, materialise

# worker functions take their helpers along; executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
# cells of one histogram; more classes than fit take turns
HISTOGRAM_CELLS = 1_000_000
# rounds after which the scores of the rows are written, so that no scan repeats many trees
KEPT_ROUNDS = 10
# gains closer than this share are ties, whatever the order their sums were added in
SAME_GAIN = 1e-9


@dataclass
class Tree:
    """Node i has the children 2i and 2i+1; a feature of -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gains: dict[int, float] = field(default_factory=dict)


@dataclass
class Boosted:
    columns: list[str]
    edges: list[list[float]]
    priors: list[float]
    rate: float
    rounds: list[list[Tree]]

    @property
    def importances(self) -> list[float]:
        """Shares of the features in the gain of a tree, averaged over the trees that split."""
        total = np.zeros(len(self.columns))
        for tree in (t for trees in self.rounds for t in trees):
            whole = sum(tree.gains.values())
            for f, gain in tree.gains.items():
                total[f] += gain / whole
        return list(total / (total.sum() or 1.0))

    def _branch(self, tree: Tree, node: int) -> str:
        f = int(tree.feature[node])
        if f < 0:
            return f"{float(tree.value[node])!r}D"
        test = f"`{self.columns[f]}` > {self.edges[f][int(tree.cut[node])]!r}D"
        return f"IF({test}, {self._branch(tree, 2 * node + 1)}, {self._branch(tree, 2 * node)})"

    def stages(self) -> list[SQLTransformer]:
        """Stages that add ``probability`` (an array in the order of the labels) and ``prediction``."""
        scores = []
        for k, prior in enumerate(self.priors):
            steps = ", ".join(self._branch(trees[k], 1) for trees in self.rounds) or "0.0D"
            scores.append(f"{prior!r}D + {self.rate!r}D * aggregate(array({steps}), 0.0D, (s, x) -> s + x)")
        return [SQLTransformer(statement=f"SELECT *, {what} FROM __THIS__") for what in (
            f"array({', '.join(scores)}) AS __scores",
            "transform(__scores, x -> exp(x - array_max(__scores))) AS __odds",
            "transform(__odds, x -> x / aggregate(__odds, 0.0D, (s, y) -> s + y)) AS probability, "
            "CAST(array_position(__scores, array_max(__scores)) - 1 AS DOUBLE) AS prediction",
        )]


def bin_edges(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Per column at most 31 rising cuts: between all its values if it has few, else at its quantiles."""
    shares = [i / BINS for i in range(1, BINS)]
    row = aggregate_row(df, [
        e for i, c in enumerate(columns) for e in (
            F.approx_count_distinct(ident(c), 0.02).alias(f"d{i}"),
            F.percentile_approx(ident(c), shares, 10_000).alias(f"q{i}"),
        )
    ])
    few = [i for i in range(len(columns)) if (row[f"d{i}"] or 0) <= 2 * BINS]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:
        # the estimate bounds what comes back to some 64 values a column
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), ident(columns[i]).cast("double").alias("v")) for i in few]))
        for r in df.select(cells.alias("x")).select("x.*").where("v IS NOT NULL").distinct().collect():
            values[r["c"]].append(r["v"])
    edges = []
    for i in range(len(columns)):
        known = sorted(values.get(i, []))
        if i in values and len(known) <= BINS:
            edges.append([(a + b) / 2.0 for a, b in zip(known, known[1:])])
        else:
            edges.append(sorted({float(v) for v in row[f"q{i}"] or []}))
    return edges


def _route(bins: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = tree.feature[node]
        right = bins[rows, np.maximum(f, 0)] > tree.cut[node]
        node = np.where(f >= 0, 2 * node + right, node)
    return node


def _scores(batch: pd.DataFrame, bins: np.ndarray, pending: list[list[Tree]], rate: float, depth: int) -> np.ndarray:
    scores = np.stack(batch["scores"].to_numpy()).astype(np.float64)
    for trees in pending:
        for k, tree in enumerate(trees):
            scores[:, k] += rate * tree.value[_route(bins, tree, depth)]
    return scores


def _cells(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["bins"].to_numpy()).astype(np.int64)


def _histogram(
    rows: DataFrame, pending: list[list[Tree]], growing: dict[int, Tree], level: int, rate: float, depth: int, features: int,
) -> dict[tuple[int, int], np.ndarray]:
    """Per (class, node) of a level: counts, gradients and weights of its rows by feature and bin."""
    wide = 1 << level

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(growing), 3, wide * features * BINS))
        for batch in batches:
            if not len(batch):
                continue
            bins = _cells(batch)
            odds = _scores(batch, bins, pending, rate, depth)
            odds = np.exp(odds - odds.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            labels, rows_of = batch["label"].to_numpy(), batch["n"].to_numpy(np.float64)
            for at, (k, tree) in enumerate(growing.items()):
                gradient = (labels == k) - odds[:, k]
                weight = np.abs(gradient) * (1.0 - np.abs(gradient))
                node = _route(bins, tree, level) - wide
                here = node >= 0
                slot = ((node[here, None] * features + np.arange(features)[None, :]) * BINS + bins[here]).ravel()
                for j, w in enumerate((rows_of, rows_of * gradient, rows_of * weight)):
                    total[at, j] += np.bincount(slot, np.repeat(w[here], features), total.shape[2])
        at, slot = np.nonzero(total[:, 0])
        yield pd.DataFrame({
            "at": at.astype(np.int32), "slot": slot.astype(np.int32), "n": total[at, 0, slot], "g": total[at, 1, slot], "w": total[at, 2, slot],
        })

    parts = rows.mapInPandas(add, "at int, slot int, n double, g double, w double")
    sums = parts.groupBy("at", "slot").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("w").alias("w")).toPandas()
    names, out = list(growing), {}
    for at, part in sums.groupby("at"):
        table = np.zeros((3, wide * features * BINS))
        table[:, part["slot"].to_numpy()] = part[["n", "g", "w"]].to_numpy().T
        table = table.reshape(3, wide, features, BINS)
        for node in range(wide):
            if table[0, node].any():
                out[names[at], wide + node] = table[:, node]
    return out


def _leaf(gradient: float, weight: float, classes: int) -> float:
    """One Newton step of the softmax loss."""
    return 0.0 if abs(weight) < 1e-150 else (classes - 1) / classes * gradient / weight


def _split(tree: Tree, node: int, sums: np.ndarray, classes: int) -> None:
    """Cut a node where the squared error of the gradients falls most; ties go to the first feature and bin."""
    n, g, w = sums
    whole = [float(x[0].sum()) for x in (n, g, w)]
    tree.value[node] = _leaf(whole[1], whole[2], classes)
    below = [x.cumsum(1)[:, :-1] for x in (n, g, w)]
    above = [t - b for t, b in zip(whole, below)]
    # counts are whole numbers, so an empty side is exactly zero
    possible = (below[0] > 0) & (above[0] > 0)
    if not possible.any():
        return
    means = below[1] / np.maximum(below[0], 1.0) - above[1] / np.maximum(above[0], 1.0)
    gain = np.where(possible, below[0] * above[0] / whole[0] * means * means, 0.0)
    if gain.max() <= 1e-12 * whole[0]:
        return
    first = np.nonzero(gain >= gain.max() * (1.0 - SAME_GAIN))
    f, cut = int(first[0][0]), int(first[1][0])
    tree.feature[node], tree.cut[node], tree.gains[f] = f, cut, tree.gains.get(f, 0.0) + float(gain[f, cut])
    for child, side in ((2 * node, below), (2 * node + 1, above)):
        tree.value[child] = _leaf(float(side[1][f, cut]), float(side[2][f, cut]), classes)


def fit(
    df: DataFrame, columns: Sequence[str], label: str, classes: int, *, rounds: int, rate: float = 0.1, depth: int = 3,
) -> Boosted:
    """Boost on double columns without nulls and a label 0 … classes-1, all of which occur.

    The scores start at the logarithms of the classes' shares.  An empty table is refused.
    """
    columns = list(columns)
    edges = bin_edges(df, columns)
    counts = {int(r[label]): r["count"] for r in df.groupBy(label).count().collect()}
    if len(counts) != classes:
        raise ValueError("every class needs a row")
    priors = [float(np.log(counts[k] / sum(counts.values()))) for k in range(classes)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = [np.searchsorted(np.array(e), batch[f"x{i}"].to_numpy(np.float64), side="left") for i, e in enumerate(edges)]
            yield pd.DataFrame({"label": batch["label"], "bins": list(np.stack(bins, 1).astype(np.int8))})

    state = "label int, bins array<tinyint>, n bigint, scores array<double>"
    plain = df.select(ident(label).cast("int").alias("label"), *[ident(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    alike = plain.mapInPandas(place, "label int, bins array<tinyint>").groupBy("label", "bins").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(alike.withColumn("scores", F.array(*[F.lit(p) for p in priors])), "boosting")
    model = Boosted(columns, edges, priors, rate, [])
    pending: list[list[Tree]] = []
    size = 2 << depth
    at_once = max(1, HISTOGRAM_CELLS // ((1 << depth) * len(columns) * BINS))
    for _ in range(rounds):
        trees = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(classes)]
        for level in range(depth):
            for start in range(0, classes, at_once):
                growing = {k: trees[k] for k in range(start, min(classes, start + at_once))}
                for (k, node), sums in _histogram(rows, pending, growing, level, rate, depth, len(columns)).items():
                    _split(trees[k], node, sums, classes)
        model.rounds.append(trees)
        pending.append(trees)
        if len(pending) == KEPT_ROUNDS and len(model.rounds) < rounds:
            done = pending

            def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    if len(batch):
                        yield batch.assign(scores=list(_scores(batch, _cells(batch), done, rate, depth)))

            before, rows, pending = rows, materialise(rows.mapInPandas(advance, state), "boosting"), []
            free(before)
    free(rows)
    return model
