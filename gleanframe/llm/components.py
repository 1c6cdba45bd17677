"""Connected components by contraction, with nothing but joins and minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.session import free, materialise

# rounds that go by the ids themselves: a star or a clique of copies needs no more
ID_ROUNDS = 2


def _order(vertex: str, turn: int) -> Column:
    """Place of a vertex in the strict order of a round; its last field is the vertex."""
    rank = F.lit(0).cast("bigint") if turn < ID_ROUNDS else F.xxhash64(F.col(vertex), F.lit(turn))
    return F.struct(rank.alias("rank"), F.col(vertex).alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b): the smallest id that can be reached.

    Each round maps a vertex to the least of itself and its neighbours and keeps the edges
    between different images.  The greatest vertex of a component is never an image, so the
    rounds end whatever the order; by a hash that is new in each round at most three quarters
    of the vertices are expected to stay, so their number grows with the logarithm of a chain.
    """
    left = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels, turn = None, 0
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_order("b", turn)).alias("m"))
        least = materialise(least.select("a", F.least(_order("a", turn), F.col("m"))["v"].alias("m")), "least")
        if labels is None:
            labels = materialise(least.select(F.col("a").alias("id"), F.col("m").alias("component")), "labels")
        else:
            moved = labels.join(least, labels["component"] == least["a"], "left")
            old, labels = labels, materialise(moved.select("id", F.coalesce("m", "component").alias("component")), "labels")
            free(old)
        x, y = least.select(F.col("a"), F.col("m").alias("ma")), least.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        rest = left.join(x, "a").join(y, "b").where("ma <> mb").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
        old, left = left, materialise(rest.distinct(), "edges")
        free(old, least)
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    if turn > ID_ROUNDS:
        # a hash order ends at any vertex of the component
        smallest = labels.groupBy("component").agg(F.min("id").alias("m"))
        old, labels = labels, materialise(labels.join(smallest, "component").select("id", F.col("m").alias("component")), "labels")
        free(old)
    return labels
