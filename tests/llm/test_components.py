"""Components of chains and random graphs, against union-find."""

import random

from gleanframe.llm import jaccard
from gleanframe.llm.components import components


def smallest_reached(edges):
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {v: root(v) for v in parent}


def chain(n, reach):
    return [(i, i + d) for i in range(n) for d in range(1, reach + 1) if i + d < n]


def test_components_equal_union_find(spark):
    draw = random.Random(3)
    star = [(i, 500) for i in range(1000) if i != 500]
    loose = [(draw.randrange(2000), draw.randrange(2000)) for _ in range(1500)]
    parts = (chain(300, 1), chain(200, 2), star, loose)
    edges = [(a + 10_000 * i, b + 10_000 * i) for i, part in enumerate(parts) for a, b in part if a != b]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["id"]: r["component"] for r in got.collect()} == smallest_reached(edges)


def test_drifting_versions_are_one_class(spark):
    # each version drops the first word of the last one and adds a word: only neighbours are near
    data = [(i, " ".join(f"w{j}" for j in range(i, i + 22))) for i in range(150)]
    got = jaccard.similar_classes(spark.createDataFrame(data, "doc_id bigint, text string"), words=4, percent=85)
    assert {r["component_id"] for r in got.collect()} == {0}
