"""Hard negatives against plain inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm.negatives import hard_negatives, planes_of, scores_of, subset_sums

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(data, anchors, least=30, most=90):
    rows = []
    for i, x, label, *_ in data:
        if None in (i, x, label) or any(v is None or not math.isfinite(v) for v in x):
            continue
        rows.append((i, [math.floor(256 * v) for v in x], label))
    out = []
    for a, q, label in [r for r in rows if r[0] in anchors]:
        score = [(-sum(x * y for x, y in zip(q, p)), i, other) for i, p, other in rows if i != a and q and len(p) == len(q)]
        for s, i, _ in sorted(r for r in score if r[2] == label)[:5]:
            fits = sorted(r for r in score if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s)
            out += [(a, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits[:10])]
    return sorted(out)


@pytest.mark.parametrize("dims", [1, 8, 13, 64])
def test_lookups_give_inner_products(dims):
    draw = np.random.default_rng(dims)
    for size in (1, 2, 130, 1 << 20):
        a, c = draw.integers(-size, size, (7, dims)), draw.integers(-size, size, (50, dims))
        assert (scores_of(planes_of(c), subset_sums(a)) == c @ a.T).all()


@pytest.mark.parametrize("wave", [1 << 18, 200])
def test_equals_plain_scores(spark, wave):
    draw = np.random.default_rng(1)
    data = [(i, [float(v) for v in draw.normal(size=20) * 0.2], int(draw.integers(4))) for i in range(900)]
    # ties: whole rows again under other ids
    data += [(900 + i, *data[i][1:]) for i in range(150)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = hard_negatives(df, F.col("id") % 100 == 0, wave=wave)
    assert sorted(tuple(r) for r in got.collect()) == plain(data, set(range(0, 1100, 100)))


def test_odd_rows(spark):
    nan, inf, one = float("nan"), float("inf"), [0.5, 0.25, -0.1]
    data = [
        (0, one, 1), (1, one, 1), (2, [0.4, 0.2, 0.0], 2), (2, [0.4, 0.2, 0.0], 2), (3, [0.3, 0.1, 0.0], 2), (4, None, 2), (5, one, None), (None, one, 2),
        (6, [0.3, nan, 0.1], 2), (7, [0.3, inf, 0.1], 2), (8, [0.3, None, 0.1], 2), (9, [], 2), (10, [0.3, 0.1], 2), (100, [], 1), (200, [-0.5, -0.2, 0.1], 1),
        (300, [0.2, 0.3], 2), (301, [1000.5, -70000.25], 2), (302, [0.1, 0.1], 1), (303, [800.0, -70000.0], 3), (400, [0.0, 0.0, 0.0], 5), (401, [1.0, 0.0, 0.0], 5),
        (500, [900.0, -60000.0], 2),
    ]
    names = ["id", "planes", "dims", "place", "rank", "score", "anchor_id", "p"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in data], SCHEMA + "".join(f", {c} int" for c in names))
    anchors = {0, 100, 200, 300, 400, 500}
    got = hard_negatives(df, F.col("id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain(data, anchors)
    assert hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0], 1), (1, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (2, [0.5, 0.5], 2)], SCHEMA)
    assert [tuple(r) for r in hard_negatives(huge, F.col("id") % 100 == 0).collect()] == [(100, 1, 1, 2, 131072, 65536)]
