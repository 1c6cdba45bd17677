"""Lattice hashing against all pairs: links, classes, weights, and every odd kind of row."""

import math

import numpy as np
import pytest

from gleanframe.llm.lattice import ROOTS, Lattice, decode, lattice_for, near_classes
from gleanframe.llm.queries import QUERIES
from tests.llm.test_components import smallest_reached


def planted(n, dims=64, seed=1, spread=0.012):
    """Random vectors of three labels; every fifth has near copies, one has very many."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = draw.normal(size=dims) / dims ** 0.5
        copies = 150 if i == 3 else (1 + i % 4 if i % 5 == 0 else 0)
        label = int(draw.integers(3))
        out += [(x + draw.normal(size=dims) * (spread if j else 0) * draw.random(), label) for j in range(copies + 1)]
    draw.shuffle(out)
    return [(i, [float(np.float32(v)) for v in x], label) for i, (x, label) in enumerate(out)]


def all_pairs(data, threshold):
    usable = [
        (i, np.array(x), label) for i, (_, x, label) in enumerate(data)
        if label is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)
    ]
    return [
        (i, j) for n, (i, x, a) in enumerate(usable) for j, y, b in usable[n + 1:]
        if a == b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold
    ]


def expected(data, threshold):
    """(links, component) by row."""
    links = all_pairs(data, threshold)
    count, part = [0] * len(data), smallest_reached(links)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    least = {}
    for i, root in part.items():
        least[root] = min(least.get(root, data[i][0]), data[i][0])
    return [(count[i], least[part[i]] if i in part else data[i][0]) for i in range(len(data))]


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def test_nearest_lattice_points():
    y = np.random.default_rng(2).normal(size=(3000, 8)) * 2
    point = decode(y)
    assert (point.sum(1) % 2 == 0).all() and ((2 * point) % 2 == (2 * point[:, :1]) % 2).all()
    beside = ((y[:, None] - point[:, None] - ROOTS) ** 2).sum(2).min(1)
    assert (((y - point) ** 2).sum(1) <= beside + 1e-12).all()


def test_codes_do_not_depend_on_the_batch():
    x = np.random.default_rng(4).normal(size=(500, 48))
    lattice = Lattice(2, 4, 4)
    home, probed = lattice.codes(x, np.arange(500) % 3)
    some = np.arange(499, 0, -7)
    again, beside = lattice.codes(np.ldexp(x[some], 9), some % 3)
    assert (again == home[some]).all() and (np.sort(beside, 2) == np.sort(probed[some], 2)).all()


@pytest.mark.parametrize("rows", [1000, 1 << 25, 1 << 40])
def test_recall_at_the_threshold(rows):
    draw, lattice = np.random.default_rng(5), lattice_for(rows)
    u, v = draw.normal(size=(2, 800, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v -= (u * v).sum(1)[:, None] * u
    v = 0.93 * u + math.sqrt(1 - 0.93 ** 2) * v / np.linalg.norm(v, axis=1)[:, None]
    group = np.zeros(800, int)
    (hu, pu), (hv, pv) = lattice.codes(u, group), lattice.codes(v, group)
    meet = (hu == hv).any(1) | (pu == hv[:, :, None]).any((1, 2)) | (pv == hu[:, :, None]).any((1, 2))
    assert meet.mean() >= 0.93


@pytest.mark.parametrize("block", [512, 16])
def test_links_and_classes_equal_all_pairs(spark, block):
    data = planted(300)
    got = near_classes(spark.createDataFrame(data, SCHEMA), threshold=0.93, block=block).collect()
    want = expected(data, 0.93)
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(n for n, _ in want) > 20_000
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
    same = [(r["n_links"], r["component_id"]) == want[r["vec_id"]] for r in got]
    assert np.mean(same) >= 0.99 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    grouped = {r["vec_id"]: r for r in got}
    again = near_classes(spark.createDataFrame(data[::-1], SCHEMA), threshold=0.93, block=block * 2).collect()
    assert all(grouped[r["vec_id"]] == r for r in again)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    unit = [1.0, 0.0, 0.5]
    data = [
        (5, unit, 1), (4, unit, 1), (9, unit, 1), (9, unit, 1), (None, unit, 1), (3, unit, 2), (2, unit, None), (1, None, 1),
        (7, [0.0, 0.0, 0.0], 1), (8, [0.0, -0.0, 0.0], 1), (10, [1.0, None, 0.5], 1), (11, [1.0, nan, 0.5], 1), (12, [inf, 0.0, 0.5], 1),
        (13, [], 1), (14, [1.0, 0.0], 1), (15, [2.0, 0.0, 1.0], 1), (16, [3e38, 0.0, 1.5e38], 1), (17, [1e-40, 0.0, 0.0], 4),
        (18, [1e-40, 0.0, 0.0], 4), (None, None, None), (19, [1.0, -0.0, 0.5], 1),
    ]
    names = ["same", "row", "id", "node", "n", "key", "links", "component_id", "weight"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in data], SCHEMA + "".join(f", {c} int" for c in names))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in near_classes(df, threshold=0.93).collect())
    linked = {5: 7, 4: 7, 9: 7, None: 7, 15: 7, 16: 7, 19: 7}
    want = sorted(
        (str(k), linked.get(k, 0) if x is not None else 0, "4" if k in linked and x is not None else "17" if k == 18 else str(k),
         (k == 4 or k not in linked and k != 18) if x is not None else True)
        for k, x, _ in data
    )
    want = [(k, 1, c, kept) if k in ("17", "18") else (k, n, c, kept) for k, n, c, kept in want]
    assert got == want
    assert near_classes(df.limit(0)).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    got = QUERIES["op11_lattice_neardup"](spark, folder).collect()
    want = expected([tuple(r) for r in rows], 0.93) if len(rows) <= 3000 else None
    assert len(got) == len(rows)
    if want:
        by = {r["vec_id"]: w for r, w in zip(rows, want)}
        assert all((r["n_links"], r["component_id"]) == by[r["vec_id"]] for r in got)
