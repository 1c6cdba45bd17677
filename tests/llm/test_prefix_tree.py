"""The prefix tree against plain Python, long chains and odd rows included."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gleanframe.llm.prefix_tree import prefix_tree, subtree_sums

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def tree(df):
    conv = F.col("conv")
    heads = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4))
    return prefix_tree(df, heads, conv - conv % 20, 3)


def plain(data):
    """Rows of the tree from nested dictionaries."""
    own = {}
    for c, turn, role, text, *_ in data:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    nodes = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        first = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h]
        whole = tuple(first + own[c][h:])
        for d in range(len(whole) + 1):
            node = nodes.setdefault(whole[:d], {"members": [], "ends": [], "kids": set()})
            node["members"].append(c)
            if d == len(whole):
                node["ends"].append(c)
            elif d < len(whole):
                node["kids"].add(whole[:d + 1])
    for path in sorted(nodes, key=len, reverse=True):
        node = nodes[path]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        node["leaves"] = sum(nodes[k]["leaves"] for k in node["kids"]) or 1
        node["saved"] = (len(node["members"]) - 1) * words + sum(nodes[k]["saved"] for k in node["kids"])
    return sorted((
        n["members"][0], len(p), nodes[p[:-1]]["members"][0] if p else -1, len(n["members"]), len(n["kids"]), n["leaves"], n["saved"],
        hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest(),
    ) for p, n in nodes.items())


def rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def drawn(n, seed):
    draw = random.Random(seed)
    out = []
    for c in range(n):
        for turn in range(draw.randrange(8)):
            text = " ".join(draw.choices(["a", "b\t", "c\x0b", "é ", "\x1c"], k=draw.randrange(1, 3)))
            out.append((c, turn, draw.choice(["user", "bot"]) if turn % 2 else "user", text if turn else "same start"))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_tree(spark, seed):
    data = drawn(300, seed)
    assert rows(tree(spark.createDataFrame(data, SCHEMA))) == plain(data)


def test_long_chain_beside_short_ones(spark):
    data = [(7, i, "u", f"t{i % 11}") for i in range(3000)] + [(c, i, "u", f"t{i % 11}") for c in (8, 40, 47) for i in range(c)]
    assert rows(tree(spark.createDataFrame(data, SCHEMA))) == plain(data)


def test_odd_rows(spark):
    data = [
        (1, None, None, None), (1, 0, "u", ""), (1, 0, "u", ""), (2, 5, "", None), (None, 1, "u", "x"), (-7, 1, "u", "x y"), (-21, 0, "a", "b"),
        (-21, 1, "ab", ""), (20, 0, "u", "word " * 50_000), (21, 0, "u", "word " * 50_000), (21, 1, "u", "z"), (39, 9, "é", " "), (45, 0, "u", "lost"),
    ]
    names = ["node", "up", "conv", "depth", "place", "name", "n", "words", "h1"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in data], SCHEMA + "".join(f", {c} int" for c in names))
    assert rows(tree(df)) == plain(data)
    assert tree(df.limit(0)).count() == 0
    assert rows(tree(spark.createDataFrame([(45, 0, "u", "lost")], SCHEMA))) == plain([(45, 0, "u", "lost")])


def test_sums_of_random_forests(spark):
    draw = random.Random(9)
    up = {i: None if i < 3 else draw.choice([i - 1, draw.randrange(i), max(0, i - 3)]) for i in range(1500)}
    value = {i: draw.randrange(100) for i in up}
    want = dict(value)
    for i in sorted(up, reverse=True):
        if up[i] is not None:
            want[up[i]] += want[i]
    nodes = spark.createDataFrame([(i, up[i], value[i]) for i in up], "node bigint, up bigint, v int")
    got = subtree_sums(nodes, ["v"]).collect()
    assert len(got) == len(up) and {r["node"]: r["v"] for r in got} == want
