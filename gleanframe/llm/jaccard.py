"""Jaccard join of shingle sets, split by set size.

Small sets enumerate the fixed-size subsets that a partner has to share; large sets go through
inverted lists of their rarest shingles.  The boundary is where the cost of both, worked out on
the histogram of sizes, is least.  Equal sets are one member of a list.  Each list first offers
only the pairs with its most central member; whoever these links connect needs no further
comparison with each other, so lists of near copies cost what their unconnected parts cost.
Every candidate is decided by intersecting whole sets.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.llm.components import components
from gleanframe.llm.rows import Sent, map_steps, text_bytes
from gleanframe.llm.shingles import mixed, shingle_sets
from gleanframe.operators.columns import ident
from gleanframe.session import free, materialise

# sets up to this size may enumerate subsets; cost of a posting against that of a subset
MOST_SMALL, POSTING_COST = 24, 3
# texts that share a shingle from which it counts as frequent and is looked at last
FREQUENT = 16
# shingles counted in one group, and the largest bitmap over shingles that is broadcast (bits)
RANGE, MOST_BITS = 1 << 20, 28
# eighths of the hash range in which shingles are counted: the rarest ones of nearly every set lie there
COUNTED = 3
# bits of the parity sketch of a set, in 64-bit words
SKETCH = 8
SKETCHES = [f"p{i}" for i in range(SKETCH)]
# bits of the largest filter that keeps keys without a partner from being moved
FILTER_BITS = 26


def required(percent: int, a: int, b: int) -> int:
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def partners(percent: int, n: int) -> range:
    """Sizes of sets that can be similar to one of size n."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(percent: int, n: int, boundary: int) -> set[int]:
    """Sizes of the subsets that a set of size n enumerates to meet all partners up to the boundary."""
    return {required(percent, n, m) for m in partners(percent, n) if m <= boundary and required(percent, n, m) <= n}


def prefix(percent: int, n: int) -> int:
    """Rarest shingles of which one is in every similar set."""
    return n - -(-percent * n // 100) + 1


def boundary_by_cost(percent: int, sizes: dict[int, int], rest: int) -> int:
    """Largest size that enumerates subsets; ``rest`` postings come from sizes beyond the histogram."""
    def cost(b: int) -> int:
        light = sum(c * sum(comb(n, k) for k in subset_sizes(percent, n, b)) for n, c in sizes.items() if n <= b)
        heavy = sum(c * prefix(percent, n) for n, c in sizes.items() if 100 * n > percent * b)
        return light + POSTING_COST * (heavy + rest)

    return min(range(MOST_SMALL + 1), key=lambda b: (cost(b), b))


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _described(columns, words: int):
    """Size, two sums of mixed shingles that tell sets apart, and the parity sketch."""
    n, one, two, sketch = [], [], [], []
    for s in shingle_sets(text_bytes(columns["text"]), words):
        n.append(len(s))
        one.append(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
        two.append(mixed(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
        parity = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
        sketch.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
    sketch = np.array(sketch, np.int64).reshape(-1, SKETCH)
    return [columns["id"], n, _signed(one), _signed(two), *sketch.T]


def _counted(columns, words: int, bits: int):
    """Shingles of a slice with the number of its texts, packed by range of their leading 32 bits."""
    sets = shingle_sets(text_bytes(columns["text"]), words)
    short = np.concatenate([s >> np.uint64(32) for s in sets] or [np.zeros(0, np.uint64)]).astype(np.uint32)
    short = short[short < COUNTED << 29]
    short, n = np.unique(short, return_counts=True)
    cut = short >> np.uint32(32 - bits) if bits else np.zeros(len(short), np.uint32)
    ranges, first = np.unique(cut, return_index=True)
    ends = [*first[1:].tolist(), len(short)]
    spans = list(zip(first.tolist(), ends))
    return (
        ranges.astype(np.int64), pa.array([short[a:b].tobytes() for a, b in spans], pa.binary()),
        pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
    )


def _segments(group: pa.Table, range_bits: int, map_bits: int) -> pa.Table:
    """Bits of one range: shingles of two or more texts, and frequent ones."""
    r = group.column("r")[0].as_py()
    short = np.concatenate([np.frombuffer(b, np.uint32) for b in group.column("shingles").to_pylist()])
    n = np.concatenate([np.frombuffer(b, np.uint32) for b in group.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(short, kind="stable")
    short, n = short[order], n[order]
    first = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
    total, short = np.add.reduceat(n, first), short[first]
    size = 1 << map_bits - range_bits
    at = (short >> np.uint32(32 - map_bits)).astype(np.int64) - r * size
    out = []
    for least in (2, FREQUENT):
        marks = np.zeros(size, np.uint8)
        marks[at[total >= least]] = 1
        out.append(np.packbits(marks, bitorder="little").tobytes())
    return pa.table({"r": [r], "shared": pa.array([out[0]], pa.binary()), "frequent": pa.array([out[1]], pa.binary())})


def _bitmaps(rows: DataFrame, words: int, total: int) -> dict:
    """Two bitmaps over the leading bits of shingles, of at most 2^MOST_BITS bits however many shingles there are.

    A set bit may also come from another shingle, and shingles outside the counted range have
    none.  That costs work, never a pair: bits only decide in which order, and whether in vain,
    a shingle is looked up.
    """
    map_bits = min(MOST_BITS, max(16, (16 * total).bit_length()))
    range_bits = min(map_bits - 4, max(0, (total // RANGE).bit_length()))
    counted = map_steps(
        rows, lambda c: _counted(c, words, range_bits), "r bigint, shingles binary, counts binary", 4 << 20,
    )
    segments = counted.groupBy("r").applyInArrow(
        lambda t: _segments(t, range_bits, map_bits), "r bigint, shared binary, frequent binary",
    ).toArrow()
    size = (1 << map_bits) // 8 * COUNTED // 8
    maps = {"bits": map_bits, "shared": bytearray(size), "frequent": bytearray(size)}
    step = (1 << map_bits) // 8 >> range_bits
    for r, shared, frequent in zip(*[segments.column(i).to_pylist() for i in range(3)]):
        # the last range may reach beyond the counted ones
        for name, segment in (("shared", shared), ("frequent", frequent)):
            maps[name][r * step:(r + 1) * step] = segment[:max(0, size - r * step)]
    return {k: bytes(v) if isinstance(v, bytearray) else v for k, v in maps.items()}


def _marked(bitmap: bytes, at: np.ndarray, beyond: bool) -> np.ndarray:
    """Bits at the places, ``beyond`` for places after the bitmap's end."""
    data = np.frombuffer(bitmap, np.uint8)
    inside = at >> 3 < len(data)
    at = np.where(inside, at, 0)
    return np.where(inside, data[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1, beyond)


def _posted(columns, words: int, percent: int, boundary: int, maps: dict):
    """(list, id, size, first sum, share of rare shingles, shingles that others may have) for every list of a set."""
    out = {k: [] for k in ("list", "id", "n", "one", "rare", "open")}
    ids = columns["id"].to_numpy()
    for key, s in zip(ids, shingle_sets(text_bytes(columns["text"]), words)):
        n = len(s)
        if not n:
            continue
        at = (s >> np.uint64(64 - maps["bits"])).astype(np.int64)
        frequent, shared = _marked(maps["frequent"], at, False), _marked(maps["shared"], at, True)
        lists = []
        if 100 * n > percent * boundary:
            # rare shingles first, in the order of their hash; those of one text meet nobody
            order = np.argsort(frequent, kind="stable")[:prefix(percent, n)]
            lists.append(s[order[shared[order]]])
        if n <= boundary:
            parts = mixed(s + np.uint64(0x632BE59BD9B4E019))
            for k in sorted(subset_sizes(percent, n, boundary)):
                chosen = np.array(list(combinations(range(n), k)), np.int64)
                lists.append(mixed(parts[chosen].sum(1, dtype=np.uint64) ^ np.uint64(k)))
        lists = np.concatenate(lists) if lists else s[:0]
        one = _signed(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).reshape(1))[0]
        out["list"].append(lists)
        for name, v in (("id", key), ("n", n), ("one", one), ("rare", int(1_000_000 * (~frequent).sum() / n)), ("open", int(shared.sum()))):
            out[name].append(np.full(len(lists), v, np.int64))
    merged = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    return [_signed(merged["list"]), *[merged[c] for c in ("id", "n", "one", "rare", "open")]]


def _filtered(rows: DataFrame, name: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose ``name`` is probably among the ``n`` distinct keys, and all that surely are.

    The filter is a bitmap over hashed keys as 64-bit words (w, b), 2^FILTER_BITS bits at most.
    """
    bits = min(FILTER_BITS, max(10, (32 * n).bit_length()))

    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << bits))

    words = keys.select(slot(name).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 AS int))")).alias("b")
    )
    near = rows.withColumn("__s", slot(name)).join(F.broadcast(words), F.shiftright("__s", 6) == F.col("w"))
    return near.where(F.expr("shiftright(b, cast(__s % 64 AS int)) & 1 = 1")).drop("__s", "w", "b")


def _room(n: str, m: str, x: str, y: str, percent: int) -> Column:
    """Whether sets of sizes n and m can be similar that share at most x, and at most y, shingles with any other."""
    most = F.least(F.col(x), F.col(y))
    return (100 + percent) * most >= percent * (F.col(n) + F.col(m))


def _near(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and parity sketches of sides a and b leave room for a link.

    Two sets differ in as many shingles as their sketches differ in bits, or in more.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = F.lit(0)
    for c in SKETCHES:
        differ = differ + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _links(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.

    Only texts that are in a pair are moved, as text, which packs better than hashes.
    """
    pairs = materialise(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = materialise(_filtered(rows, "id", ids, 2 * pairs.count()), "texts")

    def similar(columns):
        pair = [shingle_sets(text_bytes(columns[c]), words) for c in ("x", "y")]
        keep = []
        for x, y in zip(*pair):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        return [columns[c].filter(keep) for c in ("a", "b")]

    left = wanted.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = wanted.select(F.col("id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    links = materialise(map_steps(both, similar, "a bigint, b bigint").distinct(), "links")
    free(pairs, wanted)
    return links


def similar_classes(
    df: DataFrame, *, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_shingles, component_id), one row per input row; the key is an integer.

    A set holds the distinct shingles of ``words`` words (A-Z lower-cased, white space between);
    a shorter text is one shingle, and an empty or null text has none and links with nothing.
    Two texts link when 100 * intersection >= percent * union; ``component_id`` is the smallest
    key that links lead to.  Rows that repeat a key are one member.  A null key links with
    nothing and has a null component.  An empty table gives an empty one.  Shingles are compared
    by 64-bit hashes.
    """
    rows = df.select(ident(key).cast("bigint").alias("id"), ident(text).cast("string").alias("text"))
    described = materialise(map_steps(
        rows, lambda c: _described(c, words),
        "id bigint, n bigint, one bigint, two bigint, " + ", ".join(f"{c} bigint" for c in SKETCHES),
    ), "shingle-sets")
    # one row per set: equal sets are one member, under their smallest id
    members = described.where("n > 0 AND id IS NOT NULL").groupBy("n", "one", "two").agg(
        F.min("id").alias("id"), *[F.first(c).alias(c) for c in SKETCHES],
    )
    members = materialise(members, "members")
    small = members.groupBy(F.least("n", F.lit(MOST_SMALL + 1)).alias("n")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"), F.sum(F.expr(f"n - ceil({percent} * n / 100) + 1")).alias("postings"),
    ).collect()
    total = sum(r["shingles"] for r in small)
    boundary = boundary_by_cost(
        percent, {r["n"]: r["c"] for r in small if r["n"] <= MOST_SMALL},
        sum(int(r["postings"]) for r in small if r["n"] > MOST_SMALL),
    )
    texts = rows.where("id IS NOT NULL AND text IS NOT NULL")
    maps = Sent(df.sparkSession, _bitmaps(texts, words, total))
    posted = map_steps(
        texts, lambda c: _posted(c, words, percent, boundary, maps.value),
        "list bigint, id bigint, n bigint, one bigint, rare bigint, open bigint",
    )
    lists = posted.groupBy("list", "n", "one").agg(*[F.min(c).alias(c) for c in ("id", "rare", "open")])
    lists = materialise(lists.drop("one"), "lists")
    maps.drop()
    shared = lists.groupBy("list").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("list")
    shared = materialise(shared, "shared-lists")
    met = _filtered(lists, "list", shared, shared.count())
    # the most central member of each list
    centre = met.groupBy("list").agg(F.min(F.struct("rare", "n", "id", "open")).alias("p"))
    met = materialise(met.drop("rare").join(centre, "list"), "lists-met")
    free(lists, shared)
    sides = members.select("id", "n", *SKETCHES)
    stars = met.where(F.col("id") != F.col("p.id")).where(_room("n", "p.n", "open", "p.open", percent)).select(
        F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"),
    ).distinct()
    x, y = sides.alias("x"), sides.alias("y")
    likely = stars.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where(_near("x", "y", percent))
    first_links = _links(likely.select("a", "b"), texts, words, percent)
    parts = components(first_links)
    # lists that still hold more than one part
    placed = met.select("list", "id", "open").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    old, placed = met, materialise(placed, "placed")
    free(old)
    open_lists = placed.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("list")
    told = materialise(placed.join(open_lists, "list", "left_semi").join(sides, "id"), "open-lists")
    a, b = told.alias("a"), told.alias("b")
    apart = (F.col("a.list") == F.col("b.list")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
    room = _room("a.n", "b.n", "a.open", "b.open", percent)
    others = a.join(b, apart & room & _near("a", "b", percent)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    more = _links(others, texts, words, percent)
    free(placed, told)
    final = components(first_links.unionByName(more))
    classes = members.select("n", "one", "two", "id").join(final, "id", "left").select(
        F.col("n").alias("__n"), F.col("one").alias("__one"), F.col("two").alias("__two"),
        F.coalesce("component", "id").alias("component"),
    )
    same = (F.col("n") == F.col("__n")) & (F.col("one") == F.col("__one")) & (F.col("two") == F.col("__two"))
    kind = df.schema[key].dataType
    found = F.when(F.col("id").isNotNull(), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")))
    return described.select("id", "n", "one", "two").join(classes, same, "left").select(
        F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), found.cast(kind).alias("component_id"),
    )


def keep_one(df: DataFrame, *, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the smallest key of each class, with all their columns; null keys stay."""
    classes = similar_classes(df, words=words, percent=percent, key=key, text=text)
    dropped = classes.where(ident("component_id") != ident(key)).select(ident(key)).distinct()
    return df.join(dropped, key, "left_anti")
