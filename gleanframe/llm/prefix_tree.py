"""The prefix tree of conversations, and totals over its subtrees by parallel contraction.

A prefix is named by its length and the sums of hashes of (place, turn) over its turns, so the
names of all prefixes are running sums over one global sort, whatever the length of a
conversation.  The tree is contracted in rounds of joins: leaves are raked into their parents,
then nodes with a single child are spliced out, no two neighbours at once.  The number of rounds
grows with the logarithm of the nodes, also for one conversation that is a single long chain.
Spliced nodes are put back in reverse order, each from the total of the child it was joined to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.llm.lattice import run_starts, whole_runs
from gleanframe.operators.columns import ident
from gleanframe.operators.lookup import attach
from gleanframe.operators.ranks import positions, running_sums
from gleanframe.session import free, materialise

# words: runs of anything but blank and \t to \r
WORD = r"[^\x20\x09-\x0D]+"
# parts of a prefix's name; each term has 32 bits, so sums over 2^31 turns stay exact
LANES = 4
# ids that one piece of a list of ends holds
PIECE = 1 << 14


def turns_of(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place, h1, h2, words): the turns of every conversation in order, as two hashes and a word count."""
    r, t = (F.coalesce(ident(c).cast("string"), F.lit("")) for c in (role, text))
    slim = df.where(ident(conversation).isNotNull()).select(
        ident(conversation).cast("bigint").alias("conv"), ident(turn).alias("turn"),
        F.xxhash64(r, t, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), t, r).alias("h2"),
        F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("words"),
    )
    return positions(slim, [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")], ["conv"], "place").drop("turn")


def rebuilt(turns: DataFrame, heads: Column, base: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Turns with the first ``heads`` turns of every conversation taken from conversation ``base``.

    ``heads`` (at most ``longest``) and ``base`` are expressions of ``conv``.  Also returns one row
    per conversation (conv, turns), those left without a turn included.
    """
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    plan = lengths.select("conv", "own", base.alias("base"), heads.cast("bigint").alias("h"))
    there = lengths.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    plan = plan.join(there, "base", "left").select(
        "conv", "own", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken"),
    )
    plan = materialise(plan, "rebuilt-plan")
    first = turns.where(F.col("place") < longest).withColumnRenamed("conv", "base")
    head = plan.select("conv", "base", "taken").join(first, "base").where("place < taken").select("conv", "place", "h1", "h2", "words")
    # the cut of a long conversation goes to its turns by value
    cut = plan.select("conv", "h", "taken", F.col("own").alias("n"))
    tail = attach(turns, cut, "conv").where("place >= h").select(
        "conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "h1", "h2", "words",
    )
    sizes = plan.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))
    return head.unionByName(tail), sizes


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, name, parent, words) of every prefix; the parent of depth 1 is the root, named null."""
    lanes = [f"lane{i}" for i in range(LANES)]
    halves = []
    for h in ("h1", "h2"):
        mixed = F.xxhash64(F.col(h), F.col("place"), F.lit(len(halves)))
        halves += [F.shiftrightunsigned(mixed, 32), mixed.bitwiseAND(F.lit(0xFFFFFFFF))]
    summed = running_sums(
        turns.select("conv", "place", "words", *[e.alias(c) for e, c in zip(halves, lanes)]), ["conv"], "place", lanes,
    )

    def name(depth: Column, sums: Sequence[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))

    before = [F.col(f"before_{c}") for c in lanes]
    depth = F.col("place") + 1
    return summed.select(
        "conv", depth.alias("depth"), name(depth, [b + F.col(c) for b, c in zip(before, lanes)]).alias("name"),
        F.when(F.col("place") > 0, name(F.col("place"), before)).alias("parent"), "words",
    )


def tree_nodes(prefixes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, conv, depth, name, up, parent_conv, n_convs, words): the distinct prefixes under one root.

    ``conv`` is the smallest member; ``node`` and ``up`` number a node and its parent.
    """
    named = prefixes.groupBy("name").agg(
        F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.min("words").alias("words"), F.min("parent").alias("parent"),
    ).withColumn("node", F.monotonically_increasing_id() + 1)
    named = materialise(named, "tree-names")
    children = named.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    # one parent may have a third of all nodes as children
    parents = named.select("name", F.col("node").alias("up"), F.col("conv").alias("parent_conv")).join(children, "name")
    lower = attach(named.where("parent IS NOT NULL"), parents.withColumnRenamed("name", "parent"), "parent")
    root = sizes.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("bigint").alias("node"), "conv", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("name"),
        F.lit(None).cast("bigint").alias("up"), F.lit(None).cast("bigint").alias("parent_conv"), "n_convs",
        F.lit(0).cast("bigint").alias("words"),
    )
    top = sizes.agg(F.min("conv").alias("parent_conv"))
    # the root's row is one
    first = named.where("parent IS NULL").join(F.broadcast(top)).withColumn("up", F.lit(0).cast("bigint"))
    return materialise(lower.select(*root.columns).unionByName(first.select(*root.columns)).unionByName(root), "tree-nodes")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def subtree_sums(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """(node, one column per value): the values of (node, up, values…) summed over every subtree.

    ``up`` is null at a root; any number of trees is contracted at once.  Alive nodes carry what
    their removed descendants came to, how many children are left, and the exclusive or of these,
    which names an only child.  Splicing out node v above its only child u hands u an offset: what
    v's parent receives from u is u's total and the offset.  Each round's table stays until the
    end: its leaves are settled there, and it tells what was spliced out to make it.
    """
    zero = F.lit(0).cast("bigint")
    offsets = [f"off_{v}" for v in values]
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(
        F.count(F.lit(1)).alias("kids"), F.bit_xor("node").alias("child"),
    )
    alive = materialise(nodes.join(children, "node", "left").select(
        "node", "up", F.coalesce("kids", zero).alias("kids"), F.coalesce("child", zero).alias("child"),
        *[F.col(v).cast("bigint").alias(v) for v in values], *[zero.alias(c) for c in offsets],
        F.lit(None).cast("bigint").alias("gone"), *[zero.alias(f"add_{v}") for v in values],
    ), "alive")
    rounds = []
    while not alive.isEmpty():
        rounds.append(alive)
        # rake: nodes without children are settled, and their parents receive them
        received = alive.where("kids = 0 AND up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(
            *[F.sum(F.col(v) + F.col(f"off_{v}")).alias(f"got_{v}") for v in values],
            F.count(F.lit(1)).alias("raked"), F.bit_xor("node").alias("mask"),
        )
        raked = materialise(alive.where("kids > 0").drop("gone", *[f"add_{v}" for v in values]).join(received, "node", "left").select(
            "node", "up", (F.col("kids") - F.coalesce("raked", zero)).alias("kids"),
            F.col("child").bitwiseXOR(F.coalesce("mask", zero)).alias("child"),
            *[(F.col(v) + F.coalesce(f"got_{v}", zero)).alias(v) for v in values], *offsets,
        ), "alive-raked")
        # compress: of neighbours in a chain never both
        willing = raked.where((F.col("kids") == 1) & F.col("up").isNotNull() & (F.xxhash64("node", F.lit(len(rounds))) % 2 == 0))
        below = willing.select(F.col("node").alias("child"))
        gone = willing.join(below, "child", "left_anti").select(
            F.col("child").alias("node"), F.col("node").alias("gone"), F.col("up").alias("new_up"),
            *[F.col(v).alias(f"own_{v}") for v in values], *[F.col(f"off_{v}").alias(f"more_{v}") for v in values],
        )
        # a child takes its place below the parent of the node that goes; a root never goes
        patch = gone.groupBy(F.col("new_up").alias("node")).agg(F.bit_xor(F.col("gone").bitwiseXOR(F.col("node"))).alias("patch"))
        stay = raked.join(gone.select(F.col("gone").alias("node")), "node", "left_anti")
        alive = materialise(stay.join(gone, "node", "left").join(patch, "node", "left").select(
            "node", F.coalesce("new_up", "up").alias("up"), "kids", F.col("child").bitwiseXOR(F.coalesce("patch", zero)).alias("child"), *values,
            *[(F.col(f"off_{v}") + F.coalesce(F.col(f"own_{v}") + F.col(f"more_{v}"), zero)).alias(f"off_{v}") for v in values],
            "gone", *[(F.col(f"own_{v}") + F.col(f"off_{v}")).alias(f"add_{v}") for v in values],
        ), "alive")
        free(raked)
    settled = [r.where("kids = 0").select("node", *values) for r in rounds]
    # the child of a node that went was alive in the round after, so only later rounds know its total
    for i in range(len(rounds) - 1, 0, -1):
        back = rounds[i].where("gone IS NOT NULL").select("gone", "node", *[f"add_{v}" for v in values])
        later = _union(settled[i:])
        settled.append(materialise(back.join(later, "node").select(
            F.col("gone").alias("node"), *[(F.col(v) + F.col(f"add_{v}")).alias(v) for v in values],
        ), "expanded"))
    return _union(settled) if settled else nodes.select("node", *[F.col(v).cast("bigint").alias(v) for v in values])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, id) as (node, first id, ids joined by commas), a bounded number of ids a row."""
    for batch in batches:
        starts = run_starts(batch, 1)
        nodes, ids = (c.to_numpy() for c in batch.columns)
        out = []
        for s, e in zip(starts, [*starts[1:], len(nodes)]):
            for at in range(s, e, PIECE):
                some = ids[at:min(e, at + PIECE)].tolist()
                out.append((nodes[at], some[0], ",".join(map(str, some))))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["node", "first", "ids"],
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hash) of the pieces of each node, which arrive in order; one state is held at a time."""
    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["node", "ends_sha256"])

    node, state = None, None
    for batch in batches:
        rows = []
        for n, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if n != node:
                if state is not None:
                    rows.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield frame(rows)
    if state is not None:
        yield frame([(node, state.hexdigest())])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the ids of (node, id) in ascending order, joined by commas.

    Sorting and joining are spread over all tasks whatever the size of a node's list; only the
    hash itself, which cannot be split, runs over the joined pieces of a node one by one.
    """
    ordered = ends.repartitionByRange("node", "id").sortWithinPartitions("node", "id")
    pieces = ordered.select("node", "id").mapInArrow(_pieces, "node bigint, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node bigint, ends_sha256 string")


def prefix_tree(
    df: DataFrame, heads: Column, base: Column, longest: int, *, conversation: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with totals over its subtree.

    ``heads`` and ``base`` are expressions of the column ``conv``: a conversation is its base's
    first ``heads`` turns (at most ``longest``; all if the base has fewer, none if it is absent)
    and its own turns after its first ``heads``.  The result has conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    Turns go by ``turn``, null first, ties by hashes of role and text; a null role or text is empty;
    a repeated row is a turn more.  Rows with a null conversation take no part.  A turnless
    conversation is a member of the root.  An empty table has no root and gives no rows.
    """
    turns = materialise(turns_of(df, conversation, turn, role, text), "turns")
    whole, sizes = rebuilt(turns, heads, base, longest)
    whole, sizes = materialise(whole, "rebuilt"), materialise(sizes, "sizes")
    prefixes = materialise(_prefixes(whole), "prefixes")
    nodes = tree_nodes(prefixes, sizes)
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    sums = subtree_sums(nodes.select(
        "node", "up", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    ), ["n_leaves", "saved_tokens"])
    # conversations end at the prefix of all their turns
    last = prefixes.select("conv", "depth", "name").join(sizes.select("conv", F.col("turns").alias("depth")), ["conv", "depth"])
    last = materialise(last, "last-prefixes")
    many = last.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    places = nodes.where("name IS NOT NULL").select("name", "node").join(many, "name")
    ends = attach(last, places, "name").select("node", F.col("conv").alias("id")).unionByName(
        sizes.where("turns = 0").select(F.lit(0).cast("bigint").alias("node"), F.col("conv").alias("id"))
    )
    kind = df.schema[conversation].dataType
    return nodes.join(sums, "node").join(ends_hashes(ends), "node", "left").select(
        F.col("conv").cast(kind).alias("conv_id"), "depth", F.col("parent_conv").cast(kind).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
