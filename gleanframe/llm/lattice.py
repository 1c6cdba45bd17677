"""Near-duplicate vectors by lattice hashing.

A table projects every vector to a few blocks of eight dimensions and decodes each block to
its nearest point of the E8 lattice; the points are the vector's home cell.  The vector also
probes the cells one shortest lattice step away that lie nearest.  Two vectors meet in a table
when one of them probes, or shares, the home of the other, and every pair that meets is decided
by its cosine.  Projections are sums of integers, so a cell comes out the same on every worker,
and a pair is counted in the first place where it meets without being written anywhere.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gleanframe.llm.components import components
from gleanframe.llm.rows import kept, steps
from gleanframe.llm.shingles import mixed
from gleanframe.operators.columns import ident
from gleanframe.operators.lookup import attach
from gleanframe.session import free, materialise

DIMS = 8
# members of a cell that one comparison holds on either side; larger cells become a grid of such blocks
BLOCK = 512
# pairs compared at once
PAIRS = 1 << 16
# fractions of the quantised vectors, projections and residuals, as powers of two
_VECTOR, _PROJECTION, _RESIDUAL = 1 << 15, 1 << 10, 1 << 20
# distance to the threshold within which a cosine is worked out anew with exact sums
_EDGE = 1e-9


def _roots() -> np.ndarray:
    """The 240 shortest steps of E8: two entries of one, or eight halves with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(DIMS), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            step = [0.0] * DIMS
            step[i], step[j] = a, b
            out.append(step)
    halves = itertools.product((0.5, -0.5), repeat=DIMS)
    return np.array(out + [list(h) for h in halves if sum(x < 0 for x in h) % 2 == 0])


ROOTS = _roots()


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the even integer points and the same moved by a half."""
    whole, half = _even(y), _even(y - 0.5) + 0.5

    def distance(p):
        total = np.zeros(len(y))
        for i in range(DIMS):
            total += (y[:, i] - p[:, i]) ** 2
        return total

    return np.where((distance(whole) <= distance(half))[:, None], whole, half)


@dataclass(frozen=True)
class Lattice:
    """``tables`` hash tables over ``blocks`` lattice points each, probing ``probes`` cells beside the home."""

    blocks: int
    tables: int
    probes: int
    scale: float = 0.5
    seed: int = 20

    def codes(self, x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home cell per table, probed cells per table) as 64-bit keys; vectors of different groups share none."""
        n, d = x.shape
        home, probed = np.zeros((n, self.tables), np.uint64), np.zeros((n, self.tables, self.probes), np.uint64)
        q = np.rint(x / np.abs(x).max(1, keepdims=True) * _VECTOR)
        norm = np.sqrt((q.astype(np.int64) ** 2).sum(1).astype(float))[:, None]
        group = mixed(group.astype(np.int64).view(np.uint64) + np.uint64(d))
        rows, steps2 = np.arange(n)[:, None], (2 * ROOTS).T
        for t in range(self.tables):
            projection, shift, weights, moves = kept((self, d, t), lambda t=t: self._table(d, t))
            # whole numbers below 2^53, so the order of the sum does not matter
            y = (q @ projection) * (self.scale / _PROJECTION) / norm + shift
            line, scores = group + np.uint64(t), []
            for b in range(self.blocks):
                part = slice(b * DIMS, (b + 1) * DIMS)
                point = decode(y[:, part])
                line = line + (2 * point).astype(np.int64).view(np.uint64) @ weights[part]
                scores.append(np.rint((y[:, part] - point) * _RESIDUAL) @ steps2)
            # distinct whole numbers: the nearest steps are one certain set
            score = np.hstack(scores) * 1024 + np.arange(240 * self.blocks)
            best = np.argpartition(-score, self.probes, axis=1)[:, :self.probes]
            home[:, t] = mixed(line)
            probed[:, t] = mixed((line[:, None] + moves[best])[rows, np.arange(self.probes)])
        return home.view(np.int64), probed.view(np.int64)

    def _table(self, d: int, t: int):
        draw = np.random.Generator(np.random.PCG64([self.seed, d, t]))
        projection = np.rint(draw.normal(size=(d, DIMS * self.blocks)) * _PROJECTION)
        shift = draw.random(DIMS * self.blocks)
        weights = draw.integers(0, 1 << 63, DIMS * self.blocks, np.uint64) * np.uint64(2) + np.uint64(1)
        steps2 = (2 * ROOTS).astype(np.int64).view(np.uint64)
        moves = np.concatenate([steps2 @ weights[b * DIMS:(b + 1) * DIMS] for b in range(self.blocks)])
        return projection, shift, weights, moves


# (rows up to, blocks, tables, probes): a further block makes cells some hundred times finer
SIZES = [(1 << 22, 2, 8, 4), (1 << 29, 3, 16, 8), (1 << 62, 4, 32, 8)]


def lattice_for(rows: int) -> Lattice:
    """Cells that hold few unrelated vectors among so many, in enough tables to find the related ones."""
    _, blocks, tables, probes = next(s for s in SIZES if rows <= s[0])
    return Lattice(blocks, tables, probes)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, scaled by a power of two so that no square overflows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return np.ldexp(values, -np.frexp(np.abs(values).max(1, keepdims=True))[1])


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    lengths = np.array(pa.compute.list_value_length(batch.column(column)))
    for d in np.unique(lengths):
        yield batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))


_ROWS = "row bigint, id bigint, label bigint, same binary, vec array<{}>"


def _described(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with a number and, if they can link at all, a digest of label and vector; the others keep no vector."""
    row = TaskContext.get().partitionId() << 40
    for batch in steps(batches):
        ids, labels, vectors = batch.columns
        same, vecs = [], []
        known = labels.to_pylist()
        for i, label in enumerate(known):
            x = None if label is None or not vectors[i].is_valid else vectors[i].values
            x = x if x is not None and len(x) and not x.null_count else None
            x = None if x is None else x.to_numpy(zero_copy_only=False).astype(float) + 0.0
            fine = x is not None and np.isfinite(x).all() and x.any()
            same.append(hashlib.blake2b(b"%d;" % label + x.tobytes(), digest_size=16).digest() if fine else None)
            vecs.append(x if fine else None)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(row, row + len(known)), pa.int64()), ids, labels, pa.array(same, pa.binary()),
            pa.array(vecs, fields.field("vec").type),
        ], schema=fields)
        row += len(known)


_ENTRIES = "key bigint, t int, node bigint, home boolean"


def _entered(batches: Iterator[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    """One entry per cell a vector lives in or probes."""
    for whole in steps(batches):
        for batch in _by_length(whole, 2):
            nodes = batch.column(0).to_numpy()
            home, probed = lattice.codes(_matrix(batch.column(2)), batch.column(1).to_numpy())
            keys = np.concatenate([home[:, :, None], probed], axis=2)
            n, tables, cells = keys.shape
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.reshape(-1)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), cells), n)),
                pa.array(np.repeat(nodes, tables * cells)), pa.array(np.tile(np.arange(cells) == 0, n * tables)),
            ], names=["key", "t", "node", "home"])


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that rows equal in the first ``keys`` columns are never apart."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        starts = run_starts(batch, keys)
        if len(starts) > 1:
            yield batch.slice(0, starts[-1])
        held = batch.slice(starts[-1]) if len(starts) else None
    if held is not None:
        yield held


def run_starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    if not batch.num_rows:
        return np.zeros(0, int)
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in batch.columns[:keys]:
        value = c.to_numpy(zero_copy_only=False)
        new[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(new)


class _Compared:
    """Links among the members of whole cells, or of blocks of them."""

    def __init__(self, batch: pa.RecordBatch, lattice: Lattice, threshold: float):
        self.lattice, self.threshold = lattice, threshold
        _, _, _, side, t, home, node, label, weight, vec = batch.columns
        self.side, self.t, self.home = side.to_numpy(), t.to_numpy(), home.to_numpy(zero_copy_only=False)
        self.node, self.label, self.weight = node.to_numpy(), label.to_numpy(), weight.to_numpy()
        self.x = _matrix(vec)
        self.unit = self.x / np.sqrt((self.x * self.x).sum(1))[:, None]
        self.starts = run_starts(batch, 3)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def _pairs(self, a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> None:
        """Keep the pairs that link and meet here first."""
        keep = cosine >= self.threshold - _EDGE
        a, b, cosine = a[keep], b[keep], cosine[keep]
        # of two that share a home the lesser is the row
        keep = (self.label[a] == self.label[b]) & np.where(self.home[a], self.node[a] < self.node[b], self.node[a] != self.node[b])
        a, b, cosine = a[keep], b[keep], cosine[keep]
        for i in np.flatnonzero(np.abs(cosine - self.threshold) <= _EDGE):
            x, y = self.x[a[i]], self.x[b[i]]
            cosine[i] = math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))
        keep = cosine >= self.threshold
        a, b = a[keep], b[keep]
        place = 3 * self.t[a] + np.where(self.home[a], 0, np.where(self.node[a] < self.node[b], 1, 2))
        later = np.flatnonzero(place > 0)
        first = np.ones(len(a), bool)
        first[later] = self._first(a[later], b[later]) == place[later]
        self.found.append((a[first], b[first]))

    def _first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first place where the members of each pair meet."""
        some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        if not len(some):
            return np.zeros(0, int)
        home, probed = self.lattice.codes(self.x[some], self.label[some])
        swap = self.node[a] > self.node[b]
        low, high = np.where(swap, at[len(a):], at[:len(a)]), np.where(swap, at[:len(a)], at[len(a):])
        out = np.zeros(len(a), int)
        for s in range(0, len(a), PAIRS):
            i, j = low[s:s + PAIRS], high[s:s + PAIRS]
            meet = np.stack([
                home[i] == home[j], (probed[i] == home[j][:, :, None]).any(2), (probed[j] == home[i][:, :, None]).any(2),
            ], axis=2)
            out[s:s + PAIRS] = meet.reshape(len(i), -1).argmax(1)
        return out

    def run(self) -> None:
        ends = np.append(self.starts[1:], len(self.node))
        rows, cols = np.flatnonzero(self.side != 1), np.flatnonzero(self.side != 0)
        r0, r1 = np.searchsorted(rows, self.starts), np.searchsorted(rows, ends)
        c0, c1 = np.searchsorted(cols, self.starts), np.searchsorted(cols, ends)
        wide, size = c1 - c0, (r1 - r0) * (c1 - c0)
        for g in np.flatnonzero(size > PAIRS // 16):
            i, j = rows[r0[g]:r1[g]], cols[c0[g]:c1[g]]
            cosine = self.unit[i] @ self.unit[j].T
            a, b = np.nonzero(cosine >= self.threshold - _EDGE)
            self._pairs(i[a], j[b], cosine[a, b])
        small = np.flatnonzero((size > 0) & (size <= PAIRS // 16))
        parts = np.cumsum(size[small]) // PAIRS
        for part in np.unique(parts):
            g = small[parts == part]
            run = np.repeat(g, size[g])
            local = np.arange(len(run)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
            i, j = rows[r0[run] + local // wide[run]], cols[c0[run] + local % wide[run]]
            self._pairs(i, j, np.einsum("ij,ij->i", self.unit[i], self.unit[j]))

    def result(self) -> Iterator[pa.RecordBatch]:
        """Linked rows of every member, then a star of edges per connected part."""
        a, b = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, int),) * 2
        if not len(a):
            return
        some, at = np.unique(self.node[np.concatenate([a, b])], return_inverse=True)
        left, right = at[:len(a)], at[len(a):]
        links = np.zeros(len(some), np.int64)
        np.add.at(links, left, self.weight[b])
        np.add.at(links, right, self.weight[a])
        part = np.arange(len(some))
        while True:
            low, new = np.minimum(part[left], part[right]), part.copy()
            np.minimum.at(new, left, low)
            np.minimum.at(new, right, low)
            new = new[new]
            if (new == part).all():
                break
            part = new
        ends = np.flatnonzero(part != np.arange(len(some)))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([some, some[part[ends]]])),
            pa.array(np.concatenate([np.zeros(len(some), np.int64), some[ends]]), mask=np.arange(len(some) + len(ends)) < len(some)),
            pa.array(np.concatenate([links, np.zeros(len(ends), np.int64)])),
        ], names=["a", "b", "n"])


def _compared(batches: Iterator[pa.RecordBatch], lattice: Lattice, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in whole_runs(batches, 3):
        for batch in _by_length(whole, 9):
            cells = _Compared(batch, lattice, threshold)
            cells.run()
            yield from cells.result()


def _grid(members: DataFrame, block: int) -> DataFrame:
    """Members dealt to the blocks (i, j) of their cell: rows of all members against columns of those at home.

    A cell that fits one block is sent once, its homes being rows and columns (side 2).
    """
    deep, wide = F.ceil(F.col("members") / block).cast("int"), F.ceil(F.col("homes") / block).cast("int")
    i = F.pmod(F.xxhash64("node", F.lit(1)), deep).cast("int")
    j = F.pmod(F.xxhash64("node", F.lit(2)), wide).cast("int")

    def place(i, j, side):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    as_row = F.transform(F.sequence(F.lit(0), wide - 1), lambda c: place(i, c, 0))
    as_column = F.transform(F.sequence(F.lit(0), deep - 1), lambda r: place(r, j, 1))
    one = F.array(F.when(F.col("home"), place(F.lit(0), F.lit(0), 2)).otherwise(place(F.lit(0), F.lit(0), 0)))
    places = F.when(deep == 1, one).when(F.col("home"), F.concat(as_row, as_column)).otherwise(as_row)
    return members.withColumn("p", F.explode(places)).select(
        "key", "p.i", "p.j", "p.side", "t", "home", "node", "label", "weight", "vec",
    )


def near_classes(
    df: DataFrame, *, threshold: float = 0.8, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    lattice: Lattice | None = None, block: int = BLOCK,
) -> DataFrame:
    """(key, n_links, component_id, kept), one row per input row; the key is an integer.

    Vectors of equal label and length link when their cosine is ``threshold`` or more and a table
    of the lattice lets them meet; no pair below it links.  ``n_links`` counts the linked rows, and
    ``component_id`` is the smallest key that links lead to.  Equal vectors of one label are one
    member with a weight.  A row with a null label, or whose vector is null, empty, zero or holds a
    null or non-finite component, links with nothing and is its own component.  Rows that repeat a
    key are vectors of their own.  A null key is never a component's id unless all its keys are
    null.  An empty table gives an empty one.
    """
    kind, item = df.schema[key].dataType, "double"
    if "FloatType" in str(df.schema[vector].dataType):
        item = "float"
    schema = StructType.fromDDL(_ROWS.format(item))
    fields = to_arrow_schema(schema)
    code = F.when(ident(label).isNotNull(), F.xxhash64(ident(label)))
    rows = materialise(df.select(
        ident(key).cast("bigint").alias("id"), code.alias("label"), ident(vector).cast(f"array<{item}>").alias("vec"),
    ).mapInArrow(lambda batches: _described(batches, fields), schema), "vectors")
    groups = materialise(rows.where("same IS NOT NULL").groupBy("same").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("id"),
    ), "vector-groups")
    members = materialise(rows.join(groups.select("node", "weight"), F.col("row") == F.col("node")).select(
        "node", "label", "vec", "weight",
    ), "vector-members")
    lattice = lattice or lattice_for(members.count())
    entries = materialise(
        members.select("node", "label", "vec").mapInArrow(lambda batches: _entered(batches, lattice), _ENTRIES), "lattice-entries",
    )
    crowded = materialise(entries.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.count_if("home").alias("homes"),
    ).where("members > 1 AND homes > 0").withColumn("n", F.col("members")), "crowded-cells")
    met = attach(entries, crowded, "key").where("homes IS NOT NULL").join(members, "node")
    dealt = _grid(met, block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = materialise(dealt.mapInArrow(
        lambda batches: _compared(batches, lattice, threshold), "a bigint, b bigint, n bigint",
    ), "vector-links")
    free(members, entries, crowded)
    degrees = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    parts = components(links.where("b IS NOT NULL").select("a", "b"))
    placed = groups.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"),
    )
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    outcome = materialise(placed.join(smallest, "component").join(degrees, "node", "left").select(
        "same", F.col("weight").alias("n"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id",
    ), "vector-outcome")
    done = attach(rows.select("id", "same"), outcome, "same")
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return done.select(
        F.col("id").cast(kind).alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.cast(kind).alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
