"""Hard negatives by exact integer scores, worked out with the method of the Four Russians.

Vectors become whole numbers.  A candidate is kept as bit planes: bit p of eight neighbouring
components is one byte.  For every group of eight components an anchor has a table of the sums
of all 256 subsets, so a plane's byte looks up what it adds to the score, and a score is the
planes' sums shifted and added, the sign plane taken away.  Anchors go to all tasks in waves of
bounded size; a task keeps only the best few of its rows for each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanframe.llm.rows import Sent, steps
from gleanframe.operators.columns import ident
from gleanframe.session import free, materialise

DIMS = 8
# components, of all anchors together, that one wave sends to every task
WAVE = 1 << 18
# rows and anchors that one block of scores covers
ROWS, ANCHORS = 2048, 128
_LOWEST = np.iinfo(np.int64).min


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(group, byte, anchor): the sum of the components whose bits the byte holds."""
    n, d = anchors.shape
    groups = -(-d // DIMS)
    padded = np.zeros((groups * DIMS, n), anchors.dtype)
    padded[:d] = anchors.T
    tables = np.zeros((groups, 256, n), anchors.dtype)
    for bit in range(DIMS):
        half = 1 << bit
        tables[:, half:2 * half] = tables[:, :half] + padded[bit::DIMS][:, None, :]
    return tables


def planes_of(values: np.ndarray) -> np.ndarray:
    """(row, plane, group) bytes of whole numbers in two's complement; the last plane is the sign's."""
    n, d = values.shape
    widest = int(np.maximum(values, ~values).max(initial=0)).bit_length() + 1
    bits = ((values[:, None, :] >> np.arange(widest)[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def scores_of(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(row, anchor) inner products: lookups per plane, shifted and added from the sign downwards."""
    n, widest, groups = planes.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    for p in range(widest - 1, -1, -1):
        if p < widest - 1:
            total <<= 1
        for g in range(groups):
            found = tables[g].take(planes[:, p, g], axis=0)
            if p == widest - 1:
                total -= found
            else:
                total += found
    return total


class Best:
    """The first ``k`` of each list: by falling score, then rising id."""

    def __init__(self, lists: int, k: int):
        self.k, self.at_least = k, np.full(lists, _LOWEST)
        self.which = self.score = self.id = np.zeros(0, np.int64)

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        which, score, ids = (np.concatenate([a, b]) for a, b in ((self.which, which), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, which))
        which, score, ids = which[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(which, prepend=-1))
        place = np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))
        full = place == self.k - 1
        self.at_least[which[full]] = score[full]
        keep = place < self.k
        self.which, self.score, self.id = which[keep], score[keep], ids[keep]

    def offer(self, lists: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Rows of ``scores`` (row, list) that fit and are no worse than what the list holds."""
        fits = fits & (scores >= self.at_least[lists])
        if fits.sum() > 8 * self.k * len(lists):
            # most of a first block would be sorted only to be left out
            masked = np.where(fits, scores, _LOWEST)
            cut = max(0, len(ids) - self.k)
            fits &= scores >= np.partition(masked, cut, axis=0)[cut]
        row, column = np.nonzero(fits)
        if len(row):
            self.add(lists[column], scores[row, column].astype(np.int64), ids[row])


def _limit(dims: int) -> int:
    """Components below it in size keep every score within 62 bits."""
    return math.isqrt((1 << 62) // max(1, int(dims)))


_PACKED = "id bigint, label bigint, dims int, planes binary"


def _packed(batches: Iterator[pa.RecordBatch], factor: float) -> Iterator[pa.RecordBatch]:
    """Rows that take part, as bit planes."""
    for batch in steps(batches):
        whole = pa.Table.from_batches([batch]).drop_null()
        lengths = pa.compute.list_value_length(whole.column(2)).to_numpy()
        for d in np.unique(lengths):
            some = whole.filter(pa.array(lengths == d)).combine_chunks().to_batches()[0]
            x = np.zeros((some.num_rows, 0))
            if d:
                # a null component reads as NaN
                x = some.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            with np.errstate(over="ignore"):
                x = np.floor(factor * x)
            fine = (np.abs(x) < _limit(d)).all(1)
            planes = planes_of(x[fine].astype(np.int64)) if d and fine.any() else np.zeros((fine.sum(), 0, 0), np.uint8)
            ids, labels = (some.column(i).filter(pa.array(fine)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array([d] * len(ids), pa.int32()), pa.array([p.tobytes() for p in planes], pa.binary())],
                names=["id", "label", "dims", "planes"],
            )


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(ids, labels, planes, dims) of the rows of one length, fewer planes widened by their sign."""
    dims, packed = batch.column(2).to_numpy(), batch.column(3).to_pylist()
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for d in np.unique(dims[dims > 0]):
        rows, groups = np.flatnonzero(dims == d), -(-int(d) // DIMS)
        depth = np.array([len(packed[i]) // groups for i in rows])
        planes = np.zeros((len(rows), depth.max(), groups), np.uint8)
        for n in np.unique(depth):
            some = np.flatnonzero(depth == n)
            block = np.frombuffer(b"".join(packed[rows[i]] for i in some), np.uint8).reshape(len(some), n, groups)
            planes[some, :n], planes[some, n:] = block, block[:, -1:]
        yield ids[rows], labels[rows], planes, int(d)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = ROWS):
    for batch in batches:
        for start in range(0, batch.num_rows, limit):
            yield from _alike(batch.slice(start, limit))


class Wave:
    """Some anchors as whole numbers: ids, labels and components (rows of one length each)."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        self.ids, self.labels = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.values = [self._whole(d, packed) for _, _, d, packed in rows]
        self.dims = np.array([r[2] for r in rows])

    @staticmethod
    def _whole(dims: int, packed: bytes) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, -(-dims // DIMS)), axis=1, bitorder="little")[:, :dims].astype(np.int64)
        worth = 1 << np.arange(len(bits), dtype=np.int64)
        worth[-1] = -worth[-1]
        return worth @ bits

    def tiles(self, dims: int, planes: np.ndarray, chosen: np.ndarray | None = None):
        """(places of some anchors, their scores with every row)."""
        places = np.flatnonzero(self.dims == dims) if chosen is None else chosen
        for start in range(0, len(places), ANCHORS):
            some = places[start:start + ANCHORS]
            values = np.stack([self.values[i] for i in some])
            # what any partial sum can come to
            most = int(np.abs(values).sum(1).max()) << planes.shape[1]
            yield some, scores_of(planes, subset_sums(values.astype(np.int32 if most < 1 << 31 else np.int64)))


def _result(best: Best, wave: Wave, per: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(wave.ids[best.which // per]), pa.array((best.which % per).astype(np.int32)), pa.array(best.id), pa.array(best.score),
    ], names=["anchor_id", "place", "id", "score"])


_FOUND = "anchor_id bigint, place int, id bigint, score bigint"


def _positives(batches: Iterator[pa.RecordBatch], wave: Wave, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(wave.ids), k)
    for ids, labels, planes, dims in _blocks(batches):
        mine = np.flatnonzero(wave.dims == dims)
        for label in np.intersect1d(labels, wave.labels[mine]):
            rows = np.flatnonzero(labels == label)
            for some, scores in wave.tiles(dims, planes[rows], mine[wave.labels[mine] == label]):
                best.offer(some, scores, ids[rows, None] != wave.ids[some], ids[rows])
    yield _result(best, wave, 1)


def _negatives(batches: Iterator[pa.RecordBatch], wave: Wave, bounds: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """``bounds`` are the least and greatest score per (anchor, positive); a missing positive admits none."""
    low, high = bounds
    per = low.shape[1]
    best = Best(low.size, k)
    for ids, labels, planes, dims in _blocks(batches):
        for some, scores in wave.tiles(dims, planes):
            other = (labels[:, None] != wave.labels[some]) & (ids[:, None] != wave.ids[some])
            for j in range(per):
                best.offer(some * per + j, scores, other & (scores >= low[some, j]) & (scores <= high[some, j]), ids)
    yield _result(best, wave, per)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every list over all tasks, with their rank from 1."""
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    factor: float = 256.0, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, wave: int = WAVE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor.

    ``anchor`` is a condition on the column ``id``, the integer key.  Components become
    floor(factor * x) and a score is the integer inner product with the anchor; higher scores come
    first, ties by smaller key.  Positives are the first ``positives`` other rows of the anchor's
    label; for each, the result has the first ``negatives`` rows of another label whose score is
    ``least`` to ``most`` hundredths of the positive's.  Only vectors of equal length have a score.
    Rows take no part if key, label or vector is null, a component is null or not finite, or
    reaches sqrt(2^62 / length) in size, beyond which scores leave 64 bits.  Rows with the
    anchor's own key are never its partners; an anchor that repeats a key counts once, with its
    least row; other repeated rows count each.  Empty vectors and empty tables give nothing.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    code = F.when(ident(label).isNotNull(), F.xxhash64(ident(label)))
    rows = materialise(df.select(
        ident(key).cast("bigint").alias("id"), code.alias("label"), ident(vector).alias("vec"),
    ).mapInArrow(lambda batches: _packed(batches, factor), _PACKED), "packed-vectors")
    anchors = materialise(rows.where(anchor & (F.col("dims") > 0)).groupBy("id").agg(
        F.min(F.struct("label", "dims", "planes")).alias("a")
    ).select("id", "a.*"), "anchors")
    size = anchors.agg(F.sum("dims").alias("all"), F.max("dims").alias("one")).first()
    waves = -(-(size["all"] or 0) // max(1, wave // 2))
    parts = []
    for w in range(waves):
        # a hash deals the anchors out, so a wave has about half of what it may have
        some = Wave([tuple(r) for r in anchors.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(waves)) == w).collect()])
        if not len(some.ids):
            continue
        sent = Sent(spark, some)
        same = materialise(_first(rows.mapInArrow(lambda b, s=sent: _positives(b, s.value, positives), _FOUND), positives), "positives")
        place = {int(k): i for i, k in enumerate(some.ids)}
        low = np.full((len(some.ids), positives), np.iinfo(np.int64).max)
        high = np.full((len(some.ids), positives), _LOWEST)
        for r in same.collect():
            at, p = (place[r["anchor_id"]], r["rank"] - 1), r["score"]
            low[at], high[at] = -(-least * p // 100), most * p // 100
        other = rows.mapInArrow(lambda b, s=sent, x=(low, high): _negatives(b, s.value, x, negatives), _FOUND)
        chosen = _first(other, negatives).select("anchor_id", (F.col("place") + 1).alias("p"), "rank", "id", "score")
        best = same.select("anchor_id", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        parts.append(materialise(chosen.join(best, ["anchor_id", "p"]), "hard-negatives"))
        free(same)
        sent.drop()
    schema = f"anchor_id {kind.simpleString()}, positive_id {kind.simpleString()}, rank int, negative_id {kind.simpleString()}, positive_score bigint, negative_score bigint"
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part.select(
            F.col("anchor_id").cast(kind).alias("anchor_id"), F.col("positive_id").cast(kind).alias("positive_id"), "rank",
            F.col("id").cast(kind).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        ))
    return out
