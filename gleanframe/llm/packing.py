"""Pattern packing: fill sequences with few-document length patterns fitted to the histogram.

Only the histogram of lengths (one row per length, at most the sequence length) reaches the
driver.  There, repeat counts of patterns on a grid of lengths are fitted by non-negative least
squares and rounded down; what is left is packed by best fit into the gaps.  The outcome is a
table of runs, "documents of length x with rank a to b start at offset o of sequences s, s + 1, …",
bounded by the number of patterns, and each document finds its place by its rank.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gleanframe.llm.bpe import STEP_BYTES, load, vocabulary_text
from gleanframe.llm.rows import map_steps, picked, shuffle_partitions, texts
from gleanframe.session import local_frame, materialise

# units of the length grid, documents of a pattern, and rounds of the least-squares fit
GRID, DOCUMENTS, ROUNDS = 64, 4, 400

# (length, first rank, number of documents, first sequence, offset)
Run = tuple[int, int, int, int, int]


def token_pieces(
    df: DataFrame, vocabulary: str, *, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids binary]): every document's ids and the id ``end``, cut to ``capacity``.

    Only documents longer than ``capacity`` are cut; all their pieces but the first are full.  A
    null or empty text is the id ``end`` alone.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))

    def run(columns):
        vocab, tail = load(sent.value), array("I", [end]).tobytes()
        at, piece, start, length, crc, ids = [], [], [], [], [], []
        for row, packed in enumerate(vocab.encode_all(texts(columns[text]))):
            packed += tail
            n, to = len(packed) // 4, 0
            cuts = range((n - 1) % capacity + 1, n + 1, capacity)
            for i, cut in enumerate(cuts):
                content = packed[4 * to:4 * cut]
                at.append(row)
                piece.append(i)
                start.append(to)
                length.append(cut - to)
                crc.append(zlib.crc32(content))
                if with_ids:
                    ids.append(content)
                to = cut
        keys = columns[key].take(pa.array(at, pa.int64()))
        return (keys, piece, start, length, crc, *([pa.array(ids, pa.binary())] if with_ids else []))

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return map_steps(picked(df, [key, text]), run, schema, STEP_BYTES)


def patterns(units: int, most: int) -> np.ndarray:
    """One column per way to fill ``units`` with 1 to ``most`` documents: documents of each unit length."""
    found = []
    for k in range(1, most + 1):
        for first in combinations_with_replacement(range(1, units + 1), k - 1):
            last = units - sum(first)
            if last >= max([1, *first]):
                found.append((*first, last))
    columns = np.zeros((units + 1, len(found)))
    for i, lengths in enumerate(found):
        for x in lengths:
            columns[x, i] += 1
    return columns


def fit_counts(columns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts with least squared distance to the histogram, by active sets.

    A unit column of small weight per length lets documents stay over at their share of a
    sequence, so a length without partners does not distort the others.
    """
    units = len(histogram) - 1
    scale = max(histogram.max(), 1.0)
    weight = np.arange(units + 1) / units
    a, b = columns * weight[:, None], histogram / scale * weight
    x, active = np.zeros(a.shape[1]), []
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -1
        best = int(gradient.argmax())
        if gradient[best] <= 1e-9:
            break
        active.append(best)
        while True:
            solved = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (solved > 0).all():
                break
            # go as far as all counts stay positive and drop those that reach zero
            now, bad = x[active], solved <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - solved[bad], 1e-300))
            now = now + step * (solved - now)
            x[active] = np.where(now > 1e-12, now, 0)
            active = [i for i, v in zip(active, now) if v > 1e-12]
            if not active:
                break
        x[:] = 0
        x[active] = solved if active else 0
    return x * scale


def plan_runs(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs that place every document of the histogram, and fill sequences 0, 1, … without gaps."""
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[Run] = []
    sequences = 0
    # (space left, first sequence, number of sequences), ordered by space
    gaps: list[tuple[int, int, int]] = []

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    full = left.get(capacity, 0)
    if full:
        place(capacity, full, 0, 0)
        sequences = full
    unit = max(1, -(-capacity // GRID))
    units = -(-capacity // unit)
    grid = np.zeros(units + 1)
    for length, n in left.items():
        grid[-(-length // unit)] += n
    stock = [length for length, n in left.items() if n]
    # documents of the top unit have no partner on the grid; best fit places them
    if units >= 2 and grid[1:units].any():
        columns = patterns(units, DOCUMENTS)[:, 1:]
        grid[units] = 0
        counts = np.floor(fit_counts(columns, grid) + 1e-6).astype(np.int64)
        for i in np.argsort(-counts, kind="stable"):
            lengths = [int(u) for u in np.flatnonzero(columns[:, i]) for _ in range(int(columns[u, i]))]
            repeat = int(counts[i])
            while repeat > 0:
                chosen = []
                for u in reversed(lengths):
                    room = capacity - sum(chosen)
                    last = len(chosen) == len(lengths) - 1
                    # the last document closes the sequence: the longest that fits, of any unit
                    at = bisect_right(stock, room if last else min(room, u * unit)) - 1
                    while at >= 0 and left[stock[at]] <= chosen.count(stock[at]):
                        if not left[stock[at]]:
                            del stock[at]
                        at -= 1
                    if at < 0 or not last and stock[at] <= (u - 1) * unit:
                        break
                    chosen.append(stock[at])
                if len(chosen) < len(lengths):
                    break
                n = min(repeat, *(left[x] // chosen.count(x) for x in chosen))
                offset = 0
                for x in chosen:
                    place(x, n, sequences, offset)
                    offset += x
                insort(gaps, (capacity - offset, sequences, n))
                sequences += n
                repeat -= n
    # residuals, longest first, each into the tightest gap
    todo = [-x for x in left if left[x]]
    heapq.heapify(todo)
    while todo:
        length = -heapq.heappop(todo)
        while left[length]:
            at = bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):
                n, space, first = left[length], capacity, sequences
                # as many to a new sequence as fit, so runs stay few
                each = capacity // length
                whole = n // each
                if whole:
                    for j in range(each):
                        place(length, whole, first, j * length)
                    insort(gaps, (space - each * length, first, whole))
                    sequences += whole
                else:
                    for j in range(n):
                        place(length, 1, first, j * length)
                    insort(gaps, (space - n * length, first, 1))
                    sequences += 1
                continue
            space, first, n = gaps.pop(at)
            some = min(n, left[length])
            place(length, some, first, capacity - space)
            insort(gaps, (space - length, first, some))
            if some < n:
                insort(gaps, (space, first + some, n - some))
    return runs


def pack(pieces: DataFrame, *, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table with (key, piece, length) rows of 1 to ``capacity`` tokens.

    Sequences are filled from offset 0 without gaps and hold ``capacity`` tokens at most.  Rows
    of equal length are interchangeable; repeated rows each get a place.  An empty table gives
    an empty one.  Ranks within a length are counted in salted parts, as a length may have a
    third of all rows.
    """
    spark = pieces.sparkSession
    rows = materialise(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"pieces have 1 to {capacity} tokens")
    # a part has about an eighth of a shuffle partition
    part = max(1, sum(histogram.values()) // (8 * shuffle_partitions(pieces)))
    salts = local_frame(spark, [(n, -(-c // part)) for n, c in histogram.items()], "length bigint, salts bigint")
    salted = rows.join(F.broadcast(salts), "length").withColumn(
        "__salt", F.pmod(F.xxhash64(key, "piece"), F.col("salts"))
    ).drop("salts")
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy(key, "piece")
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1).join(firsts, ["length", "__salt"]).withColumn(
        "__rank", F.col("__rank") + F.col("__before")
    )
    runs = local_frame(
        spark, plan_runs(histogram, capacity),
        "length bigint, __from bigint, __n bigint, __first bigint, offset bigint",
    )
    inside = (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__n"))
    placed = ranked.join(F.broadcast(runs.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & inside)
    return placed.select(
        *pieces.columns, (F.col("__first") + F.col("__rank") - F.col("__from")).alias("sequence_id"), "offset",
    )
