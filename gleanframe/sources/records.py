"""CSV records of files that are split, line breaks inside quotes included.

Whether a line begins inside quotes depends on all lines before it, but a line only maps that
state to the next one: it keeps it, turns it over, or sets it.  One pass reduces every block of a
file to what it does to either state.  A fold over the few blocks of a file then tells how each
block begins, and a second pass cuts all blocks into records side by side.  A record that crosses
blocks leaves a fragment in each, and these few are put together by position.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleanframe.session import materialise

# worker functions travel whole, so the package need not be installed on the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# a record within its block; a record's beginning, end, and a whole block inside a record
WHOLE, BEGINS, ENDS, INSIDE = range(4)


def open_patterns(sep: str) -> tuple[str, str]:
    """Patterns of the lines that end inside quotes: of those that begin outside, and inside.

    A quote opens a field only as its first character; inside, two quotes are one of the text.
    """
    s = f"\\x{ord(sep):02x}" if ord(sep) < 256 else sep
    text = r'(?:[^"]|"")*'
    after = f'(?:[^"{s}][^{s}]*)?'
    field = f'(?:"{text}"{after}|{after})'
    outside = f'^(?:{field}{s})*"{text}$'
    inside = f'^{text}$|^{text}"{after}(?:{s}{field})*{s}"{text}$'
    return outside, inside


def _maps(lines: pa.Array, sep: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line ends inside quotes, when it begins outside and when inside."""
    n = len(lines)
    outside, inside = np.zeros(n, bool), np.ones(n, bool)
    at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(at):
        some = lines.take(pa.array(at))
        for target, pattern in zip((outside, inside), open_patterns(sep)):
            target[at] = pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
    return outside, inside


def _states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """The state after every line."""
    place = np.arange(len(outside))
    last = np.maximum.accumulate(np.where(outside == inside, place, -1))
    turns = np.concatenate([[0], np.cumsum(outside & ~inside)])
    base = np.where(last >= 0, outside[np.maximum(last, 0)], start)
    return base ^ ((turns[1:] - turns[last + 1]) % 2 == 1)


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """((file, start), lines) of every run of lines of one block."""
    file, start = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    edge = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *edge], [*edge, batch.num_rows]):
        if b > a:
            yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def _blank(text: str) -> bool:
    return not text.strip()


_BLOCKS = "file bigint, start bigint, outside boolean, inside boolean, head string"


def _reduced(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """One row per block: the state it ends in from either state, and the first record of a file's first block."""
    block, ends, head, lines = None, (False, True), None, []

    def row():
        return pa.RecordBatch.from_arrays([
            pa.array([block[0]], pa.int64()), pa.array([block[1]], pa.int64()), pa.array([bool(ends[0])]), pa.array([bool(ends[1])]),
            pa.array([head], pa.string()),
        ], names=["file", "start", "outside", "inside", "head"])

    for batch in batches:
        for at, part in _blocks_of(batch):
            if at != block:
                if block is not None:
                    yield row()
                block, ends, head, lines = at, (False, True), None, []
            maps = _maps(part.column(0), sep)
            after = [_states(*maps, e) for e in ends]
            if block[1] == 0 and head is None:
                for state, line in zip(after[0], part.column(0)):
                    lines.append(line.as_py())
                    if not state:
                        text, lines = "\n".join(lines), []
                        if not _blank(text):
                            head = text
                            break
            ends = (after[0][-1], after[1][-1])
    if block is not None:
        yield row()


_PIECES = "file bigint, start bigint, kind int, first boolean, value string"


@dataclass
class _Cutter:
    """Cuts the lines of one block after another into records and fragments."""

    sep: str
    block: tuple[int, int] | None = None
    inside: bool = False
    # lines of the record that is open, and whether it began in a block before
    held: list[str] | None = None
    before: bool = False
    fresh: bool = False

    def _rows(self, kind: int, values, first=None) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([
            pa.array([self.block[0]] * n, pa.int64()), pa.array([self.block[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
            pa.array(first if first is not None else [False] * n, pa.bool_()), values if isinstance(values, pa.Array) else pa.array(values, pa.string()),
        ], names=["file", "start", "kind", "first", "value"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.block is not None and self.held:
            text = "\n".join(self.held)
            yield self._rows(INSIDE if self.before else BEGINS, [text], [self.fresh and not self.before])
        self.held = None

    def turn(self, block: tuple[int, int], inside: bool) -> Iterator[pa.RecordBatch]:
        yield from self.finish()
        self.block, self.inside, self.before, self.held = block, inside, inside, []
        self.fresh = block[1] == 0

    def cut(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        after = _states(*_maps(lines, self.sep), self.inside)
        if not self.inside and not after.any() and not self.fresh:
            yield self._rows(WHOLE, lines)
            return
        texts, start, out = lines.to_pylist(), 0, []
        for end in np.flatnonzero(~after):
            text = "\n".join([*self.held, *texts[start:end + 1]])
            if self.before:
                yield self._rows(ENDS, [text])
            elif self.fresh and not _blank(text):
                yield self._rows(WHOLE, [text], [True])
                self.fresh = False
            else:
                out.append(text)
            self.held, self.before, start = [], False, end + 1
        self.held += texts[start:]
        self.inside = bool(after[-1])
        if out:
            yield self._rows(WHOLE, out)


def _cut(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    cutter = _Cutter(sep)
    for batch in batches:
        for at, part in _blocks_of(batch):
            if at != cutter.block:
                yield from cutter.turn(at, bool(part.column(3)[0].as_py()))
            yield from cutter.cut(part.column(0))
    yield from cutter.finish()


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in file order within every block; the carriage return of a line end stays."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
    )


def block_states(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(file, start, head, open, ends): how every block begins and ends; one small row per block."""
    reduced = _lines(spark, path).mapInArrow(lambda batches: _reduced(batches, sep), _BLOCKS)
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("outside") == F.col("inside")
    turned = F.sum(F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    folded = reduced.withColumn("turned", turned).select(
        "file", "start", "head", "outside", "inside",
        F.coalesce(F.last(F.when(sets, F.col("outside")), ignorenulls=True).over(before), F.lit(False)).alias("set"),
        F.coalesce(F.last("turned").over(before), F.lit(0)).alias("turned"),
        F.coalesce(F.last(F.when(sets, F.col("turned")), ignorenulls=True).over(before), F.lit(0)).alias("base"),
    )
    opens = F.col("set") != (F.pmod(F.col("turned") - F.col("base"), F.lit(2)) == 1)
    return materialise(folded.select("file", "start", "head", opens.alias("open"), "outside", "inside").withColumn(
        "ends", F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside")),
    ).select("file", "start", "head", "open", "ends"), "csv-blocks")


def split_records(spark: SparkSession, path: str | list[str], sep: str, blocks: DataFrame) -> DataFrame:
    """(file, first, value): every record of the files; ``first`` marks a file's first that is not blank.

    ``blocks`` are the states of :func:`block_states`.  Those that begin inside quotes go to all
    tasks: two numbers per block of a file, so some ten-millionth of the input at most.
    """
    open_blocks = blocks.where("open").select("file", "start", F.lit(True).alias("open"))

    def cut(lines: DataFrame) -> DataFrame:
        known = lines.join(F.broadcast(open_blocks), ["file", "start"], "left")
        return known.select("value", "file", "start", F.coalesce("open", F.lit(False)).alias("open")).mapInArrow(
            lambda batches: _cut(batches, sep), _PIECES,
        )

    lines = _lines(spark, path)
    whole = cut(lines).where(F.col("kind") == WHOLE).select("file", "first", "value")
    crossed = blocks.where("open OR ends").select("file", "start")
    if crossed.isEmpty():
        return whole
    parts = cut(lines.join(F.broadcast(crossed), ["file", "start"], "left_semi")).where(F.col("kind") != WHOLE)
    parts = materialise(parts.withColumn("later", (F.col("kind") == BEGINS).cast("int")), "csv-fragments")
    order = Window.partitionBy("file").orderBy("start", "later")
    numbered = parts.withColumn("record", F.sum("later").over(order))
    pieces = F.sort_array(F.collect_list(F.struct("start", "later", "value")))
    joined = numbered.groupBy("file", "record").agg(F.max("first").alias("first"), pieces.alias("pieces")).select(
        "file", "first", F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value"),
    )
    return whole.unionByName(joined)
