"""Exact de-duplication by Grace hashing over complete contents.

A first pass groups the rows of each chunk, so a text with millions of copies leaves a chunk
once.  These groups are shuffled by content hash; inside a task they are partitioned again
and again to spill files until a bucket fits an open-addressing table, which compares whole
contents.  Rows learn their group by joining on the chunk-local group, whose size is bounded
by the chunk, not on the content.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gleanframe.llm.rows import steps, text_bytes
from gleanframe.operators.columns import ident
from gleanframe.session import free, materialise

# content bytes that one table may hold in memory
TABLE_BYTES = 16 << 20
# spill files of one partitioning, and how often a bucket is split: 8 bits of the hash each time
FANOUT, LEVELS = 16, 30
_HEAD = "<32sqqqq?q"


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self):
        self.slots = array("q", [-1]) * 1024
        self.contents: list[bytes] = []
        self.digests: list[bytes] = []
        self.bytes = 0

    def _free(self, digest: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        return at

    def find(self, digest: bytes, content: bytes) -> int:
        """Number of the content, a new one if no equal content is there."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        if 2 * len(self.contents) >= len(self.slots):
            self.slots = array("q", [-1]) * (2 * len(self.slots))
            for i, d in enumerate(self.digests):
                self.slots[self._free(d)] = i
            at = self._free(digest)
        entry = self.slots[at] = len(self.contents)
        self.contents.append(content)
        self.digests.append(digest)
        self.bytes += len(content)
        return entry


# (digest, local group, rows, largest id, row of it, id is null, content)
Record = tuple[bytes, int, int, int, int, bool, bytes]


def better(a: tuple, b: tuple) -> tuple:
    """Of two (id is null, id, row) the one that stays: largest id, then the earlier row."""
    return min(a, b, key=lambda x: (x[0], -x[1], x[2]))


def _settled(members: Iterable[list[tuple]]) -> Iterator[tuple]:
    """(local group, keep id or None, keep row, group size) of the rows (group, n, best, row, null) of each content."""
    for rows in members:
        size, keep = 0, None
        for _, n, best, row, null in rows:
            size += n
            keep = (null, best, row) if keep is None else better(keep, (null, best, row))
        null, best, row = keep
        for group, *_ in rows:
            yield group, None if null else best, row, size


# length of a record whose content is that of the record before it in the file
_AGAIN = -1


def _read(file) -> Iterator[Record]:
    file.seek(0)
    content = b""
    while head := file.read(struct.calcsize(_HEAD)):
        digest, group, n, best, row, null, length = struct.unpack(_HEAD, head)
        content = content if length == _AGAIN else file.read(length)
        yield digest, group, n, best, row, null, content


def grace_groups(records: Iterable[Record], limit: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple]:
    """Settle records in a table if their distinct contents fit, else split them to spill files by the next hash byte.

    Records go into the table as they come, so equal contents share one copy at every level; what
    a full table holds is written with one copy, too.  The files have no name, so the system frees
    them with the task, however it ends.  At the last level the table takes what is left, one copy
    of each content, which is all that any order of splitting could reach.
    """
    records, table, members = iter(records), ContentTable(), []
    for digest, group, n, best, row, null, content in records:
        entry = table.find(digest, content)
        if entry == len(members):
            members.append([])
        members[entry].append((group, n, best, row, null))
        if table.bytes > limit and level < LEVELS:
            break
    else:
        yield from _settled(members)
        return
    files = [tempfile.TemporaryFile(dir=os.environ.get("TMPDIR")) for _ in range(FANOUT)]
    try:
        for digest, content, rows in zip(table.digests, table.contents, members):
            file = files[digest[level] % FANOUT]
            for i, (group, n, best, row, null) in enumerate(rows):
                file.write(struct.pack(_HEAD, digest, group, n, best, row, null, _AGAIN if i else len(content)))
                file.write(b"" if i else content)
        table = members = rows = content = None
        for digest, group, n, best, row, null, content in records:
            file = files[digest[level] % FANOUT]
            file.write(struct.pack(_HEAD, digest, group, n, best, row, null, len(content)))
            file.write(content)
        for file in files:
            yield from grace_groups(_read(file), limit, level + 1)
            file.close()
    finally:
        for file in files:
            file.close()


_ROWS = (
    "id bigint, local_group bigint, row bigint, sha binary, content binary, n bigint, best bigint, best_row bigint"
)


def _chunk_rows(batches: Iterator[pa.RecordBatch], limit: int, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Every row with its chunk-local group; after a chunk, one row per group with content, size and best row."""
    task = TaskContext.get().partitionId() << 40
    row, first, table, sums = 0, 0, ContentTable(), []

    def frame(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields,
        )

    def groups() -> pa.RecordBatch:
        null, best, where = zip(*[keep for _, keep in sums])
        return frame({
            "local_group": [task + first + i for i in range(len(sums))], "sha": table.digests, "content": table.contents,
            "n": [n for n, _ in sums], "best": [None if x else b for x, b in zip(null, best)], "best_row": list(where),
        }, len(sums))

    for batch in steps(batches):
        ids, group, shas, start = batch.column(0).to_pylist(), [], [], row
        for key, content in zip(ids, text_bytes(batch.column(1))):
            content = content.lower()
            digest = hashlib.sha256(content).digest()
            entry = table.find(digest, content)
            keep = (key is None, key or 0, task + row)
            if entry == len(sums):
                sums.append((1, keep))
            else:
                n, was = sums[entry]
                sums[entry] = (n + 1, better(was, keep))
            group.append(task + first + entry)
            shas.append(digest)
            row += 1
        yield frame({
            "id": ids, "local_group": group, "sha": shas, "row": [task + r for r in range(start, row)],
            **dict(zip(fields.names[8:], batch.columns[2:])),
        }, len(ids))
        if table.bytes > limit:
            yield groups()
            first, table, sums = first + len(sums), ContentTable(), []
    if sums:
        yield groups()


_SETTLED = "local_group bigint, keep_id bigint, keep_row bigint, group_size bigint"


def _settle(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    def records():
        for batch in batches:
            # local_group, n, best, best_row, sha, content
            for group, n, best, row, sha, content in zip(*[c.to_pylist() for c in batch.columns]):
                yield sha, group, n, best or 0, row, best is None, content

    def packed(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*rows)], names=["local_group", "keep_id", "keep_row", "group_size"],
        )

    rows = []
    for settled in grace_groups(records(), limit):
        rows.append(settled)
        if len(rows) == 10_000:
            yield packed(rows)
            rows = []
    if rows:
        yield packed(rows)


def _grouped(df: DataFrame, key: str, text: str, limit: int, payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their local group (and payload columns as p0, p1, …), and the outcome of every local group."""
    schema = StructType.fromDDL(_ROWS)
    for i, name in enumerate(payload):
        schema.add(f"p{i}", df.schema[name].dataType)
    fields = to_arrow_schema(schema)
    written = materialise(
        df.select(
            ident(key).cast("bigint").alias("id"), ident(text).cast("string").alias("text"),
            *[ident(c).alias(f"p{i}") for i, c in enumerate(payload)],
        ).mapInArrow(lambda batches: _chunk_rows(batches, limit, fields), schema),
        "dedup-rows",
    )
    groups = materialise(
        written.where("content IS NOT NULL").select("local_group", "n", "best", "best_row", "sha", "content")
        .repartition(F.xxhash64("sha")).mapInArrow(lambda batches: _settle(batches, limit), _SETTLED), "dedup-groups",
    )
    rows = written.where("content IS NULL").drop("content", "n", "best", "best_row")
    if not payload:
        # the contents are done with; what stays is a few numbers a row
        rows = materialise(rows, "dedup-members")
        free(written)
    return rows, groups


def exact_groups(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row per input row; the key is an integer.

    Texts are equal when every byte is, after lower-casing A-Z; null counts as the empty text.
    The row with the largest key stays; of rows that repeat this key, one.  A null key loses to
    any other, and ``keep_id`` is null only if all keys of the group are.  An empty table gives
    an empty one.
    """
    rows, groups = _grouped(df, key, text, table_bytes, ())
    kind = df.schema[key].dataType
    return rows.select("id", "local_group", "row", "sha").join(groups, "local_group").select(
        F.col("id").cast(kind).alias(key), F.col("keep_id").cast(kind).alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """The rows of :func:`exact_groups` that stay, with all their columns."""
    rows, groups = _grouped(df, key, text, table_bytes, ())
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL")
    if repeated.isEmpty():
        # a key names its row, so the texts need not be kept beside their groups
        gone = rows.select("id", "row", "local_group").join(groups, "local_group").where("row <> keep_row")
        return df.join(gone.select(F.col("id").cast(df.schema[key].dataType).alias(key)), key, "left_anti")
    rows, groups = _grouped(df, key, text, table_bytes, df.columns)
    keepers = groups.select(F.col("keep_row").alias("row")).distinct()
    return rows.join(keepers, "row", "left_semi").select(*[F.col(f"p{i}").alias(c) for i, c in enumerate(df.columns)])
