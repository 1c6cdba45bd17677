"""Arrow batches in, Arrow batches out: what the operators share on the workers."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gleanframe.operators.columns import ident

# bytes of text that one step of a worker function sees, unless a single row is longer
STEP_BYTES = 1 << 20


def _turned() -> dict:
    """What this worker holds on to; a value that the last two tasks did not ask for is dropped."""
    store = sys.__dict__.setdefault("_gleanframe_kept", {"task": None, "now": {}, "last": {}})
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if task != store["task"]:
        store.update(task=task, last=store["now"], now={})
    return store


def kept(key, make: Callable):
    """A value that outlives the task in a reused Python worker, such as a loaded vocabulary."""
    store = _turned()
    if key not in store["now"]:
        store["now"][key] = store["last"][key] if key in store["last"] else make()
    return store["now"][key]


def give_back() -> None:
    """Return freed memory to the system, so that idle workers do not add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    # only glibc keeps freed blocks, and only there is this function
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Sent:
    """A driver-side value of bounded size on every worker, loaded once per worker.

    It travels with its classes, so the package need not be installed there.
    """

    def __init__(self, spark: SparkSession, value):
        self.name = uuid.uuid4().hex
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return kept(self.name, lambda: cloudpickle.loads(self.packed.value))

    def drop(self) -> None:
        """Give back the copies on the executors; a task that still asks for the value fetches it anew."""
        self.packed.unpersist()


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes; at the end the worker's free memory is given back."""
    _turned()
    for batch in batches:
        pieces = max(1, min(batch.num_rows, -(-batch.nbytes // limit)))
        width = -(-batch.num_rows // pieces) or 1
        for start in range(0, batch.num_rows, width):
            yield batch.slice(start, width)
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def map_steps(df: DataFrame, fn: Callable, schema: str, limit: int = STEP_BYTES) -> DataFrame:
    """``fn`` turns the columns of a slice (name to Arrow array) into the columns of ``schema``."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in steps(batches, limit):
            columns = fn(dict(zip(batch.schema.names, batch.columns)))
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)],
                schema=fields,
            )

    return df.mapInArrow(run, schema)


def picked(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns; whatever else a table brings cannot clash."""
    return df.select(*[ident(c) for c in names])


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes, null as the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fold(key: Column, folds: int) -> Column:
    """Remainder of the CRC of an id's decimal text; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
