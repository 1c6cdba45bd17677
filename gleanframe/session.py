"""Session set-up and shared scratch storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs a millisecond per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of this machine.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gleanframe-", dir=os.environ.get("TMPDIR"))
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/gleanframe/{label}-{uuid.uuid4().hex}"


# scratch tables written inside the innermost scope
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch scope", default=None)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts the lineage, survives executor loss, and gives later steps column
    pruning and real size statistics, which a cache would not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    if _SCOPE.get() is not None:
        _SCOPE.get().append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def free(*tables: DataFrame) -> None:
    """Give back the storage of materialised tables that nothing will read any more.

    An empty table takes their place, so this asks no more of the storage than writing does.
    """
    for table in tables:
        _empty(table.sparkSession, table.scratch)


def _empty(spark: SparkSession, path: str) -> None:
    local_frame(spark, [], "freed boolean").coalesce(1).write.mode("overwrite").parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Frees, when left, the tables materialised inside; what is to stay has to be written before."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            _empty(spark, path)


def local_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str | StructType) -> DataFrame:
    """A few driver-held rows as a DataFrame that plans as a local scan, without any task."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)
