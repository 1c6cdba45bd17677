"""Immutable dataset versions on shared storage."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe.operators.catalog import latest_per_key
from gleanframe.operators.schema import column_catalog
from gleanframe.plans.rules import Rule, apply_rules
from gleanframe.sources.sinks import table_fingerprint
from gleanframe.sources.tables import load_table
from gleanframe.session import local_frame

CATALOG = (
    "dataset_id string, version_number bigint, stage string, path string, row_count bigint, "
    "checksum string, parent_version bigint, deleted boolean, byte_size bigint, created_at timestamp, columns string"
)

COLUMNS = "path string, `column` string, ordinal bigint, inferred_type string, is_pii boolean, storage_type string"


def _now() -> datetime:
    return datetime.now(timezone.utc)


def create_if_absent(spark: SparkSession, path: str) -> bool:
    """Create an empty file, in one step; False if it is there already.

    The file systems of a cluster refuse to create a file twice by themselves.  The local one
    checks first and creates then, so there the operating system is asked directly.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    if system.getUri().getScheme() == "file":
        try:
            os.close(os.open(target.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        system.create(target, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


@dataclass(frozen=True)
class Store:
    """A folder with one Parquet path per version and an append-only catalog.

    A version number belongs to whoever creates its file in the claims folder, which only one
    writer can; the others go on to the next number.
    Deleting appends a mark; the files of a deleted version can be removed at any time later.
    """

    spark: SparkSession
    root: str

    @property
    def catalog_path(self) -> str:
        return f"{self.root}/catalog"

    def _entries(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return local_frame(self.spark, [], schema)

    def _log(self) -> DataFrame:
        return self._entries(self.catalog_path, CATALOG)

    def catalog(self) -> DataFrame:
        """Live versions; one whose parent is gone has none."""
        log = self._log()
        gone = log.where("deleted").select(
            F.col("dataset_id").alias("__d"), F.col("version_number").alias("__v")
        ).distinct()
        same = F.col("dataset_id") == F.col("__d")
        live = log.where("NOT deleted").join(gone, same & (F.col("version_number") == F.col("__v")), "left_anti")
        marked = live.join(gone, same & (F.col("parent_version") == F.col("__v")), "left")
        parent = F.when(F.col("__v").isNull(), F.col("parent_version"))
        return marked.withColumn("parent_version", parent).drop("__d", "__v", "deleted")

    def _add(self, *row) -> None:
        # a folder per entry, as two jobs cannot commit to one at a time
        local_frame(self.spark, [row], CATALOG).coalesce(1).write.parquet(f"{self.catalog_path}/{uuid.uuid4().hex}")

    def versions(self, dataset_id: str) -> DataFrame:
        """Newest first."""
        return self.catalog().where(F.col("dataset_id") == dataset_id).orderBy(F.desc("version_number"))

    def columns(self, dataset_id: str) -> DataFrame:
        """(version_number, column, ordinal, inferred_type, is_pii, storage_type) of every live version.

        Types and marks are decided on all cells when a version is written; a version that was rolled
        back to has those of its files.
        """
        live = self.catalog().where(F.col("dataset_id") == dataset_id).select("version_number", "path")
        return live.join(self._entries(f"{self.root}/columns", COLUMNS), "path").drop("path")

    def latest(self) -> DataFrame:
        return latest_per_key(self.catalog(), "dataset_id", "version_number", ["stage", "path", "row_count"])

    def resolve(self, dataset_id: str, version: int | None = None):
        """Catalog row of the wanted version, or of the latest where that one is missing."""
        wanted = F.col("version_number") == (version if version is not None else -1)
        return (
            self.catalog().where(F.col("dataset_id") == dataset_id)
            .orderBy(wanted.desc(), F.desc("version_number")).first()
        )

    def load(self, dataset_id: str, version: int | None = None) -> DataFrame:
        row = self.resolve(dataset_id, version)
        if row is None:
            raise ValueError(f"unknown dataset {dataset_id!r}")
        return self.spark.read.parquet(row["path"])

    def append(self, df: DataFrame, dataset_id: str, stage: str, parent: int | None = None) -> int:
        """Write a new version to a path of its own and add its catalog row."""
        # a path of this attempt alone: one that fails leaves nothing in the way of the next
        path = f"{self.root}/dataset_id={dataset_id}/stage={stage}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        # counted and typed on the written files, so the input is not computed again
        written = self.spark.read.parquet(path)
        seal = table_fingerprint(written).first()
        kinds = local_frame(self.spark, [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "`column` string, storage_type string")
        # both sides have one row per column
        described = column_catalog(written).join(F.broadcast(kinds), "column").select(
            F.lit(path).alias("path"), "column", "ordinal", "inferred_type", "is_pii", "storage_type"
        )
        described.coalesce(1).write.parquet(f"{self.root}/columns/{uuid.uuid4().hex}")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        # the number is claimed when the files are there, so a failed write uses none up
        number = self._claim(dataset_id, parent)
        self._add(dataset_id, number, stage, path, seal["rows"], seal["checksum"], parent, False, size, _now(), shape)
        return number

    def _next(self, dataset_id: str, parent: int | None) -> int:
        """A number that no version of the dataset has had, deleted ones included."""
        used = self._log().where(F.col("dataset_id") == dataset_id).agg(F.max("version_number")).first()[0]
        return max(used or 0, parent or 0) + 1

    def _claim(self, dataset_id: str, parent: int | None) -> int:
        """A number that is this writer's alone, whoever else appends meanwhile."""
        number = self._next(dataset_id, parent)
        folder = f"{self.root}/claims/{quote(dataset_id, safe='')}"
        while not create_if_absent(self.spark, f"{folder}/{number:012d}"):
            number += 1
        return number

    def delete(self, dataset_id: str, version: int) -> None:
        """Drop a version from the catalog; the only one of a dataset stays."""
        live = [r["version_number"] for r in self.versions(dataset_id).select("version_number").collect()]
        if version not in live:
            raise ValueError(f"{dataset_id!r} has no version {version}")
        if len(live) == 1:
            raise ValueError("the only version of a dataset cannot be deleted")
        self._add(dataset_id, version, None, None, None, None, None, True, None, _now(), None)

    def roll_back(self, dataset_id: str, version: int) -> int:
        """Make an earlier version the latest again: a new number for the same files."""
        row = self.resolve(dataset_id, version)
        if row is None or row["version_number"] != version:
            raise ValueError(f"{dataset_id!r} has no version {version}")
        number = self._claim(dataset_id, version)
        self._add(
            dataset_id, number, row["stage"], row["path"], row["row_count"], row["checksum"], version, False,
            row["byte_size"], _now(), row["columns"],
        )
        return number

    def ingest(self, source: str, dataset_id: str, fmt: str | None = None) -> int:
        return self.append(load_table(self.spark, source, fmt), dataset_id, "raw")

    def clean(self, dataset_id: str, rules: list[Rule] | None = None, version: int | None = None) -> int:
        """Apply rules to a version and register the result as its child."""
        row = self.resolve(dataset_id, version)
        if row is None:
            raise ValueError(f"unknown dataset {dataset_id!r}")
        cleaned = apply_rules(self.spark.read.parquet(row["path"]), rules or [])
        return self.append(cleaned, dataset_id, "cleaned", row["version_number"])
