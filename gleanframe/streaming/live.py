"""Metric cards that follow a growing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gleanframe.operators.columns import ident
from gleanframe.session import scratch_path

# batches, or slots of a level, whose sums are merged into one
FAN = 8


def read_growing(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def metric_cards(rows: DataFrame, time: str, by: str, value: str, width: str = "1 day") -> DataFrame:
    """(window_start, by, n, total) per window and kind of the given rows."""
    window = F.window(ident(time), width)
    return (
        rows.groupBy(window, ident(by)).agg(F.count(F.lit(1)).alias("n"), F.sum(ident(value)).alias("total"))
        .select(F.col("window.start").alias("window_start"), ident(by), "n", "total")
    )


class CardFolder:
    """Sums of batches on shared storage, merged level by level.

    Every batch writes one of ``fan`` slots of level 0.  When these are full, their sums become
    one slot of level 1, and so on upwards; the next batch then writes over the first slot again.
    So there are ``fan`` folders per level, and as many levels as the logarithm of the batches.  A
    batch that runs again writes the same slots from the same ones, as no later batch has begun.
    """

    def __init__(self, spark: SparkSession, root: str, shape: StructType, by: str, fan: int = FAN):
        self.spark, self.root, self.shape, self.by, self.fan = spark, root, shape, by, fan

    def _slot(self, level: int, block: int) -> str:
        return f"{self.root}/level-{level:02d}/slot-{block % self.fan:03d}"

    def _summed(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.shape).parquet(*paths)
        return rows.groupBy("window_start", ident(self.by)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def add(self, cards: DataFrame, batch: int) -> None:
        """Keep the sums of batch number ``batch``, counted from 0 without gaps."""
        cards.write.mode("overwrite").parquet(self._slot(0, batch))
        level, block = 0, batch
        while (block + 1) % self.fan == 0:
            full = [self._slot(level, i) for i in range(self.fan)]
            level, block = level + 1, block // self.fan
            self._summed(full).write.mode("overwrite").parquet(self._slot(level, block))

    def parts(self, batches: int) -> list[str]:
        """The slots that together hold the first ``batches`` batches, each once."""
        out, level, blocks = [], 0, batches
        while blocks:
            out += [self._slot(level, i) for i in range(blocks - blocks % self.fan, blocks)]
            level, blocks = level + 1, blocks // self.fan
        return out

    def read(self, batches: int) -> DataFrame:
        """The sums of all batches so far."""
        parts = self.parts(batches)
        return self._summed(parts) if parts else self.spark.createDataFrame([], self.shape)


def run_available(
    stream: DataFrame, time: str, by: str, value: str, width: str = "1 day", label: str = "cards",
) -> DataFrame:
    """Process what is there and return the card of every window and kind.

    Each batch writes the sums of its own rows, and the sums of all batches are added when
    read.  There is no state and no watermark, so a row counts however late it comes.
    """
    spark = stream.sparkSession
    target, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    shape = metric_cards(spark.createDataFrame([], stream.schema), time, by, value, width).schema
    folder, seen = CardFolder(spark, target, shape, by), [0]

    def write(batch: DataFrame, epoch: int) -> None:
        folder.add(metric_cards(batch, time, by, value, width), epoch)
        seen[0] = epoch + 1

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return folder.read(seen[0])
