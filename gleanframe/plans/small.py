"""Small metric frames: computed now, and side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from gleanframe.session import local_frame


def settled(frame: DataFrame) -> DataFrame:
    """A metric frame computed now; it has a few rows per column or pair of columns at most."""
    return local_frame(frame.sparkSession, frame.collect(), frame.schema)


def together(*jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Independent small results from jobs that share the cluster instead of queueing."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        return [done.result() for done in [pool.submit(job) for job in jobs]]
