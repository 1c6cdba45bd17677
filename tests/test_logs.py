"""Version numbers under a race, and the levels of streamed sums."""

import os
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from pyspark.sql.types import StructType

from gleanframe.plans.versions import Store, create_if_absent
from gleanframe.streaming.live import CardFolder

CARDS = "window_start timestamp, kind string, n bigint, total double"


def test_one_writer_creates_a_file(spark, tmp_path):
    start = Barrier(8)

    def claim(_):
        start.wait()
        return create_if_absent(spark, f"file://{tmp_path}/claims/a b/1")

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(claim, range(8))) == 1
    assert not create_if_absent(spark, f"{tmp_path}/claims/a b/1")


def test_writers_that_saw_the_same_log_get_different_numbers(spark, tmp_path, monkeypatch):
    store, start, real = Store(spark, str(tmp_path / "s")), Barrier(3), Store._next
    assert store.append(spark.range(3), "d/1", "raw") == 1

    def stale(self, dataset_id, parent):
        number = real(self, dataset_id, parent)
        # nobody goes on before all have read the catalog
        start.wait()
        return number

    monkeypatch.setattr(Store, "_next", stale)
    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(lambda i: store.append(spark.range(10 + i), "d/1", "raw", 1), range(3)))
    monkeypatch.setattr(Store, "_next", real)
    assert sorted(numbers) == [2, 3, 4]
    sizes = {r["version_number"]: r["row_count"] for r in store.versions("d/1").collect()}
    assert sizes == {1: 3, **{n: 10 + i for i, n in enumerate(numbers)}}
    assert store.roll_back("d/1", 2) == 5 and store.append(spark.range(1), "d/1", "raw") == 6


def test_levels_hold_every_batch_once(spark, tmp_path):
    shape = StructType.fromDDL(CARDS)
    folder = CardFolder(spark, str(tmp_path / "cards"), shape, "kind", fan=3)

    def cards(batch):
        return spark.createDataFrame([(None, "a", 1, float(batch)), (None, f"k{batch % 4}", 2, 0.0)], shape).coalesce(1)

    assert folder.read(0).count() == 0
    for batch in range(31):
        folder.add(cards(batch), batch)
        if batch in (2, 8, 17, 26):
            # the batch failed after its work and runs again
            folder.add(cards(batch), batch)
        if batch in (0, 2, 7, 8, 26, 30):
            got = {r["kind"]: (r["n"], r["total"]) for r in folder.read(batch + 1).collect()}
            assert got["a"] == (batch + 1, sum(range(batch + 1))) and sum(n for n, _ in got.values()) == 3 * (batch + 1)
    slots = [d for d, _, files in os.walk(tmp_path) if any(f.endswith(".parquet") for f in files)]
    # 31 batches take four levels of three slots
    assert len(slots) <= 12 and len(folder.parts(31)) <= 8
