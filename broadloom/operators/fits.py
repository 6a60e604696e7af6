"""Training rows placed once, and independent fits side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from broadloom.operators.selectors import col

T = TypeVar("T")

#: Fits that run at once by default; results do not depend on it.
SLOTS = 4
#: Rows that the fits of a moment hold together: Spark keeps each fit's bagged rows, about 300 bytes a row with 20 trees.
ROWS_AT_ONCE = 10_000_000


def slots_for(rows: int, fits: int = SLOTS) -> int:
    """At most ``fits`` at once, fewer on large tables: their bagged rows would push each other out of memory, and a fit
    then fills all cores by itself."""
    return max(1, min(fits, ROWS_AT_ONCE // max(rows, 1)))


def placed(table: DataFrame, key: str, per_partition: int) -> DataFrame:
    """The rows dealt by a hash of their key and sorted by it, kept for all fits that follow.

    One exchange, whatever the number of fits: projections and filters of the result keep its partitions, whose number
    follows the row count and not the cores, so bagging by partition gives the same forests on any cluster. Keys are
    unique, so no value of a field can gather rows in one partition. Kept partitions spill to disk, and those of a lost
    executor are made again from ``table``. The caller ends with ``unpersist()``.
    """
    parts = -(-table.count() // per_partition) or 1
    dealt = table.repartition(parts, col(key)).sortWithinPartitions(F.xxhash64(col(key)), col(key))
    return dealt.persist(StorageLevel.MEMORY_AND_DISK)


def concurrently(spark: SparkSession, jobs: Sequence[Callable[[], T]], slots: int = SLOTS) -> list[T]:
    """The results of independent jobs in their order, ``slots`` of them at once, each in a scheduler pool of its own.

    With ``spark.scheduler.mode`` FAIR the pools share the executors evenly; without it small jobs still fill the slots
    that others leave. The first error ends the call; jobs that have not begun are dropped.
    """
    if slots <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]

    def in_pool(number: int, job: Callable[[], T]) -> Callable[[], T]:
        def run() -> T:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % slots}")
            return job()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(slots) as pool:
        running = [pool.submit(in_pool(i, job)) for i, job in enumerate(jobs)]
        try:
            return [r.result() for r in running]
        except BaseException:
            for r in running:
                r.cancel()
            raise
