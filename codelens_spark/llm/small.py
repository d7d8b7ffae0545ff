"""Broadcasts behind a check of their size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import stage

BROADCAST_ROWS = 100_000


def staged_small(df: DataFrame, tag: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` as a written table; marked for broadcast if it has at most `most` rows, else joined by shuffling."""
    return small(stage(df, tag), most)


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most `most` rows."""
    return F.broadcast(table) if table.count() <= most else table


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Jobs run inside hand at most `rows` rows and about `size` bytes at a time to Python: for long texts, whose batches
    fill memory outside the heap."""
    count, volume = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {key: spark.conf.get(key) for key in (count, volume)}
    spark.conf.set(count, str(min(rows, int(before[count])) if int(before[count]) > 0 else rows))
    spark.conf.set(volume, str(size))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
