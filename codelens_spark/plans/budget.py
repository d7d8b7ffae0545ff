"""Greedy choice within a budget per key, in a given order, for keys with any number of items.

An item is taken if it still fits, else it is skipped and later, smaller ones may follow. Walking a key item by item
would need one task per key; here a round takes a whole stretch of items at once. With `room` left, items larger than it
can never be taken. Of the others, those of at most half the room are small. Small ones are taken one after the other
until either they have used half the room, or a large one comes that still fits. Whichever is first by order ends the
round, and the room has at least halved; so a key needs about log2(budget) rounds. Keys with few items left are
finished at once by a fold over their sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Run, running
from .skew import attach
from .stage import stage

FOLD = 4096  # items of a key that one fold may walk


def skip_greedy(items: DataFrame, keys: Sequence[str], order: str, size: str, room: str, fold: int = FOLD) -> DataFrame:
    """(keys, order) of the items taken: `order` is a unique integer place inside the key, `room` the key's budget.

    Null and negative sizes count as 0 and always fit; a null or negative room takes nothing.
    """
    keys = list(keys)
    start = items.select(*keys, F.col(order).alias("ord"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"), F.col(room).cast("long").alias("room"))
    start = stage(start.filter("room >= 0 and size <= room"), "greedy")
    free = start.filter("size = 0").select(*keys, "ord")
    taken, live = [free], start.filter("size > 0")
    while True:
        counts = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        sized = stage(attach(live, counts, keys, how="inner"), "greedy")
        taken.append(_folded(sized.filter(F.col("__n") <= fold).drop("__n"), keys))
        live = sized.filter(F.col("__n") > fold).drop("__n")
        if live.isEmpty():
            return reduce(DataFrame.unionByName, taken).withColumnRenamed("ord", order)
        chosen, live = _round(live, keys)
        taken.append(chosen)


def _folded(live: DataFrame, keys: list[str]) -> DataFrame:
    grouped = live.groupBy(*keys).agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct("ord", "size"))).alias("items"))
    empty = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("taken"))

    def step(state, item):
        fits = item["size"] <= state["room"]
        return F.struct(
            F.when(fits, state["room"] - item["size"]).otherwise(state["room"]).alias("room"),
            F.when(fits, F.array_append(state["taken"], item["ord"].cast("long"))).otherwise(state["taken"]).alias("taken"),
        )

    return grouped.select(*keys, F.explode(F.aggregate("items", empty, step)["taken"]).alias("ord"))


def _round(live: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What one round takes, and the items still open after it with the room left."""
    small = F.col("size") * 2 <= F.col("room")
    scanned = stage(running(live, keys, "ord", [Run("before", "sum", F.when(small, F.col("size")).otherwise(0), inclusive=False)]), "greedy")
    after = F.col("before") + F.col("size")
    ends = F.when(small, after * 2 > F.col("room")).otherwise(after <= F.col("room"))
    end = scanned.filter(ends).groupBy(*keys).agg(F.min(F.struct("ord", after.alias("used"))).alias("__end"))
    marked = stage(attach(scanned, end, keys), "greedy")
    last = F.col("__end.ord")
    chosen = marked.filter((small & (last.isNull() | (F.col("ord") < last))) | (F.col("ord") == last)).select(*keys, "ord")
    left = marked.filter(F.col("ord") > last).withColumn("room", F.col("room") - F.col("__end.used")).filter("size <= room")
    return chosen, left.select(*keys, "ord", "size", "room")
