"""Set operations: reconciliation, unions, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def reconcile(expected: DataFrame, logs: DataFrame, junit: DataFrame, key: str = "name") -> DataFrame:
    """(key, missing, orphan, without_junit, without_log) for names where something is absent.

    One tagged union and one aggregation instead of four anti joins.
    """
    sides = (("e", expected), ("l", logs), ("j", junit))
    tagged = reduce(DataFrame.unionByName, [df.select(key, *[F.lit(t == tag).alias(t) for t, _ in sides]) for tag, df in sides])
    seen = tagged.groupBy(key).agg(*[F.bool_or(t).alias(t) for t, _ in sides])
    e, lg, j = F.col("e"), F.col("l"), F.col("j")
    flags = seen.select(
        key, (e & ~lg).alias("missing"), (lg & ~e).alias("orphan"), (lg & ~j).alias("without_junit"), (j & ~lg).alias("without_log")
    )
    return flags.filter("missing or orphan or without_junit or without_log")


def difference(all_rows: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    return all_rows.select(*keys).distinct().join(taken.select(*keys).distinct(), list(keys), "left_anti")


def merge_categories(*tables: DataFrame) -> DataFrame:
    """Union of category tables (big, small) without duplicates; a big category without smalls keeps a
    null row only while no table gives it one."""
    rows = reduce(DataFrame.unionByName, [t.select("big", "small") for t in tables]).distinct()
    named = rows.filter("small is not null")
    empty = rows.filter("small is null").join(named.select("big").distinct(), "big", "left_anti")
    return named.unionByName(empty)


def default_categories(spark) -> DataFrame:
    rows = [(big, small) for big, smalls in R.DEFAULT_CATEGORIES.items() for small in (smalls or (None,))]
    return spark.createDataFrame(rows, "big string, small string")


def merge_category_maps(a, b):
    """Map form of the same union, for one row's map<string, array<string>> columns."""
    return F.map_zip_with(a, b, lambda _, x, y: F.array_union(F.coalesce(x, F.array()), F.coalesce(y, F.array())))


def key_union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).distinct()


def union_corpora(*tables: DataFrame) -> DataFrame:
    """Rows of several index batches, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_map(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: all entries of both tables, the new one where a key is in both."""
    kept = existing.join(new, key, "left_anti")
    return kept.unionByName(new)
