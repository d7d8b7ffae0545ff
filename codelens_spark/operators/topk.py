"""Sorted heads: every one plans as take-ordered or as a mergeable min/max, never a full global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import ranked_rows
from ..plans.skew import first_per_key, limit_per_key
from .predicates import is_test_path


def topk(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest `by`; `tie` gives the first-seen order."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def topk_per_group(df: DataFrame, keys: Sequence[str], by: str, k: int, tie: str) -> DataFrame:
    return limit_per_key(df, keys, [F.col(by).desc(), F.col(tie).asc()], k)


def recent(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def reference_order(path: Column, start: Column, end: Column) -> list[Column]:
    """Sort key of references: test files first, then shorter ranges."""
    return [is_test_path(path).desc(), (end - start).asc()]


def rank_references(df: DataFrame, keys: Sequence[str] = ("symbol",), path: str = "uri", tie: Sequence[str] = ("ord",)) -> DataFrame:
    """References of each symbol with their `rank` from 1."""
    return _ranked(df, keys, [*reference_order(F.col(path), F.col("s"), F.col("e")), *tie])


def tree_order(df: DataFrame) -> DataFrame:
    """Entries of each parent with their `rank` from 1, directories first, then by name: df(parent, name, is_dir)."""
    return _ranked(df, ["parent"], [F.col("is_dir").desc(), F.col("name")])


def rank_conditions(df: DataFrame, keys: Sequence[str] = ("fn",)) -> DataFrame:
    """Conditions of each function with their `rank` from 1: simpler first, then shallower, then by text."""
    return _ranked(df, keys, [F.col("complexity"), F.col("depth"), F.col("condition")])


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """A rank inside each key, whatever the number of rows of one key (a folder, a symbol)."""
    return ranked_rows(df, order, "rank", keys).withColumn("rank", F.col("rank").cast("int"))


def min_path(paths: DataFrame) -> DataFrame:
    """paths(fn, path_id, conds, code): for each condition the path with the fewest conditions, then the
    fewest code lines, then the first."""
    rows = paths.select(
        "fn", F.explode(F.array_distinct("conds")).alias("condition"), F.size("conds").alias("n_cond"), F.size("code").alias("n_code"), "path_id"
    )
    return first_per_key(rows, ["fn", "condition"], ["n_cond", "n_code", "path_id"])
