"""Joins and limits that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 32
COPIES = 8


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-spread an input that lies in fewer files than there are cores (one file with one row group,
    say) before heavy row-wise work. Inputs of as many files, as on a cluster, pass unchanged; the rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, *cols)


def salt_of(df: DataFrame, salts: int = SALTS) -> Column:
    """Sub-key from the row's own content, so a recomputed task gives every row the same salt again."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left", salts: int = COPIES) -> DataFrame:
    """Join a table with one row per key onto many rows per key.

    Coarse keys (a file, a function): the many-row side is spread over `salts` sub-keys and the one-row
    side copied once per sub-key, so a hot key is read by several tasks, which the adaptive skew join
    splits further. Fine keys, whose per-key table is nearly as long as the rows, should pass salts=1:
    copying would cost more than it saves. Small per-key tables become a broadcast join at run time.
    """
    keys = list(keys)
    if salts == 1:
        right = per_key.select(*[F.col(c).alias("__r_" + c) if c in keys else F.col(c) for c in per_key.columns])
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("__r_" + k)) for k in keys])
        return rows.join(right, cond, how).drop(*["__r_" + k for k in keys])
    left = rows.withColumn("__salt", salt_of(rows, salts))
    right = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.select(*[F.col(c).alias("__r_" + c) if c in keys + ["__salt"] else F.col(c) for c in right.columns])
    cond = F.col("__salt") == F.col("__r___salt")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("__r_" + k))
    drop = ["__salt", "__r___salt"] + ["__r_" + k for k in keys]
    return left.join(right, cond, how).drop(*drop)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key. A mergeable aggregate: each task ships at most one row per key."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col("__best." + c).alias(c) for c in df.columns])


def limit_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First k rows of each key with their rank.

    A first round ranks inside salted sub-groups, so the second round sees at most `SALTS * k` rows of
    any key. Spark's own window group limit prunes each round before its shuffle.
    """
    keys = list(keys)
    salted = df.withColumn("__salt", salt_of(df))
    inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    pruned = salted.withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= k).drop("__salt")
    return pruned.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)
