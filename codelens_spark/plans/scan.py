"""Ordered scans (running sum / max / previous value) that never put a whole group into one task.

A plain `Window.partitionBy(key)` sorts all rows of a key in one task. Here the ordinal is cut into
fixed-width blocks: blocks are reduced to one row each, the few block rows are scanned per key to get
what each block inherits from the blocks before it, and rows are scanned only inside their block.
With a unique integer ordinal a block holds at most `BLOCK` rows, whatever the key's size. Block rows
are themselves scanned in super-blocks with `levels=2`, for ordinals such as record numbers that span a
whole table; positions inside a file (below 2**31) make at most 2**15 blocks per key and need one level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import attach
from .stage import stage

BLOCK = 1 << 16
SUPER = 1 << 12


@dataclass(frozen=True)
class Run:
    """One running measure: `kind` is sum, max, prev or next; `value` the column it reads."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def _block_total(run: Run, order: Column) -> Column:
    if run.kind == "sum":
        return F.sum(run.value)
    if run.kind == "max":
        return F.max(run.value)
    if run.kind == "prev":
        return F.max_by(F.struct(run.value.alias("v")), order)
    return F.min_by(F.struct(run.value.alias("v")), order)


def _fold(kind: str, total: Column, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if kind == "sum":
        return F.coalesce(F.sum(total).over(before), F.lit(0))
    if kind == "max":
        return F.max(total).over(before)
    return (F.lag if kind == "prev" else F.lead)(total).over(window)


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    runs: Sequence[Run],
    ties: Sequence[str] = (),
    block: int = BLOCK,
    levels: int = 1,
) -> DataFrame:
    """Add one column per run, scanning each key by the integer column `order`."""
    keys = list(keys)
    # helper columns carry the level, so that a nested scan does not overwrite those of the outer one
    blk, val, tot, car, loc = (f"__{c}{levels}_" for c in ("b", "v", "t", "c", "l"))
    rank = F.struct(F.col(order), *[F.col(t) for t in ties])
    base = df.withColumn(blk, F.floor(F.col(order) / F.lit(block)).cast("long"))
    for i, r in enumerate(runs):
        base = base.withColumn(f"{val}{i}", r.value)
    held = [Run(r.name, r.kind, F.col(f"{val}{i}")) for i, r in enumerate(runs)]

    totals = base.groupBy(*keys, blk).agg(*[_block_total(h, rank).alias(f"{tot}{i}") for i, h in enumerate(held)])
    if levels > 1:
        inner = [Run(f"{car}{i}", r.kind, F.col(f"{tot}{i}"), inclusive=False) for i, r in enumerate(runs)]
        carry = running(totals, keys, blk, inner, block=SUPER, levels=levels - 1)
    else:
        over_blocks = Window.partitionBy(*keys).orderBy(blk) if keys else Window.orderBy(blk)
        carry = totals.select(
            *keys, blk, *[_fold(r.kind, F.col(f"{tot}{i}"), over_blocks).alias(f"{car}{i}") for i, r in enumerate(runs)]
        )
    carry = carry.select(
        *[F.col(k).alias("__k_" + k) for k in keys],
        F.col(blk).alias("__k_" + blk),
        *[F.col(f"{car}{i}") for i in range(len(runs))],
    )

    inside = Window.partitionBy(*keys, blk).orderBy(order, *ties)
    local = base
    for i, r in enumerate(runs):
        value = F.col(f"{val}{i}")
        if r.kind in ("sum", "max"):
            frame = inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
            column = (F.sum if r.kind == "sum" else F.max)(value).over(frame)
        else:
            column = (F.lag if r.kind == "prev" else F.lead)(F.struct(value.alias("v"))).over(inside)
        local = local.withColumn(f"{loc}{i}", column)

    cond = F.col(blk) == F.col("__k_" + blk)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("__k_" + k))
    joined = local.join(carry, cond, "inner")
    out = []
    for i, r in enumerate(runs):
        merged = _merge(r.kind, F.col(f"{car}{i}"), F.col(f"{loc}{i}"))
        out.append((merged["v"] if r.kind in ("prev", "next") else merged).alias(r.name))
    return joined.select(*df.columns, *out)


def number_rows(df: DataFrame, keys: Sequence[str], order: str, name: str, start: int = 1, levels: int = 1) -> DataFrame:
    """Position of each row inside its key by a unique integer `order`, counted from `start`."""
    seen = Run(name, "sum", F.lit(1).cast("long"))
    return running(df, keys, order, [seen], levels=levels).withColumn(name, F.col(name) + F.lit(start - 1))


def ranked_rows(df: DataFrame, order: Sequence[Column | str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Place of each row in a total order, from 1, in the whole table or inside its key, without a window over all rows.

    Rows are range-sorted once, by key and order, and written with their range, so a key with a large share of all rows
    lies in many ranges. A row's place is its place among its key's rows in the range plus the numbers of these in the
    ranges before, of which there is one row per range and key.
    """
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__rows"))
    offsets = counts.select(*keys, "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    placed = attach(ranged.withColumn("__inside", inside), offsets, [*keys, "__part"], how="inner", salts=1)
    return placed.select(*df.columns, (F.col("__inside") + F.col("__before")).alias(name))
