"""Sharding by sampled splitters, with shards of nearly equal bytes.

Rows are ordered by a hash of their text and then by id, so equal texts lie side by side. A size-weighted sample of the
keys gives quantile boundaries of many fine ranges; rows are range-partitioned by them, every range is sorted and
summed on its own, and ranges that turned out overfull are cut again by a denser sample of their own keys. Range totals
give each row its place in the whole order, and shards are cut at equal shares of the bytes. Where a cut would fall
inside a group of equal texts it moves to the nearer end of the group, unless the group is a large part of a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import stage
from .small import staged_small

SHARDS = 40
ROW_BYTES = 16
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 4096, 160, 16_384
DRAWS = 16  # expected sampled keys per range
OVERFULL = 4  # times the mean rows of a range
WHOLE_GROUP = 0.05  # groups up to this share of a shard are never cut


def _assign(high: np.ndarray, low: np.ndarray):
    """Number of splitters at or below each key; keys are pairs (text hash, id hash)."""
    both = np.stack((high, low), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, l = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "l"))
            left, right = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
            at = right.copy()
            for i in np.flatnonzero(right > left):  # splitters inside a group of equal hashes: settle by id
                at[i] = left[i] + np.searchsorted(both[left[i]: right[i], 1], l[i], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "range"])

    return run


def _splitters(rows: DataFrame, ranges: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantile keys of a sample drawn with probability in proportion to size; about ranges * draws keys reach the driver."""
    total = rows.agg(F.sum("size")).first()[0] or 1
    chance = F.col("size") * (float(ranges * draws) / total)
    drawn = F.pmod(F.xxhash64("h", "l", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # a row larger than the sampling step stands for several draws
    sample = rows.filter(drawn < chance).select("h", "l", F.greatest(F.lit(1.0), chance).alias("w")).toPandas()
    if not len(sample):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sample = sample.groupby(["h", "l"], as_index=False)["w"].sum().sort_values(["h", "l"])
    seen = sample["w"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(seen, seen[-1] * np.arange(1, ranges) / ranges, "right"))
    at = at[at < len(sample)]
    return sample["h"].to_numpy(np.int64)[at], sample["l"].to_numpy(np.int64)[at]


def _ranged(rows: DataFrame, count: int) -> DataFrame:
    """`rows` with the number of their range, staged; overfull ranges are cut again."""
    ranges = int(np.clip(-(-count // RANGE_ROWS), LEAST_RANGES, MOST_RANGES))
    high, low = _splitters(rows, ranges, DRAWS)
    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())])
    dealt = stage(rows.mapInArrow(_assign(high, low), schema), "ranges")
    mean = max(1.0, count / (len(high) + 1))
    full = [r["range"] for r in dealt.groupBy("range").count().filter(F.col("count") > OVERFULL * max(mean, 64)).collect()]
    if full:
        inner = dealt.filter(F.col("range").isin(full)).drop("range")
        more = int(np.clip(-(-inner.count() // max(64, int(mean))), 2, MOST_RANGES))
        # rows of one range may be many small ones: draw by number, not by size
        h, l = _splitters(inner.withColumn("size", F.lit(1)), more, DRAWS)
        keys = sorted({*zip(high.tolist(), low.tolist()), *zip(h.tolist(), l.tolist())})
        high, low = (np.array(x, np.int64) for x in zip(*keys))
        dealt = stage(rows.mapInArrow(_assign(high, low), schema), "ranges")
    return dealt


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, size long, text_crc32 long, law, shard int, slot long, grown_shard int).

    size is the text's UTF-8 bytes (null: none) plus 16; law is `bytes`; slot counts the rows of a shard from 0 without
    gaps in the order of (text hash, id); grown_shard is null. Equal texts (null texts too) lie in one shard, or in
    neighbouring ones if their group is too large for that. Repeated rows are kept, null ids are ordinary ids, and an
    empty table gives an empty table. Fewer rows than shards leave some shards empty. Other columns are not read.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    empty = F.lit("").cast("binary")
    rows = raw.select(
        "id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), empty)).alias("crc"),
        F.xxhash64("text", F.col("text").isNull()).alias("h"),
        F.xxhash64("id").alias("l"),
    )
    rows = stage(rows, "sizes")
    count = rows.count()
    if not count:
        return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    dealt = _ranged(rows, count)
    sums = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range, at most 2 * MOST_RANGES
    offsets = sums.select(F.col("range").alias("__r"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias("__" + c) for c in ("bytes", "rows")])
    offsets = staged_small(offsets, "offsets")
    inside = Window.partitionBy("range").orderBy("h", "l", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__b", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("__n", F.count(F.lit(1)).over(inside))
    placed = placed.join(offsets, F.col("range") == F.col("__r"))
    placed = placed.select("id", "size", "crc", "h", (F.col("__b") + F.col("__bytes")).alias("at"), (F.col("__n") + F.col("__rows")).alias("nth"))
    placed = stage(placed, "placed")

    total = sums.agg(F.sum("bytes")).first()[0]
    cuts = _cuts(placed, total, shards)
    starts = placed.select(*[F.min(F.when(F.col("at") >= c, F.col("nth"))).alias(f"c{i}") for i, c in enumerate(cuts)]).first() if cuts else []
    first_row = [0, *[count if s is None else s for s in starts]]
    shard = sum([(F.col("at") >= c).cast("int") for c in cuts], F.lit(0))
    base = F.element_at(F.array(*[F.lit(int(n)).cast("long") for n in first_row]), shard + 1)
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), shard.alias("shard"), (F.col("nth") - base).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _cuts(placed: DataFrame, total: int, shards: int) -> list[int]:
    """Byte positions at which shards 1, 2, ... begin: the equal shares, moved to an end of the group they fall into."""
    share = total / shards
    wanted = [int(np.ceil(share * k)) for k in range(1, shards)]
    if not wanted:
        return []
    crossing = F.floor(F.col("at") / F.lit(share)) != F.floor((F.col("at") + F.col("size") - 1) / F.lit(share))
    crossed = placed.filter(crossing).select("h").distinct().limit(2 * shards)
    groups = placed.join(F.broadcast(crossed), "h", "left_semi").groupBy("h").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("size")).alias("hi"))
    spans = [(r["lo"], r["hi"]) for r in groups.collect()]
    cuts = []
    for c in wanted:
        for lo, hi in spans:
            if lo < c < hi and hi - lo <= max(WHOLE_GROUP * share, 0):
                c = lo if c - lo <= hi - c else hi
                break
        cuts.append(c)
    return cuts
