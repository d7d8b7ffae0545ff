"""Interval lookups without pairing every point with every interval of its key.

`stab_*` send each point and each interval once to the task of its key, where they are swept in order of their
positions. A key with more than CROWD rows does not go to one task: its closed intervals [s, e] are cut into their
canonical dyadic nodes (at most two per level) and its points into the one node per level that holds them. A point
lies in an interval exactly when they share one node, so the range join turns into an equi-join. `prefix_max_at`
answers "the largest end among intervals that start at or before x" by one ordered scan.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Run, running
from .stage import stage

LEVELS = 62
FARTHEST = 1 << 60
CROWD = 500_000  # points and intervals of a key that one task sweeps
PAIRS = 1 << 16  # rows of a result batch, about


def _width(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def _node(pos: Column, level: Column) -> Column:
    """Number of the node of a level that holds a position: an arithmetic shift, so it floors below zero too."""
    return F.call_function("shiftright", pos, level)


def _place(col: str) -> Column:
    """A position as a long; beyond +-2**60 the job fails rather than losing rows."""
    pos = F.col(col).cast("long")
    return F.when((pos > FARTHEST) | (pos < -FARTHEST), F.raise_error(F.lit("position beyond 2**60")).cast("long")).otherwise(pos)


def _depth(s: str, e: str) -> Column:
    """A canonical node is never longer than its interval."""
    return F.least(F.lit(LEVELS), F.ceil(F.log2(_place(e) - _place(s) + 2))).cast("int")


def _nodes(s: str, e: str) -> Column:
    """Canonical nodes of [s, e]; positions are integers of either sign."""

    def at(level: Column) -> Column:
        lo = _node(F.col(s).cast("long") + _width(level) - 1, level)
        hi = _node(F.col(e).cast("long") + 1, level)
        odd = lambda n: F.call_function("getbit", n, F.lit(0)) == 1
        left = F.when((lo < hi) & odd(lo), F.struct(level.alias("level"), lo.alias("node")))
        right = F.when((lo < hi) & odd(hi), F.struct(level.alias("level"), (hi - 1).alias("node")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), _depth(s, e)), at)))


def _top_level(ivals: DataFrame, s: str, e: str) -> Column:
    """Highest level any of the intervals can have a node on, as a scalar subquery."""
    return ivals.agg(F.coalesce(F.max(_depth(s, e)), F.lit(0))).scalar()


def _point_nodes(pos: str) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.col("__top")),
        lambda level: F.struct(
            level.alias("level"),
            _node(_place(pos), level).alias("node"),
        ),
    )


def _exploded(df: DataFrame, nodes: Column) -> DataFrame:
    return df.withColumn("__n", F.explode(nodes)).withColumn("level", F.col("__n.level")).withColumn("node", F.col("__n.node")).drop("__n")


def _swept(best: bool, ranks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of points and covering intervals from rows (at, point, to, p, i, rank..., key...) sorted by key, at and point.

    Intervals that cover the position reached are held, by their place in `held`. With `best` each position gets the one
    of least rank, then least payload: the open ones lie in a heap and those that have ended leave it when they come up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        open_, held, soonest = [], None, None  # (rank..., end, place) of the open intervals, the least end among them
        for batch in batches:
            at, point, to = (batch.column(c).to_pylist() for c in range(3))
            order = [*batch.columns[5:5 + ranks], *batch.column(4).flatten()] if best else []
            rank = list(zip(*(c.to_pylist() for c in order), strict=True))
            names = list(zip(*(batch.column(c).to_pylist() for c in range(5 + ranks, batch.num_columns)), strict=True))
            base = 0 if held is None else len(held)
            held = batch.column(4) if held is None else pa.concat_arrays([held, batch.column(4)])
            rows, places = [], []
            for k in range(batch.num_rows):
                if names[k] != key:
                    key, last, open_, soonest = names[k], None, [], None
                x = at[k]
                if not point[k]:
                    if best:
                        # nulls first, as Spark orders them
                        heapq.heappush(open_, (*((v is not None, v) for v in rank[k]), to[k], base + k))
                    else:
                        open_.append((to[k], base + k))
                        soonest = to[k] if soonest is None else min(soonest, to[k])
                elif best:
                    if x == last:
                        continue
                    last = x
                    while open_ and open_[0][-2] < x:
                        heapq.heappop(open_)
                    if open_:
                        rows.append(k)
                        places.append(open_[0][-1])
                elif open_:
                    if soonest < x:
                        open_ = [o for o in open_ if o[0] >= x]
                        soonest = min((o[0] for o in open_), default=None)
                    rows += [k] * len(open_)
                    places += [o[1] for o in open_]
                if len(rows) > PAIRS:
                    yield _paired(batch, held, rows, places, ranks)
                    rows, places = [], []
            if rows:
                yield _paired(batch, held, rows, places, ranks)
            # the next batch starts with what is still open
            x = at[-1] if batch.num_rows else None
            open_ = [o for o in open_ if o[-2] >= x] if x is not None else open_
            held = held.take(pa.array([o[-1] for o in open_], pa.int64()))
            open_ = [(*o[:-1], n) for n, o in enumerate(open_)]
            if best:
                heapq.heapify(open_)
            else:
                soonest = min((o[0] for o in open_), default=None)

    return run


def _paired(batch: pa.RecordBatch, held: pa.Array, rows: list[int], places: list[int], ranks: int) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    keys = range(5 + ranks, batch.num_columns)
    return pa.RecordBatch.from_arrays(
        [batch.column(3).take(at), held.take(pa.array(places, pa.int64())), *(batch.column(c).take(at) for c in keys)],
        names=["p", "i", *(batch.schema.names[c] for c in keys)],
    )


def _sweep(points: DataFrame, ivals: DataFrame, keys: list[str], pos: str, s: str, e: str, rank: Sequence[Column], payload: Sequence[str], best: bool) -> DataFrame:
    """(keys, other columns of the points, payload): covering pairs, or with `best` one per key and position."""
    rest = [c for c in points.columns if c not in keys]
    p, i = F.struct(*rest).alias("p"), F.struct(*payload).alias("i")
    r = [c.alias(f"r{n}") for n, c in enumerate(rank)]
    named = [F.col(k).alias(f"k{n}") for n, k in enumerate(keys)]
    spans = ivals.select(_place(s).alias("at"), F.lit(False).alias("point"), _place(e).alias("to"), F.lit(None).cast(points.select(p).schema["p"].dataType).alias("p"), i, *r, *named)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in spans.schema.fields if f.name == "i" or f.name in [f"r{n}" for n in range(len(r))]]
    asks = points.select(_place(pos).alias("at"), F.lit(True).alias("point"), F.lit(None).cast("long").alias("to"), p, *none, *named)
    by = [f"k{n}" for n in range(len(keys))]
    rows = spans.unionByName(asks).filter(" and ".join(f"{k} is not null" for k in ["at", *by]))
    rows = rows.repartition(*by).sortWithinPartitions(*by, "at", "point")
    # a nullable struct on one side makes the union's nullable
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in ["p", "i", *by]])
    out = rows.mapInArrow(_swept(best, len(r)), schema)
    return out.select(*[F.col(f"k{n}").alias(k) for n, k in enumerate(keys)], *[F.col("p").getField(c).alias(c) for c in rest], *[F.col("i").getField(c).alias(c) for c in payload])


def _by_crowd(points: DataFrame, ivals: DataFrame, keys: list[str], crowd: int, swept: Callable[..., DataFrame], cut: Callable[..., DataFrame]) -> DataFrame:
    """`swept` of the keys with up to `crowd` rows and `cut` of the others."""
    counts = points.select(*keys).unionByName(ivals.select(*keys)).groupBy(*keys).agg(F.count("*").alias("__rows"))
    crowded = stage(counts.filter(F.col("__rows") > crowd).drop("__rows"), "crowded")
    if crowded.isEmpty():
        return swept(points, ivals)
    few = swept(points.join(crowded, keys, "left_anti"), ivals.join(crowded, keys, "left_anti"))
    return few.unionByName(cut(points.join(crowded, keys, "left_semi"), ivals.join(crowded, keys, "left_semi")))


def stab_best(points: DataFrame, ivals: DataFrame, keys: Sequence[str], pos: str, s: str, e: str, rank: Sequence[Column], payload: Sequence[str], crowd: int = CROWD) -> DataFrame:
    """For each distinct (keys, pos): the payload of the covering interval with the least rank, then the least payload.

    In a crowded key every node keeps only its best interval before the join, and a point meets one row per level.
    """
    keys = list(keys)

    def swept(asks: DataFrame, spans: DataFrame) -> DataFrame:
        return _sweep(asks, spans, keys, pos, s, e, rank, payload, best=True)

    def cut(asks: DataFrame, spans: DataFrame) -> DataFrame:
        entry = F.struct(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]).alias("rank"), F.struct(*payload).alias("pay"))
        best = (
            _exploded(spans.select(*keys, s, e, entry.alias("entry")), _nodes(s, e))
            .groupBy(*keys, "level", "node")
            .agg(F.min("entry").alias("entry"))
        )
        where = _exploded(asks.distinct().withColumn("__top", _top_level(spans, s, e)), _point_nodes(pos)).drop("__top")
        hit = where.join(best, keys + ["level", "node"]).groupBy(*keys, pos).agg(F.min("entry").alias("entry"))
        return hit.select(*keys, pos, *[F.col("entry.pay." + p).alias(p) for p in payload])

    return _by_crowd(points.select(*keys, pos), ivals.filter(F.col(s) <= F.col(e)), keys, crowd, swept, cut)


def stab_all(points: DataFrame, ivals: DataFrame, keys: Sequence[str], pos: str, s: str, e: str, crowd: int = CROWD) -> DataFrame:
    """Every (point, covering interval) pair, each once: the size of the true result, not of its group."""
    keys = list(keys)

    def swept(asks: DataFrame, spans: DataFrame) -> DataFrame:
        return _sweep(asks, spans, keys, pos, s, e, [], [c for c in spans.columns if c not in keys], best=False)

    def cut(asks: DataFrame, spans: DataFrame) -> DataFrame:
        left = _exploded(asks.withColumn("__top", _top_level(spans, s, e)), _point_nodes(pos)).drop("__top")
        right = _exploded(spans, _nodes(s, e))
        return left.join(right, keys + ["level", "node"]).drop("level", "node")

    return _by_crowd(points, ivals.filter(F.col(s) <= F.col(e)), keys, crowd, swept, cut)


def prefix_max_at(points: DataFrame, ivals: DataFrame, keys: Sequence[str], pos: str, s: str, e: str, name: str, inclusive: bool) -> DataFrame:
    """For each distinct (keys, pos): max end over intervals with start <= pos (or < pos)."""
    keys = list(keys)
    starts = ivals.groupBy(*keys, F.col(s).alias("__p")).agg(F.max(e).alias("__e"))
    asks = points.select(*keys, F.col(pos).alias("__p")).distinct()
    asks = asks.withColumn("__e", F.lit(None).cast(starts.schema["__e"].dataType)).withColumn("__q", F.lit(1))
    line = starts.withColumn("__q", F.lit(0)).unionByName(asks).groupBy(*keys, "__p").agg(F.max("__e").alias("__e"), F.max("__q").alias("__q"))
    seen = running(line, keys, "__p", [Run(name, "max", F.col("__e"), inclusive=inclusive)])
    return seen.filter(F.col("__q") == 1).select(*keys, F.col("__p").alias(pos), name)
