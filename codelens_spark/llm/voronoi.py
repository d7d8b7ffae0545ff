"""Exact top-k search by inner product as a Voronoi join.

Vectors are quantised to whole numbers and assigned to the nearest of a bounded number of pivots. With r = |v - p| for a
vector v in the cell of pivot p, every query q has q.v <= q.p + |q| r. The k-th best score of q within a bounded sample
is a floor for its k-th best score at all, so v can only matter to q if r >= (floor - q.p) / |q|. Queries are put into
blocks along their cells; per block and cell the least such radius is kept, and a vector is copied only to the blocks
whose radius for its cell it reaches. Each block is solved in chunks of the data, exactly, and the chunks' best k are
merged. The sample serves the bounds only: every vector is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import stage
from .forest import usable_vectors

SCALE = 64
K = 20
SAMPLE, PIVOTS = 4096, 256  # bounds of the sample (2 MB of 64 numbers each) and of the pivots among it
BLOCK_QUERIES, CHUNK_ROWS = 1024, 16_384
SALTS = 8
FOUND = "query_id long, vec_id long, score long"


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(1)
        flat = np.floor(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE) + 0.0
        ends = values.offsets.to_numpy() - (values.offsets[0].as_py() if len(values.offsets) else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "vec"])


def quantised(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec array<double>): whole numbers floor(64 x); unusable vectors and null ids are left out."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null")
    return usable_vectors(rows).mapInArrow(_quantised, "id long, vec array<double>")


def _rows(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as doubles while these hold them, else as integers (cut off at 64 bits)."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = whole(a).dot(whole(b).T)
    return np.array([[max(-(2**63), min(2**63 - 1, x)) for x in row] for row in exact.tolist()], np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id, without `own`; ids ascend."""
    at = np.flatnonzero(ids != own)
    s = scores[at]
    if len(s) <= k:
        return at[np.argsort(-s, kind="stable")]
    edge = np.partition(s, len(s) - k)[len(s) - k]
    above, level = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
    chosen = np.sort(np.concatenate((above, level[: k - len(above)])))
    return at[chosen[np.argsort(-s[chosen], kind="stable")]]


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots * pivots).sum(axis=1)
        for batch in batches:
            v = _rows(batch.column("vec"), pivots.shape[1])
            cell = (square[None] - 2 * (v @ pivots.T)).argmin(axis=1)
            radius = np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)], names=[*batch.schema.names, "cell", "radius"])

    return run


def _bounds(pivots: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int):
    """Queries -> per block and cell the radius from which a vector may matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for batch in batches:
            q = _rows(batch.column("vec"), pivots.shape[1])
            ids, blocks = batch.column("id").to_numpy(), batch.column("block").to_numpy()
            for at in range(0, len(q), 256):
                part = q[at: at + 256]
                scores = (part @ points.T).astype(np.float64)
                scores[ids[at: at + 256, None] == point_ids[None]] = -np.inf
                floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(part), -np.inf)
                length = np.sqrt((part * part).sum(axis=1))
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)) + length * length)
                with np.errstate(divide="ignore", invalid="ignore"):
                    radius = (floor[:, None] - slack[:, None] - part @ pivots.T) / length[:, None]
                radius = np.where((length[:, None] == 0) | ~np.isfinite(radius), -np.inf, radius * (1 - 1e-9) - 1e-9)
                for row, block in zip(radius, blocks[at: at + 256].tolist()):
                    least[block] = np.minimum(least[block], row) if block in least else row
        cells = np.arange(len(pivots), dtype=np.int32)
        for block, row in least.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), block, np.int32)), pa.array(cells), pa.array(row)], names=["block", "cell", "least"])

    return run


def _solve(width: int, k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and data.num_rows:
            ids = data.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], _rows(data.column("vec"), width)[order]
            q, names = _rows(queries.column("qvec"), width), queries.column("qid").to_numpy()
            for at in range(0, len(q), 128):
                scores = products(q[at: at + 128], v)
                for row, own in zip(scores, names[at: at + 128].tolist()):
                    found = best(row, ids, own, k)
                    out["query_id"].append(np.full(len(found), own))
                    out["vec_id"].append(ids[found])
                    out["score"].append(row[found].astype(np.int64))
        flat = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in flat.items()})

    return run


def topk_inner_product(queries: DataFrame, data: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank int from 1, vec_id, score long): for each query its k highest scores among all rows of `data`
    but those with its own id, all if there are fewer; ties go to the smaller vec_id.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do vectors of another length
    than the commonest in `data`, nor rows with a null id. Zero vectors do. Repeated rows of `data` count each; repeated
    query ids are answered once. Other columns are not read. An empty table on either side gives an empty table.
    """
    rows = stage(quantised(data, id_col, vector_col), "quantised")
    common = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = common["w"] if common else 1
    rows = rows.filter(F.size("vec") == width)
    asked = quantised(queries, id_col, vector_col).filter(F.size("vec") == width).dropDuplicates(["id"])

    total = rows.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30)) <= share)
    sample = drawn.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    points = np.stack(sample["vec"].to_list()) if len(sample) else np.zeros((0, width))
    point_ids = sample["id"].to_numpy(np.int64) if len(sample) else np.zeros(0, np.int64)
    pivots = np.unique(points, axis=0) if len(points) else np.zeros((1, width))
    pivots = pivots[np.random.default_rng(1).permutation(len(pivots))[:PIVOTS]]

    schema = "id long, vec array<double>, cell int, radius double"
    placed = stage(rows.mapInArrow(_assign(pivots), schema), "cells")
    asked = stage(asked.mapInArrow(_assign(pivots), schema), "asked")
    # consecutive cells share blocks of about BLOCK_QUERIES queries; a cell with more has blocks of its own
    first, parts, block, room = [0] * len(pivots), [1] * len(pivots), 0, BLOCK_QUERIES
    for cell, n in sorted((r["cell"], r["count"]) for r in asked.groupBy("cell").count().collect()):
        if n > room and room < BLOCK_QUERIES:
            block, room = block + 1, BLOCK_QUERIES
        first[cell], parts[cell] = block, -(-n // BLOCK_QUERIES)
        room -= n
        if room <= 0:
            block, room = block + parts[cell], BLOCK_QUERIES
    lookup = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    asked = asked.withColumn("block", (lookup(first) + F.pmod(F.xxhash64("id"), lookup(parts))).cast("int"))

    radii = asked.select("id", "vec", "block").mapInArrow(_bounds(pivots, points, point_ids, k), "block int, cell int, least double")
    radii = radii.groupBy("block", "cell").agg(F.min("least").alias("least"))
    radii = radii.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    chunks = max(1, -(-total // CHUNK_ROWS))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copied = salted.join(radii, ["cell", "salt"]).filter(F.col("radius") >= F.col("least"))
    copied = copied.select("block", F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(chunks)).cast("int").alias("chunk"), "id", "vec")
    sent = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("block", "chunk", F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    found = sent.groupBy("block", "chunk").cogroup(copied.groupBy("block", "chunk")).applyInArrow(_solve(width, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
