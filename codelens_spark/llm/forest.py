"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Equal vectors are first reduced to one. Every tree splits recursively: a random direction, the median of the vectors'
projections as threshold, and vectors within the spill margin of it go down both sides, so near pairs are rarely
parted. A branch ends early where most vectors lie within the projected threshold distance of every median that was
tried: that is a dense group, which a cut would part again and again. Thresholds come from a bounded sample, but every vector is routed through every tree. Vectors that share a
leaf are compared; pairs with enough cosine are links. A pair that meets in several leaves is counted in the first of
them only (each vector carries its list of leaves), so no table of all pairs is ever made: a leaf gives counts per
vector and a spanning forest of its links. The sample of a large table is too thin for small leaves, so leaves that hold
too many rows are cut further, by trees grown from bounded samples of their own, until they are small or dense. Leaves with many vectors (a dense group cannot be split apart) are compared
block by block in separate groups.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from .components import components

COSINE = 0.95
TREES = 12
LEAF = 192  # sampled vectors stand for rows; a branch ends at about this many rows
SPILL = 0.3  # of the distance two vectors at the threshold can have, projected
DIRECTIONS = 8  # tried before a branch ends as dense
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
BLOCK = 1024
SEED = 5
OVERFULL = 4  # times LEAF rows: a leaf with more is cut further
LEAF_SAMPLE = 2000  # vectors of an overfull leaf that its own tree is grown from, about
ROUTED_ROWS = 50_000  # rows of an overfull leaf that one task routes, about


@dataclass
class Tree:
    """Nodes as arrays: children of node k are left[k] and right[k], or leaf[k] is its number and left[k] is -1."""

    direction: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray


def grow(sample: np.ndarray, leaf_rows: float, margin: float, reach: float, rng: np.random.Generator, first_leaf: int) -> tuple[Tree, int]:
    """One tree over a sample; a branch ends at `leaf_rows` sampled vectors or where most lie beside every median within `reach`."""
    direction, threshold, left, right, leaf = [], [], [], [], []
    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        k = len(leaf)
        if parent >= 0:
            (right if side else left)[parent] = k
        done = True
        for _ in range(DIRECTIONS if len(rows) > leaf_rows else 1):
            v = rng.normal(size=sample.shape[1])
            v /= np.linalg.norm(v)
            x = sample[rows] @ v
            cut = float(np.median(x)) if len(x) else 0.0
            if len(rows) > leaf_rows and max((x < cut + reach).sum(), (x >= cut - reach).sum()) <= 0.8 * len(rows):
                done = False
                break
        low, high = rows[x < cut + margin], rows[x >= cut - margin]
        direction.append(v)
        threshold.append(cut)
        left.append(-1)
        right.append(-1)
        leaf.append(first_leaf if done else -1)
        if done:
            first_leaf += 1
        else:
            todo += [(low, k, 0), (high, k, 1)]
    return Tree(np.array(direction), np.array(threshold), np.array(left), np.array(right), np.array(leaf)), first_leaf


def route(tree: Tree, vectors: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each vector reaches."""
    rows, leaves = [], []
    todo = [(np.arange(len(vectors)), 0)]
    while todo:
        own, k = todo.pop()
        if not len(own):
            continue
        if tree.left[k] < 0:
            rows.append(own)
            leaves.append(np.full(len(own), tree.leaf[k], np.int32))
            continue
        x = vectors[own] @ tree.direction[k]
        todo += [(own[x < tree.threshold[k] + margin], int(tree.left[k])), (own[x >= tree.threshold[k] - margin], int(tree.right[k]))]
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(leaves or [np.zeros(0, np.int32)])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _route(forest: list[Tree], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"))
            found = [route(tree, vectors, margin) for tree in forest]
            row, leaf = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            ends = np.searchsorted(row, np.arange(len(vectors) + 1)).astype(np.int32)
            leaves = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("vec"), batch.column("copies"), leaves], names=["pos", "vec", "copies", "leaves"])

    return run


def _grow(leaf_rows: int, margin: float, reach: float):
    """A sample of one leaf -> its tree; none if the leaf is dense and stays whole."""

    def run(table: pa.Table) -> pa.Table:
        leaf, n = table.column("leaf")[0].as_py(), table.column("n")[0].as_py()
        sample = _matrix(table.column("vec"))
        sample = sample[np.lexsort(sample.T)]
        tree, leaves = grow(sample, max(8.0, leaf_rows * len(sample) / n), margin, reach, np.random.default_rng([SEED, leaf & 0xFFFFFFFF]), 0)
        blob = pickle.dumps(tree) if leaves > 1 else None
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "tree": pa.array([blob], pa.binary())})

    return run


def _reroute(margin: float):
    """Some rows of one leaf and its tree -> the smaller leaves that each row reaches."""

    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows or not trees.num_rows:
            return pa.table({"pos": pa.array([], pa.int64()), "was": pa.array([], pa.int64()), "part": pa.array([], pa.int32())})
        row, part = route(pickle.loads(trees.column("tree")[0].as_py()), _matrix(rows.column("vec")), margin)
        pos = rows.column("pos").to_numpy()[row]
        return pa.table({"pos": pa.array(pos), "was": pa.array(np.full(len(row), rows.column("leaf")[0].as_py(), np.int64)), "part": pa.array(part.astype(np.int32))})

    return run


def _refined(routed: DataFrame, leaf_rows: int, margin: float, reach: float) -> DataFrame:
    """`routed` with the overfull leaves cut further. Only leaf numbers move; vectors move where their leaf is cut."""
    vectors = routed.select("pos", "vec")
    spread = routed.select("pos", F.explode(F.col("leaves").cast("array<bigint>")).alias("leaf"))
    whole: DataFrame | None = None  # leaves that cannot be cut
    cut = False
    while True:
        over = spread.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > OVERFULL * leaf_rows)
        over = stage(over if whole is None else over.join(whole, "leaf", "left_anti"), "overfull")
        if over.isEmpty():
            break
        inside = spread.join(over, "leaf")
        drawn = F.pmod(F.xxhash64("pos", "leaf"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(float(LEAF_SAMPLE)) / F.col("n")
        sampled = inside.filter(drawn).join(vectors, "pos").groupBy("leaf")
        trees = stage(sampled.applyInArrow(_grow(leaf_rows, margin, reach), "leaf long, tree binary"), "trees")
        dense = over.join(trees.filter("tree is not null"), "leaf", "left_anti").select("leaf")
        whole = stage(dense if whole is None else dense.unionByName(whole), "dense")
        trees = trees.filter("tree is not null").join(over, "leaf")
        if trees.isEmpty():
            break
        cut = True
        parts = F.ceil(F.col("n") / ROUTED_ROWS).cast("int")
        rows = inside.join(trees.select("leaf"), "leaf").withColumn("share", F.pmod(F.xxhash64("pos"), parts).cast("int")).join(vectors, "pos").select("leaf", "share", "pos", "vec")
        copies = trees.withColumn("share", F.explode(F.sequence(F.lit(0), parts - 1))).select(F.col("leaf").alias("of"), F.col("share").alias("to"), "tree")
        found = rows.groupBy("leaf", "share").cogroup(copies.groupBy("of", "to")).applyInArrow(_reroute(margin), "pos long, was long, part int")
        smaller = found.select("pos", F.xxhash64("was", "part").alias("leaf"))
        spread = stage(spread.join(trees.select("leaf"), "leaf", "left_anti").select("pos", "leaf").unionByName(smaller).distinct(), "spread")
    if not cut:
        return routed.withColumn("leaves", F.col("leaves").cast("array<bigint>"))
    lists = spread.groupBy("pos").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    return stage(routed.drop("leaves").join(lists, "pos").select(*routed.columns), "routed")


def _leaf_links(pos: np.ndarray, vec: np.ndarray, copies: np.ndarray, leaves: list[np.ndarray], block: np.ndarray, leaf: int, crossed: bool, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links first met in this leaf: how many each vector has (copies counted), and a spanning forest of them."""
    count = np.zeros(len(pos), np.int64)
    root = np.arange(len(pos))
    forest = []

    # leaves before this one as bits, so that a pair's first meeting is found for all links at once
    earlier = sorted({int(x) for own in leaves for x in own[: np.searchsorted(own, leaf)]})
    bits = np.zeros((len(pos), max(1, -(-len(earlier) // 64))), np.uint64)
    for k, own in enumerate(leaves):
        at = np.searchsorted(earlier, own[: np.searchsorted(own, leaf)])
        np.bitwise_or.at(bits[k], at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    if np.bitwise_and.reduce(bits, axis=0).any():
        return count, forest  # all of them met in an earlier leaf
    for at in range(0, len(pos), 512):
        near = vec[at: at + 512] @ vec.T >= cosine
        near &= block[at: at + 512, None] < block[None] if crossed else np.arange(at, min(at + 512, len(pos)))[:, None] < np.arange(len(pos))[None]
        a, b = np.nonzero(near)
        a += at
        new = ~(bits[a] & bits[b]).any(axis=1)
        a, b = a[new], b[new]
        count += np.bincount(a, copies[b], len(pos)).astype(np.int64) + np.bincount(b, copies[a], len(pos)).astype(np.int64)
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        for x, own in zip(a[starts].tolist(), np.split(b, starts[1:])):
            roots, first = np.unique(root[own], return_index=True)
            for q, y in zip(roots.tolist(), own[first].tolist()):
                if q != root[x]:
                    root[root == q] = root[x]
                    forest.append((int(pos[x]), int(pos[y])))
    return count, forest


def _compare(cosine: float):
    """Groups (leaf, i, j) -> rows (a, null, links of a) and (a, b, null) for the spanning links."""

    def run(table: pa.Table) -> pa.Table:
        leaf, i, j = (table.column(c)[0].as_py() for c in ("leaf", "i", "j"))
        pos = table.column("pos").to_numpy()
        lists = table.column("leaves").combine_chunks()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        leaves = np.split(flat, (ends[1:-1] - ends[0]))
        count, forest = _leaf_links(pos, _matrix(table.column("vec")), table.column("copies").to_numpy(), leaves, table.column("block").to_numpy(), leaf, i != j, cosine)
        have = np.flatnonzero(count)
        a = np.concatenate((pos[have], np.array([x for x, _ in forest], np.int64)))
        b = pa.array([None] * len(have) + [y for _, y in forest], pa.int64())
        n = pa.array(count[have].tolist() + [None] * len(forest), pa.int64())
        return pa.table({"a": pa.array(a), "b": b, "n": n})

    return run


def usable_vectors(rows: DataFrame) -> DataFrame:
    """Rows (id, v) whose vector v is neither null nor empty and has no null or non-finite component, v as doubles."""
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, trees: int = TREES, sample: int = SAMPLE
) -> DataFrame:
    """Per row of `table`: (id, n_links long, component_id long, kept boolean).

    Vectors that are null, zero, or hold null or non-finite components link with nothing; so do vectors of another
    length than the commonest. Equal vectors are links of each other (a positive multiple too, found like any other).
    Rows with a null id take no part and have a null component. Repeated ids count as rows of their own but share a
    component. Other columns are not read; an empty table gives an empty table. The trees are fitted on up to about
    `sample` distinct vectors drawn by hash; all vectors are indexed.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = usable_vectors(rows.filter("id is not null"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # scaled by the largest component first, so that no finite vector over- or underflows
    peak = F.array_max(F.transform("v", F.abs))
    good = good.withColumn("peak", peak).filter("peak > 0").withColumn("v", F.transform("v", lambda x: x / F.col("peak"))).withColumn("norm", norm)
    good = good.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("vec"), F.xxhash64("v").alias("hash"))
    good = stage(good, "vectors")
    widths = good.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] if widths else 1
    good = good.filter(F.size("vec") == width)
    distinct = stage(good.groupBy("hash", "vec").agg(F.min("id").alias("pos"), F.count(F.lit(1)).alias("copies")), "distinct")
    total = distinct.count()

    sample = max(1, min(sample, SAMPLE_BYTES // (8 * width)))
    share = min(1.0, sample / max(1, total))
    drawn = distinct.filter(F.pmod(F.xxhash64("hash", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    picked = drawn.orderBy("hash", "pos").select("vec").limit(2 * sample).toPandas()["vec"]
    points = np.stack(picked.to_list()) if len(picked) else np.zeros((0, width))
    apart = np.sqrt(2 - 2 * cosine)
    reach = apart / np.sqrt(width)  # what two vectors at the threshold are apart on a random direction
    margin = SPILL * reach * 0.5
    rng = np.random.default_rng(SEED)
    forest, leaves = [], 0
    for _ in range(trees):
        tree, leaves = grow(points, max(8.0, LEAF * share), margin, reach, rng, leaves)
        forest.append(tree)

    routed = stage(distinct.select("pos", "vec", "copies").mapInArrow(_route(forest, margin), "pos long, vec array<double>, copies long, leaves array<int>"), "routed")
    routed = _refined(routed, LEAF, margin, reach)
    spread = routed.withColumn("leaf", F.explode("leaves"))
    blocks = spread.groupBy("leaf").count().filter("count > 1").select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = spread.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("leaf", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "pos", "vec", "leaves", "copies")
    found = stage(dealt.groupBy("leaf", "i", "j").applyInArrow(_compare(cosine), "a long, b long, n long"), "leaf-links")

    counts = found.filter("n is not null").groupBy(F.col("a").alias("pos")).agg(F.sum("n").alias("n"))
    joined = components(found.filter("b is not null"))
    members = good.join(distinct.select("hash", "vec", "pos", "copies"), ["hash", "vec"])
    members = members.join(counts, "pos", "left").join(joined.withColumnRenamed("node", "pos"), "pos", "left")
    # pos is the least id of equal vectors, so a component's least pos is its least id
    linked = members.select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "pos").alias("component"))
    others = rows.filter("id is not null").join(good.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    nameless = rows.filter("id is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    out = linked.unionByName(others).unionByName(nameless)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
