"""Hard negatives from an inverted multi-index.

Vectors are quantised to whole numbers and cut into two halves; each half has a codebook, and the pair of nearest
codewords is a vector's cell. For an anchor q every codeword c of a half has a bound q_h.c + |q_h| r, r being the
greatest distance of a vector's half from its codeword; the sum of two half bounds is an upper bound for all scores of a
cell. A multi-sequence heap visits cells by falling sums. A search is over when its windows are certified: each has as
many results above the next cell's bound as it asks for, or lies above that bound altogether.

Cells are dealt to shards of about SHARD_ROWS rows (a cell with more has shards of its own), anchors to blocks. A bounded
sample gives every search a floor first, and an anchor is sent only to shards with a cell whose bounds reach its
floor and window. The first search finds an anchor's positives, the second the negatives of their score windows; both
are exact, whatever the codebooks and the sample are like.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import stage
from .forest import usable_vectors
from .voronoi import products

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
SAMPLE, SAMPLE_BYTES = 4096, 64 << 20  # the sample serves codebooks and floors only
CODEWORDS, ROUNDS = 16, 8
SHARD_ROWS, BLOCK_ANCHORS = 32_768, 4096
STEP = 512  # rows scored at once
_ROWS = "id long, label int, vec array<double>"


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(2)
        flat = np.floor(values.flatten().to_numpy(zero_copy_only=False) * SCALE) + 0.0
        ends = values.offsets.to_numpy() - (values.offsets[0].as_py() if len(values.offsets) else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "label", "vec"])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = v.shape[1] // 2
    return v[:, :cut], v[:, cut:]


def _nearest(half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row and the distance to it."""
    code = np.zeros(len(half), np.int64)
    far = np.zeros(len(half))
    for at in range(0, len(half), 4096):
        part = half[at: at + 4096]
        code[at: at + 4096] = ((book * book).sum(axis=1)[None] - 2 * part @ book.T).argmin(axis=1)
        far[at: at + 4096] = np.sqrt(((part - book[code[at: at + 4096]]) ** 2).sum(axis=1))
    return code, far


def codebook(half: np.ndarray, words: int = CODEWORDS, rounds: int = ROUNDS) -> np.ndarray:
    """A few rounds of k-means over a sample's half vectors; at most `words` codewords."""
    different = np.unique(half, axis=0)
    book = different[np.random.default_rng(3).permutation(len(different))[:words]]
    for _ in range(rounds if len(different) > words else 0):
        code, _ = _nearest(half, book)
        sums = np.zeros_like(book)
        np.add.at(sums, code, half)
        count = np.bincount(code, minlength=len(book))
        book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
    return book if len(book) else np.zeros((1, half.shape[1]))


class Reach:
    """Bounds of the scores of queries with the vectors near each codeword of one half."""

    def __init__(self, book: np.ndarray, radius: np.ndarray):
        self.book, self.radius = book, radius  # radius -1: a codeword without vectors
        self.length = np.sqrt((book * book).sum(axis=1))

    def bounds(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, rows of queries by codewords; a little wider than rounding can be wrong."""
        dot, size = half @ self.book.T, np.sqrt((half * half).sum(axis=1))[:, None]
        swing = size * np.maximum(self.radius, 0)[None]
        swing = swing * (1 + 1e-9) + 1e-9 * (1 + size * self.length[None])
        unused = self.radius[None] < 0
        return np.where(unused, np.inf, dot - swing), np.where(unused, -np.inf, dot + swing)


class Shard:
    """The rows of one shard by cell, with the bounds of its cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        codes, reaches = [], []
        for half, book in zip(_halves(v), books):
            code, far = _nearest(half, book)
            radius = np.full(len(book), -1.0)
            np.maximum.at(radius, code, far)
            codes.append(code)
            reaches.append(Reach(book, radius))
        self.reaches, self.wide = reaches, len(books[1])
        cell = codes[0] * self.wide + codes[1]
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        self.at = np.searchsorted(cell[order], np.arange(len(books[0]) * self.wide + 1))

    def cells(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) by falling bound: the multi-sequence over the two halves' sorted bounds; empty cells are left out."""
        by, also = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        a, b = first[by].tolist(), second[also].tolist()
        heap, seen = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound == np.inf:
                return
            cell = int(by[i]) * self.wide + int(also[j])
            if self.at[cell] < self.at[cell + 1]:
                yield -bound, cell
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(a[x] + b[y]), x, y))

    def search(self, q: np.ndarray, first: np.ndarray, second: np.ndarray, fits, windows: list[tuple[int, int, float]], k: int) -> list[np.ndarray]:
        """For each window (least, most, floor) the places of the k best fitting rows in it; scores are kept in `scores`.

        Only results of at least the floor are wanted: rows below it are never among the k best over all shards."""
        wanted = [max(low, floor) for low, _, floor in windows]
        self.scores = np.zeros(0)
        rows = np.zeros(0, np.int64)
        steps = self.cells(first, second)
        held: list[int] = []
        bound, cell = next(steps, (-np.inf, -1))
        while cell >= 0:
            size = 0
            while cell >= 0 and size < STEP:
                held.append(cell)
                size += int(self.at[cell + 1] - self.at[cell])
                bound, cell = next(steps, (-np.inf, -1))
            new = np.concatenate([np.arange(self.at[c], self.at[c + 1]) for c in held])
            held = []
            new = new[fits(new)]
            rows = np.concatenate((rows, new))
            self.scores = np.concatenate((self.scores, products(q[None], self.v[new])[0]))
            if all(bound < least or np.count_nonzero((self.scores > bound) & (self.scores <= most)) >= k for (_, most, _), least in zip(windows, wanted)):
                break  # every window is certified
        out = []
        for (low, most, _), least in zip(windows, wanted):
            inside = np.flatnonzero((self.scores >= least) & (self.scores <= most))
            top = inside[np.lexsort((self.ids[rows[inside]], -self.scores[inside]))[:k]]
            out.append(np.stack((rows[top], top)))
        return out


_FAR = 2**63 - 1


def _window(score: int) -> tuple[int, int]:
    """Least and greatest negative score for a positive score, in whole numbers."""
    return max(-_FAR, -(-LOW * score // 100)), min(_FAR, HIGH * score // 100)


def _kth(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def _needs(sample: list, books: tuple[np.ndarray, np.ndarray], cells: dict[str, np.ndarray], positives: bool):
    """Anchors -> (anchor, shard, floors): the shards that may hold a result, by the bounds of their cells."""
    ids, labels, v = sample
    codes = cells["cell"] // len(books[1]), cells["cell"] % len(books[1])
    reaches = []
    for code, far, book in zip(codes, (cells["r1"], cells["r2"]), books):
        radius = np.full(len(book), -1.0)
        np.maximum.at(radius, code, far)
        reaches.append(Reach(book, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("vec"), v.shape[1])
            (low1, up1), (low2, up2) = (r.bounds(h) for r, h in zip(reaches, _halves(q)))
            out: tuple[list, list, list] = ([], [], [])
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "label", "positives")))):
                anchor, own, label, marks = row
                scores = products(q[k: k + 1], v)[0] if len(v) else np.zeros(0)
                scores = scores[(ids != own) & ((labels == label) if positives else (labels != label))]
                upper, lower = up1[k][codes[0]] + up2[k][codes[1]], low1[k][codes[0]] + low2[k][codes[1]]
                floors, reached = [], np.zeros(len(upper), bool)
                for low, most in [(-np.inf, np.inf)] if positives else [_window(m["score"]) for m in marks]:
                    inside = scores[(scores >= low) & (scores <= most)]
                    floors.append(_kth(inside, POSITIVES if positives else NEGATIVES))
                    reached |= (upper >= max(low, floors[-1])) & (lower <= most)
                for shards, parts in set(zip(cells["shard"][reached].tolist(), cells["parts"][reached].tolist())):
                    for shard in range(shards, shards + parts):
                        out[0].append(anchor)
                        out[1].append(shard)
                        out[2].append(floors)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.float64()))], names=["anchor", "shard", "floors"])

    return run


def _solve(width: int, books: tuple[np.ndarray, np.ndarray], positives: bool):
    """One block of anchors against one shard: each anchor's best rows there, per window."""

    def run(asked: pa.Table, data: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if asked.num_rows and data.num_rows:
            shard = Shard(data.column("id").to_numpy(), data.column("label").to_numpy(), _matrix(data.column("vec"), width), books)
            q = _matrix(asked.column("qvec"), width)
            (_, first), (_, second) = (r.bounds(h) for r, h in zip(shard.reaches, _halves(q)))
            for k, (anchor, own, label, marks, floors) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("anchor", "qid", "qlabel", "positives", "floors")))):
                if positives:
                    fits = lambda rows: (shard.labels[rows] == label) & (shard.ids[rows] != own)  # noqa: E731, B023
                    windows = [(-np.inf, np.inf, floors[0])]
                else:
                    fits = lambda rows: (shard.labels[rows] != label) & (shard.ids[rows] != own)  # noqa: E731, B023
                    windows = [(*_window(m["score"]), floor) for m, floor in zip(marks, floors)]
                found = shard.search(q[k], first[k], second[k], fits, windows, POSITIVES if positives else NEGATIVES)
                for n, (rows, places) in enumerate(found):
                    for column, values in zip(out, (np.full(len(rows), anchor), np.full(len(rows), n), shard.ids[rows], shard.scores[places].astype(np.int64))):
                        column.append(values)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(c, t) for c, t in zip(flat, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "mark", "found", "score"])

    return run


def _codes(books: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, far1), (two, far2) = (_nearest(h, b) for h, b in zip(_halves(_matrix(batch.column("vec"), books[0].shape[1] + books[1].shape[1])), books))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((one * len(books[1]) + two).astype(np.int32)), pa.array(far1), pa.array(far2)], names=["id", "label", "vec", "cell", "r1", "r2"])

    return run


def hard_negatives(
    vectors: DataFrame, every: int = 100, moved: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank int from 1, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`. An anchor's positives are its 5 best other rows of its label, its
    negatives for a positive the 10 best rows of other labels whose score is 30 to 90 percent of the positive's. The label
    of a row whose id is divisible by `moved` first becomes (label + 1) % 10. Scores are inner products of floor(256 x),
    cut off at 64 bits; higher come first, ties by the smaller id. Rows with a null id, label or vector, with a null or
    non-finite component, or of another length than the commonest take no part. "Other" rows have another id; repeated
    rows of the table count each, equal anchor rows are answered once. Anchors without positives, and positives without
    negatives, give no row. Other columns are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("v")).filter("id is not null and label is not null")
    rows = rows.withColumn("label", F.when(F.col("id") % moved == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = stage(usable_vectors(rows).select("id", "label", "v").mapInArrow(_quantised, _ROWS), "quantised")
    common = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if not common:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = common["w"]
    rows = rows.filter(F.size("vec") == width)

    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    share = min(1.0, 2 * most / common["count"])
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30)) <= share)
    drawn = drawn.orderBy(F.xxhash64("id"), "id").limit(most).toPandas()
    v = np.stack(drawn["vec"].to_list()) if len(drawn) else np.zeros((0, width))
    sample = [drawn["id"].to_numpy(np.int64), drawn["label"].to_numpy(np.int64), v]
    books = tuple(codebook(half) for half in _halves(v))

    coded = stage(rows.mapInArrow(_codes(books), _ROWS + ", cell int, r1 double, r2 double"), "coded")
    cells = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toPandas().sort_values("cell")
    # consecutive cells share a shard; a cell with more rows than a shard holds has shards of its own
    shard, parts, room, last = [], [], 0, -1
    for n in cells["n"].tolist():
        own = -(-n // SHARD_ROWS)
        if own > 1 or n > room:
            last, room = last + 1, SHARD_ROWS
        shard.append(last)
        parts.append(own)
        last, room = last + own - 1, 0 if own > 1 else room - n
    summary = {"cell": cells["cell"].to_numpy(np.int64), "r1": cells["r1"].to_numpy(), "r2": cells["r2"].to_numpy(), "shard": np.array(shard), "parts": np.array(parts)}
    places = {c: (s, p) for c, s, p in zip(summary["cell"].tolist(), shard, parts)}
    lookup = lambda k: F.element_at(F.array(*[F.lit(places.get(c, (0, 1))[k]) for c in range(len(books[0]) * len(books[1]))]), F.col("cell") + 1)
    data = coded.select("id", "label", "vec", (lookup(0) + F.pmod(F.xxhash64("id", "vec"), lookup(1))).cast("int").alias("shard"))

    marks = "array<struct<id:bigint,score:bigint>>"
    anchors = rows.filter(F.col("id") % every == 0).distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = stage(anchors.withColumn("positives", F.lit(None).cast(marks)), "anchors")
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))

    def search(asked: DataFrame, positives: bool, k: int) -> DataFrame:
        columns = asked.select("anchor", "id", "label", "positives", "vec")
        needs = stage(columns.mapInArrow(_needs(sample, books, summary, positives), "anchor long, shard int, floors array<double>"), "needs")
        sent = columns.withColumnsRenamed({"id": "qid", "label": "qlabel", "vec": "qvec"}).join(needs, "anchor")
        block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")
        pairs = needs.select(F.col("shard").alias("to"), block.alias("of")).distinct()
        copied = data.join(pairs, F.col("shard") == F.col("to")).groupBy("to", "of")
        found = sent.withColumn("block", block).groupBy("shard", "block").cogroup(copied)
        found = found.applyInArrow(_solve(width, books, positives), "anchor long, mark int, found long, score long")
        best = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "found")
        return stage(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "searched")

    positive = search(anchors, True, POSITIVES)
    listed = positive.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "found", "score"))), lambda p: F.struct(p["found"].alias("id"), p["score"].alias("score"))).alias("positives"))
    asked = stage(anchors.drop("positives").join(listed, "anchor"), "asked")
    negative = search(asked, False, NEGATIVES)
    named = asked.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("mark", "p"))
    return negative.join(named, ["anchor", "mark"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("found").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score")
    )
