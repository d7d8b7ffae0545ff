"""N-gram Jaccard join by parity sketches.

A text is the set S of its distinct 5-word shingles. In size band g (sizes 2^g up to 2^(g+1)) a sketch has m_g words;
every shingle's hash is XORed into one of them, so the sketches of two texts differ in at most |A xor B| words. (A word
of 64 one-bit cells would be alike by chance too often; the XOR of whole 64-bit hashes is the same parity sketch over
2^64 cells, kept as the code of its set cells.) Texts with
|A n B| >= 0.8 |A u B| have |A xor B| <= (|A| + |B|) / 9 <= |A| // 4 =: d, hence agree in all but d of the m_g words.
Ordering the words of every sketch alike, two such texts share one of their first d + 1 words (pigeonhole). Words with
the most rare shingles come first, so that lines and passages that many texts share make no keys while a text has
anything else; which shingles are frequent is counted over all texts and affects the order only, never the result.
Those words are the join keys; a text goes into its own band and, if a partner can be there, into the next.
Candidates are verified on their exact shingle sets.

Copies and groups: inside a batch copies of one set and repeated keys are reduced to one row before anything is
shuffled, and equal sets are then linked to the least text that has them. A key links its members only to the key's least
member (linear, not all pairs). A second parity sketch of one-bit cells, whose Hamming distance also bounds |A xor B| from
below, refutes most false pairs before they are verified. Members of a key that are still apart after these links are
compared by it, and of keys with the same members only one is. That goes in rounds: each verifies the nearest pairs of
every component that pass the bound, 16 a task in the first round and 16 times as many in each further one, which sees
only the keys of pairs that were left out, until a round leaves no pair out. So every pair that shares a key is verified,
refuted by the bound, or already connected. Keys with many members are compared block by block in separate groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import settled, stage
from .components import components
from .small import arrow_batches, small, staged_small
from .words import mix, shingle_sets, text_buffers

PERCENT = 80
BROADCAST_IDS = 500_000  # 4 MB of ids
FREQUENT, SHARE, LEAST_FREQUENT = 65_536, 1 / 2000, 8
_ODD = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 2048
RUN = 150_000
SLICE = 4 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
MOST = 16  # pairs a component and task in the first round, and by how much more in each further one
PART_BYTES = 4 << 20  # text whose keys make a part, about
_BLOBS = "part int, kind int, x binary, y binary, z binary, f binary, g binary, h binary"
_SHARED = "kind int, key long, doc long, rep long, n long, f long, g long, bits binary"


def _keys(sets: list[np.ndarray], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the given sets (no empty ones) and the index of the set each belongs to."""
    n = np.array([len(s) for s in sets], np.int64)
    own = np.frexp(n.astype(float))[1] - 1
    up = 5 * n >= 4 * (1 << (own + 1))
    who = np.concatenate((np.arange(len(n)), np.flatnonzero(up)))
    band = np.concatenate((own, own[up] + 1)).astype(np.int64)
    words = 3 * (1 << band) // 4 + 2
    size = n[who]
    s = np.concatenate([sets[i] for i in who])
    row = np.repeat(np.arange(len(who)), size)
    place = ((s >> np.uint64(32)) * words[row].astype(np.uint64)) >> np.uint64(32)
    base = np.concatenate(([0], np.cumsum(words)))
    cell = base[row] + place.astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    word = np.bitwise_xor.reduceat(s, first)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s
    else:
        rare = np.ones(len(s), bool)
    weight = np.add.reduceat(rare.astype(np.int64), first) * 64
    weight += np.diff(np.append(first, len(s)))
    row, cell = row[first], cell[first]
    need = size // 4 + 1
    short = np.flatnonzero(np.bincount(row, minlength=len(who)) < need)
    if len(short):  # fewer words in use than the bound asks for: fill up with empty words, lowest first
        extra_row, extra_cell = [], []
        for r in short:
            used = cell[row == r] - base[r]
            free = np.setdiff1d(np.arange(words[r]), used)[: need[r] - len(used)]
            extra_row.append(np.full(len(free), r))
            extra_cell.append(base[r] + free)
        row, cell = np.concatenate([row, *extra_row]), np.concatenate([cell, *extra_cell])
        word = np.concatenate([word, np.zeros(len(row) - len(word), np.uint64)])
        weight = np.concatenate([weight, np.full(len(row) - len(weight), -1)])
    slot = (cell - base[row]).astype(np.uint64) + (band[row].astype(np.uint64) << np.uint64(48))
    key = mix(word * _ODD + mix(slot + np.uint64(1)))
    order = np.lexsort((np.where(weight < 0, slot, key), -weight, row))
    row, key = row[order], key[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(who)))[row]
    keep = rank < need[row]
    return key[keep], who[row[keep]]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about SLICE bytes of text each."""
    _, at = text_buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that are frequent among the texts of a batch. What is frequent in all texts is so in some batch."""
    for batch in (part for whole in batches for part in _slices(whole, 0)):
        sets = list(shingle_sets(batch.column(0)))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        flat.sort()
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(flat)))
        many = count >= max(LEAST_FREQUENT, len(sets) * SHARE)
        yield pa.RecordBatch.from_arrays([pa.array(flat[first][many].view(np.int64)), pa.array(count[many])], names=["s", "c"])


def frequent_shingles(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the shingles in the largest numbers of texts, at most FREQUENT of them (512 KB)."""
    counted = texts.select(text_col).mapInArrow(_frequent, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    top = counted.orderBy(F.desc("c"), "s").limit(FREQUENT).select("s").toPandas()["s"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def _width(n: np.ndarray) -> np.ndarray:
    """Bytes of the one-bit-cell sketch of a set of size n: the power of two, 8 at least, with 1.6 to 3.2 cells a shingle.

    So unrelated sets of any size are told apart. Two sets that may be similar have the same width, or one has twice the
    other's."""
    return 1 << np.maximum(3, np.ceil(np.log2(np.maximum(n, 1) / 5)).astype(np.int64))


def _cells(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """The one-bit-cell sketches of all sets, one after the other."""
    width = _width(n)
    base = np.concatenate(([0], np.cumsum(width * 8)))
    row = np.repeat(np.arange(len(n)), n)
    s = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    odd = np.bincount(base[row] + (s & (width[row] * 8 - 1).astype(np.uint64)).astype(np.int64), minlength=base[-1])
    return np.packbits((odd & 1).astype(bool), bitorder="little")


def _runs(n: np.ndarray) -> Iterator[slice]:
    """Slices of consecutive sets with about RUN shingles each, to bound the working memory."""
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")))
        yield slice(at, to)
        at = to


def _sketch(parts: int, frequent: np.ndarray):
    """Batches of texts -> per part the keys and their texts, pre-aggregated, and one row about all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = list(shingle_sets(batch.column(1)))
            n = np.array([len(s) for s in sets], np.int64)
            f = np.array([np.bitwise_xor.reduce(mix(s * _ODD)) if len(s) else 0 for s in sets], np.uint64)
            g = np.array([np.sum(mix(s + _ODD), dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            # copies inside the batch follow the first text with that set
            _, first, same = np.unique(np.stack((n.astype(np.uint64), f, g)), axis=1, return_index=True, return_inverse=True)
            rep = ids[first][same.reshape(-1)] if len(ids) else ids
            lead = np.array([i for i in first if n[i]], np.int64)
            rows = [(0, 0, ids, rep, n, f, g, np.concatenate([np.zeros(0, np.uint8), *(_cells(sets[r], n[r]) for r in _runs(n))]))]
            if len(lead):
                made = [(k, ids[lead[r]][who]) for r in _runs(n[lead]) for k, who in [_keys([sets[i] for i in lead[r]], frequent)]]
                key, doc = (np.concatenate(x) for x in zip(*made))
                key = key >> np.uint64(16)  # 48 bits travel; a chance meeting more is refuted later
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                count = np.diff(np.append(start, len(key)))
                least = np.repeat(doc[start], count)
                follows = np.ones(len(key), bool)
                follows[start] = False
                if follows.any():  # repeated keys: kept beside the shuffle, only the least text carries the key on
                    rows.append((0, 2, key[follows], doc[follows], least[follows], None, None, None))
                k, d = key[start], doc[start]
                part = (k % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                k, d, part = k[order], d[order], part[order]
                edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                rows += [(int(part[a]), 1, *_packed(k[a:b], d[a:b]), None, None) for a, b in zip(edge[:-1], edge[1:])]
            rows = [(int(ids[0] % parts) if r[1] != 1 else r[0], *r[1:]) for r in rows] if len(ids) else []
            columns = list(zip(*rows)) if rows else [()] * 8
            as_bytes = [pa.array([None if v is None else v.tobytes() for v in c], pa.binary()) for c in columns[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *as_bytes], names=["part", "kind", "x", "y", "z", "f", "g", "h"])

    return run


def _packed(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys in 48 bits, and ids as distances from the least, in 32 bits if they fit."""
    base = doc.min()
    off = (doc - base).view(np.uint64)
    wide = off.astype(np.uint32) if off.max() < 1 << 32 else off
    return key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint16), wide, np.array([base], np.int64)


def _unpacked(low: bytes, high: bytes, off: bytes, base: bytes) -> tuple[np.ndarray, np.ndarray]:
    key = np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)
    kind = np.uint32 if len(off) == len(low) else np.uint64
    return key, (np.frombuffer(off, kind).astype(np.uint64) + np.frombuffer(base, np.int64).view(np.uint64)).view(np.int64)


def _table(kind: int, rows: int, bits: pa.Array | None = None, **columns) -> pa.RecordBatch:
    names = ["key", "doc", "rep", "n", "f", "g"]
    arrays = [pa.array(columns[c].view(np.int64)) if c in columns else pa.nulls(rows, pa.int64()) for c in names]
    bits = pa.nulls(rows, pa.binary()) if bits is None else bits
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), *arrays, bits], names=["kind", *names, "bits"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: emits the members of keys that several texts hold, with the key's least text."""
    now, keys, docs = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(start, len(key)))
        shared = np.repeat(count > 1, count)
        if shared.any():
            yield _table(1, int(shared.sum()), key=key[shared], doc=doc[shared], rep=np.repeat(doc[start], count)[shared])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            part, kind, x, y, z, f, g, h = row
            if kind == 0:
                doc, n = np.frombuffer(x, np.int64), np.frombuffer(z, np.int64)
                ends = np.concatenate(([0], np.cumsum(_width(n)))).astype(np.int32)
                bits = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(h)])
                yield _table(0, len(doc), bits, doc=doc, rep=np.frombuffer(y, np.int64), n=n, f=np.frombuffer(f, np.int64), g=np.frombuffer(g, np.int64))
            elif kind == 2:
                key = np.frombuffer(x, np.int64)
                yield _table(1, len(key), key=key, doc=np.frombuffer(y, np.int64), rep=np.frombuffer(z, np.int64))
            else:
                if part != now and keys:
                    yield from flush()
                    keys, docs = [], []
                now = part
                key, doc = _unpacked(x, y, z, f)
                keys.append(key)
                docs.append(doc)
    if keys:
        yield from flush()


class _Sketches:
    """Sketches of the rows of a batch by width, with a version folded to half of it for partners of that width."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffers(column)
        self.width = np.diff(offsets)
        self.row = np.zeros(len(column), np.int64)
        self.whole: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.row[own] = np.arange(len(own))
            bits = np.empty((len(own), width), np.uint8)
            for cut in range(0, len(own), 256):
                bits[cut: cut + 256] = data[offsets[own[cut: cut + 256]][:, None] + np.arange(width)[None]]
            bits = bits.view(np.uint64)
            self.whole[width] = bits
            if width > 8:
                self.half[width] = bits[:, : width // 16] ^ bits[:, width // 16:]

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Hamming distances of the pairs (x, y), at the smaller width of the two."""
        out = np.zeros(len(x), np.int64)
        for width in self.whole:
            for a, b in ((x, y), (y, x)):
                same = (self.width[a] == width) & (self.width[b] == width)
                for pairs, bits in ((same if a is x else same[:0], self.whole), ((self.width[a] == width) & (self.width[b] * 2 == width), self.half)):
                    at = np.flatnonzero(pairs)
                    step = max(1, PAIR_BYTES // width)
                    for cut in range(0, len(at), step):
                        k = at[cut: cut + step]
                        other = self.whole[width][self.row[b[k]]] if bits is self.whole else self.whole[width // 2][self.row[b[k]]]
                        out[k] = np.bitwise_count(bits[width][self.row[a[k]]] ^ other).sum(axis=1, dtype=np.int64)
        return out


class _Nearest:
    """The nearest `most` pairs of every component, collected in bounded memory; `left` has a key of every pair beyond."""

    def __init__(self, most: int):
        self.most, self.size, self.room = most, 0, PAIRS
        self.held: list[np.ndarray] = []
        self.left = np.zeros(0, np.int64)

    def add(self, distance: np.ndarray, component: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> None:
        self.held.append(np.stack((component, distance, np.minimum(a, b), np.maximum(a, b), key)))
        self.size += len(a)
        if self.size > self.room:
            self._reduce()

    def take(self) -> Iterator[pa.RecordBatch]:
        """What is held, which is then forgotten."""
        self._reduce()
        rows, self.held, self.size, self.room = self.held[0], [], 0, PAIRS
        for at in range(0, rows.shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(rows[2, at: at + (1 << 16)]), pa.array(rows[3, at: at + (1 << 16)])], names=["a", "b"])

    def _reduce(self) -> None:
        rows = np.concatenate(self.held, axis=1) if self.held else np.zeros((5, 0), np.int64)
        order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
        rows = rows[:, order]
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
        rows = rows[:, fresh]
        start = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))) if rows.shape[1] else np.zeros(0, np.int64)
        place = np.arange(rows.shape[1]) - np.repeat(start, np.diff(np.append(start, rows.shape[1])))
        self.left = np.union1d(self.left, rows[4, place >= self.most])
        rows = rows[:, place < self.most]
        self.held, self.size = [rows], rows.shape[1]
        self.room = max(PAIRS, 2 * self.size)


SMALL = 64  # groups up to this size are paired together
PAIRS = 1 << 18
PAIR_BYTES = 4 << 20
COMPARED = 8192  # rows compared together


def _pairs(ends: np.ndarray, starts: np.ndarray, side: np.ndarray, crossed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs inside the groups, small groups together, large ones row by row.

    In a crossed group only pairs with one member on each side count."""
    size = ends - starts
    place = np.arange(len(side))
    until = np.repeat(np.where(size <= SMALL, ends, starts), size)  # large groups have no small pairs
    for gap in range(1, min(SMALL, int(size.max(initial=0)))):
        x = place[until - place > gap]
        yield x, x + gap
    for start, end in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist()):
        for at in range(start, end, 64):
            x = np.repeat(np.arange(at, min(end, at + 64)), end - start)
            y = np.tile(np.arange(start, end), min(end, at + 64) - at)
            keep = side[x] < side[y] if crossed[start] else x < y
            yield x[keep], y[keep]


def _compare(most: int):
    """Rows sorted by (key, i, j) -> passing pairs (a, b) between components; if any were left out, a row of nulls, and
    rows (null, key) with a key of each of them."""

    def whole_groups(rows: pa.RecordBatch, marks: np.ndarray, best: _Nearest) -> Iterator[pa.RecordBatch]:
        doc, component, n, side = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "component", "n", "block"))
        starts = np.flatnonzero(np.concatenate(([True], (marks[:, 1:] != marks[:, :-1]).any(axis=0))))
        ends = np.append(starts[1:], rows.num_rows)
        crossed = marks[1] != marks[2]
        sketches = _Sketches(rows.column("bits"))
        for x, y in _pairs(ends, starts, side, crossed):
            near = (component[x] != component[y]) & (5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x]) & (~crossed[x] | (side[x] != side[y]))
            x, y = x[near], y[near]
            distance = sketches.distances(x, y)
            near = 9 * distance <= n[x] + n[y]
            x, y = x[near], y[near]
            best.add(distance[near], component[x], doc[x], doc[y], marks[0][x])
            if best.room > PAIRS:  # more than memory should hold
                yield from best.take()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(most)
        held: list[pa.RecordBatch] = []
        for batch in _and_end(batches):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or batch is not None and sum(b.num_rows for b in held) < COMPARED:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            marks = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")])
            last = 0 if (marks == marks[:, -1:]).all() else int(np.flatnonzero((marks != marks[:, -1:]).any(axis=0))[-1]) + 1
            cut = rows.num_rows if batch is None else last  # the last group may go on in the next batch
            if cut:
                yield from whole_groups(rows.slice(0, cut), marks[:, :cut], best)
            held = [rows.slice(cut)] if cut < rows.num_rows else []
        yield from best.take()
        if len(best.left):
            keys = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(best.left)])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), keys], names=["a", "b"])

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _apart(members: DataFrame, joined: DataFrame, facts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that share a key, lie in different components and may be similar by their sketches: the nearest
    `most` of every component and task, and rows (null, key) where there are more. Also the members of the keys that were
    compared: of keys with the same members, which hold more than one component, the least.

    joined(doc, component, same): equal sets are compared once, by the least text that has them."""
    placed = members.join(joined, "doc", "left")
    placed = placed.select("key", F.coalesce("same", "doc").alias("doc"), F.coalesce("component", "doc").alias("component"))
    half, low = F.shiftrightunsigned(F.xxhash64("doc"), 32), F.xxhash64("doc").bitwiseAND(F.lit(0xFFFFFFFF))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum(half).alias("s"), F.sum(low).alias("t"))
    split = split.filter("lo < hi").groupBy("lo", "hi", "size", "s", "t").agg(F.min("key").alias("key"))
    split = staged_small(split.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "split", BROADCAST_IDS)
    live = stage(placed.join(split, "key").distinct(), "apart")
    ids = staged_small(live.select("doc").distinct(), "ids", BROADCAST_IDS)
    rows = live.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "doc", "component")
    rows = rows.join(facts.join(ids, "doc", "left_semi"), "doc")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "block", "doc", "component", "n", "bits").mapInArrow(_compare(most), "a long, b long"), live.select("key", "doc")


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, bits_a, bits_b) -> the pairs (a, b) that may be similar by their sketches."""
    for batch in batches:
        sketches = _Sketches(pa.concat_arrays([batch.column(4), batch.column(5)]))
        x = np.arange(batch.num_rows)
        near = 9 * sketches.distances(x, x + batch.num_rows) <= batch.column(2).to_numpy() + batch.column(3).to_numpy()
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _stars(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a key's least text and another member, whose sets differ and may be similar."""
    stars = stage(members.filter("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b")).distinct(), "stars")
    ids = staged_small(stars.select(F.col("a").alias("doc")).union(stars.select("b")).distinct(), "ids", BROADCAST_IDS)
    own = stage(facts.join(ids, "doc", "left_semi"), "own")
    both = stars.join(own.toDF("a", "na", "set_a", "bits_a"), "a").join(own.toDF("b", "nb", "set_b", "bits_b"), "b")
    both = both.filter("5 * na >= 4 * nb and 5 * nb >= 4 * na and set_a <> set_b")
    return both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_bounded, "a long, b long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            sets = list(shingle_sets(piece.column(1)))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc", "set"])


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct `pairs` (a, b) whose exact shingle sets are similar enough, with the overlap."""
    ids = staged_small(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "ids", BROADCAST_IDS)
    sets = stage(texts.join(ids, "doc", "left_semi").mapInArrow(_sets, "doc long, set array<long>"), "sets")
    first, second = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    overlap = pairs.join(first, "a").join(second, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return overlap.filter(F.col("both") * 100 >= PERCENT * (F.col("na") + F.col("nb") - F.col("both")))


def _placed(links: DataFrame, same: DataFrame) -> DataFrame:
    """(doc, component, same): the component of every linked text and, where other texts have its set, the least of them."""
    return components(links).withColumnRenamed("node", "doc").join(same, "doc", "left")


def _components_of(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of all texts (doc, ..., n, bits), and (doc, component, same) of those that are linked."""
    # keys travel packed by part: as many parts as keep one small, whatever the number of partitions
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-size // PART_BYTES))
    blobs = known.mapInArrow(_sketch(parts, frequent_shingles(known)), _BLOBS)
    shared = blobs.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_meet, _SHARED)
    shared = stage(shared, "shared")
    about = shared.filter("kind = 0").select("doc", "rep", "n", "f", "g", "bits")
    members = shared.filter("kind = 1").select("key", "doc", "rep")

    facts = about.select("doc", "n", F.xxhash64("n", "f", "g").alias("set"), "bits")
    least = facts.filter("n > 0").groupBy("set").agg(F.min("doc").alias("a"))
    equal = stage(facts.select("doc", "set").join(least, "set").groupBy("doc").agg(F.collect_set("a").alias("least")), "equal")
    # an id that stands for several sets is compared as itself
    same = equal.filter("size(least) = 1 and least[0] <> doc").select("doc", F.get("least", F.lit(0)).alias("same"))
    equal = equal.select(F.explode("least").alias("a"), F.col("doc").alias("b")).filter("a <> b")
    done = settled(lambda: _stars(members, facts), "stars")
    links = settled(lambda: equal.unionByName(_verified(known, done).select("a", "b")), "found")
    joined = settled(lambda: _placed(links, same), "placed")
    facts = about.select("doc", "n", "bits")
    members, most = members.select("key", "doc"), MOST
    while True:
        found, live = _apart(members, small(joined), facts, most)
        found = stage(found, "near")
        near = stage(found.filter("a is not null").distinct().join(done, ["a", "b"], "left_anti"), "near")
        if not near.isEmpty():
            more = settled(lambda: _verified(known, near).select("a", "b"), "found")
            done = done.unionByName(near)
            if not more.isEmpty():
                links = links.unionByName(more)
                joined = settled(lambda: _placed(links, same), "placed")
        left = staged_small(found.filter("a is null and b is not null").select(F.col("b").alias("key")).distinct(), "left", BROADCAST_IDS)
        if left.isEmpty():
            break  # every pair that passed has been verified
        members = live.join(left, "key", "left_semi")
        most *= MOST
    return about, joined


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: (id, n_shingles long, component_id long).

    component_id is the least id reached by links. A connected group is not expanded into all its pairs, so links are
    not counted. Texts that are null or without words have n_shingles 0 and are linked with nothing. Rows with a null id
    have a null component_id. Repeated ids share a component. Other columns of `docs` are not read. An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    known = texts.filter("doc is not null")
    with arrow_batches(spark, BATCH_ROWS, BATCH_BYTES):
        about, joined = _components_of(known)
    rows = about.select("doc", "n").join(joined, "doc", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    nameless = texts.filter("doc is null").select(F.lit(0).cast("long").alias("doc"), "text").mapInArrow(_sizes, "n long")
    return rows.unionByName(nameless.select(F.lit(None).cast("long").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(batch.column(1))], pa.int64())], names=["n"])
