"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners, rare terms to the first, so that every owner has about the same number of postings. Bundles
of items pass from owner to owner: at each stage a bundle meets, by cogroup, the owner's postings of its terms, and adds
their integer contributions to the sparse accumulators it carries. A bundle is split by slices of documents, so that
neither a frequent term nor a long list of items makes a large group. After the last owner the best documents of every
slice meet in one ranking.

Between stages each item has a floor: the highest k-th best sum that one of its slices has reached. Sums only grow, so
what cannot reach the floor with the most that the remaining owners can add is dropped, and no new documents are taken
in once these owners alone cannot reach it. That is exact: dropped documents are never among the k best.

Items are worked off in blocks whose terms have a bounded number (VOCABULARY); all that tasks are sent is a block's
terms, weights and floors. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import Run, running
from ..plans.stage import stage
from .words import text_buffers, word_hashes

K = 20
OWNERS = 4
VOCABULARY = 200_000  # distinct terms of the items of one block, summed over items; one item at least
BUNDLE = 256  # items of a bundle
SLICE_DOCS, SLICE_BYTES = 4096, 8 << 20
UNIT = 1_000_000_000
# every byte that is no digit, letter or part of a character beyond ASCII
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_POSTINGS = "slice string, docs long, words long, ids binary, sizes binary, term binary, start binary, doc binary, tf binary"
_CARRIED = "bundle int, slice string, item binary, doc binary, score binary"
_MET = "bundle int, slice string, ids binary, sizes binary, term binary, start binary, doc binary, tf binary"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(words, return_counts=True) for words in word_hashes(batch.column(1), _GAP)]
        lists = lambda part, kind: pa.array([f[part].view(kind) for f in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(0, np.int64), lists(1, np.int64)], names=["row", "terms", "times"])


def _postings(vocabulary: np.ndarray):
    """Texts -> one row per slice of a few thousand documents: ids, numbers of terms, and for every term of the
    vocabulary its documents with their counts (places in the vocabulary ascending, list by list)."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, at = text_buffers(batch.column(2))
        i = 0
        while i < batch.num_rows:
            j = min(i + SLICE_DOCS, max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in cut(batch)):
            sizes, places, docs = [], [], []
            for k, words in enumerate(word_hashes(part.column(2), _GAP)):
                sizes.append(len(words))
                if len(words):
                    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                    at = at[vocabulary[at] == words]
                    places.append(at)
                    docs.append(np.full(len(at), k))
            n = np.array(sizes, np.int64)
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
            pair, tf = np.unique(place * (SLICE_DOCS + 1) + doc, return_counts=True)
            place, doc = np.divmod(pair, SLICE_DOCS + 1)
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
            blobs = [part.column(1).to_numpy(zero_copy_only=False).astype(np.int64), n, place[first].astype(np.int32), np.append(first, len(place)).astype(np.int32), doc.astype(np.uint16), tf.astype(np.int32)]
            # the first document's row number names the slice: the same in every run of the task
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(part.column(0)[0].as_py())]), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]],
                names=["slice", "docs", "words", "ids", "sizes", "term", "start", "doc", "tf"],
            )

    return run


def impact(tf: np.ndarray, size: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What one occurrence of a term in an item is worth per unit of its weight; whole numbers throughout."""
    m = 75 + (25 * size.astype(np.int64) * docs) // max(1, words)
    return (UNIT * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


def _statistics(vocabulary: int, docs: int, words: int):
    """Per term of the vocabulary: number of documents and greatest impact, summed up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        for batch in batches:
            for sizes, term, start, doc, tf in zip(*(batch.column(c).to_pylist() for c in ("sizes", "term", "start", "doc", "tf"))):
                term, start = np.frombuffer(term, np.int32), np.frombuffer(start, np.int32)
                if len(term):
                    worth = impact(np.frombuffer(tf, np.int32), np.frombuffer(sizes, np.int64)[np.frombuffer(doc, np.uint16)], docs, words)
                    df[term] += np.diff(start)
                    most[term] = np.maximum(most[term], np.maximum.reduceat(worth, start[:-1]))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(df[used]), pa.array(most[used])], names=["term", "df", "most"])

    return run


class Block:
    """The items of one block by their places in the vocabulary, with weights: what every stage needs to know."""

    def __init__(self, items: list, vocabulary: np.ndarray, bundle: int):
        self.vocabulary, self.bundle = vocabulary, bundle
        size = [len(i["terms"]) for i in items]
        self.item = np.repeat(np.arange(len(items)), size)
        self.term = np.searchsorted(vocabulary, np.concatenate([np.array(i["terms"], np.int64) for i in items]).view(np.uint64))
        self.times = np.concatenate([np.array(i["times"], np.int64) for i in items])
        order = np.lexsort((self.item, self.term))
        self.item, self.term, self.times = self.item[order], self.term[order], self.times[order]
        self.at = np.searchsorted(self.term, np.arange(len(vocabulary) + 1))
        self.items = len(items)
        self.floor = np.zeros(len(items), np.int64)

    def weigh(self, df: np.ndarray, most: np.ndarray, docs: int, owners: int) -> None:
        """Weights, owners (rare terms first, about equally many postings each) and what each owner can add at most."""
        self.weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64) * (df > 0)
        by = np.argsort(df, kind="stable")
        before = np.cumsum(df[by]) - df[by]
        self.owner = np.zeros(len(df), np.int64)
        self.owner[by] = np.minimum(owners - 1, before * owners // max(1, int(df.sum())))
        adds = np.zeros((owners + 1, self.items), np.int64)
        np.add.at(adds, (self.owner[self.term], self.item), self.weight[self.term] * self.times * most[self.term])
        self.rest = np.cumsum(adds[::-1], axis=0)[::-1]  # rest[o]: most that the owners from o on can add

    def bundles_of(self, terms: np.ndarray) -> list[np.ndarray]:
        """Per bundle which of the given terms its items have."""
        held = [np.zeros(len(terms), bool) for _ in range(-(-self.items // self.bundle))]
        for k, t in enumerate(terms.tolist()):
            for b in np.unique(self.item[self.at[t]: self.at[t + 1]] // self.bundle).tolist():
                held[b][k] = True
        return held


def _owned(block: Block, owner: int):
    """Slices -> the postings of one owner's terms, a row per bundle that has any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("slice", "ids", "sizes", "term", "start", "doc", "tf"))):
                name, ids, sizes, *parts = row
                term, start, doc, tf = (np.frombuffer(p, t) for p, t in zip(parts, (np.int32, np.int32, np.uint16, np.int32)))
                mine = block.owner[term] == owner
                count = np.diff(start)
                for bundle, held in enumerate(block.bundles_of(term)):
                    held &= mine
                    if held.any():
                        keep = np.repeat(held, count)
                        ends = np.concatenate(([0], np.cumsum(count[held]))).astype(np.int32)
                        blobs = [ids, sizes, *(x.tobytes() for x in (term[held], ends, doc[keep], tf[keep]))]
                        yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.int32()), pa.array([name]), *[pa.array([x], pa.binary()) for x in blobs]], names=["bundle", "slice", "ids", "sizes", "term", "start", "doc", "tf"])

    return run


def _add(block: Block, owner: int, docs: int, words: int):
    """One stage: a bundle's accumulators of one slice and the owner's postings there -> the accumulators after it."""

    def run(carried: pa.Table, met: pa.Table) -> pa.Table:
        name = (met if met.num_rows else carried).slice(0, 1).to_pylist()[0]
        bundle, first = name["bundle"], name["bundle"] * block.bundle
        items = min(block.bundle, block.items - first)
        item, doc, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if carried.num_rows:
            had = carried.slice(0, 1).to_pylist()[0]
            item, doc = (np.frombuffer(had[c], np.uint16).astype(np.int64) for c in ("item", "doc"))
            score = np.frombuffer(had["score"], np.int64)
        if met.num_rows:
            row = met.slice(0, 1).to_pylist()[0]
            sizes = np.frombuffer(row["sizes"], np.int64)
            sums = np.zeros((items, len(sizes)), np.int64)
            sums[item, doc] = score
            start, of, tf = (np.frombuffer(row[c], t) for c, t in (("start", np.int32), ("doc", np.uint16), ("tf", np.int32)))
            worth = impact(tf, sizes[of], docs, words)
            for n, t in enumerate(np.frombuffer(row["term"], np.int32).tolist()):
                where, value = of[start[n]: start[n + 1]], worth[start[n]: start[n + 1]]
                for e in range(block.at[t], block.at[t + 1]):
                    i = block.item[e] - first
                    if 0 <= i < items:
                        sums[i, where] += block.weight[t] * block.times[e] * value
            least = np.maximum(1, block.floor - block.rest[owner + 1])[first: first + items]
            item, doc = np.nonzero(sums >= least[:, None])
            score = sums[item, doc]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (item.astype(np.uint16), doc.astype(np.uint16), score.astype(np.int64))]
        return pa.table([pa.array([bundle], pa.int32()), pa.array([name["slice"]]), *blobs], names=["bundle", "slice", "item", "doc", "score"])

    return run


def _floors(k: int, size: int):
    """Accumulators -> per item the greatest k-th best sum of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            for bundle, item, score in zip(*(batch.column(c).to_pylist() for c in ("bundle", "item", "score"))):
                item, score = np.frombuffer(item, np.uint16), np.frombuffer(score, np.int64)
                order = np.lexsort((-score, item))
                item, score = item[order].astype(np.int64), score[order]
                start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, np.int64)
                full = start[np.diff(np.append(start, len(item))) >= k]
                for i, s in zip((item[full] + bundle * size).tolist(), score[full + k - 1].tolist()):
                    best[i] = max(best.get(i, 0), s)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], names=["item", "floor"])

    return run


def _selected(k: int, size: int):
    """A bundle's last accumulators and the ids of the slice's documents -> the k best of every item."""

    def run(carried: pa.Table, slices: pa.Table) -> pa.Table:
        out = ([], [], [])
        ids = {r["slice"]: np.frombuffer(r["ids"], np.int64) for r in slices.to_pylist()}
        for row in carried.to_pylist():
            item, doc = np.frombuffer(row["item"], np.uint16), np.frombuffer(row["doc"], np.uint16)
            score, name = np.frombuffer(row["score"], np.int64), ids[row["slice"]][doc]
            order = np.lexsort((name, -score, item))
            place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            top = order[place < k]
            for column, values in zip(out, (item[top].astype(np.int64) + row["bundle"] * size, name[top], score[top])):
                column.append(values)
        flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
        return pa.table(flat, names=["item", "doc", "score"])

    return run


def _search(block: Block, texts: DataFrame, k: int, owners: int) -> DataFrame | None:
    """(item place in the block, doc place, score): the k best rows of `texts` for every item, or None without any."""
    postings = stage(texts.mapInArrow(_postings(block.vocabulary), _POSTINGS), "postings")
    docs, words = postings.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    if not docs:
        return None
    known = postings.select("sizes", "term", "start", "doc", "tf").mapInArrow(_statistics(len(block.vocabulary), docs, words), "term long, df long, most long")
    known = known.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).toPandas()
    df, most = np.zeros(len(block.vocabulary), np.int64), np.zeros(len(block.vocabulary), np.int64)
    df[known["term"]], most[known["term"]] = known["df"], known["most"]
    block.weigh(df, most, docs, owners)
    carried = postings.sparkSession.createDataFrame([], _CARRIED)
    for owner in range(owners):
        met = postings.drop("docs", "words").mapInArrow(_owned(block, owner), _MET)
        carried = carried.groupBy("bundle", "slice").cogroup(met.groupBy("bundle", "slice")).applyInArrow(_add(block, owner, docs, words), _CARRIED)
        carried = stage(carried, "accumulators")
        floors = carried.select("bundle", "item", "score").mapInArrow(_floors(k, block.bundle), "item long, floor long").groupBy("item").agg(F.max("floor").alias("floor")).toPandas()
        block.floor[floors["item"]] = np.maximum(block.floor[floors["item"]], floors["floor"])
    return carried.groupBy("slice").cogroup(postings.select("slice", "ids").groupBy("slice")).applyInArrow(_selected(k, block.bundle), "item long, doc long, score long")


def ranked_search(items: DataFrame, docs: DataFrame, k: int = K, owners: int = OWNERS, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank int from 1, doc_id, score long): per item the k best rows of `docs` with a score above 0, all if
    fewer; equal scores by ascending doc_id, null last.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z as a-z. Null and empty texts have
    no terms; an item without terms, or with terms that no document has, gives no row. Equal rows of `items` count
    once, different texts under one id are searched apart; repeated rows of `docs` are documents of their own. Null ids
    are kept. Other columns are not read. An empty table on either side gives an empty table.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    asked = stage(asked.withColumn("row", F.monotonically_increasing_id()), "items")
    bags = stage(asked.select("row", "text").mapInArrow(_terms, "row long, terms array<long>, times array<long>").filter(F.size("terms") > 0), "bags")
    bags = running(bags, [], "row", [Run("before", "sum", F.size("terms").cast("long"), inclusive=False)], levels=2)
    bags = stage(bags.withColumn("block", F.floor(F.col("before") / VOCABULARY)), "blocks")
    # ids travel as they are; a null id by a value that no id of the table has
    ids = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    most = ids.agg(F.max("doc")).first()[0]
    if most == 2**63 - 1:
        raise ValueError("the greatest 64-bit number stands for a null id")
    texts = ids.select(F.monotonically_increasing_id().alias("row"), F.coalesce("doc", F.lit(2**63 - 1)).alias("doc"), "text")
    found = None
    for (number,) in sorted(bags.select("block").distinct().collect()):
        rows = bags.filter(F.col("block") == number).orderBy("row").collect()
        vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64))
        best = _search(Block(rows, vocabulary, BUNDLE), texts, k, owners)
        if best is None:
            break
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(n, r["row"]) for n, r in enumerate(rows)], "item long, row long").join(asked.select("row", "item_id"), "row")
        ranked = stage(ranked, "ranked").join(names, "item")
        ranked = ranked.select("item_id", "rank", F.expr(f"nullif(doc, {2**63 - 1})").alias("doc"), "score")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = spark.createDataFrame([], "item_id long, rank int, doc long, score long")
    return found.select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
