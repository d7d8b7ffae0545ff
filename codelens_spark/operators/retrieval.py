"""Vector retrieval and context pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import estimated_tokens
from ..plans.budget import skip_greedy
from ..plans.scan import number_rows, ranked_rows
from ..plans.skew import attach, limit_per_key
from ..plans.stage import stage

QUERY_BLOCK = 512
CORPUS_BLOCK = 16_384
OUT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Score matrix (query, vector): squared distance for l2, similarity for cosine and dot."""
    dots = queries @ vectors.T
    if metric == "dot":
        return dots
    q2, v2 = (queries**2).sum(1), (vectors**2).sum(1)
    if metric == "cosine":
        return dots / np.maximum(np.sqrt(q2)[:, None] * np.sqrt(v2)[None, :], 1e-300)
    return np.maximum(q2[:, None] + v2[None, :] - 2 * dots, 0.0)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """The k best vectors of each query, smaller ids first among equals: never more than k rows a query."""
    # scores are compared at 9 places so that rounding noise cannot reorder equal vectors
    scores = np.round(_scores(queries, vectors, metric), 9)
    order = np.argsort(ids, kind="stable")
    ids, worst_first = ids[order], (scores if metric == "l2" else -scores)[:, order]
    m = min(k, len(ids))
    if m < len(ids):
        edge = np.partition(worst_first, m - 1, axis=1)[:, m - 1 : m]
        room = m - (worst_first < edge).sum(axis=1, keepdims=True)
        level = worst_first == edge
        keep = (worst_first < edge) | (level & (np.cumsum(level, axis=1) <= room))
    else:
        keep = np.ones_like(worst_first, bool)
    rows, cols = np.nonzero(keep)
    return pd.DataFrame({"query_id": query_ids[rows], "vec_id": ids[cols], "score": scores[:, order][rows, cols]})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def knn(queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "l2", block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """Exact k nearest corpus vectors of each query: (query_id, vec_id, score, rn).

    queries(query_id, embedding), corpus(vec_id, embedding); rows without a vector match nothing. Both sides
    are cut into blocks of bounded size, and every pair of blocks is one task group that answers with its own
    best k, whatever the number of queries.
    """
    found = _block_knn(queries.filter("embedding is not null"), corpus.filter("embedding is not null"), k, metric, block, corpus_block)
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return limit_per_key(found, ["query_id"], [order, F.col("vec_id").asc()], k)


def _block_knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str, block: int, corpus_block: int) -> DataFrame:
    q_blocks = max(1, -(-queries.count() // block))
    c_blocks = max(1, -(-corpus.count() // corpus_block))

    def side(df: DataFrame, key: str, own: int, other: int, own_name: str, other_name: str) -> DataFrame:
        spread = df.withColumn(own_name, F.pmod(F.xxhash64(key), F.lit(own)).cast("int"))
        return spread.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = side(queries.select("query_id", "embedding"), "query_id", q_blocks, c_blocks, "qb", "cb")
    right = side(corpus.select("vec_id", "embedding"), "vec_id", c_blocks, q_blocks, "cb", "qb")

    def pair(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or vs.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return _best(qs["query_id"].to_numpy(), _matrix(qs["embedding"]), vs["vec_id"].to_numpy(), _matrix(vs["embedding"]), k, metric)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(pair, OUT)


def at_least(hits: DataFrame, threshold: float = 0.0) -> DataFrame:
    return hits.filter(F.col("score") >= threshold)


def centroids(vectors: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group: one mergeable average per dimension."""
    per_dim = vectors.select(by, F.posexplode(vec).alias("d", "x")).groupBy(by, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per_dim.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias(vec))


def prune_context(hits: DataFrame, max_tokens: int, share: float = 0.75, best_first: bool = True) -> DataFrame:
    """Fit each query's hits into its token budget: hits(query_id, source_tokens, vec_id, text, score, rn).

    Greedy in score order, then by rn and vec_id; an item that does not fit is skipped, but while nothing has been taken
    it is halved until it fits. Returns the taken items in order with `pos`. A query may have any number of hits: places
    and choices are made on sizes alone (`plans.budget`), and only the texts that are taken move.
    """
    by = F.col("score") * (-1 if best_first else 1)
    room = F.lit(int(max_tokens * share)) - F.col("source_tokens")
    slim = hits.select("query_id", "rn", "vec_id", "score", F.length("text").alias("len"), estimated_tokens(F.col("text")).cast("long").alias("tokens"), room.cast("long").alias("room"))
    placed = stage(ranked_rows(slim.filter("room > 0 and len is not null"), [by, "rn", "vec_id"], "place", ["query_id"]), "hits")

    # whatever comes first is taken, whole or halved until it fits; what is left is a plain choice of what fits
    halves = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda h: F.floor(F.col("len") / F.pow(F.lit(2), h)).cast("int"))
    halved = F.get(F.filter(halves, lambda n: F.floor(n / 4) <= F.col("room")), F.lit(0))
    cut = F.col("tokens") > F.col("room")
    first = placed.filter("place = 1").withColumns({"cut": cut, "kept": F.when(cut, halved).otherwise(F.col("len"))})
    first = first.withColumn("tokens", F.when(F.col("cut"), F.floor(F.col("kept") / 4)).otherwise(F.col("tokens")).cast("long"))
    left = first.select("query_id", (F.col("room") - F.col("tokens")).alias("room"))
    rest = attach(placed.filter("place > 1").drop("room"), left, ["query_id"], how="inner")
    more = attach(rest, skip_greedy(rest, ["query_id"], "place", "tokens", "room").withColumn("fits", F.lit(True)), ["query_id", "place"], how="inner", salts=1)
    more = more.select("query_id", "place", "rn", "vec_id", "tokens", F.lit(False).alias("cut"), F.col("len").alias("kept"))
    taken = stage(first.select(*more.columns).unionByName(more), "taken")

    texts = hits.join(taken.select("query_id", "rn", "vec_id").distinct(), ["query_id", "rn", "vec_id"], "left_semi").dropDuplicates(["query_id", "rn", "vec_id"])
    joined = number_rows(taken, ["query_id"], "place", "pos", start=0).join(texts.select("query_id", "rn", "vec_id", "text", "score"), ["query_id", "rn", "vec_id"])
    text = F.when(F.col("cut"), F.col("text").substr(F.lit(1), F.col("kept"))).otherwise(F.col("text"))
    return joined.select("query_id", "pos", "vec_id", text.alias("text"), "score", "tokens", F.col("cut").alias("truncated"))


def apply_embedder(docs: DataFrame, text: str, embedder, out: str = "embedding") -> DataFrame:
    """Add vectors with a user's Arrow-batched embedder (a pandas_udf returning array<float>)."""
    return docs.withColumn(out, embedder(F.col(text)))
