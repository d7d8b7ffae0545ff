"""Ranked lexical search and hard-negative mining against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from codelens_spark.llm import lexical, negatives
from codelens_spark.llm.lexical import ranked_search
from codelens_spark.llm.negatives import Reach, Shard, codebook, hard_negatives

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(items, docs, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    words = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        asked = Counter(terms(text))
        scored = []
        for doc, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n_docs) // max(1, words)
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, c in asked.items() if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -minus) for rank, (minus, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n=300, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(200)] + ["The", "ÜBER", "straße", "a_b", "x-y", "４2"]
    weight = 1 / np.arange(1, len(words) + 1)
    text = lambda size: " ".join(rng.choice(words, size, p=weight / weight.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "... --"), (None, "w1 w2 The"), (5, "w1 w2 The"), (5, "w1 w2 The"), (n + 3, "w1 " * 40_000)]
    items = [(i, text(8)) for i in range(40)] + [(90, None), (91, "unseen"), (3, "w1 w2"), (3, "w1 w2"), (None, "über w7 w7")]
    return items, docs


@pytest.mark.parametrize("bundle, docs_a_slice, vocabulary, owners", [(256, 4096, 200_000, 4), (7, 16, 50, 3), (16, 64, 1, 1)])
def test_ranked_search(spark, documents, monkeypatch, bundle, docs_a_slice, vocabulary, owners):
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    monkeypatch.setattr(lexical, "SLICE_DOCS", docs_a_slice)
    monkeypatch.setattr(lexical, "VOCABULARY", vocabulary)
    items, docs = corpus()
    if vocabulary == 1:  # every item a block of its own
        items = items[-8:]
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    for k in (20, 2):
        out = ranked_search(asked, documents(docs).repartition(3), k=k, owners=owners).collect()
        assert sorted(map(tuple, out), key=repr) == brute_search(items, docs, k)


def test_ranked_search_without_rows(spark, documents):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search(asked, documents([])).collect() == []
    assert ranked_search(asked.limit(0), documents([(1, "a b")])).collect() == []
    assert ranked_search(asked, documents([(1, None)])).collect() == []


SCHEMA = "vec_id long, embedding array<float>, label int, id long, shard int"
NAN, INF = float("nan"), float("inf")


def brute_negatives(rows, width):
    ok = [(i, v, l) for i, v, l in rows if i is not None and l is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    ids = np.array([i for i, _, _ in ok])
    label = np.array([(l + 1) % 10 if i % 7 == 0 else l for i, _, l in ok])
    v = np.floor(256 * np.array([np.asarray(x, np.float32) for _, x, _ in ok], float)).astype(np.int64)
    out, seen = [], set()
    for a in np.flatnonzero(ids % 100 == 0):
        if (ids[a], label[a], v[a].tobytes()) in seen:
            continue
        seen.add((ids[a], label[a], v[a].tobytes()))
        score = v @ v[a]
        ranked = sorted(np.flatnonzero(ids != ids[a]), key=lambda r: (-score[r], ids[r]))
        for p in [r for r in ranked if label[r] == label[a]][:5]:
            hits = [r for r in ranked if label[r] != label[a] and 30 * score[p] <= 100 * score[r] <= 90 * score[p]]
            out += [(int(ids[a]), int(ids[p]), n, int(ids[r]), int(score[p]), int(score[r])) for n, r in enumerate(hits[:10], 1)]
    return sorted(out)


def clustered(n=900, d=9, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.4, size=d)).astype(np.float32).tolist(), int(rng.integers(0, 10)) if i % 3 else 4) for i in range(n)]
    copies = [(2000 + i, rows[100][1], 1) for i in range(80)]  # copies of an anchor under another label
    odd = [(3000, None, 1), (3100, [1.0] * d, None), (3200, [NAN] + [1.0] * (d - 1), 1), (3300, [None] + [1.0] * (d - 1), 1), (3400, [1.0], 1), (3500, [0.0] * d, 2), (None, [1.0] * d, 1), (3600, [INF] * d, 1)]
    return rows + copies + odd + [rows[200], rows[200], rows[201]]


@pytest.mark.parametrize("shard, block, sample, words", [(32_768, 4096, 4096, 16), (60, 3, 40, 5), (1000, 2, 1, 1)])
def test_hard_negatives(spark, monkeypatch, shard, block, sample, words):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    monkeypatch.setattr(negatives, "codebook", lambda half: codebook(half, words))
    rows = clustered()
    table = spark.createDataFrame([(i, v, l, 0, 0) for i, v, l in rows], SCHEMA).repartition(3)
    out = sorted(tuple(r) for r in hard_negatives(table).collect())
    assert out == brute_negatives(rows, 9)
    assert len(out) > 100


def test_hard_negatives_without_rows(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives(spark.createDataFrame([(100, [1.0, 2.0], 3, 0, 0)], SCHEMA)).collect() == []


def test_cells_come_by_falling_bound_and_searches_stop_early(monkeypatch):
    monkeypatch.setattr(negatives, "STEP", 8)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 12)) * 40
    v = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 12)) * 2)
    books = tuple(codebook(h) for h in (v[:, :6], v[:, 6:]))
    shard = Shard(np.arange(3000), rng.integers(0, 3, 3000), v, books)
    q = v[:20]
    (low1, up1), (low2, up2) = (r.bounds(h) for r, h in zip(shard.reaches, (q[:, :6], q[:, 6:])))
    visited = 0
    for k in range(len(q)):
        score = shard.v @ q[k]
        order = list(shard.cells(up1[k], up2[k]))
        assert [b for b, _ in order] == sorted((b for b, _ in order), reverse=True)
        assert sorted(c for _, c in order) == sorted(np.flatnonzero(np.diff(shard.at)))
        for bound, cell in order:
            inside = score[shard.at[cell]: shard.at[cell + 1]]
            assert inside.max() <= bound
            i, j = divmod(cell, shard.wide)
            assert inside.min() >= low1[k][i] + low2[k][j]
        top = int(score.max())
        windows = [(int(0.3 * top), int(0.9 * top), -np.inf), (-np.inf, np.inf, -np.inf)]
        found = shard.search(q[k], up1[k], up2[k], lambda rows: shard.labels[rows] != 1, windows, 10)
        visited += len(shard.scores)
        for (low, most, _), (rows, _) in zip(windows, found):
            fits = [r for r in range(3000) if shard.labels[r] != 1 and low <= score[r] <= most]
            assert rows.tolist() == sorted(fits, key=lambda r: (-score[r], shard.ids[r]))[:10]
    assert visited < 20 * 2000
