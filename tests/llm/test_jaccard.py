"""N-gram Jaccard join against brute force, and its odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from codelens_spark.llm import jaccard
from codelens_spark.llm.components import components
from codelens_spark.llm.jaccard import ngram_jaccard_join
from codelens_spark.llm.words import shingle_sets, word_hashes


def words_of(text):
    out, word = [], bytearray()
    for b in (text or "").encode():
        if b == 0x20 or 0x09 <= b <= 0x0D:
            if word:
                out.append(bytes(word))
            word = bytearray()
        else:
            word.append(b + 32 if 65 <= b <= 90 else b)
    return out + [bytes(word)] if word else out


def set_of(text):
    w = words_of(text)
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, set_of(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1:]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(max(1, int(len(copy) * rng.choice([0.0, 0.005, 0.01, 0.02, 0.04])))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("\n".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
        texts.append(passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([4, 20, 80]))))
    base = [rng.choice(words) for _ in range(150)]  # one large group around the threshold
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [2048, 8])
def test_against_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus()
    assert got(ngram_jaccard_join(documents(rows).repartition(7))) == brute(rows)


def test_a_pair_beside_refuted_ones_is_not_lost(spark, documents):
    """Texts of 104 common words and tails of their own: 1-2 and 1-3 fall short of the threshold, 2-3 reaches it exactly."""
    common = [f"c{i}" for i in range(104)]
    rng = random.Random(11)
    rows = []
    for t in range(400):
        tails = [[f"t{rng.random()}" for _ in range(n)] for n in (14, 12, 13)]
        rows += [(10 * t + i, " ".join([f"{t}{c}" for c in common] + tail)) for i, tail in enumerate(tails, 1)]
    expected = []
    for t in range(400):
        expected += brute(rows[3 * t: 3 * t + 3])
    assert got(ngram_jaccard_join(documents(rows))) == expected
    assert sum(c != i for i, _, c in expected) == 400


def near(rng, base, change):
    copy = list(base)
    for _ in range(change):
        copy[rng.randrange(len(copy))] = f"n{rng.random()}"
    return copy


def test_many_triples_near_the_threshold(spark, documents):
    rng = random.Random(5)
    rows = []
    for t in range(700):
        base = [f"b{t}x{i}" for i in range(rng.choice([30, 60, 110, 200]))]
        cut = int(len(base) * 0.11)
        rows += [(3 * t + k, " ".join(base + [f"e{rng.random()}" for _ in range(cut + rng.randrange(-2, 4))])) for k in range(2)]
        rows.append((3 * t + 2, " ".join(near(rng, base, max(1, int(len(base) * rng.choice([0.01, 0.02, 0.03])))))))
    expected = []
    for t in range(700):
        expected += brute(rows[3 * t: 3 * t + 3])
    assert got(ngram_jaccard_join(documents(rows))) == expected


def test_every_passing_pair_of_a_batch_comes_out(monkeypatch):
    """The comparison of groups against a plain loop, for small, large and crossed groups and every number of rounds."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) > rng.choice([0.02, 0.1])], rng.integers(0, 2**63, int(rng.integers(0, 30)), dtype=np.uint64)))) for _ in range(60)]
    sets += [base[:5], base[: int(rng.integers(10, 20))]]
    n = np.array([len(x) for x in sets], np.int64)
    width = jaccard._width(n)
    bits = np.split(jaccard._cells(sets, n), np.cumsum(width)[:-1])
    component = rng.integers(0, 40, len(sets))
    rows = [(1, 0, 0, 0, d) for d in range(40)] + [(2, 0, 1, d % 2, d) for d in range(len(sets))] + [(3, 0, 0, 0, d) for d in (3, 50, 61)] + [(4, 0, 1, 1, 5), (4, 0, 1, 1, 6)]
    schema = ["key", "i", "j", "block", "doc", "component", "n", "bits"]
    table = pa.table([*[pa.array([r[c] for r in rows]) for c in range(5)], pa.array([int(component[r[4]]) for r in rows]), pa.array([int(n[r[4]]) for r in rows]), pa.array([bits[r[4]].tobytes() for r in rows])], names=schema)
    want = set()
    for key, i, j, block, x in rows:
        for key2, i2, j2, block2, y in rows:
            if (key, i, j) == (key2, i2, j2) and x < y and component[x] != component[y] and (i == j or block != block2) and 5 * min(n[x], n[y]) >= 4 * max(n[x], n[y]):
                w = min(width[x], width[y])
                fold = [np.bitwise_xor.reduce(bits[d].reshape(-1, w), axis=0) for d in (x, y)]
                if 9 * int(np.bitwise_count(fold[0] ^ fold[1]).sum()) <= n[x] + n[y]:
                    want.add((x, y))
    assert len(want) > 50
    for batch in (3, 200):
        out = pa.Table.from_batches(list(jaccard._compare(10**6)(iter(table.to_batches(max_chunksize=batch)))))
        assert {(r["a"], r["b"]) for r in out.to_pylist()} == want
        few = pa.Table.from_batches(list(jaccard._compare(1)(iter(table.to_batches(max_chunksize=batch))))).to_pylist()
        assert {"a": None, "b": None} in few and {(r["a"], r["b"]) for r in few if r["a"] is not None} <= want


def sketched(sets):
    """(doc, n, bits) of each set, numbered from 0."""
    n = np.array([len(x) for x in sets], np.int64)
    bits = np.split(jaccard._cells(sets, n), np.cumsum(jaccard._width(n))[:-1])
    return [(i, int(n[i]), bits[i].tobytes()) for i in range(len(sets))]


def test_every_pair_left_out_has_a_key_that_is_named():
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    facts = sketched([np.delete(base, i) for i in range(12)] + [np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))])
    groups = {5: range(8), 6: range(6, 12), 7: [0, 12], 8: [2, 3], 9: [11, 12]}
    rows = [{"key": k, "i": 0, "j": 0, "block": 0, "doc": d, "component": d, "n": facts[d][1], "bits": facts[d][2]} for k, docs in groups.items() for d in docs]
    out = pa.Table.from_batches(list(jaccard._compare(1)(iter(pa.Table.from_pylist(rows).to_batches(max_chunksize=4))))).to_pylist()
    kept = {(r["a"], r["b"]) for r in out if r["a"] is not None}
    named = {r["b"] for r in out if r["a"] is None} - {None}
    near = {(x, y): {k for k, docs in groups.items() if x in docs and y in docs} for x in range(12) for y in range(x + 1, 12)}
    assert kept and all(keys & named for pair, keys in near.items() if keys and pair not in kept)
    assert named <= {5, 6, 8}


def test_keys_with_the_same_members_are_compared_once(spark):
    rng = np.random.default_rng(8)
    facts = spark.createDataFrame(sketched([np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(6)]), "doc long, n long, bits binary")
    groups = {40: [0, 1, 2], 41: [2, 1, 0], 42: [0, 1], 43: [0, 1, 3], 44: [0, 1, 4], 45: [4, 5]}
    members = spark.createDataFrame([(k, d) for k, docs in groups.items() for d in docs], "key long, doc long")
    joined = spark.createDataFrame([(4, 4, None), (5, 4, None), (3, 2, 2)], "doc long, component long, same long")
    _, live = jaccard._apart(members, joined, facts, 1)
    assert sorted(tuple(r) for r in live.collect()) == [(40, 0), (40, 1), (40, 2), (42, 0), (42, 1), (44, 0), (44, 1), (44, 4)]


def test_pairs_with_a_key_are_verified_only_if_their_sketches_allow(spark, documents, monkeypatch):
    """Texts with a passage in common share keys, but are too far apart by their sketches."""
    verified, seen = jaccard._verified, []
    monkeypatch.setattr(jaccard, "_verified", lambda texts, pairs: (seen.append(pairs.count()), verified(texts, pairs))[1])
    passage = " ".join(f"p{i}" for i in range(104))
    rows = [(t, passage + " " + " ".join(f"o{t}x{i}" for i in range(20))) for t in range(40)]
    rows += [(100, rows[7][1] + " more")]
    assert got(ngram_jaccard_join(documents(rows))) == brute(rows)
    assert 1 <= sum(seen) < 10


def test_odd_rows(spark, documents):
    long = " ".join(f"x{i % 7919}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " y"), (9, "Größe ÄÖ a b c"), (10, "GRößE ÄÖ a b c"), (11, "größe äö a b c")]
    assert got(ngram_jaccard_join(documents(rows))) == brute(rows)
    extra = [*rows, (4, "one two"), (None, "one two")]
    out = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(documents(extra)).collect()]
    assert out.count((4, 1, 4)) == 2 and (None, 1, None) in out and len(out) == len(extra)
    assert ngram_jaccard_join(documents([])).collect() == []


def test_words_do_not_depend_on_pieces(monkeypatch):
    texts = pa.array(["a b  c" * 50, None, "", "é\tB" * 70, "x" * 500 + " y"])
    whole = [w.tolist() for w in word_hashes(texts)]
    monkeypatch.setattr("codelens_spark.llm.words.PIECE", 64)
    assert [w.tolist() for w in word_hashes(texts)] == whole
    assert [len(w) for w in whole] == [len(words_of(t)) for t in texts.to_pylist()]


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 63, 64, 100, 127, 128, 500]:
        for _ in range(5):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            gone = int(len(a) * rng.uniform(0, 0.2))
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 2**63, int(len(a) * rng.uniform(0, 0.1)), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                key, who = jaccard._keys([a, b], np.sort(a[::3]))
                assert np.intersect1d(key[who == 0], key[who == 1]).size


def test_components_of_chains_and_loops(spark):
    links = spark.createDataFrame([*[(i, i + 1) for i in range(1, 60)], (100, 99), (99, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 99: 99, 100: 99}
    assert components(links.limit(0)).collect() == []


def test_shingle_sets_count(documents):
    texts = ["a b c d e", "a b c d e a b c d e a b c d e", "a"]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(set_of(t)) for t in texts]
