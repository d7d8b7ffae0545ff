"""Operators on keys that hold a large share of all rows, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codelens_spark.operators import graph as G
from codelens_spark.operators import topk as T
from codelens_spark.operators import windows as W
from codelens_spark.operators.retrieval import prune_context
from codelens_spark.plans.budget import skip_greedy
from codelens_spark.plans.scan import ranked_rows
from codelens_spark.plans.stage import stage


def greedy(sizes, room):
    taken = []
    for n, size in enumerate(sizes):
        if max(size or 0, 0) <= room:
            room -= max(size or 0, 0)
            taken.append(n)
    return taken


@pytest.mark.parametrize("fold", [4096, 1])
def test_skip_greedy_equals_a_walk(spark, fold):
    rnd = random.Random(3)
    rooms = {"hot": 500, "a": 7, "b": 0, "c": -1, None: 60}
    sizes = {k: [rnd.choice([None, -2, 0, 1, 2, 3, 60, 200, 249, 251, 400, 500, 501]) for _ in range(900 if k == "hot" else 40)] for k in rooms}
    rows = [(k, n, s, rooms[k]) for k, v in sizes.items() for n, s in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, place long, size long, room long").repartition(3)
    got = sorted((tuple(r) for r in skip_greedy(df, ["k"], "place", "size", "room", fold=fold).select("k", "place").collect()), key=repr)
    want = [(k, n) for k, v in sizes.items() if rooms[k] >= 0 for n in greedy(v, rooms[k])]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("best_first", [True, False])
def test_prune_context_over_many_hits(spark, best_first):
    rnd = random.Random(5)
    hits = [(q, 10 * q, n, "x" * rnd.choice([0, 3, 40, 200, 900, 5000]), float(rnd.randrange(20)), n) for q in range(4) for n in range(400 if q == 0 else 12)]
    hits += [(9, 5000, 0, "over", 1.0, 0), (8, 0, 0, "y" * 9000, 2.0, 0)]
    df = spark.createDataFrame(hits, "query_id long, source_tokens long, vec_id long, text string, score double, rn long")
    got = sorted(tuple(r) for r in prune_context(df, 400, best_first=best_first).select("query_id", "pos", "vec_id", "text", "tokens", "truncated").collect())
    want = []
    for q in {h[0] for h in hits}:
        own = sorted((h for h in hits if h[0] == q), key=lambda h: (-h[4] if best_first else h[4], h[5]))
        room, taken = 300 - own[0][1], []
        for _, _, v, text, _, _ in own if room > 0 else []:
            if len(text) // 4 <= room:
                taken.append((v, text, len(text) // 4, False))
            elif not taken:
                n = len(text)
                while n // 4 > room:
                    n //= 2
                taken.append((v, text[:n], n // 4, True))
            else:
                continue
            room -= taken[-1][2]
        want += [(q, pos, *t) for pos, t in enumerate(taken)]
    assert got == sorted(want)


def test_ranks_inside_a_hot_key(spark):
    rnd = random.Random(1)
    data = [("hot" if n % 3 else str(n % 7), rnd.randrange(50), n) for n in range(3000)] + [(None, 1, 9999)]
    df = spark.createDataFrame(data, "k string, v int, n long").repartition(5)
    got = {r.n: r.place for r in ranked_rows(df, [F.col("v").desc(), "n"], "place", ["k"]).collect()}
    want = {}
    for k in {d[0] for d in data}:
        for place, (_, _, n) in enumerate(sorted((d for d in data if d[0] == k), key=lambda d: (-d[1], d[2])), 1):
            want[n] = place
    assert got == want
    tree = spark.createDataFrame([("src", f"n{n:05d}", n % 2 == 0) for n in range(2000)], "parent string, name string, is_dir boolean")
    ranked = [r.name for r in T.tree_order(tree).orderBy("rank").collect()]
    assert ranked == [f"n{n:05d}" for n in [*range(0, 2000, 2), *range(1, 2000, 2)]]


def test_budget_of_a_key_with_many_free_items(spark):
    rows = [("hot", n, 0 if n % 2 else 3) for n in range(2000)] + [("b", 0, 5), ("b", 1, None), ("b", 2, 1), ("b", 3, -1)]
    df = spark.createDataFrame(rows, "k string, n long, size int").repartition(4)
    got = sorted(tuple(r) for r in W.take_prefix_budget(df, ["k"], [F.col("n")], "size", 9).select("k", "n", "running_size").collect())
    assert got == [("b", 0, 5), ("b", 1, 5), ("b", 2, 6), ("b", 3, 6)] + [("hot", n, 3 * (n // 2 + 1)) for n in range(6)]


def chain(spark, forks, fn="f"):
    """`forks` conditions one after the other: 2**forks paths through few nodes."""
    nodes = [(fn, "in", "ENTRY", None, None), (fn, "out", "EXIT", None, None)]
    edges = [(fn, "in", "c0", "next", 0)]
    for k in range(forks):
        after = f"c{k + 1}" if k + 1 < forks else "out"
        nodes += [(fn, f"c{k}", "CONDITION", None, f"x{k}"), (fn, f"s{k}", "STATEMENT", f"y{k}", None)]
        edges += [(fn, f"c{k}", f"s{k}", "true", 0), (fn, f"c{k}", after, "false", 1), (fn, f"s{k}", after, "next", 0)]
    return nodes, edges


def tables(spark, nodes, edges):
    return spark.createDataFrame(nodes, "fn string, id string, type string, text string, cond string"), spark.createDataFrame(edges, "fn string, src string, dst string, label string, ord int")


@pytest.mark.parametrize("packed, hops", [(4096, 4), (0, 1)])
def test_paths_of_one_hot_function(spark, monkeypatch, packed, hops):
    monkeypatch.setattr(G, "CROWD", 50)
    forks = 9 if packed else 5
    got = G.enumerate_paths(*tables(spark, *chain(spark, forks)), packed=packed, hops=hops).collect()
    want = set()
    for n in range(2**forks):
        bits = [n >> (forks - 1 - k) & 1 for k in range(forks)]
        want.add(("".join(f"{b:04d}" for b in bits), tuple(f"!(x{k})" if b else f"x{k}" for k, b in enumerate(bits)), tuple(f"y{k}" for k, b in enumerate(bits) if not b), None))
    assert {(r.path_id, tuple(r.conds), tuple(r.code), r.error) for r in got} == want and len(got) == 2**forks


@pytest.mark.parametrize("packed", [4096, 0])
def test_malformed_graphs_give_error_rows(spark, packed):
    nodes, edges = chain(spark, 2)
    nodes += [("g", "in", "ENTRY", None, None), ("g", "c", "CONDITION", None, "q"), ("g", "b", "BREAK", "break", None), ("g", "k", "CONTINUE", "continue", None), ("h", "in", "ENTRY", None, None), ("h", "b", "BREAK", "break", None), ("h", "x", "BLOCK", None, None)]
    edges += [("g", "in", "c", "next", 0), ("g", "c", "b", "true", 0), ("g", "c", "k", "false", 1), ("h", "in", "b", "next", 0), ("h", "b", "x", "next", 0)]
    got = {(r.fn, tuple(r.conds), r.error) for r in G.enumerate_paths(*tables(spark, nodes, edges), packed=packed).collect() if r.fn != "f"}
    assert got == {("g", ("q",), "BREAK without EXIT_MERGED"), ("g", ("!(q)",), "CONTINUE without LOOP"), ("h", (), "BREAK without EXIT_MERGED")}


def random_flow(rnd, fn, size):
    kinds = ["CONDITION", "STATEMENT"] * 9 + ["LOOP", "BREAK", "CONTINUE", "RETURN", "EXIT", "BLOCK", "TRY", "TRY_ENDED", "CATCH", "ELSE", "EXIT_MERGED", "MERGED", "FINALLY", "OTHER", None]
    nodes = [(fn, "in", "ENTRY", None, None)]
    nodes += [(fn, f"n{k}", rnd.choice(kinds), rnd.choice([None, "", f"t{k}", f"except E{k}:"]), rnd.choice([None, "", f"q{k}"])) for k in range(size)]
    edges = [(fn, "in", "n0", "next", 0)]
    for k in range(size):
        for _ in range(rnd.randrange(1, 5)):
            to = [f"n{j}" for j in range(k + 1, size)]
            edges.append((fn, f"n{k}", rnd.choice([*to[:3], *to, "gone", None]), rnd.choice(["next", "next", "next", "true", "true", "false", "false", "odd", None]), rnd.choice([0, 1, 2, 12345, None])))
    return nodes, edges


def test_walked_paths_are_those_of_the_rounds(spark, monkeypatch):
    rnd = random.Random(5)
    flows = [random_flow(rnd, f"f{n:03d}", rnd.randrange(3, 12)) for n in range(150)]
    flows.append(([("loop", i, t, f"y{i}", "q") for i, t in (("in", "ENTRY"), ("l", "LOOP"), ("c", "CONDITION"), ("s", "STATEMENT"), ("out", "EXIT"))],
                  [("loop", *e, 0) for e in (("in", "l", "next"), ("l", "c", "next"), ("c", "s", "true"), ("c", "l", "false"), ("s", "l", "next"), ("l", "out", "false"))]))
    flows += [([("two", "in", "ENTRY", None, None), ("two", "a", "STATEMENT", "x", None)] * 2, [("two", "in", "a", "next", 0)]), ([(None, "in", "ENTRY", None, None)], []), chain(spark, 7, "crowd")]
    nodes, edges = tables(spark, [n for f in flows for n in f[0]], [e for f in flows for e in f[1]])
    rounds, left = G._in_rounds, set()

    def watched(n, e, *more):
        left.update(r.fn for r in n.select("fn").distinct().collect())
        return rounds(n, e, *more)

    plain = lambda df: sorted((tuple(r) for r in df.select("fn", "path_id", "conds", "code", "error").collect()), key=repr)
    want = plain(rounds(nodes, edges, 2, "python", 10, 5, 4096))
    monkeypatch.setattr(G, "_in_rounds", watched)
    monkeypatch.setattr(G, "CROWD", 30)
    assert plain(G.enumerate_paths(nodes, edges)) == want
    assert len(want) > 200
    assert {"two", "crowd"} <= left and len(left) < 20  # all others are walked where their rows meet


def test_paths_without_functions(spark):
    assert G.enumerate_paths(*tables(spark, [], [])).collect() == []


@pytest.mark.parametrize("hub", [100_000, 7])
def test_bfs_through_hubs(spark, hub):
    """A star with a thousand rays, reached from many roots, and a ring behind it."""
    edges = [("hub", f"n{i}") for i in range(1000)] + [(f"r{i}", "hub") for i in range(30)] + [(f"n{i}", f"n{(i + 1) % 1000}") for i in range(1000)] + [("hub", "n1"), ("n3", "hub"), ("r0", "r0")]
    roots = [(i, f"r{i}") for i in range(30)] + [(99, "nowhere"), (0, "n5")]
    df, start = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(roots, "root long, node string")
    out = {}
    for d in (df.repartition(5),):
        out = {(r.root, r.node): (r.depth, r.truncated) for r in G.bfs(d, start, 3, hub=hub).collect()}
    want = {}
    for root, first in roots:
        level, seen = {first}, {first}
        for depth in range(4):
            for node in level:
                if depth < want.get((root, node), (9,))[0]:
                    want[(root, node)] = (depth, depth >= 3)
            level = {b for a, b in edges if a in level} - seen
            seen |= level
    assert out == want


@pytest.mark.parametrize("hub", [4, 1000])
def test_bfs_of_many_roots(spark, hub):
    """More roots than share a number, one of them null, that meet in nodes at different depths."""
    rnd = random.Random(12)
    links = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(70)] + [("n1", None), (None, "n2")]
    asks = [(r, f"n{rnd.randrange(40)}") for r in range(150) for _ in range(1 + r % 2)] + [(None, "n1"), (7, None)]
    want = {}
    for root, node in asks:
        level = {node}
        for depth in range(4):
            for n in level:
                want[(root, n)] = min(depth, want.get((root, n), depth))
            level = {d for s, d in links if s in level and s is not None}
    edges, roots = spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame(asks, "root long, node string")
    got = G.bfs(edges, roots, 3, hub=hub).collect()
    assert len(got) == len(want)
    assert {(r.root, r.node): (r.depth, r.truncated) for r in got} == {k: (d, d >= 3) for k, d in want.items()}


def test_bfs_follows_an_edge_once_for_all_roots(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(G, "stage", lambda df, tag: staged.append((tag, s := stage(df, tag))) or s)
    edges = spark.createDataFrame([("a", f"b{i}") for i in range(20)], "src string, dst string")
    assert G.bfs(edges, spark.createDataFrame([(r, "a") for r in range(50)], "root long, node string"), 1).count() == 50 * 21
    assert [df.count() for tag, df in staged if tag == "bfs"] == [1, 20]
