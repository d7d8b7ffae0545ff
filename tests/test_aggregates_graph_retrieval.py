"""Aggregations, control-flow paths, reachability and retrieval on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelens_spark.operators import aggregates as A
from codelens_spark.operators import graph as G
from codelens_spark.operators import retrieval as K
from codelens_spark.operators import topk as T


def test_costs(spark):
    log = spark.createDataFrame(
        [
            ("f1", 0, "buildCFG", 2, 0), ("f1", 1, "generateTest", 15000, 2600), ("f1", 2, "FixWithLLM_1", 9000, 1500), ("f1", 3, "fixDiagnostics", 9100, 0),
            ("f2", 0, "generateTest", 0, 0), ("f3", None, None, 0, 0),
        ],
        "file string, seq int, process string, time_ms long, tokens long",
    )
    r = A.overall_cost(log).first()
    assert (r.files, r.total_time, r.total_tokens, r.fix_time, r.fix_tokens, r.fix_runs) == (3, 24002, 4100, 9000, 1500, 1)
    assert abs(r.avg_time - 24002 / 3) < 1e-9
    per = {x.process: (x.files, x.avg_time) for x in A.process_cost(log.filter("process is not null")).collect()}
    assert per["generateTest"] == (2, 7500.0) and per["FixWithLLM_1"] == (1, 9000.0)
    wide = A.stage_pivot(log.withColumn("lang", F.lit("go")), "lang").first()
    assert (wide.gen, wide.cfg, wide.fix, wide.diag) == (7500.0, 2.0, 3000.0, 0.0)


def test_baseline_units(spark):
    log = spark.createDataFrame([("d", "a", "generateTest", 2_000_000), ("d", "b", "other", 1_000_000)], "directory string, file string, process string, time long")
    empty = spark.createDataFrame([("e", "x", 4.0), ("e", "y", None)], "directory string, file string, retrieval_sec double")
    got = {r.category: (r.avg_seconds, r.files) for r in A.baseline_time(log, empty).collect()}
    assert got == {"logged": (6.5, 2), "retrieval": (12.0, 1)}


def test_fixes(spark, rows):
    diag = spark.createDataFrame(
        [("a", 1, "undefined: foo"), ("a", 2, "undefined: foo"), ("a", 1, "foo redeclared in this block"), ("b", 1, "foo redeclared in this block")],
        "file string, round int, message string",
    )
    assert rows(A.fix_sets(diag)) == [("foo redeclared in this block", True, True), ("undefined: foo", False, True)]
    assert rows(A.difficulty(diag)) == [("foo redeclared in this block", 1, "easy"), ("undefined: foo", 2, "moderate")]


def test_final_status_and_build_errors(spark, rows):
    ev = spark.createDataFrame(
        [("T1", 0, "run", None, "f"), ("T1", 1, "output", " x ", "f"), ("T1", 2, "pass", None, "f"), ("T2", 3, "run", "", "f"), ("T2", 4, "fail", "boom", "f"), ("T3", 5, "run", "y", "f")],
        "test string, ord int, action string, output string, file string",
    )
    assert rows(A.final_status(ev)) == [("T1", "pass", 1), ("T2", "fail", 1), ("T3", "run", 1)]
    assert rows(A.failure_details(ev)) == [("T2", 4, "boom")]
    files = spark.createDataFrame([("f", "FAIL"), ("g", "x [build failed]"), ("h", "ok")], "file string, log string")
    assert rows(A.build_errors(files, ev), "code_name") == [("g::BuildError",)]


def test_coverage_and_mutation(spark):
    cov = spark.createDataFrame([("a", 0), ("a", 3), ("b", 0)], "block string, hits long")
    assert tuple(A.merge_coverage(cov).first()) == (2, 1, 50.0)
    mut = spark.createDataFrame(
        [("t1", "m", "m", "AOR", 10, "survived"), ("t2", "m", "m", "AOR", 10, "killed"), ("t1", "m", "m", "ROR", 12, "incompetent"), ("t2", "m", None, "COI", None, "survived")],
        "test string, target string, module string, operator string, lineno int, status string",
    )
    assert tuple(A.mutation_score(mut).first()) == (2, 1, 50.0)
    assert tuple(A.mutation_score(mut.filter("false")).first()) == (0, 0, 0.0)


def test_run_matrix(spark):
    rows = [
        ("commons-cli", "gpt-4o", "main", "final", "1", 0.2, None), ("commons-cli", "gpt-4o", "main", "final", "2", 0.4, None), ("commons-cli", "gpt-4o", "main", "final", "3", 0.9, "x"),
        ("commons-cli", "gpt-4o", "main", "initial", "4", 0.1, None), ("commons-cli", "gpt-4o", "naive", "codes", "5", 0.3, None),
        ("commons-cli", "gpt-4o", "rag", "final", "6", 0.5, "x"), ("commons-cli", "gpt-4o", "rag", "codes", "7", 0.5, None),
    ]
    runs = spark.createDataFrame(rows, "project string, model string, baseline string, target_type string, folder string, coverage double, error string")
    r = A.run_matrix(runs, "coverage", ["naive", "rag", "main", "absent"], "main").first()
    assert r.row_id == "cli-4o" and r.model_ord == 1 and r.naive == 0.3 and abs(r.main - 0.3) < 1e-9
    # final runs that all failed do not fall back to codes
    assert r.rag is None and r.absent is None and r["main-nofix"] == 0.1
    assert A.check_repeats(runs, 3).count() == 4


def test_all_pass(spark, rows):
    f = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", "x", False), ("c", None, None)], "file string, func string, passed boolean")
    assert rows(A.all_pass(f)) == [("a", 2, 2, True), ("b", 1, 0, False), ("c", 0, 0, False)]


def test_size_profile_exact(spark):
    sizes = [random.Random(1).randrange(1000) for _ in range(501)]
    df = spark.createDataFrame([("p", s) for s in sizes], "project string, size int")
    r = A.size_profile(df, "project", "size").first()
    o = sorted(sizes)
    assert (r.n, r.least, r.most, r.p50, r.p25) == (501, o[0], o[-1], o[250], o[125])


def test_minimize_paths_equals_sequential_rule(spark):
    rnd = random.Random(7)
    data = [("f" if i % 3 else "g", f"{i:04d}", [rnd.choice("abcdefgh") for _ in range(rnd.randrange(4))]) for i in range(60)]
    kept = {(r.fn, r.path_id) for r in A.minimize_paths(spark.createDataFrame(data, "fn string, path_id string, conds array<string>")).collect()}
    want = set()
    for fn in "fg":
        seen = set()
        for f, pid, conds in data:
            if f == fn and set(conds) - seen:
                seen |= set(conds)
                want.add((f, pid))
    assert kept == want


def test_merge_terms_and_children(spark, rows):
    terms = spark.createDataFrame([("f", "a", 0, True, False, "z"), ("f", "a", 1, False, True, "z"), ("f", "z", 2, True, True, "z"), ("f", "n", 3, False, False, "z")], "fn string, name string, ord int, need_definition boolean, need_example boolean, focal string")
    assert rows(A.merge_terms(terms), "name", "need_definition", "need_example", "ord") == [("a", True, True, 0)]
    edges = spark.createDataFrame([("p", "x", "u", 0), ("p", "x", "u", 1), ("p", "y", "u", 2)], "parent string, name string, uri string, ord int")
    assert rows(A.compact_children(edges), "label") == [("x ×2",), ("y",)]


# ---- control flow ----


def flow(spark, nodes, edges):
    n = spark.createDataFrame([("f", *x) for x in nodes], "fn string, id string, type string, text string, cond string")
    e = spark.createDataFrame([("f", *x) for x in edges], "fn string, src string, dst string, label string, ord int")
    return n, e


IN, OUT = ("in", "ENTRY", None, None), ("out", "EXIT", None, None)


def stmt(i, text):
    return (i, "STATEMENT", text, None)


def test_if_else_paths(spark):
    nodes = [IN, OUT, ("c", "CONDITION", "if x > 0", "x > 0"), ("bt", "BLOCK", None, None), ("bf", "BLOCK", None, None), stmt("a", "y = 1"), stmt("b", "y = 2"), ("m", "MERGED", None, None), stmt("z", "z = 3")]
    edges = [
        ("in", "c", "next", 0), ("c", "bt", "true", 0), ("c", "bf", "false", 1), ("c", "bt", "next", 2), ("bt", "a", "next", 0), ("bf", "b", "next", 0),
        ("a", "m", "next", 0), ("b", "m", "next", 0), ("m", "z", "next", 0), ("z", "out", "next", 0),
    ]
    got = [(r.conds, r.code) for r in G.enumerate_paths(*flow(spark, nodes, edges)).orderBy("path_id").collect()]
    assert got == [(["x > 0"], ["y = 1", "z = 3"]), (["!(x > 0)"], ["y = 2", "z = 3"])]


def test_straight_return_and_last_statement(spark):
    nodes = [IN, OUT, stmt("a", "x = 1"), ("r", "RETURN", "return x", None)]
    edges = [("in", "a", "next", 0), ("a", "r", "next", 0), ("r", "out", "next", 0)]
    paths = G.enumerate_paths(*flow(spark, nodes, edges))
    r = paths.select(G.render_path(F.col("conds"), F.col("code")).alias("p")).first().p
    assert (r.code, r.path, r.simple) == ("x = 1\nreturn x", "where (\n\t\n)", "")
    assert [x.code for x in G.enumerate_paths(*flow(spark, [IN, stmt("a", "q")], [("in", "a", "next", 0)])).collect()] == [["q"]]
    # a path without segments is not a path
    assert G.enumerate_paths(*flow(spark, [IN, OUT], [("in", "out", "next", 0)])).count() == 0


@pytest.mark.parametrize("hops,contract", [(1, 0), (4, 0), (1, 5), (4, 1)])
def test_loop_is_entered_twice_then_left(spark, hops, contract):
    nodes = [IN, OUT, ("l", "LOOP", "while", None), ("c", "CONDITION", None, "i < n"), ("b", "BLOCK", None, None), stmt("s", "i += 1"), ("x", "EXIT_MERGED", None, None), ("k", "BREAK", "break", None)]
    edges = [
        ("in", "l", "next", 0), ("l", "c", "next", 0), ("l", "x", "false", 1), ("c", "b", "true", 0), ("b", "s", "next", 0), ("s", "l", "next", 0),
        ("c", "k", "false", 1), ("k", "x", "next", 0), ("x", "out", "next", 0),
    ]
    got = [(r.conds, r.code) for r in G.enumerate_paths(*flow(spark, nodes, edges), hops=hops, contract=contract).orderBy("path_id").collect()]
    assert got == [
        (["i < n", "i < n"], ["i += 1", "i += 1"]), (["i < n", "!(i < n)"], ["i += 1"]), (["!(i < n)"], []),
    ]


def test_try_catch_paths(spark):
    nodes = [IN, OUT, ("t", "TRY", None, None), stmt("a", "risky()"), ("e", "TRY_ENDED", None, None), ("c", "CATCH", "except ValueError:", None), stmt("h", "handle()"), ("o", "ELSE", None, None), stmt("k", "ok()"), ("f", "FINALLY", None, None), stmt("z", "end()")]
    edges = [
        ("in", "t", "next", 0), ("t", "a", "next", 0), ("a", "e", "next", 0), ("e", "c", "next", 0), ("e", "o", "next", 1), ("c", "h", "next", 0), ("h", "f", "next", 0),
        ("o", "k", "next", 0), ("k", "f", "next", 0), ("f", "z", "next", 0), ("z", "out", "next", 0),
    ]
    got = [(r.conds, r.code) for r in G.enumerate_paths(*flow(spark, nodes, edges)).orderBy("path_id").collect()]
    assert got == [
        (["throws ValueError"], ["TRY_START", "risky()", "TRY_END", "handle()", "end()"]), (["no_exception"], ["TRY_START", "risky()", "TRY_END", "ok()", "end()"]),
    ]


def test_condition_table(spark):
    paths = spark.createDataFrame(
        [("f", "0000", ["a", "b > 1"], ["s1", "s2"]), ("f", "0001", ["!(b > 1)"], ["s1"]), ("f", "0002", ["a", "(a)"], [])], "fn string, path_id string, conds array<string>, code array<string>"
    )
    got = {r.condition: (r.depth, r.complexity, r.min_path_id) for r in G.condition_table(paths).collect()}
    assert got == {"a": (0, 0, "0002"), "b > 1": (1, 1, "0001")}
    ranked = [r.condition for r in T.rank_conditions(G.condition_table(paths)).orderBy("rank").collect()]
    assert ranked == ["a", "b > 1"]


def test_compat_constraints(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "c array<string>")
    assert [r.k for r in df.select(G.compat_constraints(F.col("c")).alias("k")).collect()] == [["where (", "a", "b\n)"], ["where (", ")"]]


def test_bfs(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f")], "src string, dst string")
    roots = spark.createDataFrame([(1, "a"), (2, "d")], "root int, node string")
    got = rows(G.bfs(edges, roots, 2), "root", "node", "depth", "truncated")
    assert got == [(1, "a", 0, False), (1, "b", 1, False), (1, "c", 1, False), (1, "d", 2, True), (2, "a", 1, False), (2, "b", 2, True), (2, "c", 2, True), (2, "d", 0, False), (2, "e", 1, False), (2, "f", 2, True)]


def test_flatten_edges_keeps_what_no_root_reaches(spark, rows):
    edges = spark.createDataFrame([(None, "r"), ("r", "a"), ("a", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("gone", "z")], "parent string, node string")
    assert rows(G.flatten_edges(edges), "node", "parent", "depth") == sorted(
        [("r", None, 0), ("a", "r", 1), ("b", "a", 2), ("a", "b", 3), ("y", "x", None), ("x", "y", None), ("z", "gone", None)], key=repr
    )
    deep = spark.createDataFrame([(str(i - 1) if i else None, str(i)) for i in range(6)], "parent string, node string")
    assert rows(G.flatten_edges(deep), "depth") == [(i,) for i in range(6)]


def test_line_feeds_are_white_space(spark, rows):
    ev = spark.createDataFrame([("T", 0, "output", "=== RUN T\n"), ("T", 1, "output", "\n"), ("T", 2, "fail", None)], "test string, ord int, action string, output string")
    assert rows(A.final_status(ev)) == [("T", "fail", 1)] and rows(A.failure_details(ev)) == [("T", 0, "=== RUN T")]
    freq = spark.createDataFrame([("\n", 3), ("x redeclared in this block", 2)], "message string, frequency long")
    assert rows(A.category_totals(freq), "messages", "occurrences") == [(1, 2)]


def test_numbers_as_ordered_text(spark):
    got = [r.t for r in spark.range(0, 200_000, 997).select(F.expr(G.ordered_number("id")).alias("t")).collect()]
    assert got == sorted(got)


def test_hierarchy(spark, rows):
    p = spark.createDataFrame([("src/a/x.py",), ("src/a/y.py",), ("src/z.py",)], "path string")
    h = G.path_hierarchy(p, focal="src/z.py")
    assert rows(h, "parent", "name", "is_dir", "focal") == [("", "src", True, False), ("src", "a", True, False), ("src", "z.py", False, True), ("src/a", "x.py", False, False), ("src/a", "y.py", False, False)]
    assert rows(G.hierarchy_counts(p)) == [("", 3), ("src", 3), ("src/a", 2)]
    assert [r.name for r in T.tree_order(h).orderBy("parent", "rank").collect()] == ["src", "a", "z.py", "x.py", "y.py"]


# ---- retrieval ----


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("block", [1000, 7])
def test_knn_brute_force(spark, metric, block):
    rng = np.random.default_rng(0)
    c, q = rng.normal(size=(120, 8)).astype("float32"), rng.normal(size=(20, 8)).astype("float32")
    c[50] = c[51] = c[52] = c[53]  # ties are broken by id
    q[0] = c[50]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)] + [(999, None)], "vec_id long, embedding array<float>")
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    got = {(r.query_id, r.rn): r.vec_id for r in K.knn(asks, corpus, 3, metric, block=block, corpus_block=40).collect()}
    c, q = c.astype("float64"), q.astype("float64")
    for i in range(20):
        if metric == "l2":
            s = ((c - q[i]) ** 2).sum(1)
        else:
            s = -(c @ q[i]) / (1 if metric == "dot" else np.linalg.norm(c, axis=1) * np.linalg.norm(q[i]))
        order = sorted(range(120), key=lambda j: (round(s[j], 9), j))[:3]
        assert [got[(i, n)] for n in (1, 2, 3)] == order


def sequential_prune(items, budget):
    out, used = [], 0
    if budget <= 0:
        return out
    for vec, text in items:
        tokens = len(text) // 4
        if used + tokens > budget:
            if not out:
                while used + tokens > budget and text:
                    text = text[: len(text) // 2]
                    tokens = len(text) // 4
                if text:
                    out.append((vec, text, True))
                    used += tokens
            continue
        out.append((vec, text, False))
        used += tokens
    return out


def test_prune_context_equals_sequential_rule(spark):
    rnd = random.Random(2)
    hits, want = [], {}
    for q in range(40):
        source = rnd.choice([0, 10, 70, 80])
        items = [(q * 10 + i, "x" * rnd.randrange(1, 500)) for i in range(4)]
        hits += [(q, source, v, t, float(10 - i), i + 1) for i, (v, t) in enumerate(items)]
        want[q] = sequential_prune(items, 75 - source)
    df = spark.createDataFrame(hits, "query_id long, source_tokens int, vec_id long, text string, score double, rn int")
    got = {q: [] for q in want}
    for r in K.prune_context(df, 100).orderBy("query_id", "pos").collect():
        got[r.query_id].append((r.vec_id, r.text, r.truncated))
    assert got == want


def test_embedder_plugin(spark):
    from codelens_spark.functions.udfs import embedder

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    out = K.apply_embedder(df, "t", embedder(lambda texts: [[float(len(t))] for t in texts])).collect()
    assert [r.embedding for r in out] == [[2.0], [0.0]]
