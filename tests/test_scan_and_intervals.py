"""Block scans and interval lookups against plain Python on random data, with one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from codelens_spark.operators import joins as J
from codelens_spark.operators import windows as W
from codelens_spark.plans.intervals import stab_all, stab_best
from codelens_spark.plans.scan import Run, number_rows, running
from codelens_spark.plans.skew import attach, first_per_key, limit_per_key


def skewed(n, seed, span=400):
    rnd = random.Random(seed)
    keys = [rnd.choice("aaaabc") for _ in range(n)]
    return [(k, s := rnd.randrange(span), s + rnd.randrange(12), i) for i, k in enumerate(keys)]


def ivals(spark, data):
    return spark.createDataFrame(data, "uri string, s int, e int, ord long").withColumn("name", F.col("ord"))


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("parts", [1, 7])
def test_running_measures(spark, levels, parts):
    rnd = random.Random(5)
    data = [(rnd.choice("aab"), i, rnd.randrange(50)) for i in rnd.sample(range(500), 200)]
    df = spark.createDataFrame(data, "k string, o long, v long").repartition(parts)
    runs = [Run("s", "sum", F.col("v")), Run("sx", "sum", F.col("v"), False), Run("m", "max", F.col("v")), Run("p", "prev", F.col("v")), Run("n", "next", F.col("v"))]
    got = {(r.k, r.o): (r.s, r.sx, r.m, r.p, r.n) for r in running(df, ["k"], "o", runs, block=16, levels=levels).collect()}
    want = {}
    for k in "ab":
        seq = sorted((o, v) for kk, o, v in data if kk == k)
        vals = [v for _, v in seq]
        for i, (o, v) in enumerate(seq):
            want[(k, o)] = (
                sum(vals[: i + 1]), sum(vals[:i]), max(vals[: i + 1]), vals[i - 1] if i else None, vals[i + 1] if i + 1 < len(vals) else None
            )
    assert got == want


def test_running_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 200000, 2), ("x", 5, 3)], "k string, o long, v long")
    got = {(r.k, r.o): r.s for r in running(df, ["k"], "o", [Run("s", "sum", F.col("v"))]).collect()}
    assert got == {(None, 1): 1, (None, 200000): 3, ("x", 5): 3}


def test_number_rows(spark):
    df = spark.createDataFrame([("a", i * 70000) for i in range(5)], "k string, o long")
    assert sorted(r.i for r in number_rows(df, ["k"], "o", "i", levels=2).collect()) == [1, 2, 3, 4, 5]


def test_merge_intervals_golden(spark, rows):
    df = spark.createDataFrame([("f", 1, 5), ("f", 3, 8), ("f", 9, 9), ("f", 12, 14), ("f", 4, 4)], "k string, s int, e int")
    assert rows(W.merge_intervals(df, ["k"]), "start", "end") == [(1, 9), (12, 14)]
    # a contained range goes, touching ones stay apart when only overlaps merge
    assert rows(W.merge_intervals(df, ["k"], gap=0), "start", "end") == [(1, 8), (12, 14), (9, 9)]


def test_merge_contexts(spark, rows):
    data = [("f", 1, 5, 0), ("f", 1, 9, 1), ("f", 10, 12, 2), ("f", 20, 21, 3), ("f", 30, 31, 4)]
    df = ivals(spark, data).withColumn("name", F.element_at(F.array(*[F.lit(n) for n in "aabca"]), F.col("ord").cast("int") + 1))
    got = rows(W.merge_contexts(df), "name", "s", "e", "start", "end")
    # a is kept once, as its longest first range; b touches it and merges
    assert got == [("a", 1, 9, 1, 12), ("b", 10, 12, 1, 12), ("c", 20, 21, 20, 21)]


def test_merged_intervals_are_disjoint(spark):
    merged = W.merge_intervals(ivals(spark, skewed(300, 1)), ["uri"]).collect()
    by_key = {}
    for r in merged:
        by_key.setdefault(r.uri, []).append((r.start, r.end))
    for spans in by_key.values():
        spans.sort()
        assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:]))
    assert sum(r.ranges for r in merged) == 300


def test_drop_contained_and_gaps(spark, rows):
    data = [("f", 1, 10, 1), ("f", 1, 4, 2), ("f", 3, 9, 3), ("f", 8, 12, 4), ("f", 15, 16, 5), ("f", 15, 16, 6)]
    kept = W.drop_contained(ivals(spark, data), ["uri"])
    assert rows(kept, "s", "e", "ord") == [(1, 10, 1), (15, 16, 5), (8, 12, 4)]
    assert rows(W.gap_marks(kept, ["uri"]), "s", "gap") == [(1, False), (15, True), (8, False)]


@pytest.mark.parametrize("parts", [1, 7])
def test_smallest_enclosing_brute_force(spark, parts):
    data = skewed(150, 2)
    df = ivals(spark, data).repartition(parts)
    points = [(k, p) for k in "abc" for p in range(0, 415, 3)]
    got = {(r.uri, r.line): r.name for r in J.smallest_enclosing(spark.createDataFrame(points, "uri string, line int"), df).collect()}
    want = {}
    for k, p in points:
        hits = [(e - s, i) for kk, s, e, i in data if kk == k and s <= p <= e]
        if hits:
            want[(k, p)] = min(hits)[1]
    assert got == want


def test_enclosing_chain_brute_force(spark):
    data = skewed(80, 3)
    points = [(k, p) for k in "abc" for p in range(0, 415, 7)]
    got = sorted((r.uri, r.line, r.ord) for r in J.enclosing_chain(spark.createDataFrame(points, "uri string, line int"), ivals(spark, data)).collect())
    assert got == sorted((k, p, i) for k, p in points for kk, s, e, i in data if kk == k and s <= p <= e)


def test_exclusions_brute_force(spark, rows):
    data, focal = skewed(120, 4), [(k, s, s + 40, i) for k, s, _, i in skewed(6, 9)]
    defs, f = ivals(spark, data), ivals(spark, focal)
    inside = [i for k, s, e, i in data if not any(fk == k and fs < s and e < fe for fk, fs, fe, _ in focal)]
    touch = [i for k, s, e, i in data if not any(fk == k and not (e < fs or s > fe) for fk, fs, fe, _ in focal)]
    assert sorted(r.ord for r in J.exclude_inside(defs, f).collect()) == inside
    assert sorted(r.ord for r in J.exclude_overlap(defs, f).collect()) == touch


def test_next_bound_with_shared_starts(spark, rows):
    data = [("f", 1, 5, 1), ("f", 7, 9, 2), ("f", 7, 8, 3), ("f", 20, 30, 4)]
    assert rows(W.next_bound(ivals(spark, data)), "ord", "bound") == [(1, 7), (2, 7), (3, 20), (4, 30)]


def test_prefix_budget(spark, rows):
    data = [("f", 3, 1), ("f", 4, 2), ("f", 5, 3), ("f", 1, 4), ("g", 20, 5)]
    df = spark.createDataFrame(data, "k string, size int, ord int")
    # stops at the first overflow although a later item would fit
    assert rows(W.take_prefix_budget(df, ["k"], [F.col("ord")], "size", 8), "k", "ord") == [("f", 1), ("f", 2)]
    assert W.take_prefix_budget(df, ["k"], [F.col("ord")], "size", -1).count() == 5


def test_section_scan(spark, rows):
    text = ["x", "= short test summary info", "FAILED a", "ERROR b", "= 1 failed =", "tail", "= short test summary info", "again"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, n int, text string")
    start, end = F.col("text").contains("summary"), F.col("text").startswith("=") & F.col("text").contains("failed")
    assert [r[0] for r in rows(W.section(df, ["file"], start, end, first_only=True), "text")] == ["ERROR b", "FAILED a"]
    assert [r[0] for r in rows(W.section(df, ["file"], start, end), "text")] == ["ERROR b", "FAILED a", "again"]


def test_block_lines(spark, rows):
    text = ["package a", "import (", '  "fmt"', "", "// note", '\t"os"', ")", '"no"', ")"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, n int, text string")
    assert rows(W.block_lines(df, ["file"]), "name") == [("fmt",), ("os",)]


def test_delta_decode(spark, rows):
    deltas = [(0, 4), (0, 3), (2, 1), (0, 5), (1, 0), (0, 2)]
    df = spark.createDataFrame([("d", i, a, b) for i, (a, b) in enumerate(deltas)], "doc string, ord long, d_line int, d_char int")
    out = sorted((r.ord, r.line, r.ch) for r in W.delta_decode(df, "doc", "ord").collect())
    assert out == [(0, 0, 4), (1, 0, 7), (2, 2, 1), (3, 2, 6), (4, 3, 0), (5, 3, 2)]


def test_unique_names(spark, rows):
    df = spark.createDataFrame([("A", 1), ("a", 2), ("b", 3), ("A", 400000)], "name string, ord long")
    assert rows(W.unique_names(df, "name", "ord"), "ord", "unique_name") == [(1, "A"), (2, "a_1"), (3, "b"), (400000, "A_2")]


def test_numbered_names_never_clash(spark):
    names = ["a", "A", "a_1", "a", "a_1", "x_test.go", "X_test.go", "x_test_1.go", "x_test.go", "b_2", "b", "b", "b", "a_1_1"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord long")
    got = [r.unique_name for r in W.unique_names(df, "name", "ord").orderBy("ord").collect()]
    assert got == ["a", "A_2", "a_1", "a_3", "a_1_2", "x_test.go", "X_test_2.go", "x_test_1.go", "x_test_3.go", "b_2", "b", "b_1", "b_3", "a_1_1"]
    assert len({g.lower() for g in got}) == len(got)


def test_budget_with_free_items(spark, rows):
    df = spark.createDataFrame([("k", 1, 0), ("k", 2, 3), ("k", 3, None), ("k", 4, 2), ("k", 5, 0), ("k", 6, 1), ("k", 7, 0)], "key string, ord int, size int")
    got = rows(W.take_prefix_budget(df, ["key"], [F.col("ord")], "size", 5), "ord", "running_size")
    assert got == [(1, 0), (2, 3), (3, 3), (4, 5), (5, 5)]


def test_positions_of_either_sign_and_beyond_32_bits(spark, rows):
    big = 1 << 40
    data = [("f", -10, -2, 1), ("f", -3, 3, 2), ("f", 0, 1 << 35, 3), ("f", big, big, 4), ("f", -big, big, 5)]
    iv = spark.createDataFrame(data, "uri string, s long, e long, ord long").withColumn("name", F.col("ord"))
    points = spark.createDataFrame([("f", p) for p in (-11, -10, -5, -2, -1, 0, 5, big, -big, big + 1)], "uri string, line long")
    assert rows(J.smallest_enclosing(points, iv), "line", "s") == sorted(
        [(-11, -big), (-10, -10), (-5, -10), (-2, -3), (-1, -3), (0, -3), (5, 0), (big, big), (-big, -big)], key=repr
    )
    assert J.enclosing_chain(points, iv).count() == sum(s <= p <= e for p in (-11, -10, -5, -2, -1, 0, 5, big, -big, big + 1) for _, s, e, _ in data)


def test_prune_to_mean(spark):
    df = spark.createDataFrame([("f", f"{i:03d}", i) for i in range(21)] + [("g", "x", 1)], "fn string, path_id string, len int")
    kept = W.prune_to_mean(df).collect()
    assert sorted(r.len for r in kept if r.fn == "f") == [5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
    assert [r.len for r in kept if r.fn == "g"] == [1]


def test_round_delta(spark, rows):
    df = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), ("f", 3, "a")], "file string, round int, message string")
    assert rows(W.round_delta(df), "round", "remaining", "fixed") == [(1, 2, 0), (3, 1, 1)]


def test_running_distinct(spark, rows):
    df = spark.createDataFrame([(0, "A", "x"), (70000, "A", "y"), (140000, "B", "x"), (210000, "A", "x")], "ord long, big string, small string")
    got = rows(W.running_distinct(df), "ord", "big_before", "big_after", "small_before", "small_after")
    assert got == [(0, 0, 1, 0, 1), (140000, 1, 2, 2, 3), (210000, 2, 2, 3, 3), (70000, 1, 1, 1, 2)]


@pytest.mark.parametrize("salts", [1, 8])
def test_attach_is_a_plain_join(spark, rows, salts):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 99), ("z", 1)], "k string, v int")
    right = spark.createDataFrame([("a", 1), (None, 2)], "k string, w int")
    got = rows(attach(left, right, ["k"], salts=salts), "k", "v", "w")
    assert len(got) == 52 and ("z", 1, None) in got and (None, 99, 2) in got
    assert attach(left, right, ["k"], how="inner", salts=salts).count() == 51


def test_first_and_limit_per_key(spark, rows):
    df = spark.createDataFrame([("a", i, -i) for i in range(100)] + [("b", 7, 0)], "k string, o int, v int")
    assert rows(first_per_key(df, ["k"], ["o"])) == [("a", 0, 0), ("b", 7, 0)]
    assert rows(first_per_key(df.select("k"), ["k"], ["k"])) == [("a",), ("b",)]
    top = limit_per_key(df, ["k"], [F.col("v")], 3)
    assert rows(top, "k", "o", "rn") == [("a", 97, 3), ("a", 98, 2), ("a", 99, 1), ("b", 7, 1)]


def _stabbed(spark, data, points, **limit):
    iv = spark.createDataFrame(data, "uri string, s long, e long, ord long").withColumn("name", F.col("ord") % 7)
    asks = spark.createDataFrame(points, "uri string, line long")
    best = stab_best(asks, iv, ["uri"], "line", "s", "e", [F.col("e") - F.col("s")], ["name", "s", "e"], **limit)
    return best, stab_all(asks, iv, ["uri"], "line", "s", "e", **limit)


def test_stabbing_by_sweep_and_by_nodes(spark, rows):
    """Keys of both sides of the limit, stretched positions, ties, nulls and points asked twice, over many Arrow batches."""
    rnd = random.Random(8)
    data = [(k, s * f, e * f, i) for (k, s, e, i) in skewed(250, 6) for f in [rnd.choice([1, 1 << 33])]]
    data += [(None, 0, 9, 900), ("a", None, 9, 901), ("a", 3, None, 902), ("a", 9, 3, 903), ("b", 5, 9, None)]
    points = [(k, p * f) for k in ["a", "b", "c", None] for p in range(0, 415, 5) for f in (1, 1 << 33)] + [("a", 5), ("a", None)]
    valid = [d for d in data if None not in d[:3]]
    pairs = [(k, p, i) for k, p in points if k and p is not None for kk, s, e, i in valid if kk == k and s <= p <= e]
    least = {}
    for k, p in {p for p in points if None not in p}:
        hits = [(e - s, i is not None, i % 7 if i is not None else 0, s, e) for kk, s, e, i in valid if kk == k and s <= p <= e]
        if hits:
            least[(k, p)] = min(hits)[3:]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for limit in (1, 300, 100_000):
            best, every = _stabbed(spark, data, points, crowd=limit)
            assert rows(best, "uri", "line", "s", "e") == sorted(((*k, *v) for k, v in least.items()), key=repr)
            assert rows(every, "uri", "line", "ord") == sorted(pairs, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_stabbing_sends_a_row_once(spark):
    for df in _stabbed(spark, [("a", 0, 9 << 40, 1)], [("a", 1 << 33)]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
