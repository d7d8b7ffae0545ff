"""Code-index joins on small tables."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from codelens_spark.operators import joins as J
from codelens_spark.operators import sets as S


def test_match_normalized_golden(spark):
    mapping = spark.createDataFrame(
        [
            ("command_HasNameOrAliasPrefix_4921_test.go", "command.go", "(*Command).hasNameOrAliasPrefix", 0),
            ("a_f_1_test.py", "x.py", "f", 1), ("a_f_2_test.py", "y.py", "g", 2),
        ],
        "test_name string, file_name string, symbol string, ord int",
    )
    tests = spark.createDataFrame(
        [("d/command_HasNameOrAliasPrefix_6509_test.go", None), ("a_f_77_test.py", "g"), ("a_f_78_test.py", "zzz"), ("none_test.py", None)],
        "test string, method string",
    )
    got = {r.test: r.file_name for r in J.match_normalized(tests, mapping).collect()}
    assert got == {"d/command_HasNameOrAliasPrefix_6509_test.go": "command.go", "a_f_77_test.py": "y.py", "a_f_78_test.py": "x.py", "none_test.py": None}
    # every collected test with a mapping resolves to a source file
    assert J.map_to_source(tests.filter("test <> 'none_test.py'"), mapping).filter("source_stem is null").count() == 0


def test_name_split_goldens(spark):
    names = ["pytree_replace_1523_test.py", "pytree_prev_sibling_5806_test.py", "a_b_run_it_12_test.py", "x_test.py", "q_w_e_r_9_test.py"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    modules = spark.createDataFrame([("pytree.py", 0), ("a", 1), ("a_b.py", 2)], "module string, ord int")
    got = {r.name: (r.module, r.function, r.number) for r in J.longest_prefix_match(df, modules).collect()}
    assert got == {
        "pytree_replace_1523_test.py": ("pytree", "replace", "1523"),
        "pytree_prev_sibling_5806_test.py": ("pytree", "prev_sibling", "5806"),
        "a_b_run_it_12_test.py": ("a_b", "run_it", "12"),
        "q_w_e_r_9_test.py": ("q", "w_e_r", "9"),
    }
    go = spark.createDataFrame([("command_Has_It_4921_test.go",), ("x_1_test.go",)], "n string").select(J.go_test_name(F.col("n")).alias("g")).collect()
    assert tuple(go[0].g) == ("command", "Has_It", "4921") and go[1].g is None


def test_contains_join_brute_force(spark):
    rnd = random.Random(3)
    letters = "abx_"
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 5))) for _ in range(40)} | {"a" * 70})
    texts = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(6)) for _ in range(60)]
    # one very long run of word characters, longer than a piece
    texts += ["".join(rnd.choice("ab") for _ in range(500)), "b" * 63 + "xab_" * 30, "a" * 200, "-- ++"]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    got = sorted((r.word, r.text_id) for r in J.contains_join(w, t).collect())
    assert got == sorted((x, i) for x in words for i, text in enumerate(texts) if x in text)
    keyed_w = spark.createDataFrame([(i % 2, x) for i, x in enumerate(words)], "key int, word string")
    keyed_t = spark.createDataFrame([(i % 2, i, x) for i, x in enumerate(texts)], "key int, text_id int, text string")
    got = sorted((r.word, r.text_id) for r in J.contains_join(keyed_w, keyed_t, keyed=True).collect())
    assert got == sorted((x, i) for k, x in enumerate(words) for i, text in enumerate(texts) if k % 2 == i % 2 and x in text)
    assert J.contains_join(w.filter("false"), t).count() == 0


def test_fuzzy_symbol_match(spark, rows):
    symbols = spark.createDataFrame([("u", 0, "getName"), ("u", 1, "Name"), ("v", 0, "other")], "uri string, ord int, name string")
    wanted = spark.createDataFrame([("u", "NAME"), ("v", "NAME")], "uri string, name string")
    assert rows(J.match_fuzzy(symbols, wanted), "uri", "name") == [("u", "getName")]


def test_same_line_propagation(spark, rows):
    tokens = spark.createDataFrame(
        [("u", 1, 0, "t1", True), ("u", 1, 1, "t2", True), ("u", 1, 2, "t3", True), ("u", 2, 0, "t4", False), ("u", 2, 1, "t5", False)],
        "uri string, line int, ord int, token_id string, assign boolean",
    )
    matched = spark.createDataFrame([("t2", "c1"), ("t2", "c2"), ("t3", "c3"), ("t4", "c4")], "token_id string, condition string")
    got = rows(J.propagate_same_line(tokens, matched), "token_id", "condition")
    assert got == [("t1", "c1"), ("t1", "c2"), ("t2", "c1"), ("t2", "c2"), ("t3", "c3"), ("t4", "c4")]


def test_use_def_expansion(spark, rows):
    tokens = spark.createDataFrame(
        [("u", 1, "1:0", "a", []), ("u", 1, "1:4", "b", []), ("u", 5, "5:0", "c", ["declaration"]), ("u", 6, "6:0", "d", ["x", "declaration"]), ("v", 1, "1:0", "e", ["declaration"])],
        "uri string, line int, id string, word string, modifiers array<string>",
    )
    assert rows(J.expand_use_def(tokens, tokens.filter("word = 'a'")), "word") == [("a",), ("b",), ("c",)]


def test_redefined(spark, rows):
    reach = spark.createDataFrame([("t", "f", "src"), ("t", "g", "src"), ("t", "v", "src"), ("t", "h", "lib")], "test string, name string, uri string")
    src = spark.createDataFrame([("src", "f", 9, 4, 0), ("src", "g", 2, 0, 1)], "uri string, name string, line int, ch int, ord int")
    tst = spark.createDataFrame(
        [("t", "f", "Function", 1, 2, 0), ("t", "f", "Variable", 8, 2, 1), ("t", "v", "Variable", 3, 0, 2), ("t", "h", "Class", 0, 0, 3)],
        "test string, name string, kind string, line int, ch int, ord int",
    )
    got = rows(J.find_redefined(reach, src, tst), "name", "test_loc", "source_loc")
    assert got == [("f", "f@2:2", "src@10:4"), ("h", "h@1:0", None)]


def test_group_by_parent(spark, rows):
    s = spark.createDataFrame([("u", "A", None), ("u", "m", "A"), ("u", "n", "A"), ("v", "B", None)], "uri string, name string, parent string")
    assert rows(J.group_by_parent(s)) == [("u", "A", "m"), ("u", "A", "n"), ("v", "B", None)]


def test_annotate_lines(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a", "b", "c", "d"])], "doc string, n int, text string")
    ranges = spark.createDataFrame([("d", 1, 2, "bad", 0), ("d", 3, 3, "worse", 1)], "doc string, s int, e int, message string, ord int")
    got = [r.text for r in J.annotate_lines(lines, ranges).orderBy("n").collect()]
    assert got == ["a", 'b\nc # Error Group: "bad"', "", 'd # Error Group: "worse"']


def test_contains_any_word(spark):
    words = ["größe", "a.b", "x>0", "abc", "two words", "ß", "\n", "", "öß e", None]
    texts = ["größe a.b x>0 abc", "GRÖßE", "has two words\nhere", "xabcx", "ößx größ e", None]
    w, t = spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    got = {(r.word, r.text_id) for r in J.contains_join(w, t).collect()}
    assert got == {(x, i) for x in words if x for i, y in enumerate(texts) if y and x in y}


def test_import_origin_takes_names_literally(spark):
    cases = [
        ("from axb import f", "a.b", "f", "unknown"), ("from a.b import f", "a.b", "f", "imported"), ("import c++(", "c++(", "f", "imported"), ("def x+(y", "m", "x+(", "reimplemented"),
        ("import m\\Ex", "m\\Ex", "f", "imported"), ("import mm", "m", "f", "unknown"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "text string, module string, function string")
    assert [r.origin for r in J.import_origin(df).collect()] == [c[3] for c in cases]


def test_import_origin(spark):
    cases = [("from m import a, f", "imported", "from m import a, f"), ("import m as x", "imported", "import m"), ("class T:\n  def f(self):", "reimplemented", None), ("import mm", "unknown", None)]
    df = spark.createDataFrame([(c[0], "m", "f") for c in cases], "text string, module string, function string")
    assert [(r.text, r.origin, r.import_line) for r in J.import_origin(df).collect()] == cases


def test_pending(spark, rows):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "test string")
    outputs = spark.createDataFrame([("a", 5, 5), ("b", 5, 0)], "test string, log_size int, junit_size int")
    assert rows(J.pending(tasks, J.finished_outputs(outputs), ["test"])) == [("b",), ("c",)]


def test_reconcile(spark, rows):
    t = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    got = rows(S.reconcile(t("a", "b", "c"), t("b", "c", "x"), t("c", "y")))
    assert got == [("a", True, False, False, False), ("b", False, False, True, False), ("x", False, True, True, False), ("y", False, False, False, True)]


def test_merge_categories(spark, rows):
    extra = spark.createDataFrame([("Logic Error", "off by one"), ("Mine", None), ("Symbol Misusing", "re-declare already declared symbol")], "big string, small string")
    got = rows(S.merge_categories(S.default_categories(spark), extra))
    assert ("Logic Error", None) not in got and ("Logic Error", "off by one") in got and ("Mine", None) in got and len(got) == 7
    m = spark.sql("select map('a', array('x')) l, map('a', array('x', 'y'), 'b', array()) r").select(S.merge_category_maps(F.col("l"), F.col("r")).alias("m")).first().m
    assert m == {"a": ["x", "y"], "b": []}


def test_merge_map(spark, rows):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert rows(S.merge_map(old, new, "k")) == [("a", 1), ("b", 3), ("c", 4)]


def test_only_hits_of_repeated_ids_are_made_distinct(spark):
    words = spark.createDataFrame([("ab",), ("b",), ("ab",), (None,), ("",)], "word string")
    plain = [(2, None), (3, "x"), (4, "ab b")]
    out = J.contains_join(words, spark.createDataFrame(plain, "text_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [("ab", 4), ("b", 4)]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    twice = [*plain, (1, "abab"), (1, "b"), (None, "b"), (None, "bb"), (4, "ab")]
    out = J.contains_join(words, spark.createDataFrame(twice, "text_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=repr) == [("ab", 1), ("ab", 4), ("b", 1), ("b", 4), ("b", None)]


def test_hits_do_not_copy_their_text():
    from codelens_spark.plans.dictionary import _seek

    text = "abc" * 10_000
    taken = []

    class Watched:
        """A batch that notes the columns of which rows are taken."""

        def __init__(self, batch):
            self.batch = batch

        def __getattr__(self, name):
            return getattr(self.batch, name)

        def select(self, names):
            return Watched(self.batch.select(names))

        def take(self, rows):
            taken.append(self.batch.schema.names)
            return self.batch.take(rows)

    batch = pa.RecordBatch.from_arrays([pa.array([text, "b"]), pa.nulls(2, pa.string()), pa.array([1, 2])], names=["text", "__key", "text_id"])
    out = [b.to_pydict() for b in _seek((("a", None), ("b", None)))(iter([Watched(batch)]))]
    assert sorted(zip(out[0]["text_id"], out[0]["word"])) == [(1, "a"), (1, "b"), (2, "b")]
    assert taken == [["__key", "text_id"]]
