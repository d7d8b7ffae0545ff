"""Classification goldens and text functions on literal values."""

import pytest
from pyspark.sql import functions as F

from codelens_spark.functions import conditions as C
from codelens_spark.functions import rules as R
from codelens_spark.functions import text as X
from codelens_spark.functions.classify import classify_by_table, classify_error, classify_ordered, collection_status, is_unclear, map_stage
from codelens_spark.functions.udfs import token_counter
from codelens_spark.operators import predicates as P
from codelens_spark.operators.aggregates import token_totals

GOLDENS = [
    ("x redeclared in this block", R.REDECLARATION, R.REDECLARATION),
    ('Import "a.b" could not be resolved', R.IMPORT, R.IMPORT),
    ("name could not be resolved", R.OTHER, R.OTHER),
    ("The constructor A() is undefined", R.CONSTRUCTOR, R.CONSTRUCTOR),
    ("Unhandled exception type IOException", R.UNHANDLED, R.UNHANDLED),
    ("something else", R.OTHER, R.OTHER),
    # intended rules restore keywords that the literal lists lose
    ("Foo cannot be resolved to a type", R.IMPORT, R.IMPORT),
    ("Cannot infer type arguments for List<>", R.TYPE, R.OTHER),
    ("Illegal enclosing instance specification", R.MEMBER, R.OTHER),
    ("enum classes must not be local", R.SYNTAX, R.OTHER),
    ("use of package fmt not in selector", R.IMPORT, R.OTHER),
]


@pytest.mark.parametrize("preset,want", [("seven", 1), ("seven_compat", 2)])
def test_classification_goldens(spark, preset, want):
    df = spark.createDataFrame([(g[0],) for g in GOLDENS], "m string")
    got = {r.m: r.category for r in classify_ordered(df, "m", preset).collect()}
    assert got == {g[0]: g[want] for g in GOLDENS}


def test_constructor_first_and_veto(spark):
    texts = {
        "The constructor Import() is undefined": R.CONSTRUCTOR,
        "symbol: is not defined and could not be resolved": R.OTHER,
        "module x could not be resolved": R.IMPORT,
    }
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    assert {r.m: r.category for r in classify_ordered(df, "m", "constructor_first").collect()} == texts


def test_ten_categories_and_unclear(spark):
    texts = {"": R.UNCLEAR, "x: 1": R.UNCLEAR, "a\nb": R.UNCLEAR, "an error": R.OTHER, "undefined: foo in some place": R.RESOLUTION}
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    assert {r.m: r.category for r in classify_ordered(df, "m", "ten").collect()} == texts
    flags = {r.m: r.u for r in df.select("m", is_unclear(F.col("m")).alias("u")).collect()}
    assert flags == {"": True, "x: 1": True, "a\nb": True, "an error": False, "undefined: foo in some place": False}


def test_classify_by_table(spark):
    rules = spark.createDataFrame([(1, "A", "Foo"), (2, "A", "bar"), (3, "B", "o")], "rule_ord int, category string, keyword string")
    df = spark.createDataFrame([("FOO",), ("o bar",), ("so",), ("x",), (None,)], "m string")
    got = {r.m: r.category for r in classify_by_table(df, "m", rules).collect()}
    assert got == {"FOO": "A", "o bar": "A", "so": "B", "x": R.OTHER, None: R.OTHER}


def test_classify_by_a_table_of_100_000_keywords(spark, monkeypatch):
    monkeypatch.setattr("codelens_spark.plans.dictionary.WORDS", 40_000)  # several blocks
    rules = spark.range(100_000).select((100_000 - F.col("id")).alias("rule_ord"), F.concat(F.lit("c"), "id").alias("category"), F.concat(F.lit("Key"), "id", F.lit(";")).alias("keyword"))
    df = spark.createDataFrame([(i, f"a key{i}; and KEY{i // 2}; x") for i in range(0, 100_000, 997)] + [(-1, "nothing")], "n int, m string")
    got = {r.n: r.category for r in classify_by_table(df, "m", rules).collect()}
    assert got == {-1: R.OTHER, **{i: f"c{i}" for i in range(0, 100_000, 997)}}


def test_error_types(spark):
    cases = {
        "AssertionError: 1 != 2": ("Assertion Errors", "AssertionError"), "ModuleNotFoundError: No module named 'x'": ("Import Errors", "ModuleNotFoundError"),
        "ZeroDivisionError": ("Runtime Errors", "ZeroDivisionError"), "boom": ("Unknown Errors", "UnknownError"),
    }
    df = spark.createDataFrame([(c,) for c in cases], "d string")
    assert {r.d: tuple(r.c) for r in df.select("d", classify_error(F.col("d")).alias("c")).collect()} == cases
    got = [r.s for r in df.select(collection_status(F.col("d")).alias("s")).collect()]
    assert got == ["Runtime Errors", "Import Errors", "Runtime Errors", "Unknown Errors"]


def test_stages(spark):
    names = ["buildCFG", "FixWithLLM_3", "gatherContext", "gatherContext-2", None]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r.s for r in df.select(map_stage(F.col("p")).alias("s")).collect()] == ["cfg", "fix", None, "ref", None]


def test_run_paths(spark):
    df = spark.createDataFrame([("a/black/main/codeQA_gpt-4o-mini_2025/final",), ("a/x/gpt-4o/naive/codes",), ("a/black/xgpt-4o/y",)], "p string")
    out = P.classify_run_path(df, "p", ["black"], ["main", "naive"]).collect()
    assert [(r.project, r.model, r.baseline, r.target_type) for r in out] == [
        ("black", "gpt-4o-mini", "main", "final"), (None, "gpt-4o", "naive", "codes"), ("black", None, None, None),
    ]


def test_conditions(spark):
    cases = {
        "!(x > 0)": ("x > 0", 1), "!(!(b))": ("b", 0), "((a) && (b))": ("(a) && (b)", 6), "(a) && (b)": ("(a) && (b)", 6),
        "f(g(x)) >= 1": ("f(g(x)) >= 1", 6), "!" + "(" * 9 + "x" + ")" * 9: ("(" * 8 + "x" + ")" * 8, 16),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string").withColumn("n", C.normalize_condition(F.col("c")))
    got = {r.c: (r.n, r.k) for r in df.select("c", "n", C.complexity(F.col("n")).alias("k")).collect()}
    assert got == cases


def test_json_repair(spark):
    cases = ['{"a": 1}', '```json\n{"a": 1}\n```', '{\\"a\\": 1}', "{'a': 1}", '{"a": {"b": [1]}}']
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r.ok for r in df.select(X.tolerant_json(F.col("t")).isNotNull().alias("ok")).collect()] == [True, True, True, False, True]


def test_report_totals(spark):
    texts = {
        "go": "Files: 4/24 passed (16.67%)\nTotal Statements: 431\nCovered Statements: 94",
        "java": "Total lines 1965\nMissed Lines 1252\nTotal .java files: 44\nFiles with corresponding .class files: 24",
        "python": "TOTAL   7405   3413    54%\nPassRate ((passed files + failed files)/ total files): 201/293",
    }
    want = {"go": (94, 431, 4, 24), "java": (713, 1965, 24, 44), "python": (3992, 7405, 201, 293)}
    for kind, text in texts.items():
        df = spark.createDataFrame([(text,)], "t string")
        assert tuple(df.select(X.report_totals(F.col("t"), kind).alias("r")).first().r) == want[kind]


def test_globs_and_sampling(spark, rows):
    df = spark.createDataFrame([("a/x_test.py",), ("test_y.py",), ("test_d/z.py",), ("xtest.py",)], "p string")
    assert rows(df.filter(P.match_globs(F.col("p"), ["*_test.py", "test_*.py"]))) == [("a/x_test.py",), ("test_y.py",)]
    ids = spark.range(2000).withColumnRenamed("id", "k")
    a = rows(P.sample_by_key(ids.repartition(7), "k", 0.25))
    assert a == rows(P.sample_by_key(ids.coalesce(1), "k", 0.25)) and 400 < len(a) < 600


def test_code_checks(spark):
    long = "x" * 60
    df = spark.createDataFrame([("go", 'func Test import "testing"' + long), ("rust", long), ("C++", "TEST(")], "lang string, code string")
    got = [(r.valid, len(r.warnings)) for r in P.check_code(df, "code", "lang").collect()]
    assert got == [(True, 0), (True, 1), (False, 1)]


def test_token_counter_plugin(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("d",)], "t string")
    count = token_counter(str.split)
    assert token_totals(df, "t", counter=count).first().tokens == 4
    assert token_totals(df, "t", "1234").first().tokens == 4


def test_stub_blocks(spark, rows):
    df = spark.createDataFrame([("a: int\nb: str",), ("a: int\nx = 1\ny = 2",), ("a: int",)], "c string")
    assert rows(P.drop_stub_blocks(df, "c")) == [("a: int",), ("a: int\nx = 1\ny = 2",)]


def test_source_line_kinds(spark):
    df = spark.createDataFrame([("  import os",), ("from a import b",), ("package x;",), ('import "fmt"',), ("x = 1",)], "l string")
    got = df.select(*[X.source_line_kind(F.col("l"), lang).alias(lang) for lang in ("python", "java", "go")]).collect()
    assert [tuple(r) for r in got] == [("import", None, None), ("import", None, None), (None, "package", "package"), (None, None, "import"), (None, None, None)]


def test_a_categorisation_answer_is_parsed_once(spark, tmp_path):
    from codelens_spark.registry import QUERIES

    spark.createDataFrame([(n,) for n in range(8)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    out = QUERIES["x3_categorization"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert [tuple(r) for r in out.orderBy("id").limit(4).collect()] == [(0, "s0", "2", "B", "c"), (1, "s1", "3", "B2", "c2"), (2, None, None, None, None), (3, None, None, None, None)]
