"""Queries for the text and condition functions.

Template queries give every customer one of a few texts built around its key, and check each result
against the value worked out by hand for that template.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import views as V
from ..functions import conditions as C
from ..functions import text as X
from ..functions.classify import action_label
from .core import query


def _templates(name: str, texts: Sequence[str], expected: dict[str, Sequence], make: Callable[[Column], dict[str, Column]], once: Callable[[Column], Column] | None = None) -> None:
    """`{n}` in texts and expected strings stands for the customer key. `make` gets the text, or what `once` makes of it,
    as a column of its own."""

    def cell(values: Sequence, col: str) -> str:
        if all(isinstance(v, str) or v is None for v in values):
            items = ", ".join("null" if v is None else V.sql_str(v) for v in values)
            return f"replace(list_extract([{items}]::varchar[], cast(c_custkey % {len(values)} as int) + 1), '{{n}}', c_custkey::varchar) {col}"
        items = ", ".join("null" if v is None else str(v).lower() for v in values)
        return f"list_extract([{items}], cast(c_custkey % {len(values)} as int) + 1) {col}"

    sql = "select c_custkey id, " + ", ".join(cell(v, k) for k, v in expected.items()) + " from customer"

    @query(name, sql=sql)
    def _(spark, sf):
        body = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("c_custkey") % len(texts)).cast("int"))
        rows = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.replace(body, F.lit("{n}"), F.col("c_custkey").cast("string")).alias("t"))
        if once:
            rows = rows.select("id", once(F.col("t")).alias("t"))
        return rows.select("id", *[c.alias(k) for k, c in make(F.col("t")).items()])


FOOT = '<tfoot><tr><td>Total</td><td class="ctr1">9</td><td class="ctr2">10</td><td class="ctr1">1,{n}</td> <td class="ctr2">2,{n}</td></tr></tfoot>'
_templates(
    "x1_html_footer", ["<table>" + FOOT, "<p>none</p>", "<tfoot><td>1</td></tfoot>"],
    {"missed": ["1{n}", None, None], "total": ["2{n}", None, None]},
    lambda t: {k: X.html_footer_lines(t)[k].cast("string") for k in ("missed", "total")},
)


@query(
    "x1_html_footer_pages",
    sql="select page_id, page_id * 1000 + 999 total, page_id missed from pages",
)
def _(spark, sf):
    n = F.col("page_id")
    foot = F.concat(
        F.lit('<tfoot>\n<td class="ctr1">1</td><td class="ctr2">2</td>\n<td class="ctr1">'), n.cast("string"), F.lit('</td>\n<td class="ctr2"> '),
        (n * 1000 + 999).cast("string"), F.lit("</td></tfoot>"),
    )
    found = X.html_footer_lines(F.concat("html", foot))
    return V.table(spark, sf, "pages").select("page_id", found["total"].alias("total"), found["missed"].alias("missed"))


FENCED = ["a ```py\nx{n} = 1\n``` b ```\n y \n```", "no fence {n}", "t\n```go~~\nz\n```\nmore"]
_templates(
    "x2_fenced_blocks", FENCED,
    {
        "first": ["x{n} = 1", "no fence {n}", "z"], "last": ["y", "no fence {n}", "z"], "head": ["a", "no fence {n}", "t"],
        "blocks": ["py:x{n} = 1|unknown:y", "", ""],
    },
    lambda t: {
        "first": X.first_block(t),
        "last": X.last_block(t), "head": X.before_fence(t),
        "blocks": F.array_join(F.transform(X.fenced_blocks(t), lambda b: F.concat_ws(":", b["language"], b["code"])), "|"),
    },
)

ANSWERS = [
    '```json\n{"root_cause_summary": "s{n}", "categorization_decision": "2", "big_category": "B", "small_category": "c"}\n```',
    '{"rootCauseSummary": "s{n}", "categorizationDecision": "9", "bigCategory": "B2", "smallCategory": "c2", "reasoning": "r"}',
    '{"root_cause_summary": "s{n}", "big_category": ""}',
    "not json {n}",
]
_templates(
    "x3_categorization", ANSWERS,
    {"summary": ["s{n}", "s{n}", None, None], "decision": ["2", "3", None, None], "big": ["B", "B2", None, None], "small": ["c", "c2", None, None]},
    lambda c: {"summary": c["root_cause_summary"], "decision": c["decision"], "big": c["big_category"], "small": c["small_category"]},
    once=X.categorization,
)
_templates(
    "x3_tolerant_json", ['{"a": {n}}', 'x ```json\n{"a": [{n}]}\n```', '{\\"a\\": {n}}', "{'a': {n}}", "[{n}, 2]", '{"k": [1, {n}, 3]}'],
    {"ok": [True, True, True, False, True, True], "items": [0, 1, 0, 0, 2, 3]},
    lambda t: {"ok": X.tolerant_json(t).isNotNull(), "items": F.size(X.json_array(X.tolerant_json(t)))},
)


@query(
    "x4_action_label", "v_cat",
    """select ord, case decision when '1' then 'added_to_existing' when '2' then 'created_small_category' else 'created_big_category' end action from v_cat""",
)
def _(spark, sf):
    return V.v_cat(spark, sf).select("ord", action_label(F.col("decision")).alias("action"))


_templates(
    "x5_cleanup_code", ["Here's the test for {n}:\ncode\r\n\n\n\n\nend \n", "the test code below\nx{n}", "  keep {n}  "],
    {"code": ["code\n\nend", "x{n}", "keep {n}"]},
    lambda t: {"code": X.cleanup_code(t)},
)


@query("x5_cleanup_documents", sql="select doc_id, md5(trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(11) || chr(12) || chr(13))) code from documents")
def _(spark, sf):
    return V.wide_table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5(X.cleanup_code(F.col("text"))).alias("code"))


_templates(
    "x6_strip_comments", ["a // c\nb\n\n  \n", "x /* y\nz */ w # {n}", 'p\n"""doc\nmore"""\nq{n}', "''' a '''r"],
    {"code": ["a b", "x  w ", "p\nq{n}", "r"]},
    lambda t: {"code": X.strip_comments(t)},
)
_templates(
    "x7_normalize_condition",
    ["!(a{n} > 0)", "!(!(b{n}))", "((c{n}))", "(a) && (b{n})", " !(!(!( x{n} ))) ", "(!(d{n}))", "x{n} > 0", "(((((((((((f(x{n}))))))))))))"],
    {"condition": ["a{n} > 0", "b{n}", "c{n}", "(a) && (b{n})", "x{n}", "!(d{n})", "x{n} > 0", "f(x{n})"]},
    lambda t: {"condition": C.normalize_condition(t)},
)


@query(
    "x8_complexity",
    sql="""with c as (select p_partkey, repeat('(', p_size % 4) || p_name || ' >= ' || p_size || case when p_size % 3 = 0 then ' && (x - 1)' else '' end || repeat(')', p_size % 4) c from part)
    select p_partkey, length(c) - length(regexp_replace(c, '[!&|<>=+*/%-]', '', 'g')) + case when contains(c, '&&') then 2 else 0 end
      + 2 * list_max(list_transform(range(0, length(c) + 1), lambda i: 2 * i - 0 + length(replace(substr(c, 1, i), '(', '')) * -1 + length(replace(substr(c, 1, i), ')', '')) - 2 * i)) complexity from c""",
)
def _(spark, sf):
    p = V.table(spark, sf, "part")
    n = F.col("p_size")
    cond = F.concat(
        F.expr("repeat('(', p_size % 4)"), "p_name", F.lit(" >= "), n.cast("string"), F.when(n % 3 == 0, " && (x - 1)").otherwise(""), F.expr("repeat(')', p_size % 4)")
    )
    return p.select("p_partkey", C.complexity(cond).cast("long").alias("complexity"))


_templates(
    "x10_exception_type",
    ["except ValueError{n}:", "except:", "catch (std::Err{n} e)", "catch (...)", "catch(IOEx{n} e)", "recover {n}"],
    {
        "py": ["ValueError{n}", "Exception", "Exception", "Exception", "Exception", "Exception"],
        "cpp": ["Exception", "Exception", "Err{n}", "Exception", "IOEx{n}", "Exception"],
        "go": ["error", "error", "std", "error", "IOEx{n}", "error"],
        "java": ["Exception", "Exception", "std", "Exception", "IOEx{n}", "Exception"],
    },
    lambda t: {"py": X.exception_type(t, F.lit("python")), "cpp": X.exception_type(t, F.lit("cpp")), "go": X.exception_type(t, F.lit("go")), "java": X.exception_type(t, F.lit("java"))},
)


@query("x11_identifiers", sql="select doc_id, len(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) words from documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.size(X.identifiers(F.col("text"))).cast("long").alias("words"))


_templates(
    "x12_names", ["pkg/sub/mod_{n}.py", "pkg/__init__.py", "a_1_b_{n}_test.go", "__init__.py"],
    {
        "stem": ["pkg/sub/mod_{n}", "pkg/__init__", "a_1_b_{n}_test", "__init__"],
        "norm": ["pkg/sub/mod.py", "pkg/__init__.py", "a_b_test.go", "__init__.py"],
        "module": ["pkg.sub.mod_{n}", "pkg", "a_1_b_{n}_test.go", ""],
    },
    lambda t: {"stem": X.file_stem(t), "norm": X.normalized_name(t), "module": X.dotted_module(t)},
)
_templates(
    "x13_output_name", ["(*Command).find{n}", "get<T{n}>(a, b)", "plain{n}", "._x(y)"],
    {
        "name": ["Command_.find{n}", "get_a", "plain{n}", "x_y_"],
        "java": ["com/acme/File_(*Command).find{n}", "com/acme/File_get<T{n}>(a, b)", "com/acme/File_plain{n}", "com/acme/File_._x(y)"],
        "go": ["dir/file_(*Command).find{n}", "dir/file_Get<T{n}>(a, b)", "dir/file_Plain{n}", "dir/file_._x(y)"],
        "other": ["File_(*Command).find{n}_test.py", "File_get<T{n}>(a, b)_test.py", "File_plain{n}_test.py", "File_._x(y)_test.py"],
    },
    lambda t: {
        "name": X.output_name(t),
        "java": X.test_file_core(F.lit("File.java"), t, F.lit("java"), F.lit("package com.acme;"), F.lit(None).cast("string")),
        "go": X.test_file_core(F.lit("file.go"), t, F.lit("go"), F.lit(None).cast("string"), F.lit("dir/file.go")),
        "other": X.test_suffix(X.test_file_core(F.lit("File.py"), t, F.lit("python"), F.lit(None).cast("string"), F.lit(None).cast("string")), F.lit("python"), F.lit("py")),
    },
)

LEGEND = ["declaration", "definition", "readonly", "static", "deprecated", "abstract", "async"]


@query(
    "x14_modifiers",
    sql=f"""select event_id, array_to_string(list_filter([{', '.join(f"case when (k >> {i}) & 1 = 1 then '{n}' end" for i, n in enumerate(LEGEND))}], lambda x: x is not null), ',') modifiers
    from ({V.EVENTS})""",
)
def _(spark, sf):
    return V.events(spark, sf).select("event_id", F.array_join(X.modifiers(F.col("k"), LEGEND), ",").alias("modifiers"))


@query(
    "x15_line_numbers",
    sql="""with a as (select doc_id, text, string_split(text, chr(10)) l from documents)
    select doc_id, md5(array_to_string(list_transform(range(1, len(l) + 1), lambda i: '[L' || (i + 9) || '] ' || l[i]), chr(10))) numbered, md5(text) stripped,
      cast(10 as bigint) first_n, cast(9 + len(l) as bigint) last_n from a""",
)
def _(spark, sf):
    d = V.wide_table(spark, sf, "documents", "doc_id", "text").select("doc_id", X.add_line_numbers(F.col("text"), F.lit(10)).alias("t"))
    t = F.col("t")
    return d.select("doc_id", F.md5("t").alias("numbered"), F.md5(X.strip_line_numbers(t)).alias("stripped"), X.first_line_number(t).alias("first_n"), X.last_line_number(t).alias("last_n"))


@query(
    "x15_line_window",
    sql="""with a as (select doc_id, string_split(text, chr(10)) l from documents), b as (select *, cast(doc_id % len(l) as int) pos from a)
    select doc_id, md5(array_to_string(list_transform(range(greatest(0, pos - 3), least(len(l) - 1, pos + 3) + 1), lambda i: '[L' || (i + 1) || '] ' || trim(l[i + 1], ' ' || chr(9) || chr(13))), chr(10))) context from b""",
)
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    d = d.withColumn("at", (F.col("doc_id") % F.size("l")).cast("int"))
    return d.select("doc_id", F.md5(X.line_window(F.col("l"), F.col("at"))).alias("context"))


@query(
    "x16_log_health",
    sql="""select doc_id, cast(doc_id % 3 as int) panics, case when doc_id % 2 = 0 then 1 else 0 end timeouts, case when doc_id % 5 = 0 then 1 else 0 end build_errors from documents""",
)
def _(spark, sf):
    n = F.col("doc_id")
    log = F.concat(
        F.when(n % 5 == 0, "# pkg/a\nx.go:1: error: bad\n").otherwise("# pkg\nfine\n"), "text", F.expr("repeat('\npanic: x', cast(doc_id % 3 as int))"),
        F.when(n % 2 == 0, "\nTEST Timed Out").otherwise(""),
    )
    h = X.log_health(log)
    return V.table(spark, sf, "documents").select("doc_id", *[h[c].alias(c) for c in ("panics", "timeouts", "build_errors")])


_templates(
    "x17_problem_files",
    ["./pkg/a_test.go: x\n  at b/c{n}_test.go:12", "doc (main.x_test.go)\nnothing", "all fine {n}", "q/z_test_{n}.go failed"],
    {"files": ["./pkg/a_test.go|b/c{n}_test.go", "main.x_test.go", "", "q/z_test_{n}.go"]},
    lambda t: {"files": F.array_join(F.array_sort(X.problem_files(t)), "|")},
)
_templates(
    "x18_imports",
    ['package main\nimport "fmt{n}"\nx', "package a.b;\nimport c.D{n};\nimport e.F;", "import os{n}\nfrom a.b import c\nx = 1", "from p import (\n  a,\n  b{n},\n)\nimport as\nimport inspect # why"],
    {
        "go": ['package main\nimport "fmt{n}"', "package a.b;\nimport c.D{n};", "import os{n}\nimport c", "import (\nimport as"],
        "java": ["", "package a.b;\nimport c.D{n};\nimport e.F;", "", ""],
        "python": ["", "", "import os{n}\nfrom a.b import c", "from p import (\na\nb{n}\n)\nimport inspect"],
    },
    lambda t: {
        "go": X.import_statement(t, "go"),
        "java": X.import_statement(t, "java"),
        "python": X.import_statement(t, "python"),
    },
)
_templates(
    "x19_inferred_exit", ["= {n} failed, 1 passed =", "1 error in 2s", "{n} passed", "nothing"], {"code": [1, 1, 0, 0]}, lambda t: {"code": X.inferred_exit(t)}
)


@query(
    "x20_query_text",
    sql="""select doc_id, md5('Find code related to ' || source || ', to comprehensively test the code, include all relevant code. Below is the source code of the file: ' || chr(10) || text) query from documents""",
)
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(X.retrieval_query(F.col("source"), F.col("text"))).alias("query"))


@query(
    "x20_join_contexts",
    sql="select conv_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn)) context from conversations group by conv_id",
)
def _(spark, sf):
    texts = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]).alias("a"))
    return texts.select("conv_id", F.md5(X.join_contexts(F.col("a"))).alias("context"))


_templates("x21_safe_casts", ["{n}", "", "abc", "1{n}", "1.5x"], {"v": ["{n}", "0", "0", "1{n}", "0"]}, lambda t: {"v": X.number(t).cast("string")})
_templates(
    "x22_test_functions",
    ["func TestA{n}(t *testing.T) {\nfunc BenchmarkB(b *testing.B)", "func ExampleC{n}() {", "func testX(t *testing.T)", "func TestD(t testing.TB)\nfunc TestE(x int)"],
    {"names": ["TestA{n}|BenchmarkB", "ExampleC{n}", "", "TestD"]},
    lambda t: {"names": F.array_join(X.go_test_functions(t), "|")},
)
_templates(
    "x23_verdict_lines",
    ["t{n}.py::TestA::test_ok PASSED [ 50%]", "FAILED t.py::TestA::test_bad{n} - AssertionError: 1 != 2", "ERROR u{n}.py - ModuleNotFoundError: No", "ERROR v.py", "noise"],
    {
        "passed": ["t{n}.py::TestA::test_ok", None, None, None, None],
        "failed": [None, "t.py::TestA::test_bad{n}=AssertionError: 1 != 2", None, None, None],
        "errored": [None, None, "u{n}.py::CollectionError=ModuleNotFoundError: No", "v.py::CollectionError=Collection error", None],
    },
    lambda t: {
        "passed": X.passed_line(t),
        "failed": F.concat(X.failed_line(t)["test"], F.lit("="), X.failed_line(t)["detail"]),
        "errored": F.concat(X.error_line(t)["test"], F.lit("="), X.error_line(t)["detail"]),
    },
)
_templates(
    "x24_frequency_lines", ["Frequency: {n} - some message ", "Frequency: x - y", "other"],
    {"freq": ["{n}", None, None], "message": ["some message", None, None]},
    lambda t: {"freq": X.frequency_line(t)["frequency"].cast("string"), "message": X.frequency_line(t)["message"]},
)
