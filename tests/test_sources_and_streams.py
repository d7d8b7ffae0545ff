"""Readers and writers on real files, and streaming jobs over several micro-batches."""

import json

import pytest
from pyspark.sql import functions as F

from codelens_spark.operators import aggregates as A
from codelens_spark.sources import corpus, logs, maps, writers
from codelens_spark.streaming import jobs


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
        return p

    return write


def test_process_log_scan(spark, put, tmp_path):
    put("a/f1.json", [
        {"process": "buildCFG", "time": "2"}, {"process": "generateTest", "time": "15000", "llmInfo": {"tokenUsage": 2600, "result": "r", "prompt": "p", "model": "m"}},
        {"process": "FixWithLLM_1", "time": "9000", "llmInfo": {"tokenUsage": 1500}},
    ])
    put("a/b/f2.json", [{"process": "generateTest", "time": "abc", "llmInfo": {"tokenUsage": ""}}, {"time": "5"}])
    put("a/f3.json", "not json")
    put("a/f4.json", {"process": "x"})
    put("a/x_diagnostic_report.json", {"roundHistory": []})
    put("a/other.txt", "[]")
    log = logs.read_process_logs(spark, str(tmp_path / "a"))
    total = A.overall_cost(log).first()
    assert (total.files, total.total_time, total.total_tokens, total.fix_time, total.fix_runs) == (4, 24007, 4100, 9000, 1)
    per = {r.process: r.files for r in A.process_cost(log.filter("process is not null")).collect()}
    assert per == {"buildCFG": 1, "generateTest": 2, "FixWithLLM_1": 1, "Unknown Process": 1}


def test_diag_scan(spark, put, tmp_path, rows):
    put("d/a.json", {"roundHistory": [{"round": 1, "diagnosticMessages": ["m1", "m1"]}, {"round": 2, "diagnosticMessages": ["m2"]}, {"round": 2, "diagnosticMessages": ["m3"]}]})
    put("d/s/B.JSON", [1])
    put("d/c.json", "{broken")
    put("d/e.json", {})
    r = logs.read_diag_rounds(spark, str(tmp_path / "d"))
    assert rows(r, "round", "pos", "message") == [(1, 0, "m1"), (1, 1, "m1"), (2, 0, "m2"), (2, 0, "m3")]
    assert rows(logs.round_sets(r), "round", "message") == [(1, "m1"), (2, "m3")]


def test_map_and_tasks(spark, put, tmp_path, rows):
    put("m.json", {"b_test.py": {"project_name": "p", "file_name": "b.py", "symbol_name": "f"}, "a_test.py": {"file_name": "a.py"}})
    got = rows(logs.read_test_map(spark, str(tmp_path / "m.json")), "ord", "test_name", "project", "file_name", "symbol")
    assert got == [(0, "b_test.py", "p", "b.py", "f"), (1, "a_test.py", None, "a.py", None)]
    put("t.json", [{"symbolName": "intersect", "sourceCode": "x", "importString": "", "lineNum": 18, "relativeDocumentPath": "ci/magefile.go"}])
    assert logs.read_tasks(spark, str(tmp_path / "t.json")).first().lineNum == 18


def test_go_events(spark, put, tmp_path):
    lines = [
        "=" * 80, "=== RUN", '{"Time":"t","Action":"run","Package":"p","Test":"TestSample"}', '{"Time":"t","Action":"output","Package":"p","Test":"TestSample","Output":"hi\\n"}',
        "# p", "x.go:1: error", '{"Time":"t","Action":"pass","Package":"p","Test":"TestSample","Elapsed":0.1}', '{"Time":"t","Action":"pass","Package":"p"}', "FAIL p [build failed]", "",
    ]
    put("g/x_test.go.log", "\n".join(lines))
    ev = logs.read_go_events(spark, str(tmp_path / "g"))
    assert [r.Action for r in ev.collect()] == ["run", "output", "pass"]
    raw = spark.read.text(str(tmp_path / "g"))
    c = logs.jsonl_line_counts(raw, "Time string, Action string", ["Time", "Action"]).first()
    assert (c.valid, c.noise) == (4, 2)


def test_cover_profile(spark, put, tmp_path):
    put("c.out", "mode: atomic\na 1 0\na 1 3\nb 2 0\n\nbad line\nx 1 many\n")
    cov = logs.read_cover_profile(spark, str(tmp_path / "c.out"))
    assert tuple(A.merge_coverage(cov).first()) == (2, 1, 50.0)
    assert {tuple(r) for r in A.dedup_profile(cov).collect()} == {("a", 1, 1), ("b", 1, 0)}


def test_mutation_report(spark):
    text = """mutation_score: 50.0
mutations:
- exception_traceback: null
  module: &id001 !!python/module:pkg.mod
  mutations:
  - lineno: 10
    operator: AOR
  status: killed
- exception_traceback: null
  module: *id001
  mutations:
  - lineno: 12
    operator: ROR
  - lineno: 13
    operator: COI
  status: survived
- exception_traceback: null
  module: !!python/module:pkg.other
  mutations:
  - lineno: 1
    operator: SDL
  status: incompetent"""
    df = spark.createDataFrame([("r", i, line) for i, line in enumerate(text.split("\n"))], "file string, n int, value string")
    got = sorted((r.block, r.module, r.operator, r.lineno, r.status) for r in logs.parse_mutation_report(df).collect())
    # the third entry names its module only after it opened, and an entry opens with the module seen before
    assert got == [(1, "pkg.mod", "AOR", 10, "killed"), (2, "pkg.mod", "ROR", 12, "survived"), (3, "pkg.mod", "SDL", 1, "incompetent")]


def test_corpus(spark, put, tmp_path, rows):
    put("r/a b/x.py", "print(1)")
    put("r/node_modules/y.js", "1")
    put("r/lib/z.h", "int;")
    put("r/readme.md", "t")
    put("r/target.go", "package t")
    got = rows(corpus.read_corpus(spark, str(tmp_path / "r")), "path", "lang", "size")
    assert got == [("a b/x.py", "Python", 8), ("lib/z.h", "C/C++ Header", 4), ("target.go", "Go", 9)]


def test_report_writer(spark, tmp_path):
    tests = spark.createDataFrame(
        [("f", "b", "Passed", None), ("f", "a", "Passed", None), ("f", "c", "Assertion Errors", "AssertionError"), ("g", "d", "Import Errors", "ImportError"), ("g", "e", "Skipped", None)],
        "file string, test string, status string, error_type string",
    )
    out = str(tmp_path / "rep")
    writers.write_report(tests, out)

    def lines(name):
        return [ln for p in sorted((tmp_path / "rep" / "lists" / f"list={name}").glob("part*")) for ln in p.read_text().splitlines()]

    assert lines("passed") == ["a", "b"] and lines("assertion_errors") == ["c"] and lines("errors") == ["d [ImportError]"]
    counts = {(r.file, r.status): r.tests for r in spark.read.json(f"{out}/files").collect()}
    assert counts[("f", "Passed")] == 2 and counts[("g", "Passed")] == 0 and counts[("g", "Error")] == 0
    assert spark.read.json(f"{out}/tests").count() == 5


def test_unified_log(spark, tmp_path):
    execs = spark.createDataFrame([("d/b.py", "l1"), ("a.py", "l2")], "test_file string, log_path string")
    text = spark.createDataFrame([("l1", 0, "x"), ("l1", 1, "y")], "log_path string, n int, line string")
    writers.write_unified_log(execs, text, str(tmp_path / "u"))
    whole = [ln for p in sorted((tmp_path / "u").glob("part*")) for ln in p.read_text().split("\n")[:-1]]
    assert whole == ["===== a.py =====", "(log file missing)", "", "===== b.py =====", "x", "y", ""]


def test_matrix_csv(spark, tmp_path):
    df = spark.createDataFrame([("p", 0, "cli-4o", 0.5, None)], "project string, model_ord int, row_id string, a double, b double")
    writers.write_matrix(df, ["a", "b"], str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("part*"))
    assert text == "project,a,b\ncli-4o,0.500000000,None\n"
    assert tuple(writers.matrix_text(df, ["a", "b"]).first()) == ("cli-4o", "0.500000000", "None")


def test_upsert_map(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long"), spark.createDataFrame([("b", 2)], "k string, v long")
    writers.upsert_map(old, new, "k", str(tmp_path / "o"))
    assert {r.k: r.v for r in spark.read.json(str(tmp_path / "o")).collect()} == {"a": 1, "b": 2}


# ---- streaming: two batches, then a restart that must not count anything twice ----


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path))


def test_action_counts_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    feed(spark, src, [("task_start", 1), ("error_occurred", 3)], "action string, level int")
    jobs.stream_action_counts(jobs.action_log_stream(spark, str(src)), out).awaitTermination()
    feed(spark, src, [("task_start", 1)], "action string, level int")
    jobs.stream_action_counts(jobs.action_log_stream(spark, str(src)), out).awaitTermination()
    assert {r.action: (r.n, r.errors) for r in jobs.read_action_counts(spark, out).collect()} == {"task_start": (2, 0), "error_occurred": (1, 1)}


def test_category_state_stream(spark, tmp_path):
    schema = "ord long, big string, small string"
    src, out = tmp_path / "in", str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(schema).json(str(src))
    feed(spark, src, [(0, "A", "x"), (1, "A", "x"), (2, "B", "x")], schema)
    jobs.stream_category_state(stream(), out).awaitTermination()
    feed(spark, src, [(3, "A", "y"), (4, "B", "x"), (5, "C", "z")], schema)
    jobs.stream_category_state(stream(), out).awaitTermination()
    got = sorted((r.ord, r.total, r.bigs, r.smalls) for r in jobs.read_state(spark, f"{out}/log").collect())
    assert got == [(0, 1, 1, 1), (1, 2, 1, 1), (2, 3, 2, 2), (3, 4, 2, 3), (4, 5, 2, 3), (5, 6, 3, 4)]


def test_progress_stream(spark, tmp_path):
    schema = "task long, ord long, ok boolean"
    src, out = tmp_path / "in", str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(schema).json(str(src))
    feed(spark, src, [(1, 0, True), (1, 1, False), (2, 2, False)], schema)
    jobs.stream_progress(stream(), out).awaitTermination()
    feed(spark, src, [(2, 3, True), (3, 4, True)], schema)
    jobs.stream_progress(stream(), out).awaitTermination()
    assert sorted((r.task, r.ord, r.ok) for r in jobs.read_state(spark, f"{out}/tasks").collect()) == [(1, 0, True), (2, 2, False), (3, 4, True)]


def test_category_state_with_nulls_and_a_hot_category(spark, tmp_path):
    schema = "ord long, big string, small string"
    src, out = tmp_path / "in", str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(schema).json(str(src))
    batches = [[(0, "A", None), (1, None, "x"), (2, "A", None), (3, None, None)], [(4, "A", None), (5, None, "x"), (6, "A", ""), *((7 + i, "A", f"s{i % 40}") for i in range(300))], [(400, "A", "s3"), (401, "B", None)]]
    bigs, smalls, want, total = set(), set(), [], 0
    for rows in batches:  # the query is started anew for each
        feed(spark, src, rows, schema)
        jobs.stream_category_state(stream(), out).awaitTermination()
        for place, big, small in rows:
            total += 1
            bigs.add(big)
            smalls.add((big, small))
            want.append((place, total, len(bigs), len(smalls)))
    got = sorted((r.ord, r.total, r.bigs, r.smalls) for r in jobs.read_state(spark, f"{out}/log").collect())
    assert got == want
    # an epoch writes the categories that changed in it and no others
    changed = jobs.read_state(spark, f"{out}/changes").filter("kind = 1").groupBy("epoch").count().collect()
    assert {r.epoch: r["count"] for r in changed} == {0: 3, 1: 43, 2: 2}
    assert jobs.STORE not in {r.key for r in spark.sql("set").collect()}


def test_progress_state_is_bounded_by_time(spark, tmp_path):
    schema = "task long, ord long, ok boolean"
    src, out = tmp_path / "in", str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(schema).json(str(src))
    sizes = []
    for n in range(3):
        feed(spark, src, [(task, 100 * n + task, True) for task in range(20 * n, 20 * n + 20)], schema)
        query = jobs.stream_progress(stream(), out, keep_ms=1)
        assert query.awaitTermination(120)
        sizes.append(max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]))
    assert jobs.read_state(spark, f"{out}/tasks").count() == 60
    feed(spark, src, [(0, 999, False)], schema)
    assert jobs.stream_progress(stream(), out, keep_ms=1).awaitTermination(120)
    assert jobs.read_state(spark, f"{out}/tasks").filter("task = 0").count() == 2  # forgotten in between
    assert sizes[-1] < 3 * 20 * 2


def test_bucketed_map(spark, tmp_path):
    folder = str(tmp_path / "map")
    table = lambda rows: spark.createDataFrame(rows, "k string, v long")
    assert maps.upsert(table([(f"k{i}", i) for i in range(100)] + [(None, -1)]), "k", folder, buckets=8) == 0
    first = {r.k: r.v for r in maps.read_map(spark, folder).collect()}
    before = maps._latest(spark, folder)
    assert maps.upsert(table([("k3", 300)]), "k", folder) == 1
    after = maps._latest(spark, folder)
    assert len(after) == 8 and len({e["folder"] for e in before} & {e["folder"] for e in after}) == 7  # seven buckets kept
    assert {r.k: r.v for r in maps.read_map(spark, folder).collect()} == first | {"k3": 300}
    assert maps.upsert(table([(None, 7), ("new", 8)]), "k", folder) == 2
    assert {r.k: r.v for r in maps.read_map(spark, folder).collect()} == first | {"k3": 300, None: 7, "new": 8}
    # what a failed upsert leaves behind is not read
    table([("k1", 999)]).write.parquet(f"{folder}/data/lost/bucket=0")
    assert {r.k: r.v for r in maps.read_map(spark, folder).collect()}["k1"] == 1
    empty = str(tmp_path / "empty")
    maps.upsert(table([]), "k", empty)
    assert maps.read_map(spark, empty).count() == 0
    with pytest.raises(ValueError):
        maps.read_map(spark, str(tmp_path / "none"))


def test_many_files_are_read_as_by_spark_but_by_few_opens(spark, tmp_path):
    from codelens_spark.sources.files import read_files

    files = {"a b/x%y é.json": b"1\r\n", "k/z#1.json": b"", "k/_h.json": b"h", "k/.i.json": b"i", "_k/q.json": b"q", "k=1/w+[2].json": b"w", "k/n.txt": b"t", "_p=1/q.json": b"q", "m/J.JsoN": b"\xc3\xa9"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for glob in ("*.json", "*.[jJ][sS][oO][nN]", "*.txt"):
        old = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(str(tmp_path), wholetext=True)
        want = sorted(map(tuple, old.select(F.col("_metadata.file_path"), F.col("value")).collect()))
        got = read_files(spark, [str(tmp_path)], glob)
        assert sorted(map(tuple, got.collect())) == want
    # the files are dealt to tasks; Spark's scan, which opens each at a high price, is not used
    read = logs.read_process_logs(spark, str(tmp_path))
    assert "FileScan" not in read._jdf.queryExecution().executedPlan().toString()
    one = tmp_path / "k" / "n.txt"
    assert [tuple(r) for r in read_files(spark, [str(one)], "*.txt").collect()] == [(f"file:{one}", "t")]
    assert read_files(spark, [str(tmp_path / "a*")], "*.json").count() == 1
