"""Queries for readers and writers. File-based ones first have Spark write the derived files to the scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import aggregates as A
from ..plans.stage import new_path, stage
from ..sources import corpus, logs, writers
from .core import query


@query(
    "s1_process_logs",
    sql="""select process, count(*) entries, cast(sum(n) as bigint) time_ms, cast(sum(k) as bigint) tokens from (
      select case when i % 3 = 0 then 'generateTest' else 'FixWithLLM_' || i end process, length(l) n, case when length(l) % 4 = 0 then 0 else length(l) % 100 end k
      from (select unnest(a) l, unnest(range(len(a))) i from (select string_split(text, chr(10)) a from documents where doc_id % 10 <> 7))) group by process
    union all select null, count(*), 0, 0 from documents where doc_id % 10 = 7""",
)
def _(spark, sf):
    # one log text per document: its lines become the entries, every tenth text is not a list
    entry = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.struct(
            F.when(i % 3 == 0, "generateTest").otherwise(F.concat(F.lit("FixWithLLM_"), i.cast("string"))).alias("process"),
            F.length(l).cast("string").alias("time"),
            F.struct(F.when(F.length(l) % 4 == 0, "").otherwise((F.length(l) % 100).cast("string")).alias("tokenUsage")).alias("llmInfo"),
        ),
    )
    docs = V.wide_table(spark, sf, "documents", "doc_id", "text")
    files = docs.select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 10 == 7, '{"a": 1}').otherwise(F.to_json(entry)).alias("content"))
    parsed = logs.parse_process_logs(files)
    return parsed.groupBy("process").agg(F.count("*").alias("entries"), F.sum("time_ms").alias("time_ms"), F.sum("tokens").alias("tokens"))


@query(
    "s2_diag_rounds",
    sql="""select doc_id file, cast(unnest(range(len(a))) + 1 as int) round, md5(unnest(a)) message from (select doc_id, string_split(text, chr(10)) a from documents where doc_id % 10 <> 7)""",
)
def _(spark, sf):
    rounds = F.transform(F.split("text", "\n"), lambda l, i: F.struct((i + 1).alias("round"), F.array(l).alias("diagnosticMessages")))
    docs = V.table(spark, sf, "documents")
    content = F.when(F.col("doc_id") % 10 == 7, "[1]").otherwise(F.to_json(F.struct(rounds.alias("roundHistory"))))
    out = logs.parse_diag_rounds(docs.select(F.col("doc_id").alias("file"), content.alias("content")))
    return out.select("file", "round", F.md5("message").alias("message"))


@query(
    "s3_corpus",
    sql="""with f as (select doc_id, case doc_id % 5 when 0 then 'src/a' || doc_id || '.py' when 1 then 'node_modules/x/b.js' when 2 then 'lib/c.go' when 3 then 'docs/d.txt' else 'x/build.d/e.h' end path, text from documents)
    select path, case when path like '%.py' then 'Python' when path like '%.go' then 'Go' else 'C/C++ Header' end lang, count(*) files, cast(sum(length(text)) as bigint) chars
    from f where path not like 'node_modules/%' and path not like '%.txt' group by 1, 2""",
)
def _(spark, sf):
    n = F.col("doc_id") % 5
    path = (
        F.when(n == 0, F.concat(F.lit("src/a"), F.col("doc_id").cast("string"), F.lit(".py"))).when(n == 1, "node_modules/x/b.js").when(n == 2, "lib/c.go")
        .when(n == 3, "docs/d.txt").otherwise("x/build.d/e.h")
    )
    docs = corpus.classify_files(V.table(spark, sf, "documents").select(path.alias("path"), F.col("text").alias("content")))
    return docs.groupBy("path", "lang").agg(F.count("*").alias("files"), F.sum("size").alias("chars"))


@query(
    "s4_map_json",
    sql="""select item_id file, cast(unnest(range(len(a))) as int) ord, 't' || unnest(range(len(a))) key, 'p' || item_id project_name, unnest(a) file_name from (select item_id, string_split(text, chr(10)) a from benchmark)""",
)
def _(spark, sf):
    entries = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.struct(F.concat(F.lit("t"), i.cast("string")), F.struct(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("project_name"), l.alias("file_name"))),
    )
    files = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("file"), F.to_json(F.map_from_entries(entries)).alias("content"))
    return logs.parse_map_json(files).select("file", "ord", "key", "project_name", "file_name")


def _noisy(spark, sf):
    """Event attributes with headers, verdict lines and broken JSON mixed in."""
    n = F.col("event_id") % 11
    line = F.when(n == 3, "=== RUN x").when(n == 4, "--- FAIL: y").when(n == 5, "broken {").when(n == 6, '{"z": 1}').otherwise(F.col("props"))
    return V.table(spark, sf, "events").select("event_id", line.alias("value"))


@query("s5_jsonl_tolerant", sql=f"select event_id, k from ({V.EVENTS}) where event_id % 11 not in (3, 4, 5, 6)")
def _(spark, sf):
    return logs.read_jsonl_tolerant(_noisy(spark, sf), "k bigint", ["k"]).select("event_id", "k")


@query("s5_jsonl_counts", sql="select count_if(event_id % 11 not in (3, 4, 5, 6)) valid, count_if(event_id % 11 = 5) noise from events")
def _(spark, sf):
    return logs.jsonl_line_counts(_noisy(spark, sf), "k bigint", ["k"])


@query(
    "s6_cover_profile", "v_cov",
    """with b as (select block, max(hits) > 0 covered from v_cov group by block)
    select count(*) total, count_if(covered) covered, round(count_if(covered) * 100 / count(*), 2) percent from b""",
)
def _(spark, sf):
    path = new_path(spark, "cover")
    cov = V.v_cov(spark, sf)
    lines = cov.select(F.concat_ws(" ", "block", F.lit("1"), F.col("hits").cast("string")).alias("value"))
    noise = cov.filter("hits = 0").select(F.concat("block", F.lit(" 1 many")).alias("value"))
    head = cov.limit(1).select(F.lit("mode: atomic").alias("value"))
    head.unionByName(lines).unionByName(noise).write.text(path)
    return A.merge_coverage(logs.read_cover_profile(spark, path))


@query(
    "s7_report_lists", "v_test",
    """select case status when 'Passed' then 'passed' when 'Assertion Errors' then 'assertion_errors' else 'errors' end list,
    case when status in ('Passed', 'Assertion Errors') then test when error_type is null then test else test || ' [' || error_type || ']' end entry, count(*) n from v_test group by 1, 2""",
)
def _(spark, sf):
    path = new_path(spark, "report")
    writers.write_report(V.v_test(spark, sf), path)
    lists = spark.read.schema("value string, list string").option("basePath", f"{path}/lists").text(f"{path}/lists")
    return lists.groupBy("list", F.col("value").alias("entry")).agg(F.count("*").alias("n"))


@query(
    "s8_unified_log", "v_line",
    """with e as (select doc_id, 'f' || lpad(doc_id::varchar, 8, '0') || '.py' as name, doc_id % 6 = 0 lost from documents)
    select name, -1 n, '===== ' || name || ' =====' line from e
    union all select name, coalesce(l.n, 0), coalesce(l.text, '(log file missing)') from e left join v_line l on l.doc_id = e.doc_id and not e.lost
    union all select name, 2147483647, '' from e""",
)
def _(spark, sf):
    docs = V.table(spark, sf, "documents")
    name = F.concat(F.lit("d/f"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".py"))
    execs = docs.select(name.alias("test_file"), F.col("doc_id").alias("log_path"))
    lines = V.v_line(spark, sf).filter("doc_id % 6 <> 0").select(F.col("doc_id").alias("log_path"), "n", F.col("text").alias("line"))
    return writers.unified_log(execs, lines)


@query(
    "s9_matrix_text", "v_run",
    """with c as (select project, model, avg(coverage) filter (where error is null and target_type = 'initial' and baseline = 'main') nofix from v_run group by project, model)
    select replace(project, 'commons-', '') || '-' || case model when 'gpt-4o-mini' then '4o-mini' when 'gpt-4o' then '4o' when 'deepseek-chat' then 'deepseek' else model end project,
      round(nofix, 6) nofix, 'None' absent from c""",
)
def _(spark, sf):
    path = new_path(spark, "matrix")
    out = A.run_matrix(V.v_run(spark, sf), "coverage", ["main", "unknown"], "main")
    writers.write_matrix(out, ["main-nofix", "unknown"], path)
    back = spark.read.schema("project string, nofix string, absent string").option("header", True).csv(path)
    return back.select("project", F.round(F.col("nofix").cast("double"), 6).alias("nofix"), "absent")


# ---- the same over real files, one per row, written first and then found by the readers ----


def _written(spark, files, tag):
    """The folder below which files(path, content) have been written."""
    root = new_path(spark, tag)
    stage(writers.write_files(files, root), "written")
    return root


def _number(path, pattern):
    return F.regexp_extract(path, pattern, 1).cast("long")


@query(
    "s1_log_files",
    sql="""select process, count(*) entries, cast(sum(n) as bigint) time_ms, count(distinct doc_id) files from (
      select doc_id, case when i % 3 = 0 then 'generateTest' else 'FixWithLLM_' || i end process, length(l) n
      from (select doc_id, unnest(a) l, unnest(range(len(a))) i from (select doc_id, string_split(text, chr(10)) a from documents where doc_id % 10 not in (5, 7)))) group by process
    union all select null, count(*), 0, count(*) from documents where doc_id % 10 = 7""",
)
def _(spark, sf):
    """Logs in folders, among them files that are no list and reports, which are left out."""
    entry = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.struct(F.when(i % 3 == 0, "generateTest").otherwise(F.concat(F.lit("FixWithLLM_"), i.cast("string"))).alias("process"), F.length(l).cast("string").alias("time")),
    )
    name = F.when(F.col("doc_id") % 10 == 5, F.concat_ws("/", F.lit("r"), "doc_id", F.lit("diagnostic_report.json"))).otherwise(F.concat(F.lit("run "), "source", F.lit("/d"), "doc_id", F.lit(".json")))
    docs = V.table(spark, sf, "documents")
    root = _written(spark, docs.select(name.alias("path"), F.when(F.col("doc_id") % 10 == 7, "{ no\nlist").otherwise(F.to_json(entry, {"pretty": "true"})).alias("content")), "logs")
    read = logs.read_process_logs(spark, root)
    return read.groupBy("process").agg(F.count("*").alias("entries"), F.coalesce(F.sum("time_ms"), F.lit(0)).cast("long").alias("time_ms"), F.count_distinct("file").alias("files"))


@query(
    "s2_report_files",
    sql="""select doc_id, cast(unnest(range(len(a))) + 1 as int) round, md5(unnest(a)) message from (select doc_id, string_split(text, chr(10)) a from documents where doc_id % 10 <> 7)""",
)
def _(spark, sf):
    rounds = F.transform(F.split("text", "\n"), lambda l, i: F.struct((i + 1).alias("round"), F.array(l).alias("diagnosticMessages")))
    content = F.when(F.col("doc_id") % 10 == 7, "[1").otherwise(F.to_json(F.struct(rounds.alias("roundHistory")), {"pretty": "true"}))
    root = _written(spark, V.table(spark, sf, "documents").select(F.concat(F.lit("a/b/r"), "doc_id", F.lit(".JSON")).alias("path"), content.alias("content")), "reports")
    read = logs.read_diag_rounds(spark, root)
    return read.select(_number("file", r"/r(\d+)\.JSON$").alias("doc_id"), "round", F.md5("message").alias("message"))


@query(
    "s3_corpus_files",
    sql="""select case doc_id % 5 when 0 then 'src/a' || doc_id || '.py' when 2 then 'lib x/c' || doc_id || '.go' else 'x/build.d/e' || doc_id || '.h' end path,
    case doc_id % 5 when 0 then 'Python' when 2 then 'Go' else 'C/C++ Header' end lang, length(text) size, md5(text) digest from documents where doc_id % 5 in (0, 2, 4)""",
)
def _(spark, sf):
    n, name = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    path = F.when(n == 0, F.concat(F.lit("src/a"), name, F.lit(".py"))).when(n == 1, F.concat(F.lit("node_modules/x/b"), name, F.lit(".js"))).when(n == 2, F.concat(F.lit("lib x/c"), name, F.lit(".go")))
    path = path.when(n == 3, F.concat(F.lit("docs/d"), name, F.lit(".txt"))).otherwise(F.concat(F.lit("x/build.d/e"), name, F.lit(".h")))
    root = _written(spark, V.table(spark, sf, "documents").select(path.alias("path"), F.col("text").alias("content")), "corpus")
    return corpus.read_corpus(spark, root).select("path", "lang", "size", F.md5("content").alias("digest"))


@query(
    "s4_map_files",
    sql="""select 't' || unnest(range(len(a))) test_name, 'p' || item_id project, unnest(a) file_name, cast(unnest(range(len(a))) as int) ord from (select item_id, string_split(text, chr(10)) a from benchmark)""",
)
def _(spark, sf):
    entries = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.struct(F.concat(F.lit("t"), i.cast("string")), F.struct(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("project_name"), l.alias("file_name"))),
    )
    files = V.table(spark, sf, "benchmark").select(F.concat(F.lit("m"), "item_id", F.lit(".json")).alias("path"), F.to_json(F.map_from_entries(entries), {"pretty": "true"}).alias("content"))
    return logs.read_test_map(spark, _written(spark, files, "maps")).select("test_name", "project", "file_name", "ord")
