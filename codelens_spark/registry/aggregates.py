"""Queries for the aggregation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import rules as R
from ..operators import aggregates as A
from ..operators import topk as T
from ..plans.scan import ranked_rows
from ..plans.stage import stage
from .core import query, r6


def classify_sql(preset: str, col: str) -> str:
    """CASE expression of a rule set, from the same rule data."""
    low = f"lower({col})"

    def has(w: str) -> str:
        return f"contains({low}, {V.sql_str(w)})"

    whens = []
    if preset == "ten":
        whens.append(f"when {unclear_sql(col)} then {V.sql_str(R.UNCLEAR)}")
    for cat in R.PRESETS[preset]:
        context = "(" + " or ".join(has(w) for w in cat.context) + ")"
        guarded = [w for w in cat.keywords if w in cat.needs_context]
        terms = [has(w) for w in cat.keywords if w not in guarded]
        terms += [f"regexp_matches({low}, {V.sql_str(p)})" for p in cat.patterns]
        terms += ["(" + " and ".join(has(w) for w in ws) + ")" for ws in cat.all_of]
        lone = " or ".join(has(w) for w in guarded) or "false"
        if guarded and cat.veto:
            cond = f"({' or '.join(terms + [has(w) for w in guarded])}) and not (({lone}) and not {context})"
        else:
            cond = " or ".join(terms + [f"({has(w)} and {context})" for w in guarded])
        whens.append(f"when {cond} then {V.sql_str(cat.name)}")
    return f"case {' '.join(whens)} else {V.sql_str(R.OTHER)} end"


def unclear_sql(col: str) -> str:
    words = " or ".join(f"contains(lower({col}), '{w}')" for w in R.ERROR_WORDS)
    count = f"len(list_filter(regexp_split_to_array(lower({col}), '\\s+'), lambda w: w <> ''))"
    short = f"regexp_matches({col}, {V.sql_str(R.UNCLEAR_SHORT)})"
    return f"({col} = '' or ({short} and ((contains({col}, chr(10)) and length({col}) < 150) or (not ({words}) and {count} < 5))))"


@query(
    "a1_process_cost", "v_log",
    """with f as (select file, process, sum(time_ms) t, sum(coalesce(tokens, 0)) k from v_log group by all)
    select process, count(*) files, round(avg(t), 6) avg_time, round(avg(k), 6) avg_tokens from f group by process""",
)
def _(spark, sf):
    return A.process_cost(V.v_log(spark, sf)).select("process", "files", r6("avg_time"), r6("avg_tokens"))


@query(
    "a2_overall_cost", "v_log",
    """select count(distinct file) files, cast(sum(case when process not in ('fixDiagnostics', 'gatherContext') then time_ms else 0 end) as bigint) total_time,
    cast(sum(tokens) as bigint) total_tokens, cast(sum(case when process like 'FixWithLLM%' then time_ms else 0 end) as bigint) fix_time,
    cast(sum(case when process like 'FixWithLLM%' then tokens else 0 end) as bigint) fix_tokens, count_if(process like 'FixWithLLM%') fix_runs,
    round(sum(case when process not in ('fixDiagnostics', 'gatherContext') then time_ms else 0 end) / count(distinct file), 6) avg_time,
    round(sum(tokens) / count(distinct file), 6) avg_tokens,
    round(sum(case when process like 'FixWithLLM%' then time_ms else 0 end) / count(distinct file), 6) avg_fix_time,
    round(sum(case when process like 'FixWithLLM%' then tokens else 0 end) / count(distinct file), 6) avg_fix_tokens,
    round(count_if(process like 'FixWithLLM%') / count(distinct file), 6) avg_fix_runs from v_log""",
)
def _(spark, sf):
    means = ("avg_time", "avg_tokens", "avg_fix_time", "avg_fix_tokens", "avg_fix_runs")
    out = A.overall_cost(V.v_log(spark, sf))
    return out.select(*[r6(c) if c in means else F.col(c) for c in out.columns])


@query(
    "a3_stage_pivot", "v_log",
    """with l as (select *, case file % 3 when 0 then 'go' when 1 then 'java' else 'python' end lang,
      case process when 'generateTest' then 'gen' when 'gatherContext-1' then 'def' when 'buildCFG' then 'cfg' end stage from v_log),
    p as (select lang, file, process, stage, sum(time_ms) t from l group by all),
    m as (select lang, stage, process, avg(t) v from p where stage is not null group by all),
    x as (select lang, avg(t) v from (select lang, file, sum(case when process like 'FixWithLLM%' then time_ms else 0 end) t from l group by all) group by lang)
    select lang, round((select v from x where x.lang = m.lang), 6) fix, round(sum(case when stage = 'gen' then v else 0 end), 6) gen,
      round(sum(case when stage = 'cfg' then v else 0 end), 6) cfg, round(sum(case when stage = 'def' then v else 0 end), 6) "def",
      0.0::double "ref", 0.0::double "filter", 0.0::double diag, 0.0::double save from m group by lang""",
)
def _(spark, sf):
    lang = F.when(F.col("file") % 3 == 0, "go").when(F.col("file") % 3 == 1, "java").otherwise("python")
    out = A.stage_pivot(V.v_log(spark, sf).withColumn("lang", lang), "lang")
    return out.select("lang", *[r6(c) for c in A.STAGE_NAMES])


@query(
    "a4_baseline_time", "v_log",
    """with f as (select file % 7 directory, file, sum(time_ms) / 1e6 + case when bool_or(process = 'generateTest') then 0 else 10 end sec from v_log group by all),
    r as (select c_nationkey directory, c_acctbal / 1000 + 8 sec from customer),
    d as (select 'logged' category, directory, avg(sec) m, count(*) n from f group by all union all
      select 'retrieval', directory, avg(sec), count(*) from r group by all)
    select category, round(sum(m * n) / sum(n), 6) avg_seconds, cast(sum(n) as bigint) files, count(*) directories from d group by category""",
)
def _(spark, sf):
    log = V.v_log(spark, sf).select((F.col("file") % 7).alias("directory"), "file", "process", F.col("time_ms").alias("time"))
    c = V.table(spark, sf, "customer")
    looked = c.select(F.col("c_nationkey").cast("long").alias("directory"), F.col("c_custkey").alias("file"), (F.col("c_acctbal") / 1000).alias("retrieval_sec"))
    out = A.baseline_time(log, looked)
    return out.select("category", r6("avg_seconds"), "files", "directories")


@query("a5_message_freq", "v_diag", "select message, count(*) frequency from v_diag group by message")
def _(spark, sf):
    return A.message_freq(V.v_diag(spark, sf))


@query(
    "a6_category_totals", "v_diag",
    f"""with f as (select message, count(*) frequency from v_diag where trim(message) <> '' group by message),
    c as (select {classify_sql('seven', 'message')} category, frequency from f)
    select category, count(*) messages, cast(sum(frequency) as bigint) occurrences, category <> 'Other Error' in_total from c group by category""",
)
def _(spark, sf):
    return A.category_totals(A.message_freq(V.v_diag(spark, sf)))


@query(
    "a6_category_messages", "v_diag",
    f"""with f as (select message, count(*) frequency from v_diag where trim(message) <> '' group by message)
    , c as (select {classify_sql('constructor_first', 'message')} category, message, frequency from f)
    select *, row_number() over (order by category, frequency desc, message) place from c""",
)
def _(spark, sf):
    rows = A.classify_freq(A.message_freq(V.v_diag(spark, sf)), "constructor_first")
    return ranked_rows(rows.select("category", "message", "frequency"), ["category", F.desc("frequency"), "message"], "place")


@query(
    "a7_fix_sets", "v_diag",
    """with l as (select file, max(round) last_round from v_diag group by file),
    s as (select file, message, max(round) seen from v_diag group by file, message)
    select message, bool_or(seen < last_round) fixed, bool_or(seen = last_round) unfixed from s join l using (file) group by message""",
)
def _(spark, sf):
    return A.fix_sets(V.v_diag(spark, sf))


@query(
    "a7_fix_summary", "v_diag",
    """with l as (select file, max(round) last_round from v_diag group by file),
    s as (select file, message, max(round) seen from v_diag group by file, message),
    m as (select message, bool_or(seen < last_round) fixed, bool_or(seen = last_round) unfixed from s join l using (file) group by message)
    select count(*) messages, count_if(fixed) fixed, count_if(unfixed) unfixed from m""",
)
def _(spark, sf):
    return A.fix_summary(V.v_diag(spark, sf))


@query(
    "a8_difficulty", "v_diag",
    """with s as (select file, message, count(distinct round) n from v_diag group by all), p as (select message, max(n) persistence from s group by message)
    select message, persistence, case when persistence >= 4 then 'very_hard' when persistence = 3 then 'hard' when persistence = 2 then 'moderate' else 'easy' end level from p""",
)
def _(spark, sf):
    return A.difficulty(V.v_diag(spark, sf))


@query(
    "a9_final_status", "v_event",
    """select test, coalesce(arg_max(action, ord) filter (where action in ('pass', 'fail', 'skip')), arg_min(action, ord)) action,
    count_if(trim(output) <> '') outputs from v_event group by test""",
)
def _(spark, sf):
    return A.final_status(V.v_event(spark, sf))


@query(
    "a9_failure_details", "v_event",
    """with f as (select test from v_event group by test having arg_max(action, ord) filter (where action in ('pass', 'fail', 'skip')) = 'fail')
    select test, ord, trim(output) line from v_event where trim(output) <> '' and test in (select test from f)""",
)
def _(spark, sf):
    return A.failure_details(V.v_event(spark, sf))


@query(
    "a10_build_errors", "v_event",
    """with f as (select c_custkey file, case when c_nationkey % 3 = 0 then 'FAIL ' when c_nationkey % 3 = 1 then 'cannot find pkg' else 'ok' end log from customer)
    select file || '::BuildError' code_name, file, 'Errored' status, 'BuildError' error_type from f
    where file not in (select file from v_event) and (contains(log, 'FAIL') or contains(log, 'build failed') or contains(log, 'cannot find'))""",
)
def _(spark, sf):
    n = F.col("c_nationkey") % 3
    files = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("file"), F.when(n == 0, "FAIL ").when(n == 1, "cannot find pkg").otherwise("ok").alias("log")
    )
    return A.build_errors(files, V.v_event(spark, sf))


@query(
    "a11_status_counts", "v_test",
    """select file, count_if(status = 'Passed') "Passed", count_if(status = 'Assertion Errors') "Assertion Errors", count_if(status = 'Error') "Error",
    count_if(status not in ('Passed', 'Assertion Errors', 'Error')) other from v_test group by file""",
)
def _(spark, sf):
    return A.status_counts(V.v_test(spark, sf))


@query(
    "a11_status_rows", "v_test",
    """with x as (select distinct file, unnest(['Passed', 'Assertion Errors', 'Error']) status, 0 one from v_test union all select file, status, 1 from v_test)
    select file, status, cast(sum(one) as bigint) tests from x group by file, status""",
)
def _(spark, sf):
    return A.status_count_rows(V.v_test(spark, sf))


@query(
    "a11_last_per_test", "v_test",
    "select file, test, max(ord) ord, arg_max(status, ord) status, arg_max(coalesce(error_type, '-'), ord) error_type from v_test group by file, test",
)
def _(spark, sf):
    return A.last_per_test(V.v_test(spark, sf)).withColumn("error_type", F.coalesce("error_type", F.lit("-")))


@query(
    "a12_run_summary", "v_exec",
    """select count(*) total, count_if(exit_code = 0 and not timeout) successful, count_if(exit_code <> 0) failed, count_if(timeout) timed_out,
    round(count_if(exit_code = 0 and not timeout) * 100 / count(*), 1) success_rate from v_exec""",
)
def _(spark, sf):
    return A.run_summary(V.v_exec(spark, sf))


@query(
    "a13_exit_buckets", "v_exec",
    """select event_type, count(*) total, count_if(exit_code = 0) passed, count_if(exit_code = 1) failed, count_if(exit_code = 124) hanging,
    count_if(exit_code not in (0, 1, 124)) error, round(count_if(exit_code in (0, 1)) / count(*), 6) valid_rate from v_exec group by event_type""",
)
def _(spark, sf):
    out = A.exit_buckets(V.v_exec(spark, sf), ["event_type"])
    return out.withColumn("valid_rate", F.round("valid_rate", 6))


@query(
    "a14_all_pass",
    sql="""select o_custkey file, count(*) functions, count_if(o_orderstatus <> 'P') passed_functions, bool_and(o_orderstatus <> 'P') all_passed
    from orders group by o_custkey""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    return A.all_pass(o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("func"), (F.col("o_orderstatus") != "P").alias("passed")))


@query(
    "a15_merge_coverage", "v_cov",
    """with b as (select block, max(hits) > 0 covered from v_cov group by block)
    select count(*) total, count_if(covered) covered, round(count_if(covered) * 100 / count(*), 2) percent from b""",
)
def _(spark, sf):
    return A.merge_coverage(V.v_cov(spark, sf))


@query("a15_dedup_profile", "v_cov", "select block, 1 stmts, max(case when hits > 0 then 1 else 0 end) hits from v_cov group by block")
def _(spark, sf):
    return A.dedup_profile(V.v_cov(spark, sf))


REPORT = {
    "go": ("Files: {p}/{t} passed (1%)\nTotal Statements: {t}\nCovered Statements: {p}\n", "t", "p"),
    "java": ("Total lines {t}\nMissed Lines {p}\nTotal .java files: {t}\nFiles with corresponding .class files: {p}\n", "t", "m"),
    "python": ("TOTAL   {t}   {p}   54%\nPassRate ((passed files + failed files)/ total files): {p}/{t}\n", "t", "m"),
}


def _report(kind: str):
    """A printed report per order: totals from its key and date."""
    text = REPORT[kind][0]
    pieces = [F.lit("head\n")]
    for i, part in enumerate(text.replace("{p}", "\0p\0").replace("{t}", "\0t\0").split("\0")):
        pieces.append(F.col("p").cast("string") if part == "p" else F.col("t").cast("string") if part == "t" else F.lit(part))
    return F.concat(*pieces)


def _report_query(kind: str) -> None:
    covered = "p" if kind == "go" else "t - p"
    total = "case c_mktsegment when 'black' then 7523 else 7555 end" if kind == "python" else "t"

    @query(
        f"a16_coverage_ratio_{kind}",
        sql=f"""with s as (select c_custkey id, c_mktsegment, c_custkey % 90 + 100 t, c_nationkey p from customer)
        select id, round(({covered}) / ({total}), 6) coverage, round(p / t, 6) validrate from s""",
    )
    def _(spark, sf):
        c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", (F.col("c_custkey") % 90 + 100).alias("t"), F.col("c_nationkey").alias("p"))
        out = A.coverage_ratio(c.withColumn("report", _report(kind)), "report", kind, "c_mktsegment")
        return out.select("id", r6("coverage"), r6("validrate"))


for _kind in REPORT:
    _report_query(_kind)


MUT = """u as (select coalesce(module, target) module, operator, lineno, max(lower(status) = 'killed') killed from v_mut
    where lower(status) <> 'incompetent' group by 1, 2, 3)"""


@query("a17_mutation_by_module", "v_mut", f"with {MUT} select module, count(*) eligible, count_if(killed) killed from u group by module")
def _(spark, sf):
    return A.mutation_by_module(V.v_mut(spark, sf))


@query("a17_mutation_score", "v_mut", f"with {MUT} select count(*) eligible, count_if(killed) killed, round(count_if(killed) * 100 / count(*), 2) score from u")
def _(spark, sf):
    return A.mutation_score(V.v_mut(spark, sf))


@query(
    "a18_mutation_per_test", "v_mut",
    "select test, count(*) mutants, count_if(lower(status) <> 'incompetent') total, count_if(lower(status) = 'killed') killed from v_mut group by test",
)
def _(spark, sf):
    return A.mutation_per_test(V.v_mut(spark, sf))


@query(
    "a18_reported_scores", "v_mut",
    """with d as (select doc_id, text || case doc_id % 4 when 0 then chr(10) || 'mutation SCORE: ' || doc_id % 101 || '.5 %' when 1 then chr(10) || 'Generated mutants: ' || doc_id || chr(10) || 'killed mutants: 7'
      when 2 then chr(10) || '  mutation_score: ' || doc_id % 100 || '.25' else '' end t from documents)
    select doc_id, try_cast(regexp_extract(t, 'Mutation score:\\s*([0-9]+(?:\\.[0-9]+)?)\\s*%', 1, 'i') as double) score,
      try_cast(regexp_extract(t, 'Generated mutants:\\s*([0-9]+)', 1, 'i') as bigint) total, try_cast(regexp_extract(t, 'Killed mutants:\\s*([0-9]+)', 1, 'i') as bigint) killed,
      case when doc_id % 4 = 2 then doc_id % 100 + 0.25::double end reported from d""",
)
def _(spark, sf):
    from ..functions.text import printed_mutation_stats, reported_mutation_score

    n = F.col("doc_id")
    said = (
        F.when(n % 4 == 0, F.concat(F.lit("\nmutation SCORE: "), (n % 101).cast("string"), F.lit(".5 %")))
        .when(n % 4 == 1, F.concat(F.lit("\nGenerated mutants: "), n.cast("string"), F.lit("\nkilled mutants: 7")))
        .when(n % 4 == 2, F.concat(F.lit("\n  mutation_score: "), (n % 100).cast("string"), F.lit(".25")))
        .otherwise("")
    )
    text = F.concat("text", said)
    stats = printed_mutation_stats(text)
    return V.table(spark, sf, "documents").select("doc_id", stats["score"].alias("score"), stats["total"].alias("total"), stats["killed"].alias("killed"), reported_mutation_score(text).alias("reported"))


@query(
    "a18_mutation_per_test_reported", "v_mut",
    """select test, count(*) mutants, count_if(lower(status) <> 'incompetent') total, count_if(lower(status) = 'killed') killed,
      case when test % 2 = 0 then test + 0.5::double end reported_score from v_mut group by test""",
)
def _(spark, sf):
    from ..functions.text import reported_mutation_score

    mut = V.v_mut(spark, sf)
    n = F.col("test")
    report = F.when(n % 2 == 0, F.concat(F.lit("mutants:\nmutation_score: "), n.cast("string"), F.lit(".5\n"))).otherwise("time: 3")
    reports = mut.select("test").distinct().select("test", reported_mutation_score(report).alias("score"))
    return A.mutation_per_test(mut, reports)


@query("udf1_token_counter", sql="select source, cast(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) as bigint) tokens from documents group by source")
def _(spark, sf):
    from ..functions.udfs import token_counter

    count = token_counter(lambda text: [w for w in text.split(" ") if w])
    return V.table(spark, sf, "documents").select("source", count("text").alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"))


@query("udf2_embedder", sql="select doc_id, length(text)::double chars, (length(text) - length(replace(text, ' ', '')))::double blanks from documents")
def _(spark, sf):
    from ..functions.udfs import embedder
    from ..operators.retrieval import apply_embedder

    vectors = apply_embedder(V.table(spark, sf, "documents").select("doc_id", "text"), "text", embedder(lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]))
    return vectors.select("doc_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("blanks"))


@query(
    "udf3_default_term_flags", "v_token",
    "select id, type in ('function', 'class', 'method', 'global', 'member') need_definition, type in ('method', 'function', 'assignment') need_example from v_token",
)
def _(spark, sf):
    from ..operators.predicates import default_term_flags

    definition, example = default_term_flags(F.col("type"))
    return V.v_token(spark, sf).select("id", definition.alias("need_definition"), example.alias("need_example"))


@query(
    "udf4_large_rule_table",
    sql="""with r as (select item_id rule_ord, 'c' || item_id category, lower(unnest(string_split(text, ' '))) word from benchmark),
    w as (select word, min(struct_pack(o := rule_ord, c := category)) r from r where length(word) >= 9 group by word),
    h as (select doc_id, min(r) r from documents join w on contains(lower(text), word) group by doc_id)
    select doc_id, coalesce(r.c, 'Other Error') category from documents left join h using (doc_id)""",
)
def _(spark, sf):
    from ..functions.classify import classify_by_table

    rules = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("rule_ord"), F.concat(F.lit("c"), "item_id").alias("category"), F.explode(F.split("text", " ")).alias("keyword"))
    docs = V.wide_table(spark, sf, "documents", "doc_id", "text")
    return classify_by_table(docs, "text", rules.filter(F.length("keyword") >= 9)).select("doc_id", "category")


@query("udf4_rule_table", sql="select event_id, upper(event_type) category from events")
def _(spark, sf):
    from ..functions.classify import classify_by_table

    events = V.table(spark, sf, "events")
    rules = events.select("event_type").distinct().select(F.length("event_type").alias("rule_ord"), F.upper("event_type").alias("category"), F.col("event_type").alias("keyword"))
    rows = events.select("event_id", F.concat(F.lit("an "), F.upper("event_type"), F.lit(" happened")).alias("message"))
    return classify_by_table(rows, "message", rules).select("event_id", "category")


def _matrix_sql(metric: str) -> str:
    def cell(baseline: str) -> str:
        ok = f"error is null and {metric} is not null"
        f = f"baseline = '{baseline}' and target_type"
        return (
            f"case when count_if({f} = 'final') > 0 then avg({metric}) filter (where {f} = 'final' and {ok}) "
            f"else avg({metric}) filter (where {f} = 'codes' and {ok}) end"
        )

    nofix = f"avg({metric}) filter (where baseline = 'main' and target_type = 'initial' and error is null and {metric} is not null)"
    return f"""select project, model, replace(project, 'commons-', '') || '-' || case model when 'gpt-4o-mini' then '4o-mini' when 'gpt-4o' then '4o'
      when 'deepseek-chat' then 'deepseek' else model end row_id,
    case model when 'gpt-4o-mini' then 0 when 'gpt-4o' then 1 when 'deepseek-chat' then 2 else 999 end model_ord,
    round({cell('standard')}, 6) standard, round({cell('naive')}, 6) naive, round({cell('main')}, 6) main, round({nofix}, 6) "main-nofix"
    from v_run group by project, model"""


def _matrix_query(metric: str) -> None:
    @query(f"a19_run_matrix_{metric}", "v_run", _matrix_sql(metric))
    def _(spark, sf):
        out = A.run_matrix(V.v_run(spark, sf), metric, ["standard", "naive", "main"], "main")
        return out.select("project", "model", "row_id", "model_ord", *[r6(F.col(f"`{c}`"), c) for c in ("standard", "naive", "main", "main-nofix")])


_matrix_query("coverage")
_matrix_query("validrate")


@query(
    "a20_check_repeats", "v_run",
    "select project, model, baseline, target_type, count(*) runs from v_run group by all having count(*) <> 5",
)
def _(spark, sf):
    return A.check_repeats(V.v_run(spark, sf))


@query(
    "a21_fix_history", "v_attempt",
    """with t as (select test, count(*) n, count_if(result = 'pass') p, arg_max(result, round) last from v_attempt group by test)
    select count(*) tests, cast(sum(n) as bigint) rounds, cast(sum(p) as bigint) pass_rounds, cast(sum(n - p) as bigint) other_rounds,
    count_if(last = 'pass') passing_tests, round(count_if(last = 'pass') * 100 / count(*), 1) success_rate from t""",
)
def _(spark, sf):
    return A.fix_history(V.v_attempt(spark, sf))


@query("a21_last_result", "v_attempt", "select test, arg_max(result, round) last_result, count(*) rounds from v_attempt group by test")
def _(spark, sf):
    return A.last_result(V.v_attempt(spark, sf))


@query(
    "a22_first_success", "v_attempt",
    """select test, min(round) round, arg_min(role, round) role, arg_min(text, round) as text, 'pass' result from v_attempt where result = 'pass' group by test""",
)
def _(spark, sf):
    return A.first_success(V.v_attempt(spark, sf))


LABEL = "case decision when '1' then 'added_to_existing' when '2' then 'created_small_category' else 'created_big_category' end"


@query(
    "a23_category_rollup", "v_cat",
    f"""with n as (select count(*) n from v_cat), x as (
      select 'big' level, big, null small, null action, count(*) tests from v_cat group by big union all
      select 'small', big, small, null, count(*) from v_cat group by big, small union all
      select 'action', null, null, {LABEL}, count(*) from v_cat group by {LABEL})
    select level, big, small, action, tests, round(tests * 100 / (select n from n), 1) percent from x""",
)
def _(spark, sf):
    return A.category_rollup(V.v_cat(spark, sf))


@query("a24_tests_by_category", "v_cat", "select big, small, test, row_number() over (order by big, small, test) place from v_cat")
def _(spark, sf):
    return A.tests_by_category(V.v_cat(spark, sf))


@query(
    "a25_prefix_topk",
    sql="""select lower(substring(text, 1, 50)) prefix, count(*) n, min(doc_id) first_ord from documents group by 1 order by n desc, first_ord limit 10""",
)
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("summary"))
    return T.topk(A.prefix_freq(docs), "n", 10, "first_ord")


@query("a26_category_stats", "v_cat", "select big, count(distinct small) smalls from v_cat group by big")
def _(spark, sf):
    return A.category_stats(V.v_cat(spark, sf))


@query("a26_category_totals_row", "v_cat", "with b as (select big, count(distinct small) n from v_cat group by big) select count(*) bigs, cast(sum(n) as bigint) smalls from b")
def _(spark, sf):
    return A.category_totals_row(V.v_cat(spark, sf))


@query("a26_duration_minutes", "v_cat", "select cast(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000, 0) as bigint) as minutes from v_cat")
def _(spark, sf):
    return A.duration_minutes(V.v_cat(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))


@query(
    "a27_merge_terms", "v_token",
    """with t as (select uri fn, word as name, id, type in ('function', 'class', 'method', 'global', 'member') d, type in ('method', 'function', 'assignment') x from v_token)
    select fn, name, bool_or(d) need_definition, bool_or(x) need_example, min(id) ord from t where name <> 'the' group by fn, name having bool_or(d) or bool_or(x)""",
)
def _(spark, sf):
    from ..operators.predicates import default_term_flags

    d, x = default_term_flags(F.col("type"))
    terms = V.v_token(spark, sf).select(
        F.col("uri").alias("fn"), F.col("word").alias("name"), F.col("id").alias("ord"), d.alias("need_definition"), x.alias("need_example"), F.lit("the").alias("focal")
    )
    return A.merge_terms(terms)


@query(
    "a28_group_messages", "v_diag",
    "select message, count(*) occurrences, arg_min(line, ord) first_line, min(ord) first_ord from v_diag group by message",
)
def _(spark, sf):
    return A.group_messages(V.v_diag(spark, sf))


@query("a29_def_counts", "v_token", "select word token, count(distinct (uri, line, ch)) definitions from v_token group by word")
def _(spark, sf):
    return A.def_counts(V.v_token(spark, sf).withColumnRenamed("word", "token"))


@query("a29_def_sketches", "v_token", "select word token, count(distinct (uri, line, ch)) definitions, true in_bounds from v_token group by word")
def _(spark, sf):
    """Sketches per file, merged per token; the estimate must lie within its error bound of the exact count."""
    defs = V.v_token(spark, sf).withColumnRenamed("word", "token").withColumn("log", F.col("uri"))
    kept = stage(A.def_sketches(defs, "log"), "sketches")
    guess = A.merged_def_counts(kept).withColumnRenamed("definitions", "guess")
    exact = A.def_counts(defs)
    return exact.join(guess, "token").select("token", "definitions", (F.abs(F.col("guess") - F.col("definitions")) <= F.col("definitions") * 0.03 + 1).alias("in_bounds"))


@query("a29_need_filter", "v_token", "select uri fn, count(distinct word) words, count(distinct word) > 30 filter_terms from v_token group by uri")
def _(spark, sf):
    return A.need_filter(V.v_token(spark, sf).withColumnRenamed("uri", "fn"), 30)


@query(
    "a30_size_profile",
    sql="""select o_orderpriority, count(*) n, min(d) least, max(d) most, quantile_disc(d, 0.25) p25, quantile_disc(d, 0.5) p50, quantile_disc(d, 0.75) p75
    from (select o_orderpriority, cast(o_orderkey % 997 as bigint) d from orders) group by o_orderpriority""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderkey") % 997).alias("d"))
    return A.size_profile(o, "o_orderpriority", "d")


@query(
    "a30_size_sketches",
    sql="select o_orderpriority, count(*) n, true in_bounds from orders group by o_orderpriority",
)
def _(spark, sf):
    """Sketches per month, merged per group; the ranks of the estimated quantiles must be off by 2 % at most."""
    o = V.table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderkey") % 997).alias("d"), F.date_trunc("month", "o_orderdate").alias("log"))
    kept = stage(A.size_sketches(o, "log", "o_orderpriority", "d"), "sketches")
    guess = A.merged_size_profile(kept, "o_orderpriority")
    marks = o.join(guess.drop("n"), "o_orderpriority").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), *[F.avg((F.col("d") <= F.col(f"p{q}")).cast("int")).alias(f"r{q}") for q in (25, 50, 75)]
    )
    return marks.select("o_orderpriority", "n", ((F.abs(F.col("r25") - 0.25) < 0.02) & (F.abs(F.col("r50") - 0.5) < 0.02) & (F.abs(F.col("r75") - 0.75) < 0.02)).alias("in_bounds"))


@query("a31_lang_counts", sql="select lang, count(*) files from documents group by lang")
def _(spark, sf):
    return A.lang_counts(V.table(spark, sf, "documents"))


SYSTEM = "You are a test writer. "


@query(
    "a32_token_totals",
    sql=f"""select count(*) files, cast(sum(t) as bigint) tokens, round(avg(t), 6) avg_tokens
    from (select length('{SYSTEM}' || text) // 4 t from documents)""",
)
def _(spark, sf):
    out = A.token_totals(V.table(spark, sf, "documents"), "text", SYSTEM)
    return out.withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(
    "a33_experiment_summary",
    sql="""select (select count(*) from orders) tasks, (select count_if(o_orderstatus <> 'F') from orders) succeeded,
    (select count_if(o_orderstatus = 'F') from orders) failed, (select count_if(o_orderstatus <> 'F' and o_orderkey % 3 > 0) from orders) with_warnings,
    (select cast(sum(o_orderkey % 1000) as bigint) from orders) time_ms,
    (select arg_max(c_acctbal, c_custkey) - arg_min(c_acctbal, c_custkey) from customer) spent, (select round(sum(c_acctbal), 2) from customer) billed""",
)
def _(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    results = o.select((F.col("o_orderstatus") != "F").alias("success"), (F.col("o_orderkey") % 3).alias("warnings"), (F.col("o_orderkey") % 1000).alias("time_ms"))
    out = A.experiment_summary(results, c.select(F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("cost")))
    return out.withColumn("billed", F.round("billed", 2))


@query(
    "a34_invert",
    sql="""select distinct unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) as value, item_id from benchmark""",
)
def _(spark, sf):
    from ..functions.text import identifiers

    return A.invert(V.table(spark, sf, "benchmark").withColumn("words", identifiers(F.col("text"))), "item_id", "words")


@query(
    "a35_compact_children",
    sql=f"""select l_suppkey parent, p_name as name, p_brand uri, count(*) n, min({V.ROW_ORD}) ord,
    case when count(*) > 1 then p_name || ' ×' || count(*) else p_name end label
    from lineitem join part on l_partkey = p_partkey group by 1, 2, 3""",
)
def _(spark, sf):
    li, part = V.table(spark, sf, "lineitem"), V.table(spark, sf, "part")
    edges = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("parent"), F.col("p_name").alias("name"), F.col("p_brand").alias("uri"), V.row_ord().alias("ord")
    )
    return A.compact_children(edges)


@query(
    "a36_minimize_paths", "v_token",
    """with p as (select distinct split_part(uri, ':', 1) fn, uri path_id, type || line c from v_token),
    f as (select fn, c, min(path_id) path_id from p group by fn, c)
    select distinct fn, path_id from f""",
)
def _(spark, sf):
    paths = V.v_token(spark, sf).select(F.substring_index("uri", ":", 1).alias("fn"), F.col("uri").alias("path_id"), F.concat("type", F.col("line").cast("string")).alias("c"))
    # one path per conversation turn: its constraint set is bounded by the turn's own text
    paths = paths.groupBy("fn", "path_id").agg(F.collect_set("c").alias("conds"))
    return A.minimize_paths(paths).select("fn", "path_id")
