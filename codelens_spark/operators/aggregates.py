"""Aggregations: all mergeable map-side, so a hot key costs one partial row per task.

List-valued results of the reports (messages of a category, tests of a category, locations of a message)
are returned as ordered rows instead of arrays, because their groups have no size bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.classify import action_label, classify_ordered, map_stage
from ..functions.text import estimated_tokens, report_totals, strip
from ..plans.scan import Run, ranked_rows, running
from ..plans.skew import attach, first_per_key


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


# ---- run logs: log(file, seq, process, time_ms, tokens) ----


def process_cost(log: DataFrame) -> DataFrame:
    """Mean time and tokens per process over the files in which the process occurs."""
    per_file = log.groupBy("file", "process").agg(F.sum("time_ms").alias("t"), F.sum(F.coalesce("tokens", F.lit(0))).alias("k"))
    return per_file.groupBy("process").agg(
        F.count("*").alias("files"), F.avg("t").alias("avg_time"), F.avg("k").alias("avg_tokens")
    )


def overall_cost(log: DataFrame) -> DataFrame:
    """One row of totals and per-file means. Files without a readable entry (process null) still count."""
    counted = ~F.coalesce(F.col("process").isin(*R.NOT_COUNTED), F.lit(True))
    fix = F.coalesce(F.col("process").startswith("FixWithLLM"), F.lit(False))
    tokens = F.coalesce("tokens", F.lit(0))
    per_file = log.groupBy("file").agg(
        F.sum(F.when(counted, F.col("time_ms")).otherwise(0)).alias("t"),
        F.sum(tokens).alias("k"),
        F.sum(F.when(fix, F.col("time_ms")).otherwise(0)).alias("ft"),
        F.sum(F.when(fix, tokens).otherwise(0)).alias("fk"),
        F.count_if(fix).alias("fn"),
    )
    n = F.col("files")
    totals = per_file.agg(
        F.count("*").alias("files"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("t", "total_time"), ("k", "total_tokens"), ("ft", "fix_time"), ("fk", "fix_tokens"), ("fn", "fix_runs"))],
    )
    means = (("total_time", "avg_time"), ("total_tokens", "avg_tokens"), ("fix_time", "avg_fix_time"), ("fix_tokens", "avg_fix_tokens"), ("fix_runs", "avg_fix_runs"))
    return totals.select("*", *[_ratio(F.col(c), n).alias(a) for c, a in means])


STAGE_NAMES = ("fix", "gen", "cfg", "def", "ref", "filter", "diag", "save")


def stage_pivot(log: DataFrame, dim: str) -> DataFrame:
    """One row per `dim` (project language, say), one column per stage: the sum of its processes' mean times.

    The fix stage is total fix time over all files of the dimension.
    """
    staged = log.withColumn("stage", map_stage(F.col("process")))
    per_file = staged.groupBy(dim, "file", "process", "stage").agg(F.sum("time_ms").alias("t"))
    means = per_file.filter("stage <> 'fix'").groupBy(dim, "stage", "process").agg(F.avg("t").alias("v")).select(dim, "stage", "v")
    files = staged.groupBy(dim, "file").agg(F.sum(F.when(F.col("stage") == "fix", F.col("time_ms")).otherwise(0)).alias("t"))
    fix = files.groupBy(dim).agg(F.avg("t").alias("v")).select(dim, F.lit("fix").alias("stage"), "v")
    wide = means.unionByName(fix).groupBy(dim).pivot("stage", list(STAGE_NAMES)).agg(F.sum("v"))
    return wide.na.fill(0.0, list(STAGE_NAMES))


def baseline_time(log: DataFrame, retrieval: DataFrame, unit: str = "us", llm_seconds: float = 8.0, missing_seconds: float = 10.0) -> DataFrame:
    """Weighted mean generation time per category.

    log(directory, file, process, time) are logged runs in `unit`; retrieval(directory, file,
    retrieval_sec) are runs that only report retrieval time, to which a fixed answer time is added.
    """
    scale = {"us": 1e6, "ms": 1e3, "s": 1.0}[unit]
    per_file = log.groupBy("directory", "file").agg(
        F.sum("time").alias("t"), F.max(F.col("process") == "generateTest").alias("gen")
    )
    logged = per_file.select(
        F.lit("logged").alias("category"),
        "directory",
        (F.col("t") / scale + F.when(F.col("gen"), 0.0).otherwise(missing_seconds)).alias("sec"),
    )
    looked_up = retrieval.filter("retrieval_sec is not null").select(
        F.lit("retrieval").alias("category"), "directory", (F.col("retrieval_sec") + llm_seconds).alias("sec")
    )
    per_dir = logged.unionByName(looked_up).groupBy("category", "directory").agg(F.avg("sec").alias("m"), F.count("*").alias("n"))
    return per_dir.groupBy("category").agg(
        (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("avg_seconds"),
        F.sum("n").alias("files"),
        F.count("*").alias("directories"),
    )


# ---- diagnostics: diag(file, round, message) ----


def message_freq(diag: DataFrame) -> DataFrame:
    return diag.groupBy("message").agg(F.count("*").alias("frequency"))


def classify_freq(freq: DataFrame, preset: str = "seven") -> DataFrame:
    """Category of each distinct non-blank message with its frequency."""
    return classify_ordered(freq.filter(strip(F.col("message")) != ""), "message", preset)


def category_totals(freq: DataFrame, preset: str = "seven") -> DataFrame:
    """Messages and occurrences per category; `in_total` is false for the fallback category."""
    return (
        classify_freq(freq, preset)
        .groupBy("category")
        .agg(F.count("*").alias("messages"), F.sum("frequency").alias("occurrences"))
        .withColumn("in_total", F.col("category") != R.OTHER)
    )


def _last_round(diag: DataFrame) -> DataFrame:
    """diag reduced to (file, message, rounds, last_seen), with the file's last round attached."""
    per_round = diag.groupBy("file", "message", "round").agg(F.lit(1).alias("one"))
    seen = per_round.groupBy("file", "message").agg(F.count("*").alias("rounds"), F.max("round").alias("last_seen"))
    last = diag.groupBy("file").agg(F.max("round").alias("last_round"))
    return attach(seen, last, ["file"])


def fix_sets(diag: DataFrame) -> DataFrame:
    """(message, fixed, unfixed): seen but gone by some file's last round / present in some last round."""
    gone = F.col("last_seen") < F.col("last_round")
    return _last_round(diag).groupBy("message").agg(F.bool_or(gone).alias("fixed"), F.bool_or(~gone).alias("unfixed"))


def fix_summary(diag: DataFrame) -> DataFrame:
    return fix_sets(diag).agg(
        F.count("*").alias("messages"), F.count_if("fixed").alias("fixed"), F.count_if("unfixed").alias("unfixed")
    )


def difficulty(diag: DataFrame) -> DataFrame:
    """Persistence of each message: the most rounds any file shows it in, and its level."""
    per_round = diag.groupBy("file", "message", "round").agg(F.lit(1).alias("one"))
    per_file = per_round.groupBy("file", "message").agg(F.count("*").alias("n"))
    p = F.col("persistence")
    level = F.when(p >= 4, "very_hard").when(p == 3, "hard").when(p == 2, "moderate").otherwise("easy")
    return per_file.groupBy("message").agg(F.max("n").alias("persistence")).withColumn("level", level)


def group_messages(diag: DataFrame) -> DataFrame:
    """diag(message, line, ord): occurrences and first position of each message."""
    return diag.groupBy("message").agg(
        F.count("*").alias("occurrences"), F.min_by("line", "ord").alias("first_line"), F.min("ord").alias("first_ord")
    )


# ---- test results ----


def final_status(events: DataFrame) -> DataFrame:
    """events(test, ord, action, output): the last pass / fail / skip of each test, else its first action."""
    terminal = F.col("action").isin("pass", "fail", "skip")
    said = strip(F.coalesce("output", F.lit(""))) != ""
    return events.groupBy("test").agg(
        F.coalesce(
            F.max_by(F.when(terminal, F.col("action")), F.when(terminal, F.col("ord"))), F.min_by("action", "ord")
        ).alias("action"),
        F.count_if(said).alias("outputs"),
    )


def failure_details(events: DataFrame) -> DataFrame:
    """Trimmed output lines of failed tests as (test, ord, line) rows."""
    failed = final_status(events).filter("action = 'fail'").select("test")
    said = events.withColumn("line", strip(F.col("output"))).filter("line <> ''")
    return said.join(failed, "test", "left_semi").select("test", "ord", "line")


def build_errors(files: DataFrame, events: DataFrame) -> DataFrame:
    """files(file, log): one BuildError row per file without test events whose log reports a failure."""
    silent = files.join(events.select("file").distinct(), "file", "left_anti")
    bad = F.col("log").contains("FAIL") | F.col("log").contains("build failed") | F.col("log").contains("cannot find")
    return silent.filter(bad).select(
        F.concat("file", F.lit("::BuildError")).alias("code_name"),
        "file",
        F.lit("Errored").alias("status"),
        F.lit("BuildError").alias("error_type"),
    )


SEEDED = ("Passed", "Assertion Errors", "Error")


def status_counts(tests: DataFrame, statuses: Sequence[str] = SEEDED) -> DataFrame:
    """Per file one column per listed status (0 where absent) and `other` for the rest."""
    cols = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    rest = F.count_if(~F.col("status").isin(*statuses)).alias("other")
    return tests.groupBy("file").agg(*cols, rest)


def status_count_rows(tests: DataFrame) -> DataFrame:
    """(file, status, tests) in long form with the seeded statuses always present."""
    seeds = tests.select("file").distinct().select("file", F.explode(F.array(*[F.lit(s) for s in SEEDED])).alias("status"), F.lit(0).cast("long").alias("one"))
    ones = tests.select("file", "status", F.lit(1).cast("long").alias("one"))
    return seeds.unionByName(ones).groupBy("file", "status").agg(F.sum("one").alias("tests"))


def last_per_test(tests: DataFrame, keys: Sequence[str] = ("file", "test")) -> DataFrame:
    """Last result per test; with keys=("test",) equal names in different files overwrite each other."""
    return first_per_key(tests, list(keys), [-F.col("ord")])


def run_summary(execs: DataFrame) -> DataFrame:
    """execs(exit_code, timeout). A timed-out run with a non-zero code counts as failed and timed out."""
    ok = F.count_if((F.col("exit_code") == 0) & ~F.col("timeout"))
    return execs.agg(
        F.count("*").alias("total"),
        ok.alias("successful"),
        F.count_if(F.col("exit_code") != 0).alias("failed"),
        F.count_if("timeout").alias("timed_out"),
        F.round(_ratio(ok * 100, F.count("*")), 1).alias("success_rate"),
    )


def exit_buckets(execs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs by exit code: 0 passed, 1 failed, 124 hanging, anything else error; valid = passed + failed."""
    code = F.col("exit_code")
    passed, failed = F.count_if(code == 0), F.count_if(code == 1)
    return execs.groupBy(*by).agg(
        F.count("*").alias("total"),
        passed.alias("passed"),
        failed.alias("failed"),
        F.count_if(code == 124).alias("hanging"),
        F.count_if(~code.isin(0, 1, 124)).alias("error"),
        _ratio(passed + failed, F.count("*")).alias("valid_rate"),
    )


def all_pass(funcs: DataFrame) -> DataFrame:
    """funcs(file, func, passed): a file passes when it has functions and all of them pass."""
    return funcs.groupBy("file").agg(
        F.count("func").alias("functions"),
        F.count_if(F.col("func").isNotNull() & F.col("passed")).alias("passed_functions"),
        (F.coalesce(F.bool_and(F.when(F.col("func").isNotNull(), F.col("passed"))), F.lit(False))).alias("all_passed"),
    )


def merge_coverage(cov: DataFrame) -> DataFrame:
    """cov(block, hits): a block is covered when any profile hit it; one row of totals."""
    blocks = cov.groupBy("block").agg(F.max(F.col("hits") > 0).alias("covered"))
    covered = F.count_if("covered")
    return blocks.agg(
        F.count("*").alias("total"),
        covered.alias("covered"),
        F.round(_ratio(covered * 100, F.count("*")), 2).alias("percent"),
    )


def dedup_profile(cov: DataFrame) -> DataFrame:
    """Merged profile rows (block, 1, covered as 0/1)."""
    return cov.groupBy("block").agg(F.lit(1).alias("stmts"), F.max(F.when(F.col("hits") > 0, 1).otherwise(0)).alias("hits"))


def coverage_ratio(df: DataFrame, col: str, kind: str, project: str | None = None) -> DataFrame:
    """coverage and validrate of each printed report; null where the report lacks the lines."""
    t = report_totals(F.col(col), kind)
    total = t["total"]
    if kind == "python":
        lines = F.create_map(*[F.lit(x) for kv in R.PYTHON_PROJECT_LINES.items() for x in kv])
        name = F.col(project) if project else F.lit("")
        total = F.when(total.isNotNull(), F.coalesce(lines[name], F.lit(R.PYTHON_DEFAULT_LINES)))

    def rate(part: Column, whole: Column) -> Column:
        return F.when(part.isNotNull() & whole.isNotNull(), _ratio(part, whole))

    return df.withColumn("coverage", rate(t["covered"], total)).withColumn("validrate", rate(t["passed"], t["files"]))


# ---- mutation: mutants(test, target, module, operator, lineno, status) ----


def _mutants(mutants: DataFrame) -> DataFrame:
    status = F.lower(F.coalesce("status", F.lit("")))
    return mutants.withColumn("module", F.coalesce("module", "target")).filter("module is not null").withColumn("status", status)


def mutation_by_module(mutants: DataFrame) -> DataFrame:
    """Distinct eligible (operator, lineno) per module and how many any test killed."""
    ids = (
        _mutants(mutants).filter("status <> 'incompetent'")
        .groupBy("module", "operator", "lineno")
        .agg(F.max(F.col("status") == "killed").alias("killed"))
    )
    return ids.groupBy("module").agg(F.count("*").alias("eligible"), F.count_if("killed").alias("killed"))


def mutation_score(mutants: DataFrame) -> DataFrame:
    return mutation_by_module(mutants).agg(
        F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible"),
        F.coalesce(F.sum("killed"), F.lit(0)).alias("killed"),
        F.round(F.coalesce(_ratio(F.sum("killed") * 100, F.sum("eligible")), F.lit(0.0)), 2).alias("score"),
    )


def mutation_per_test(mutants: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Mutants of each test; with reported(test, score) also the score its own report states, null where it states none."""
    status = F.lower(F.coalesce("status", F.lit("")))
    counted = mutants.groupBy("test").agg(
        F.count("*").alias("mutants"),
        F.count_if(status != "incompetent").alias("total"),
        F.count_if(status == "killed").alias("killed"),
    )
    if reported is None:
        return counted
    scores = reported.groupBy("test").agg(F.min("score").alias("reported_score"))
    return counted.join(scores, "test", "left")


# ---- experiment runs: runs(project, model, baseline, target_type, folder, coverage, validrate, error) ----


def run_matrix(runs: DataFrame, metric: str, baselines: Sequence[str], main: str, models: Sequence[str] = R.MODEL_ORDER) -> DataFrame:
    """Mean metric of error-free runs, one row per project and model, one column per baseline.

    A baseline's value comes from its final runs, or from its codes runs when it has no final run at all;
    `<main>-nofix` holds the main baseline's initial runs.
    """
    ok = F.col("error").isNull() & F.col(metric).isNotNull()
    cells = runs.groupBy("project", "model", "baseline", "target_type").agg(
        F.avg(F.when(ok, F.col(metric))).alias("v"), F.count("*").alias("n")
    )
    by_type = cells.groupBy("project", "model", "baseline").pivot("target_type", ["initial", "final", "codes"]).agg(
        F.first("v").alias("v"), F.first("n").alias("n")
    )
    final = by_type.select("project", "model", "baseline", F.when(F.col("final_n") > 0, F.col("final_v")).otherwise(F.col("codes_v")).alias("v"))
    nofix = by_type.filter(F.col("baseline") == main).select("project", "model", F.lit(f"{main}-nofix").alias("baseline"), F.col("initial_v").alias("v"))
    wide = final.unionByName(nofix).groupBy("project", "model").pivot("baseline", [*baselines, f"{main}-nofix"]).agg(F.first("v"))
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    short = F.create_map(*[F.lit(x) for kv in R.MODEL_SHORT.items() for x in kv])
    name = F.concat_ws("-", F.regexp_replace("project", "commons-", ""), F.coalesce(short[F.col("model")], F.col("model")))
    return wide.withColumn("row_id", name).withColumn("model_ord", F.when(place == 0, 999).otherwise(place - 1).cast("int"))


def check_repeats(runs: DataFrame, n: int = 5) -> DataFrame:
    """Combinations that do not have exactly n runs."""
    return runs.groupBy("project", "model", "baseline", "target_type").agg(F.count("*").alias("runs")).filter(F.col("runs") != n)


# ---- fix attempts: attempts(test, round, result, ...) ----


def fix_history(attempts: DataFrame) -> DataFrame:
    """One row: tests, rounds, pass and fail rounds, and tests whose last round passes."""
    per_test = attempts.groupBy("test").agg(
        F.count("*").alias("n"), F.count_if(F.col("result") == "pass").alias("p"), F.max_by("result", "round").alias("last")
    )
    return per_test.agg(
        F.count("*").alias("tests"),
        F.sum("n").alias("rounds"),
        F.sum("p").alias("pass_rounds"),
        F.sum(F.col("n") - F.col("p")).alias("other_rounds"),
        F.count_if(F.col("last") == "pass").alias("passing_tests"),
        F.round(_ratio(F.count_if(F.col("last") == "pass") * 100, F.count("*")), 1).alias("success_rate"),
    )


def last_result(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("test").agg(F.max_by("result", "round").alias("last_result"), F.count("*").alias("rounds"))


def first_success(attempts: DataFrame) -> DataFrame:
    """First passing attempt of each test that has one."""
    return first_per_key(attempts.filter("result = 'pass'"), ["test"], ["round"])


# ---- categories: ev(ord, test, decision, big, small, summary) ----


def _with_share(counts: DataFrame, total: DataFrame) -> DataFrame:
    return counts.withColumn("percent", F.round(F.col("tests") * 100 / total.scalar(), 1))


def category_rollup(ev: DataFrame) -> DataFrame:
    """Counts and share by big category, by small category within it, and by action label, in one pass."""
    total = ev.agg(F.count("*"))
    fine = ev.groupBy("big", "small", action_label(F.col("decision")).alias("action")).agg(F.count("*").alias("tests"))
    level = F.when(F.grouping("action") == 0, "action").when(F.grouping("small") == 0, "small").otherwise("big")
    sets = fine.groupingSets([["big"], ["big", "small"], ["action"]], "big", "small", "action").agg(level.alias("level"), F.sum("tests").alias("tests"))
    return _with_share(sets.select("level", "big", "small", "action", "tests"), total)


def tests_by_category(ev: DataFrame) -> DataFrame:
    """Tests of each small category with their place in the report, as rows: a category may hold any number of tests.

    The report is range-sorted; places come from the sorted ranges' sizes, not from one window over all rows."""
    rows = ev.select("big", "small", "test")
    return ranked_rows(rows, ["big", "small", "test"], "place")


def prefix_freq(ev: DataFrame, col: str = "summary", n: int = 50) -> DataFrame:
    """Occurrences and first position of the lower-cased first n characters."""
    key = F.substring(F.lower(F.col(col)), 1, n).alias("prefix")
    return ev.groupBy(key).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def category_stats(cat: DataFrame) -> DataFrame:
    """cat(big, small): small categories per big one; a big category may have none (small null)."""
    return cat.groupBy("big").agg(F.count_distinct("small").alias("smalls"))


def category_totals_row(cat: DataFrame) -> DataFrame:
    return category_stats(cat).agg(F.count("*").alias("bigs"), F.sum("smalls").alias("smalls"))


def duration_minutes(ev: DataFrame, ts: str = "ts") -> DataFrame:
    """Whole minutes, rounded, between the first and the last event."""
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 60_000_000
    return ev.agg(F.round(span, 0).cast("long").alias("minutes"))


# ---- terms, definitions, tasks, documents ----


def merge_terms(terms: DataFrame, focal: str = "focal") -> DataFrame:
    """terms(fn, name, ord, need_definition, need_example, focal): flags OR-ed per name, the focal method
    and names without any need removed."""
    return (
        terms.groupBy("fn", "name")
        .agg(
            F.bool_or("need_definition").alias("need_definition"),
            F.bool_or("need_example").alias("need_example"),
            F.min("ord").alias("ord"),
            F.max(focal).alias("__focal"),
        )
        .filter((F.col("need_definition") | F.col("need_example")) & (F.col("name") != F.col("__focal")))
        .drop("__focal")
    )


def def_counts(defs: DataFrame, by: str = "token") -> DataFrame:
    """Distinct definition positions per token: defs(token, uri, line, ch)."""
    places = defs.groupBy(by, "uri", "line", "ch").agg(F.lit(1).alias("one"))
    return places.groupBy(by).agg(F.count("*").alias("definitions"))


def def_sketches(defs: DataFrame, log: str, by: str = "token", precision: int = 14) -> DataFrame:
    """One sketch of the distinct definition positions per log and token: (log, token, sketch), to be kept and merged."""
    place = F.concat_ws("\u0001", "uri", F.col("line").cast("string"), F.col("ch").cast("string"))
    return defs.groupBy(log, by).agg(F.hll_sketch_agg(place, precision).alias("sketch"))


def merged_def_counts(sketches: DataFrame, by: str = "token") -> DataFrame:
    """Estimated distinct definition positions per token over any number of logs, from their sketches alone.

    With precision 14 the estimate lies within 3 % of the exact number in all but rare cases."""
    return sketches.groupBy(by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("definitions"))


def size_sketches(tasks: DataFrame, log: str, by: str, size: str) -> DataFrame:
    """One quantile sketch of an integer size per log and group: (log, by, sketch, n), to be kept and merged."""
    value = F.col(size).cast("long")
    return tasks.groupBy(log, by).agg(F.call_function("kll_sketch_agg_bigint", value, F.lit(400)).alias("sketch"), F.count(value).alias("n"))


def merged_size_profile(sketches: DataFrame, by: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Group size and estimated quantiles from the sketches of any number of logs; a quantile's rank is off by 1 % at most
    in all but rare cases. The sketches of a group are folded pairwise: one row per log."""
    folded = sketches.groupBy(by).agg(F.sum("n").alias("n"), F.collect_list("sketch").alias("all"))
    merged = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.call_function("kll_sketch_merge_bigint", a, b))
    cols = [F.call_function("kll_sketch_get_quantile_bigint", F.col("one"), F.lit(float(q))).alias(f"p{int(q * 100)}") for q in quantiles]
    return folded.withColumn("one", merged).select(by, "n", *cols)


def need_filter(tokens: DataFrame, max_terms: int, by: str = "fn") -> DataFrame:
    """Distinct words per function and whether they exceed what a prompt may list unfiltered."""
    words = tokens.groupBy(by, "word").agg(F.lit(1).alias("one"))
    return words.groupBy(by).agg(F.count("*").alias("words")).withColumn("filter_terms", F.col("words") > max_terms)


def size_profile(tasks: DataFrame, by: str, size: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Group size, least and largest size, and exact (discrete) quantiles of an integer size.

    Equal sizes are counted first, so the ordered scan is as long as the range of sizes, not the group.
    """
    counts = tasks.groupBy(by, size).agg(F.count("*").alias("__n"))
    seen = running(counts, [by], size, [Run("__cum", "sum", F.col("__n"))])
    total = counts.groupBy(by).agg(F.sum("__n").alias("n"))
    reached = attach(seen, total, [by])
    cols = [F.min(F.when(F.col("__cum") >= F.col("n") * p, F.col(size))).alias(f"p{int(p * 100)}") for p in quantiles]
    return reached.groupBy(by).agg(F.max("n").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), *cols)


def lang_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("lang").agg(F.count("*").alias("files"))


def token_totals(df: DataFrame, text: str, prefix: str = "", counter=None) -> DataFrame:
    """Files, total and mean tokens; `prefix` is the fixed system prompt put before every text."""
    whole = F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))
    tokens = counter(whole) if counter else estimated_tokens(whole)
    return df.select(tokens.alias("t")).agg(F.count("*").alias("files"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.avg("t").alias("avg_tokens"))


def experiment_summary(results: DataFrame, costs: DataFrame) -> DataFrame:
    """results(success, warnings, time_ms), costs(ord, cost): outcome counts, time, and cost spent."""
    left = results.agg(
        F.count("*").alias("tasks"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("success") & (F.col("warnings") > 0)).alias("with_warnings"),
        F.sum("time_ms").alias("time_ms"),
    )
    spent = costs.agg((F.max_by("cost", "ord") - F.min_by("cost", "ord")).alias("spent"))
    billed = costs.agg(F.sum("cost").alias("billed"))
    return left.withColumn("spent", spent.scalar()).withColumn("billed", billed.scalar())


def invert(df: DataFrame, key: str, values: str) -> DataFrame:
    """Inverted index of an array column as distinct (value, key) rows."""
    return df.select(F.explode(values).alias("value"), key).distinct()


def compact_children(edges: DataFrame) -> DataFrame:
    """edges(parent, name, uri, ord): equal children once, labelled with their count."""
    n = F.col("n")
    label = F.when(n > 1, F.concat("name", F.lit(" ×"), n.cast("string"))).otherwise(F.col("name"))
    return edges.groupBy("parent", "name", "uri").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).withColumn("label", label)


def minimize_paths(paths: DataFrame) -> DataFrame:
    """paths(fn, path_id, conds): keep a path when it brings a constraint no earlier path of its function has.

    Equivalent to the sequential rule: a skipped path adds nothing to the seen set, so a path is kept
    exactly when it is the first holder of one of its constraints.
    """
    held = paths.select("fn", "path_id", F.explode(F.array_distinct("conds")).alias("c")).filter("c <> ''")
    firsts = held.groupBy("fn", "c").agg(F.min("path_id").alias("path_id")).select("fn", "path_id").distinct()
    return paths.join(firsts, ["fn", "path_id"], "left_semi")
