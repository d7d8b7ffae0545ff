"""Queries for projections, filters and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import rules as R
from ..functions.classify import classify_error, classify_ordered, is_unclear, map_stage
from ..operators import predicates as P
from ..operators import retrieval as K
from .aggregates import classify_sql, unclear_sql
from .core import query


def _classify_query(preset: str) -> None:
    @query(f"p1_classify_{preset}", "v_diag", f"select ord, {classify_sql(preset, 'message')} category from v_diag")
    def _(spark, sf):
        return classify_ordered(V.v_diag(spark, sf), "message", preset).select("ord", "category")


for _preset in R.PRESETS:
    _classify_query(_preset)


@query("p1_classify_documents", sql=f"select doc_id, {classify_sql('seven', 'text')} category from documents")
def _(spark, sf):
    return classify_ordered(V.wide_table(spark, sf, "documents", "doc_id", "text"), "text").select("doc_id", "category")


@query("p2_is_unclear", "v_diag", f"select ord, {unclear_sql('message')} unclear from v_diag")
def _(spark, sf):
    return V.v_diag(spark, sf).select("ord", is_unclear(F.col("message")).alias("unclear"))


@query("p3_drop_prefixed", "v_diag", "select ord, message from v_diag where not starts_with(message, 'The error messages are:') and not starts_with(message, '```')")
def _(spark, sf):
    return P.drop_prefixed(V.v_diag(spark, sf), "message").select("ord", "message")


@query(
    "p4_filter_diagnostics", "v_diag",
    """select ord, severity, lang, message from v_diag where case when lang = 'python' then severity <= 1 and not contains(message, 'is not accessed') else severity < 1 end""",
)
def _(spark, sf):
    return P.filter_diagnostics(V.v_diag(spark, sf)).select("ord", "severity", "lang", "message")


DETAILS = (
    "AssertionError: 1 != 2", "ModuleNotFoundError: No module named 'x'", "TypeError: bad", "AttributeError", "ValueError: v",
    "NameError: n", "IndentationError: i", "KeyError: 'k'", "timeout", "ImportError: AssertionError inside",
)


@query(
    "p5_classify_error", "v_exec",
    f"""with d as (select ord, list_extract([{', '.join(V.sql_str(d) for d in DETAILS)}], cast(ord % {len(DETAILS)} as int) + 1) detail from v_exec),
    x as (select *, regexp_extract(detail, '^([A-Z]\\w*Error)', 1) kind from d)
    select ord, detail, case when contains(detail, 'AssertionError') then 'Assertion Errors' when kind = '' then 'Unknown Errors'
      when kind in ('ImportError', 'ModuleNotFoundError') then 'Import Errors' when kind = 'TypeError' then 'Type Errors' when kind = 'AttributeError' then 'Attribute Errors'
      when kind = 'ValueError' then 'Value Errors' when kind = 'NameError' then 'Name Errors' when kind in ('SyntaxError', 'IndentationError') then 'Syntax Errors' else 'Runtime Errors' end status,
    case when contains(detail, 'AssertionError') then 'AssertionError' when kind = '' then 'UnknownError' else kind end error_type from x""",
)
def _(spark, sf):
    detail = F.get(F.array(*[F.lit(d) for d in DETAILS]), (F.col("ord") % len(DETAILS)).cast("int"))
    rows = V.v_exec(spark, sf).select("ord", detail.alias("detail"))
    return rows.select("ord", "detail", classify_error(F.col("detail")).alias("c")).select("ord", "detail", "c.status", "c.error_type")


FOLDERS = ("black", "main", "5_gpt-4o-mini_x", "results", "final"), ("cli", "naive", "gpt-4o", "out", "codes"), ("csv", "other", "run_deepseek-chat", "initial"), ("none", "standard", "gpt-4o-mini_7", "final")


@query(
    "p6_classify_run_path",
    sql=f"""with d as (select o_orderkey id, o_orderkey % {len(FOLDERS)} i from orders)
    select id, case i when 0 then 'black' when 1 then 'cli' when 2 then 'csv' end project,
    case i when 0 then 'gpt-4o-mini' when 1 then 'gpt-4o' when 2 then 'deepseek-chat' else 'gpt-4o-mini' end model,
    case i when 0 then 'main' when 1 then 'naive' when 3 then 'standard' end baseline,
    case i when 0 then 'final' when 1 then 'codes' when 2 then 'initial' else 'final' end target_type from d""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    base = F.get(F.array(*[F.lit("/".join(p)) for p in FOLDERS]), (F.col("o_orderkey") % len(FOLDERS)).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("data/"), base, F.lit("/r"), F.col("o_custkey").cast("string")).alias("path"))
    out = P.classify_run_path(rows, "path", ["black", "cli", "csv"], ["main", "naive", "standard"])
    return out.select("id", "project", "model", "baseline", "target_type")


@query(
    "p7_select_runs", "v_run",
    """select project, model, baseline, target_type, count(*) runs from v_run
    where case when baseline = 'main' then target_type in ('initial', 'final') else target_type in ('final', 'codes') end group by all""",
)
def _(spark, sf):
    kept = P.select_runs(V.v_run(spark, sf), "main")
    return kept.groupBy("project", "model", "baseline", "target_type").agg(F.count("*").alias("runs"))


@query(
    "p8_is_test_path",
    sql="""select page_id, contains(lower(p), '/test/') or contains(lower(p), '/tests/') or contains(lower(p), '/spec/') or contains(lower(p), '/__tests__/')
      or regexp_matches(lower(p), '\\.(test|spec)\\.(js|ts|jsx|tsx)$') is_test
    from (select page_id, url || case page_id % 4 when 0 then '/Test/a.py' when 1 then '/x.spec.ts' when 2 then '/contest.js' else '' end p from pages)""",
)
def _(spark, sf):
    n = F.col("page_id") % 4
    tail = F.when(n == 0, "/Test/a.py").when(n == 1, "/x.spec.ts").when(n == 2, "/contest.js").otherwise("")
    return V.table(spark, sf, "pages").select("page_id", P.is_test_path(F.concat("url", tail)).alias("is_test"))


@query(
    "p9_match_globs",
    sql="""select c_custkey from (select c_custkey, case c_custkey % 3 when 0 then 'd/test_a.py' when 1 then 'test_x/b_test.py' else 'test_d/c.py' end p from customer)
    where regexp_matches(regexp_extract(p, '[^/]*$'), '^(.*_test\\.py|test_.*\\.py)$')""",
)
def _(spark, sf):
    n = F.col("c_custkey") % 3
    path = F.when(n == 0, "d/test_a.py").when(n == 1, "test_x/b_test.py").otherwise("test_d/c.py")
    return V.table(spark, sf, "customer").filter(P.match_globs(path, ["*_test.py", "test_*.py"])).select("c_custkey")


@query("p10_min_span", "v_ival", "select uri, name, s, e, ord from v_ival where e - s >= 20")
def _(spark, sf):
    return P.min_span(V.v_ival(spark, sf), "s", "e", 20)


@query("p10_min_span_first", "v_ival", "select uri, name, s, e, ord from v_ival where e - s >= 20 order by ord limit 50")
def _(spark, sf):
    return P.min_span(V.v_ival(spark, sf), "s", "e", 20, [F.col("ord")], 50)


@query("p11_sample_by_key", sql="select o_orderkey, o_custkey from orders where cast('0x' || substr(md5('12345' || o_orderkey), 1, 8) as ubigint) < cast(floor(0.3 * 4294967296) as ubigint)")
def _(spark, sf):
    return P.sample_by_key(V.table(spark, sf, "orders"), "o_orderkey", 0.3).select("o_orderkey", "o_custkey")


TASKS = """select doc_id, case when doc_id % 3 = 0 then '' else source end symbol, case when doc_id % 5 = 0 then null else lang end path from documents"""


@query(
    "p12_validate_required",
    sql=f"""select doc_id, case when symbol = '' then 'symbol' else '' end || case when symbol = '' and path is null then ',' else '' end
      || case when path is null then 'path' else '' end missing from ({TASKS}) where symbol = '' or path is null""",
)
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("symbol"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("path")
    )
    return P.validate_required(d, ["symbol", "path"])[1].select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("p12_validate_good", sql=f"select * from ({TASKS}) where symbol <> '' and path is not null")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("symbol"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("path")
    )
    return P.validate_required(d, ["symbol", "path"])[0]


@query("p13_filter_status", "v_test", "select file, test, ord from v_test where status = 'Assertion Errors'")
def _(spark, sf):
    return P.filter_status(V.v_test(spark, sf)).select("file", "test", "ord")


@query(
    "p14_similarity_threshold",
    sql="""with c as (select label query_id, list(x order by d) q from (select label, d, avg(v) x from (
        select label, unnest(range(64)) d, unnest(embedding)::double v from embeddings) group by all) group by label)
    select query_id, vec_id, round(list_dot_product(q, embedding::double[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 5) score
    from (select *, list_dot_product(q, embedding::double[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))) s,
      row_number() over (partition by query_id order by round(s, 9) desc, vec_id) rn from c, embeddings) where rn <= 20 and s >= 0.3""",
)
def _(spark, sf):
    emb = V.table(spark, sf, "embeddings")
    asks = K.centroids(emb, "label").select(F.col("label").cast("long").alias("query_id"), "embedding")
    return K.at_least(K.knn(asks, emb, 20, "cosine"), 0.3).select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query(
    "p15_drop_stub_blocks",
    sql="""select doc_id from (select doc_id, string_split(case when doc_id % 2 = 0 then 'a: int' || chr(10) || ' b: Str ' || chr(10) || text else text end, chr(10)) l from documents)
    where len(l) < 2 or len(list_filter(l, lambda x: regexp_matches(trim(x), '(?i)^[a-zA-Z_][a-zA-Z0-9_]*:\\s*(int|str|bool|float|list|dict|set|tuple|any)$'))) / len(l) < 0.5""",
)
def _(spark, sf):
    d = V.wide_table(spark, sf, "documents", "doc_id", "text")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a: int\n b: Str \n"), "text")).otherwise(F.col("text"))
    return P.drop_stub_blocks(d.select("doc_id", text.alias("block")), "block").select("doc_id")


@query("p16_filter_tokens", "v_token", "select id, word, type from v_token where type in ('method', 'class', 'string') and type not in ('string')")
def _(spark, sf):
    return P.filter_tokens(V.v_token(spark, sf), types=["method", "class", "string"], skip=True).select("id", "word", "type")


@query(
    "p16_term_flags", "v_token",
    """select id, length(word) > 4 and case when type in ('method', 'function') then length(word) % 3 <> 0 else type <> 'class' end need_definition, length(word) = 3 need_example from v_token""",
)
def _(spark, sf):
    t = V.v_token(spark, sf)
    detail = F.when(F.length("word") % 3 == 0, "void").otherwise("int")
    d, x = P.cfg_term_flags(F.col("type"), F.length("word") > 4, F.length("word") == 3, detail)
    return t.select("id", d.alias("need_definition"), x.alias("need_example"))


@query(
    "p17_check_code", "v_attempt",
    f"""with c as (select test, round, case when round % 2 = 0 then 'import unittest' || chr(10) || 'class TestA:' || chr(10) || text else '@Test ' || text end code,
      case when round % 2 = 0 then 'Python' else 'java' end lang from v_attempt)
    select test, round, case when lang = 'Python' then contains(code, 'def test_') and length(code) >= 50 else contains(code, 'import org.junit') and length(code) >= 50 end valid,
      concat_ws('|', case when lang = 'Python' and not contains(code, 'def test_') then 'Python test should define test methods (def test_*)' end,
        case when lang = 'java' and not contains(code, 'import org.junit') then 'Java test should import JUnit' end,
        case when length(code) < 50 then '{R.SHORT_CODE}' end) warnings from c""",
)
def _(spark, sf):
    a = V.v_attempt(spark, sf)
    even = F.col("round") % 2 == 0
    code = F.when(even, F.concat(F.lit("import unittest\nclass TestA:\n"), "text")).otherwise(F.concat(F.lit("@Test "), "text"))
    rows = a.select("test", "round", code.alias("code"), F.when(even, "Python").otherwise("java").alias("lang"))
    return P.check_code(rows, "code", "lang").select("test", "round", "valid", F.array_join("warnings", "|").alias("warnings"))


@query(
    "p18_map_stage", "v_log",
    """select case process when 'generateTest' then 'gen' when 'gatherContext-1' then 'def' when 'buildCFG' then 'cfg' when 'FixWithLLM_1' then 'fix' else '-' end stage,
    count(*) n, cast(sum(time_ms) as bigint) time_ms from v_log group by 1""",
)
def _(spark, sf):
    log = V.v_log(spark, sf).withColumn("stage", F.coalesce(map_stage(F.col("process")), F.lit("-")))
    return log.groupBy("stage").agg(F.count("*").alias("n"), F.sum("time_ms").alias("time_ms"))


@query(
    "t4_knn",
    sql="""with c as (select label query_id, list(x order by d) q from (select label, d, avg(v) x from (
        select label, unnest(range(64)) d, unnest(embedding)::double v from embeddings) group by all) group by label),
    s as (select query_id, vec_id, pow(list_distance(q, embedding::double[]), 2) score from c, embeddings),
    r as (select *, row_number() over (partition by query_id order by round(score, 9), vec_id) rn from s)
    select query_id, vec_id, round(score, 5) score, cast(rn as int) rn from r where rn <= 3""",
)
def _(spark, sf):
    emb = V.table(spark, sf, "embeddings")
    asks = K.centroids(emb, "label").select(F.col("label").cast("long").alias("query_id"), "embedding")
    return K.knn(asks, emb, 3).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rn")


@query(
    "t5_prune_context",
    sql="""with recursive ranked as (
      select source query_id, doc_id vec_id, row_number() over (partition by source order by doc_id * 7919 % 10007, doc_id) rn, length(text) len, length(text) // 4 tokens from documents),
    h as (select *, cast(substr(query_id, 4) as bigint) * 400 src from ranked),
    b as (select *, 7500 - src budget from h),
    f as (
      select query_id, 0::bigint rn, 0::bigint used, 0 taken, null::bigint vec_id, 0::bigint toks, false cut from (select distinct query_id from b where budget > 0)
      union all
      select f.query_id, b.rn, case when f.used + b.tokens <= b.budget then f.used + b.tokens when f.taken = 0 and x.n > 0 then f.used + x.n // 4 else f.used end,
        case when f.used + b.tokens <= b.budget or (f.taken = 0 and x.n > 0) then f.taken + 1 else f.taken end,
        case when f.used + b.tokens <= b.budget or (f.taken = 0 and x.n > 0) then b.vec_id end,
        case when f.used + b.tokens <= b.budget then b.tokens else x.n // 4 end, not (f.used + b.tokens <= b.budget)
      from f join b on b.query_id = f.query_id and b.rn = f.rn + 1,
        lateral (select max(n) n from (select cast(floor(b.len / pow(2, unnest(range(1, 32)))) as bigint) n) where n // 4 <= b.budget) x)
    select query_id, taken - 1 pos, vec_id, toks tokens, cut truncated from f where vec_id is not null""",
)
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("vec_id"), "text")
    # an order that has nothing to do with the sizes, so that large texts are skipped and smaller ones follow
    hits = docs.withColumn("score", -(F.col("vec_id") * 7919 % 10007).cast("double")).withColumn("rn", F.col("vec_id"))
    hits = hits.withColumn("source_tokens", F.substring("query_id", 4, 10).cast("long") * 400)
    return K.prune_context(hits, 10_000).select("query_id", "pos", "vec_id", "tokens", "truncated")


