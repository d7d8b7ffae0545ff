"""Queries for ordered operators and sorted heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.conditions import complexity
from ..operators import aggregates as A
from ..operators import topk as T
from ..operators import windows as W
from .core import query


@query(
    "w1_dedup_first", "v_diag",
    "select message, severity, min(ord) ord, arg_min(file, ord) file from v_diag group by message, severity",
)
def _(spark, sf):
    return W.dedup_first(V.v_diag(spark, sf), ["message", "severity"], ["ord"]).select("message", "severity", "ord", "file")


@query(
    "w2_next_bound", "v_ival",
    """select uri, name, ord, s, e, coalesce(lead(s) over (partition by uri order by s, ord), max(e) over (partition by uri)) bound from v_ival""",
)
def _(spark, sf):
    return W.next_bound(V.v_ival(spark, sf))


def _merge_sql(gap: int) -> str:
    return f"""with p as (select *, max(e) over (partition by uri order by s, ord rows between unbounded preceding and 1 preceding) pe from v_ival),
    i as (select *, sum(case when pe is null or s > pe + {gap} then 1 else 0 end) over (partition by uri order by s, ord rows unbounded preceding) g from p)
    select uri, min(s) start, max(e) as "end", count(*) ranges from i group by uri, g"""


@query("w3_merge_intervals", "v_ival", _merge_sql(1))
def _(spark, sf):
    return W.merge_intervals(V.v_ival(spark, sf), ["uri"])


@query("w3_merge_overlapping", "v_ival", _merge_sql(0))
def _(spark, sf):
    return W.merge_intervals(V.v_ival(spark, sf), ["uri"], gap=0)


@query(
    "w3_merge_contexts", "v_ival",
    """with d as (select *, row_number() over (partition by uri, name order by s, e desc, ord) rn from v_ival), k as (select * from d where rn = 1),
    p as (select *, max(e) over (partition by uri order by s, ord rows between unbounded preceding and 1 preceding) pe from k),
    i as (select *, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by uri order by s, ord rows unbounded preceding) g from p)
    select uri, name, s, e, ord, min(s) over (partition by uri, g) start, max(e) over (partition by uri, g) as "end" from i""",
)
def _(spark, sf):
    return W.merge_contexts(V.v_ival(spark, sf))


CONTAINED = """with l as (select *, row_number() over (partition by uri, s order by e desc, ord) rn from v_ival), d as (select uri, name, s, e, ord from l where rn = 1),
    p as (select *, max(e) over (partition by uri order by s rows between unbounded preceding and 1 preceding) pe from d),
    k as (select uri, name, s, e, ord from p where pe is null or e > pe)"""


@query("w4_drop_contained", "v_ival", f"{CONTAINED} select * from k")
def _(spark, sf):
    return W.drop_contained(V.v_ival(spark, sf), ["uri"])


@query("w5_gap_marks", "v_ival", f"{CONTAINED} select *, coalesce(s > lag(e) over (partition by uri order by s) + 1, false) gap from k")
def _(spark, sf):
    return W.gap_marks(W.drop_contained(V.v_ival(spark, sf), ["uri"]), ["uri"])


@query(
    "w6_take_prefix_budget", "v_ival",
    """with z as (select *, case when s % 5 = 0 then null when s % 7 = 0 then 0 else e - s + 1 end size from v_ival),
    r as (select *, sum(coalesce(size, 0)) over (partition by uri order by e - s, ord rows unbounded preceding) running_size from z)
    select uri, name, s, e, ord, size, cast(running_size as bigint) running_size from r where running_size <= 200""",
)
def _(spark, sf):
    rows = V.v_ival(spark, sf)
    n = F.col("s")
    rows = rows.withColumn("size", F.when(n % 5 == 0, None).when(n % 7 == 0, 0).otherwise(F.col("e") - F.col("s") + 1))
    return W.take_prefix_budget(rows, ["uri"], [F.col("e") - F.col("s"), F.col("ord")], "size", 200)


MARKS = """with m as (select *, contains(text, 'qu') st, contains(text, 'th') and not contains(text, 'qu') en from v_line)"""


@query(
    "w7_section", "v_line",
    MARKS + """, w as (select *, max(case when st then n end) over (partition by doc_id order by n) o, max(case when en then n end) over (partition by doc_id order by n) c from m)
    select doc_id, n, text from w where o < n and coalesce(c, -1) < o""",
)
def _(spark, sf):
    start, end = F.col("text").contains("qu"), F.col("text").contains("th")
    return W.section(V.v_line(spark, sf), ["doc_id"], start, end)


@query(
    "w7_section_first", "v_line",
    MARKS.replace("contains(text, 'th') and not contains(text, 'qu') en", "contains(text, 'th') en")
    + """, o as (select doc_id, min(n) o from m where st group by doc_id), c as (select m.doc_id, min(n) c from m join o using (doc_id) where en and n > o group by m.doc_id)
    select m.doc_id, m.n, m.text from m join o on o.doc_id = m.doc_id left join c on c.doc_id = m.doc_id where n > o and (c is null or n < c) and not st""",
)
def _(spark, sf):
    start, end = F.col("text").contains("qu"), F.col("text").contains("th")
    return W.section(V.v_line(spark, sf), ["doc_id"], start, end, first_only=True)


@query(
    "w8_block_lines", "v_line",
    """with t as (select doc_id, n, case n % 7 when 1 then 'import (' when 5 then ')' when 2 then '"' || trim(text) || '"' when 3 then '// x' else trim(text) end as text from v_line),
    m as (select *, starts_with(text, 'import (') st, text = ')' en from t),
    w as (select *, max(case when st then n end) over (partition by doc_id order by n) o, max(case when en then n end) over (partition by doc_id order by n) c from m)
    select doc_id, n, regexp_replace(text, '^"+|"+$', '', 'g') as name from w
    where o < n and coalesce(c, -1) < o and text <> '' and not starts_with(text, '//') and regexp_replace(text, '^"+|"+$', '', 'g') <> ''""",
)
def _(spark, sf):
    n, t = F.col("n") % 7, F.trim("text")
    text = F.when(n == 1, "import (").when(n == 5, ")").when(n == 2, F.concat(F.lit('"'), t, F.lit('"'))).when(n == 3, "// x").otherwise(t)
    return W.block_lines(V.v_line(spark, sf).withColumn("text", text), ["doc_id"])


RUNNING = """with f as (select *, case when row_number() over (partition by big order by ord) = 1 then 1 else 0 end nb,
      case when row_number() over (partition by big, small order by ord) = 1 then 1 else 0 end ns from v_cat),
    r as (select ord, nb, ns, sum(nb) over (order by ord) b, sum(ns) over (order by ord) s from f)"""


@query(
    "w9_running_distinct", "v_cat",
    RUNNING + "select ord, cast(b as bigint) big_after, cast(s as bigint) small_after, cast(b - nb as bigint) big_before, cast(s - ns as bigint) small_before from r",
)
def _(spark, sf):
    out = W.running_distinct(V.v_cat(spark, sf).select("ord", "big", "small"), dense=True)
    return out.select("ord", "big_after", "small_after", "big_before", "small_before")


@query(
    "w9_running_distinct_by_time",
    sql="""with e as (select event_type || '-' || user_id % 3 big, epoch_us(ts) * 1000 + event_id % 1000 ord, value > 50 small from events),
    u as (select *, row_number() over (partition by ord order by big, small) c from e), f as (select *, case when row_number() over (partition by big order by ord) = 1 then 1 else 0 end nb,
      case when row_number() over (partition by big, small order by ord) = 1 then 1 else 0 end ns from u where c = 1)
    select ord, cast(sum(nb) over (order by ord) as bigint) big_after, cast(sum(ns) over (order by ord) as bigint) small_after from f""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events")
    big = F.concat("event_type", F.lit("-"), (F.col("user_id") % 3).cast("string"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select(big.alias("big"), (micros * 1000 + F.col("event_id") % 1000).alias("ord"), (F.col("value") > 50).alias("small"))
    first = rows.groupBy("ord").agg(F.min(F.struct("big", "small")).alias("r")).select("r.*", "ord")
    return W.running_distinct(first).select("ord", "big_after", "small_after")


DELTAS = "select user_id doc, event_id ord, case when k % 3 = 0 then k % 5 else 0 end d_line, k d_char from (" + V.EVENTS + ")"


@query(
    "w10_delta_decode",
    sql=f"""with t as ({DELTAS}), a as (select *, sum(d_line) over (partition by doc order by ord) line, sum(case when d_line > 0 then 1 else 0 end) over (partition by doc order by ord) g from t)
    select doc, ord, d_line, d_char, cast(line as bigint) line, cast(sum(d_char) over (partition by doc, g order by ord) as bigint) ch from a""",
)
def _(spark, sf):
    e = V.events(spark, sf)
    k = F.col("k")
    t = e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), F.when(k % 3 == 0, k % 5).otherwise(0).alias("d_line"), k.alias("d_char"))
    return W.delta_decode(t, "doc", "ord")


@query(
    "w11_prune_to_mean", "v_ival",
    """with m as (select uri fn, ord path_id, e - s len, avg(e - s) over (partition by uri) mean from v_ival),
    r as (select *, row_number() over (partition by fn order by round(abs(len - mean), 9), path_id) rn from m) select fn, path_id, len from r where rn <= 10""",
)
def _(spark, sf):
    p = V.v_ival(spark, sf).select(F.col("uri").alias("fn"), F.col("ord").alias("path_id"), (F.col("e") - F.col("s")).alias("len"))
    return W.prune_to_mean(p)


@query(
    "w12_unique_names",
    # every seventh name carries a number of its own, so plain numbering would clash with it
    sql="""with p as (select p_partkey, p_brand || case when p_partkey % 7 = 0 then '_' || (p_partkey % 5 + 1) else '' end || '.go' nm from part),
    r as (select p_partkey, nm, regexp_extract(nm, '^(.*?)\\.go$', 1) stem, row_number() over (partition by lower(nm) order by p_partkey) - 1 i from p),
    u as (select distinct lower(regexp_replace(stem, '_[1-9][0-9]*$', '')) b, cast(regexp_extract(stem, '_([1-9][0-9]*)$', 1) as bigint) k from r where regexp_matches(stem, '_[1-9][0-9]*$')),
    j as (select b, k, row_number() over (partition by b order by k) - 1 j from u)
    select p_partkey, stem || case when i > 0 then '_' || (i + (select count(*) from j where j.b = lower(r.stem) and j.k - j.j <= r.i)) else '' end || '.go' unique_name from r""",
)
def _(spark, sf):
    k = F.col("p_partkey")
    name = F.concat("p_brand", F.when(k % 7 == 0, F.concat(F.lit("_"), (k % 5 + 1).cast("string"))).otherwise(""), F.lit(".go"))
    return W.unique_names(V.table(spark, sf, "part").select("p_partkey", name.alias("nm")), "nm", "p_partkey").select("p_partkey", "unique_name")


@query(
    "w13_round_delta", "v_diag",
    """with c as (select file, round, count(*) remaining from v_diag group by file, round)
    select *, coalesce(lag(remaining) over (partition by file order by round) - remaining, 0) fixed from c""",
)
def _(spark, sf):
    return W.round_delta(V.v_diag(spark, sf))


@query("w14_numbered_locations", "v_diag", "select message, ord, line, row_number() over (partition by message order by ord) idx from v_diag")
def _(spark, sf):
    return W.numbered_locations(V.v_diag(spark, sf).select("message", "ord", "line"))


@query(
    "t1_topk_messages", "v_diag",
    "select message, count(*) frequency, min(ord) first_ord from v_diag group by message order by frequency desc, first_ord limit 10",
)
def _(spark, sf):
    freq = V.v_diag(spark, sf).groupBy("message").agg(F.count("*").alias("frequency"), F.min("ord").alias("first_ord"))
    return T.topk(freq, "frequency", 10, "first_ord")


@query(
    "t1_topk_per_level", "v_diag",
    """with s as (select file, message, count(distinct round) n from v_diag group by all), p as (select message, max(n) persistence from s group by message),
    l as (select message, persistence, case when persistence >= 4 then 'very_hard' when persistence = 3 then 'hard' when persistence = 2 then 'moderate' else 'easy' end level from p),
    r as (select *, row_number() over (partition by level order by persistence desc, message) rn from l) select message, persistence, level, cast(rn as int) rn from r where rn <= 5""",
)
def _(spark, sf):
    return T.topk_per_group(A.difficulty(V.v_diag(spark, sf)), ["level"], "persistence", 5, "message")


@query("t2_recent", "v_cat", "select ord, test, big, small from v_cat order by ord desc limit 10")
def _(spark, sf):
    return T.recent(V.v_cat(spark, sf), "ord", 10).select("ord", "test", "big", "small")


@query(
    "t3_rank_references",
    sql="""select page_id, symbol, uri, s, e, cast(row_number() over (partition by symbol order by page_id % 3 = 0 desc, e - s, page_id) as int) rank
    from (select page_id, page_id % 50 symbol, url || case when page_id % 3 = 0 then '/test/x' else '' end uri, 0 s, cast(page_id % 17 as int) e from pages)""",
)
def _(spark, sf):
    p = V.table(spark, sf, "pages")
    n = F.col("page_id")
    rows = p.select("page_id", (n % 50).alias("symbol"), F.concat("url", F.when(n % 3 == 0, "/test/x").otherwise("")).alias("uri"), F.lit(0).alias("s"), (n % 17).cast("int").alias("e"))
    return T.rank_references(rows, tie=["page_id"])


@query(
    "t6_tree_order",
    sql="""with p as (select doc_id, string_split(source || '/' || lang || '/f' || doc_id, '/') a from documents),
    s as (select distinct unnest([struct_pack(parent := '', name := a[1], is_dir := true), struct_pack(parent := a[1], name := a[2], is_dir := true),
      struct_pack(parent := a[1] || '/' || a[2], name := a[3], is_dir := false)]) x from p)
    select x.parent, x.name, x.is_dir, cast(row_number() over (partition by x.parent order by x.is_dir desc, x.name) as int) rank from s""",
)
def _(spark, sf):
    from ..operators.graph import path_hierarchy

    docs = V.table(spark, sf, "documents")
    paths = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("path"))
    return T.tree_order(path_hierarchy(paths)).select("parent", "name", "is_dir", "rank")


@query(
    "t7_rank_conditions",
    sql="""with c as (select c_mktsegment fn, 'x' || c_custkey || ' > ' || c_nationkey || case when c_custkey % 3 = 0 then ' && y > 1' else '' end condition,
      cast(c_nationkey as int) depth, case when c_custkey % 3 = 0 then 6 else 1 end complexity from customer)
    select *, cast(row_number() over (partition by fn order by complexity, depth, condition) as int) rank from c""",
)
def _(spark, sf):
    c = V.table(spark, sf, "customer")
    cond = F.concat(F.lit("x"), F.col("c_custkey").cast("string"), F.lit(" > "), F.col("c_nationkey").cast("string"))
    cond = F.concat(cond, F.when(F.col("c_custkey") % 3 == 0, " && y > 1").otherwise(""))
    rows = c.select(F.col("c_mktsegment").alias("fn"), cond.alias("condition"), F.col("c_nationkey").cast("int").alias("depth")).withColumn("complexity", complexity(F.col("condition")))
    return T.rank_conditions(rows)


@query(
    "t8_min_path", "v_token",
    """with p as (select split_part(uri, ':', 1) fn, uri path_id, count(distinct type || (line % 3)) n_cond, count(distinct line) n_code from v_token group by 1, 2),
    c as (select distinct split_part(uri, ':', 1) fn, uri path_id, type || (line % 3) condition from v_token),
    r as (select c.fn, condition, n_cond, n_code, p.path_id, row_number() over (partition by c.fn, condition order by n_cond, n_code, p.path_id) rn from c join p using (path_id))
    select fn, condition, n_cond, n_code, path_id from r where rn = 1""",
)
def _(spark, sf):
    t = V.v_token(spark, sf)
    # one path per conversation turn: its arrays are bounded by the turn's own text
    paths = t.groupBy(F.substring_index("uri", ":", 1).alias("fn"), F.col("uri").alias("path_id")).agg(
        F.collect_set(F.concat("type", (F.col("line") % 3).cast("string"))).alias("conds"), F.collect_set("line").alias("code")
    )
    return T.min_path(paths).withColumn("n_cond", F.col("n_cond").cast("long")).withColumn("n_code", F.col("n_code").cast("long"))


@query(
    "t9_pick_block",
    sql="select conv_id, turn, case when turn % 2 = 0 then 'py ' || role else 'long text ' || role end block from conversations",
)
def _(spark, sf):
    from ..functions.text import fenced_blocks, pick_block

    c = V.table(spark, sf, "conversations")
    answer = F.concat(
        F.lit("intro\n```go\ns\n```\n"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```Python\npy "), "role", F.lit("\n```\n"))).otherwise(""),
        F.lit("```\nlong text "), "role", F.lit("\n```\n"),
    )
    return c.select("conv_id", "turn", pick_block(fenced_blocks(answer), "python").alias("block"))
