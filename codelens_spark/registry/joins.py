"""Queries for the join and set families."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import joins as J
from ..operators import sets as S
from .core import query


@query(
    "j1_match_tasks",
    sql="""select o_orderkey symbol_name, o_custkey path, o_totalprice, l_partkey from orders join (select l_orderkey, l_suppkey, l_partkey from lineitem) l
    on o_orderkey = l_orderkey and o_custkey = l_suppkey""",
)
def _(spark, sf):
    o, li = V.table(spark, sf, "orders"), V.table(spark, sf, "lineitem")
    symbols = o.select(F.col("o_orderkey").alias("symbol_name"), F.col("o_custkey").alias("path"), "o_totalprice")
    tasks = li.select(F.col("l_orderkey").alias("symbol_name"), F.col("l_suppkey").alias("path"), "l_partkey")
    return J.match_tasks(symbols, tasks)


@query(
    "j1_unmatched_tasks",
    sql="""select c_custkey symbol_name, c_nationkey path from customer c where not exists (select 1 from supplier s where s_suppkey = c_custkey and s_nationkey = c_nationkey)""",
)
def _(spark, sf):
    c, s = V.table(spark, sf, "customer"), V.table(spark, sf, "supplier")
    tasks = c.select(F.col("c_custkey").alias("symbol_name"), F.col("c_nationkey").alias("path"))
    return J.unmatched_tasks(s.select(F.col("s_suppkey").alias("symbol_name"), F.col("s_nationkey").alias("path")), tasks)


TESTS = """select replace(c_mktsegment, ' ', '') || '_f_' || (c_custkey % 9000 + 1000) || '_test.py' test, 'm' || (c_custkey % 40) "method", c_custkey from customer"""
MAPPING = """select replace(c_mktsegment, ' ', '') || '_f_' || (s_suppkey + 50) || '_test.py' test_name, 'm' || (s_suppkey % 60) symbol, s_suppkey ord, 'src/' || s_suppkey || '.py' file_name
  from supplier join (select distinct c_mktsegment, row_number() over (order by c_mktsegment) - 1 i from (select distinct c_mktsegment from customer)) on i = s_suppkey % 4"""


@query(
    "j2_match_normalized",
    sql=f"""with t as ({TESTS}), m as ({MAPPING}), tn as (select *, regexp_replace(regexp_replace(test, '\\.py$', ''), '_\\d+', '', 'g') || '.py' norm from t),
    mn as (select *, regexp_replace(regexp_replace(test_name, '\\.py$', ''), '_\\d+', '', 'g') || '.py' norm from m),
    r as (select tn.c_custkey, tn.test, tn."method", mn.test_name map_name, mn.file_name, mn.symbol,
      row_number() over (partition by tn.c_custkey order by case when mn.symbol = tn."method" then 0 else 1 end, mn.ord) rn from tn left join mn on tn.norm = mn.norm)
    select c_custkey, test, "method", map_name, file_name, symbol from r where rn = 1""",
)
def _(spark, sf):
    c, s = V.table(spark, sf, "customer"), V.table(spark, sf, "supplier")
    seg = F.regexp_replace("c_mktsegment", " ", "")
    tests = c.select(
        F.concat(seg, F.lit("_f_"), (F.col("c_custkey") % 9000 + 1000).cast("string"), F.lit("_test.py")).alias("test"),
        F.concat(F.lit("m"), (F.col("c_custkey") % 40).cast("string")).alias("method"),
        "c_custkey",
    )
    # the market segments are a fixed domain of a few names
    from pyspark.sql import Window

    segs = c.select("c_mktsegment").distinct().withColumn("i", F.row_number().over(Window.orderBy("c_mktsegment")) - 1)
    mapping = s.join(segs, F.col("i") == F.col("s_suppkey") % 4).select(
        F.concat(seg, F.lit("_f_"), (F.col("s_suppkey") + 50).cast("string"), F.lit("_test.py")).alias("test_name"),
        F.concat(F.lit("m"), (F.col("s_suppkey") % 60).cast("string")).alias("symbol"),
        F.col("s_suppkey").alias("ord"),
        F.concat(F.lit("src/"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("file_name"),
    )
    return J.match_normalized(tests, mapping)


@query(
    "j3_longest_prefix_match",
    sql="""with n as (select c_custkey id, 'a' || (c_custkey % 5) || '_b' || (c_custkey % 7) || case when c_custkey % 3 = 0 then '' else '_c' || (c_custkey % 11) end
        || '_' || c_custkey || '_test.py' as name from customer),
    m as (select distinct 'a' || (s_suppkey % 5) || case when s_suppkey % 2 = 0 then '_b' || (s_suppkey % 7) else '' end module from supplier where s_suppkey % 5 <> 4),
    p as (select *, string_split(replace(name, '_test.py', ''), '_') a from n),
    x as (select *, len(a) - 1 cnt from p),
    b as (select x.id, max(len(string_split(module, '_'))) best from x join m on x.cnt > 2 and list_slice(x.a, 1, len(string_split(module, '_'))) = string_split(module, '_')
      and len(string_split(module, '_')) <= x.cnt group by x.id)
    select x.name, array_to_string(list_slice(a, 1, coalesce(best, 1)), '_') module, array_to_string(list_slice(a, coalesce(best, 1) + 1, cnt), '_') function,
      list_extract(a, len(a)) number from x left join b using (id)""",
)
def _(spark, sf):
    c, s = V.table(spark, sf, "customer"), V.table(spark, sf, "supplier")
    k, n = F.col("c_custkey"), F.col("s_suppkey")
    text = lambda col: col.cast("string")
    names = c.select(
        F.concat(
            F.lit("a"), text(k % 5), F.lit("_b"), text(k % 7), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_c"), text(k % 11))), F.lit("_"), text(k), F.lit("_test.py")
        ).alias("name")
    )
    modules = s.filter(n % 5 != 4).select(
        F.concat(F.lit("a"), text(n % 5), F.when(n % 2 == 0, F.concat(F.lit("_b"), text(n % 7))).otherwise("")).alias("module"), n.alias("ord")
    )
    return J.longest_prefix_match(names, modules)


@query(
    "j4_smallest_enclosing", "v_ival",
    """with p as (select distinct uri, s line from v_ival),
    r as (select p.uri, p.line, i.name, i.s, i.e, row_number() over (partition by p.uri, p.line order by i.e - i.s, i.ord) rn
      from p join v_ival i on p.uri = i.uri and p.line between i.s and i.e)
    select uri, line, name, s, e from r where rn = 1""",
)
def _(spark, sf):
    ivals = V.v_ival(spark, sf)
    return J.smallest_enclosing(ivals.select("uri", F.col("s").alias("line")), ivals)


FAR = "select uri, name, ord, (s - 600) * case when s % 2 = 0 then 1 else 8589934592 end s, (e - 600) * case when s % 2 = 0 then 1 else 8589934592 end e from v_ival"


def _far(spark, sf):
    """Intervals on both sides of zero, half of them stretched far beyond 2**31."""
    ivals = V.v_ival(spark, sf)
    stretch = F.when(F.col("s") % 2 == 0, F.lit(1)).otherwise(F.lit(1 << 33))
    place = lambda c: ((F.col(c).cast("long") - 600) * stretch).alias(c)
    return ivals.select("uri", "name", "ord", place("s"), place("e"))


@query(
    "j4_far_and_negative", "v_ival",
    f"""with i as ({FAR}), p as (select distinct uri, s line from i),
    r as (select p.uri, p.line, i.name, i.s, i.e, row_number() over (partition by p.uri, p.line order by i.e - i.s, i.ord) rn
      from p join i on p.uri = i.uri and p.line between i.s and i.e)
    select uri, line, name, s, e from r where rn = 1""",
)
def _(spark, sf):
    ivals = _far(spark, sf)
    return J.smallest_enclosing(ivals.select("uri", F.col("s").alias("line")), ivals)


@query(
    "j5_far_and_negative", "v_ival",
    f"""with i as ({FAR}), p as (select distinct uri, s line from i)
    select p.uri, p.line, count(*) depth, cast(sum(i.s % 1000003) as bigint) starts from p join i on p.uri = i.uri and p.line between i.s and i.e group by 1, 2""",
)
def _(spark, sf):
    ivals = _far(spark, sf)
    points = ivals.select("uri", F.col("s").alias("line")).distinct()
    chain = J.enclosing_chain(points, ivals)
    return chain.groupBy("uri", "line").agg(F.count("*").alias("depth"), F.sum(F.col("s") % 1000003).alias("starts"))


@query(
    "j5_enclosing_chain", "v_nest v_day",
    'select d.uri, d.line, n.name, n.s, n.e, n.s - n.e as "outer" from v_day d join v_nest n on d.uri = n.uri and d.line between n.s and n.e',
)
def _(spark, sf):
    return J.enclosing_chain(V.v_day(spark, sf), V.v_nest(spark, sf))


FOCAL = "select p_partkey uri, p_size * 20 s, p_size * 20 + 60 e from part"
PIECES = f"select l_partkey uri, {V.ROW_ORD} ord, date_diff('day', date '1995-01-01', cast(l_shipdate as date)) s, date_diff('day', date '1995-01-01', cast(l_shipdate as date)) + cast(l_quantity as int) e from lineitem"


def _pieces(spark, sf):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    cols = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    li = V.wide_table(spark, sf, "lineitem", *cols).select(F.col("l_partkey").alias("uri"), V.row_ord().alias("ord"), day.alias("s"), (day + F.col("l_quantity").cast("int")).alias("e"))
    focal = V.table(spark, sf, "part").select(F.col("p_partkey").alias("uri"), (F.col("p_size") * 20).alias("s"), (F.col("p_size") * 20 + 60).alias("e"))
    return li, focal


@query("j6_exclude_inside", sql=f"with f as ({FOCAL}), d as ({PIECES}) select * from d where not exists (select 1 from f where f.uri = d.uri and f.s < d.s and d.e < f.e)")
def _(spark, sf):
    return J.exclude_inside(*_pieces(spark, sf))


@query("j6_exclude_overlap", sql=f"with f as ({FOCAL}), d as ({PIECES}) select * from d where not exists (select 1 from f where f.uri = d.uri and not (d.e < f.s or d.s > f.e))")
def _(spark, sf):
    return J.exclude_overlap(*_pieces(spark, sf))


@query(
    "j1_match_fuzzy",
    sql="""with w as (select distinct p_brand uri, lower(p_type) word from part),
    h as (select w.uri, word, min(p_partkey) ord from w join part on p_brand = w.uri and contains(lower(p_name), word) group by w.uri, word)
    select h.uri, word, ord, p_name as name from h join part on p_partkey = ord""",
)
def _(spark, sf):
    part = V.table(spark, sf, "part")
    symbols = part.select(F.col("p_brand").alias("uri"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    return J.match_fuzzy(symbols, part.select(F.col("p_brand").alias("uri"), F.col("p_type").alias("name")).distinct()).select("uri", "word", "ord", "name")


@query(
    "j7_contains_join",
    sql="""with w as (select distinct unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) word from benchmark)
    select word, count(*) texts from w join documents on contains(text, word) group by word""",
)
def _(spark, sf):
    from ..functions.text import identifiers

    words = V.table(spark, sf, "benchmark").select(F.explode(identifiers(F.col("text"))).alias("word"))
    docs = V.wide_table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("text_id"), "text")
    return J.contains_join(words, docs).groupBy("word").agg(F.count("*").alias("texts"))


@query(
    "j7_contains_any_word",
    sql="""with b as (select unnest(string_split(text, ' ')) w from benchmark union all select left(text, 9) from benchmark
      union all select word from (select unnest(regexp_extract_all(text, '[^\x00-\x7F]+')) word from documents where lang <> 'en')),
    w as (select distinct w word from b where w <> '')
    select word, count(*) texts from w join documents on contains(text, word) group by word""",
)
def _(spark, sf):
    bench = V.table(spark, sf, "benchmark")
    docs = V.wide_table(spark, sf, "documents", "doc_id", "text", "lang")
    # words with punctuation, with blanks inside, and of letters beyond ASCII
    words = (
        bench.select(F.explode(F.split("text", " ")).alias("word"))
        .union(bench.select(F.left("text", F.lit(9))))
        .union(docs.filter("lang <> 'en'").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]+"), F.lit(0)))))
    )
    texts = docs.select(F.col("doc_id").alias("text_id"), "text")
    return J.contains_join(words.distinct(), texts).groupBy("word").agg(F.count("*").alias("texts"))


@query(
    "j7_contains_join_keyed", "v_token",
    """with w as (select distinct split_part(uri, ':', 1) key, word from v_token where type = 'method'),
    t as (select cast(conv_id as varchar) key, turn text_id, text from conversations)
    select w.key, word, text_id from w join t on w.key = t.key and contains(text, word)""",
)
def _(spark, sf):
    words = V.v_token(spark, sf).filter("type = 'method'").select(F.substring_index("uri", ":", 1).alias("key"), "word")
    texts = V.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("text_id"), "text")
    return J.contains_join(words, texts, keyed=True)


@query(
    "j8_propagate_same_line", "v_token",
    """with t as (select *, line % 2 = 0 assign from v_token), m as (select id token_id, word condition from t where type = 'method'),
    l as (select uri, line, arg_min(id, ch) source from t where type = 'method' and assign group by uri, line)
    select distinct token_id, condition from (select * from m union all
      select t.id, m.condition from t join l using (uri, line) join m on m.token_id = l.source where t.assign and t.type <> 'method')""",
)
def _(spark, sf):
    t = V.v_token(spark, sf)
    tokens = t.select("uri", "line", F.col("ch").alias("ord"), F.col("id").alias("token_id"), (F.col("line") % 2 == 0).alias("assign"))
    matched = t.filter("type = 'method'").select(F.col("id").alias("token_id"), F.col("word").alias("condition"))
    return J.propagate_same_line(tokens, matched)


@query(
    "j9_expand_use_def", "v_token",
    """with g as (select * from v_token where word = 'the')
    select distinct uri, id, word from v_token t where exists (select 1 from g where g.uri = t.uri and g.line = t.line)
      or (declared and exists (select 1 from g where g.uri = t.uri))""",
)
def _(spark, sf):
    t = V.v_token(spark, sf)
    return J.expand_use_def(t, t.filter("word = 'the'")).select("uri", "id", "word")


@query(
    "j10_find_redefined", "v_token",
    """with ts as (select uri test, word as name, arg_min(type, id) kind, min(id) id from v_token where split_part(uri, ':', 2) <> '0' group by 1, 2),
    tl as (select t.test, t.name, t.name || '@' || (v.line + 1) || ':' || v.ch test_loc from ts t join v_token v on v.id = t.id where t.kind <> 'variable'),
    ss as (select split_part(uri, ':', 1) uri, word as name, min(id) id from v_token where split_part(uri, ':', 2) = '0' group by 1, 2),
    sl as (select s.uri, s.name, s.uri || '@' || (v.line + 1) || ':' || v.ch source_loc from ss s join v_token v on v.id = s.id)
    select tl.test, tl.name, split_part(tl.test, ':', 1) uri, test_loc, source_loc from tl join sl on sl.uri = split_part(tl.test, ':', 1) and sl.name = tl.name""",
)
def _(spark, sf):
    t = V.v_token(spark, sf)
    turn, conv = F.substring_index("uri", ":", -1), F.substring_index("uri", ":", 1)
    kind = F.when(F.col("type") == "variable", "Variable").otherwise(F.col("type"))
    test = t.filter(turn != "0").select(F.col("uri").alias("test"), F.col("word").alias("name"), kind.alias("kind"), "line", "ch", F.col("id").alias("ord"))
    source = t.filter(turn == "0").select(conv.alias("uri"), F.col("word").alias("name"), "line", "ch", F.col("id").alias("ord"))
    tests = test.select("test", F.substring_index("test", ":", 1).alias("uri")).distinct()
    reach = source.select("name", "uri").distinct().join(tests, "uri")
    return J.find_redefined(reach, source, test)


@query(
    "j11_group_by_parent",
    sql="""with s as (select n_regionkey % 3 uri, n_name as name, case when n_regionkey % 3 <> 2 and n_nationkey % 4 <> 0 then r_name end parent from nation join region on n_regionkey = r_regionkey
      union all select 100 + c_nationkey, c_name, case when c_custkey % 2 = 0 then c_mktsegment end from customer where c_nationkey <> 7
      union all select 100 + c_nationkey, c_name, null from customer where c_nationkey = 7)
    select uri, parent, name child from s where parent is not null union all
    select uri, name, null from s where parent is null and uri not in (select uri from s where parent is not null)""",
)
def _(spark, sf):
    n, r, c = (V.table(spark, sf, t) for t in ("nation", "region", "customer"))
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    kept = (F.col("n_regionkey") % 3 != 2) & (F.col("n_nationkey") % 4 != 0)
    a = j.select((F.col("n_regionkey") % 3).alias("uri"), F.col("n_name").alias("name"), F.when(kept, F.col("r_name")).alias("parent"))
    owned = (F.col("c_nationkey") != 7) & (F.col("c_custkey") % 2 == 0)
    b = c.select((F.col("c_nationkey") + 100).alias("uri"), F.col("c_name").alias("name"), F.when(owned, F.col("c_mktsegment")).alias("parent"))
    return J.group_by_parent(a.unionByName(b))


@query("j12_pending", sql="select o_orderkey, o_custkey from orders o where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 10 and l_discount > 0)")
def _(spark, sf):
    out = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") - 10).alias("log_size"), F.col("l_discount").alias("junit_size")
    )
    return J.pending(V.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), J.finished_outputs(out), ["o_orderkey"])


RANGES = """select doc_id doc, cast(doc_id % 4 as int) s, cast(doc_id % 4 + quality * 2 as int) e, 'm' || (doc_id % 3) message, doc_id * 2 ord from labels
  union all select doc_id, cast(doc_id % 3 as int), cast(doc_id % 3 + toxic as int), 'm' || (doc_id % 5), doc_id * 2 + 1 from labels"""


@query(
    "j13_annotate_lines", "v_line",
    f"""with r as ({RANGES}), g as (select message, min(ord) g from r group by message),
    o as (select l.doc_id, l.n, r.s, r.e, r.message, row_number() over (partition by l.doc_id, l.n order by g.g desc, r.s, r.ord) rn
      from v_line l join r on r.doc = l.doc_id and l.n between r.s and r.e join g using (message)),
    b as (select o.doc_id, o.n, trim(string_agg(trim(l.text, ' ' || chr(9) || chr(13)), chr(10) order by l.n), ' ' || chr(9) || chr(10) || chr(13)) body from o join v_line l on l.doc_id = o.doc_id and l.n between o.s and o.e
      where o.rn = 1 and o.n = o.s group by o.doc_id, o.n)
    select l.doc_id doc, l.n, case when o.message is null then l.text when o.n = o.s then b.body || ' # Error Group: "' || o.message || '"' else '' end as text, o.message
    from v_line l left join o on o.doc_id = l.doc_id and o.n = l.n and o.rn = 1 left join b on b.doc_id = l.doc_id and b.n = l.n""",
)
def _(spark, sf):
    lab = V.table(spark, sf, "labels")
    d = F.col("doc_id")

    def part(mod: int, width, groups: int, shift: int):
        start = (d % mod).cast("int")
        return lab.select(
            d.alias("doc"), start.alias("s"), (start + width).cast("int").alias("e"), F.concat(F.lit("m"), (d % groups).cast("string")).alias("message"), (d * 2 + shift).alias("ord")
        )

    ranges = part(4, F.col("quality") * 2, 3, 0).unionByName(part(3, F.col("toxic"), 5, 1))
    return J.annotate_lines(V.v_line(spark, sf).withColumnRenamed("doc_id", "doc"), ranges)


ORIGIN = """select c_custkey id, 'mod' || (c_custkey % 9) module, 'fn' || (c_custkey % 5) function,
  case c_custkey % 5 when 0 then 'from mod' || (c_custkey % 9) || ' import a, fn' || (c_custkey % 5) || ', b' when 1 then 'import  mod' || (c_custkey % 9)
    when 2 then 'x' || chr(10) || 'def fn' || (c_custkey % 5) || '(a):' when 3 then 'import mod' || (c_custkey % 9) || 'x' else c_name end as text from customer"""


@query(
    "j14_import_origin",
    sql=f"""with d as ({ORIGIN}), x as (select *, regexp_extract(text, 'from\\s+' || module || '\\s+import\\s+.*\\b' || function || '\\b') a, regexp_extract(text, 'import\\s+' || module || '\\b') b from d)
    select id, case when a <> '' or b <> '' then 'imported' when regexp_matches(text, 'def\\s+' || function || '\\b') then 'reimplemented' else 'unknown' end origin,
    case when a <> '' then a when b <> '' then b end import_line, case when a <> '' or b <> '' then module end module_path from x""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    module, fn = F.concat(F.lit("mod"), text(k % 9)), F.concat(F.lit("fn"), text(k % 5))
    body = (
        F.when(k % 5 == 0, F.concat(F.lit("from "), module, F.lit(" import a, "), fn, F.lit(", b")))
        .when(k % 5 == 1, F.concat(F.lit("import  "), module))
        .when(k % 5 == 2, F.concat(F.lit("x\ndef "), fn, F.lit("(a):")))
        .when(k % 5 == 3, F.concat(F.lit("import "), module, F.lit("x")))
        .otherwise(F.col("c_name"))
    )
    rows = V.table(spark, sf, "customer").select(k.alias("id"), module.alias("module"), fn.alias("function"), body.alias("text"))
    return J.import_origin(rows).select("id", "origin", "import_line", "module_path")


@query(
    "u1_reconcile",
    sql="""with e as (select doc_id as name from documents), l as (select doc_id * 2 as name from labels), j as (select doc_id * 3 as name from labels),
    k as (select name from e union select name from l union select name from j),
    f as (select name, name in (select name from e) e, name in (select name from l) l, name in (select name from j) j from k)
    select name, e and not l missing, l and not e orphan, l and not j without_junit, j and not l without_log from f
    where (e and not l) or (l and not e) or (l and not j) or (j and not l)""",
)
def _(spark, sf):
    lab = V.table(spark, sf, "labels")
    return S.reconcile(
        V.table(spark, sf, "documents").select(F.col("doc_id").alias("name")),
        lab.select((F.col("doc_id") * 2).alias("name")),
        lab.select((F.col("doc_id") * 3).alias("name")),
    )


@query(
    "u2_difference", "v_diag",
    """select file, message from v_diag except select d.file, d.message from v_diag d join (select file, max(round) m from v_diag group by file) l on d.file = l.file and d.round = l.m""",
)
def _(spark, sf):
    d = V.v_diag(spark, sf)
    last = d.groupBy("file").agg(F.max("round").alias("round"))
    return S.difference(d, d.join(last, ["file", "round"], "left_semi"), ["file", "message"])


@query(
    "u3_merge_categories", "v_cat",
    """with a as (select big, small from v_cat where decision <> '0' union select 'Logic Error', null),
    b as (select event_type || '-0' big, 'c5' small from events union select 'signup-0', null),
    x as (select * from a union select * from b)
    select * from x where small is not null union all select distinct big, null from x where small is null and big not in (select big from x where small is not null)""",
)
def _(spark, sf):
    null = F.lit(None).cast("string")
    cats = V.v_cat(spark, sf).filter("decision <> '0'").select("big", "small")
    seeds = cats.limit(1).select(F.lit("Logic Error").alias("big"), null.alias("small"))
    ev = V.table(spark, sf, "events")
    other = ev.select(F.concat("event_type", F.lit("-0")).alias("big"), F.lit("c5").alias("small"))
    empty = ev.select(F.lit("signup-0").alias("big"), null.alias("small")).distinct()
    return S.merge_categories(cats, seeds, other, empty)


@query("u4_key_union", "v_log", "select distinct process from v_log where time_ms > 5000 union select distinct process from v_log where tokens > 90")
def _(spark, sf):
    log = V.v_log(spark, sf)
    return S.key_union(log.filter("time_ms > 5000").select("process"), log.filter("tokens > 90").select("process"))


@query(
    "u5_union_corpora",
    sql="""with x as (select doc_id id, lang, length(text) size from documents union all select item_id, null, length(text) from benchmark)
    select lang, count(*) docs, cast(sum(size) as bigint) chars from x group by lang""",
)
def _(spark, sf):
    a = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.length("text").alias("size"))
    b = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("size"))
    return S.union_corpora(a, b).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("size").alias("chars"))


@query(
    "s10_bucketed_map",
    sql="""select c_custkey key, case when c_custkey % 300 = 0 then 'third' when c_custkey in (select s_suppkey * 3 from supplier) then (select min(s_name) from supplier where s_suppkey * 3 = c_custkey)
      else c_name end as value from customer union all select s_suppkey * 3, case when s_suppkey * 3 % 300 = 0 then 'third' else s_name end from supplier where s_suppkey * 3 not in (select c_custkey from customer)""",
)
def _(spark, sf):
    """A map written once and changed twice, the second time in few buckets."""
    from ..plans.stage import new_path
    from ..sources.maps import read_map, upsert

    folder = new_path(spark, "map")
    named = lambda t, k, v: V.table(spark, sf, t).select(k.alias("key"), F.col(v).alias("value"))
    upsert(named("customer", F.col("c_custkey"), "c_name"), "key", folder, buckets=16)
    upsert(named("supplier", F.col("s_suppkey") * 3, "s_name"), "key", folder)
    upsert(read_map(spark, folder).filter("key % 300 = 0").select("key", F.lit("third").alias("value")), "key", folder)
    return read_map(spark, folder)


@query(
    "s10_merge_map",
    sql="""select c_custkey key, c_name as value from customer where c_custkey not in (select s_suppkey * 3 from supplier) union all select s_suppkey * 3, s_name from supplier""",
)
def _(spark, sf):
    old = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    new = V.table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("key"), F.col("s_name").alias("value"))
    return S.merge_map(old, new, "key")
