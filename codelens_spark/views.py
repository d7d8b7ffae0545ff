"""Model tables derived from the driver tables, each in Spark and in SQL for the checks.

Every view is row-wise or a keyed aggregate over a whole table, so its size follows the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.skew import spread

# sample compiler messages used to give events a diagnostic text
MESSAGES = (
    "foo redeclared in this block",
    'Import "a.b" could not be resolved',
    "name could not be resolved",
    "The constructor Widget(int) is undefined",
    "Unhandled exception type IOException",
    "something else happened while checking",
    "Syntax error on token, delete this token",
    "c.name undefined (type *Command has no field or method name)",
    "cannot use x as int value in argument",
    "Cannot infer type arguments for List<>",
    "The error messages are:",
    "cannot instantiate the type Shape",
    "undefined: bar",
    "x is not accessed",
    "",
    "short one",
)
PROCESSES = {
    "signup": "generateTest",
    "purchase": "FixWithLLM_1",
    "error": "fixDiagnostics",
    "view": "gatherContext-1",
    "click": "buildCFG",
}
ACTIONS = {"signup": "run", "purchase": "pass", "error": "fail", "view": "output", "click": "skip"}


# tables whose rows are worth spreading when they sit in one small file, and the columns to spread by
SPREAD = {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey"), "documents": ("doc_id",), "conversations": ("conv_id", "turn")}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide_table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table, spread over the cores: for queries with heavy work per row."""
    df = table(spark, sf, name)
    return spread(df.select(*cols) if cols else df, *SPREAD[name])


def _map(col: Column, fixed: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])[col]


def _case(col: str, fixed: dict) -> str:
    return "case " + " ".join(f"when {col} = '{k}' then '{v}'" for k, v in fixed.items()) + " end"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


EVENTS = "select *, cast(props->>'$.k' as bigint) k from events"


def v_log(spark, sf):
    e = events(spark, sf)
    return e.select(
        F.col("user_id").alias("file"), F.col("event_id").alias("seq"), _map(F.col("event_type"), PROCESSES).alias("process"),
        F.floor(F.col("value") * 100).alias("time_ms"), F.col("k").alias("tokens"),
    )


V_LOG = f"""select user_id file, event_id seq, {_case('event_type', PROCESSES)} process,
  cast(floor(value * 100) as bigint) time_ms, k tokens from ({EVENTS})"""


def v_diag(spark, sf):
    e = events(spark, sf)
    text = F.get(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("k") % len(MESSAGES)).cast("int"))
    # every third text is kept bare, the others name a unit, so that messages repeat unevenly
    unit = F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit(" (u"), (F.col("k") % 10).cast("string"), F.lit(")")))
    return e.select(
        F.col("user_id").alias("file"), F.weekofyear("ts").alias("round"), F.concat(text, unit).alias("message"),
        F.col("event_id").alias("ord"), F.col("k").cast("int").alias("line"),
        (F.col("k") % 3).cast("int").alias("severity"),
        F.when(F.col("event_type") == "view", "python").otherwise("java").alias("lang"),
    )


V_DIAG = f"""select user_id file, cast(week(ts) as int) round,
  list_extract([{', '.join(sql_str(m) for m in MESSAGES)}], cast(k % {len(MESSAGES)} as int) + 1)
    || case when k % 3 = 0 then '' else ' (u' || cast(k % 10 as varchar) || ')' end message,
  event_id ord, cast(k as int) line, cast(k % 3 as int) severity,
  case when event_type = 'view' then 'python' else 'java' end lang from ({EVENTS})"""


def v_event(spark, sf):
    """Test events: a test per user and attribute."""
    e = events(spark, sf)
    return e.select(
        F.concat(F.lit("Test"), F.col("user_id").cast("string"), F.lit("_"), (F.col("k") % 4).cast("string")).alias("test"),
        F.col("user_id").alias("file"), F.col("event_id").alias("ord"), _map(F.col("event_type"), ACTIONS).alias("action"),
        F.when(F.col("k") % 5 == 0, " ").otherwise(F.concat(F.lit(" out "), F.col("k").cast("string"), F.lit(" "))).alias("output"),
    )


V_EVENT = f"""select 'Test' || user_id || '_' || (k % 4) test, user_id file, event_id ord, {_case('event_type', ACTIONS)} action,
  case when k % 5 = 0 then ' ' else ' out ' || k || ' ' end output from ({EVENTS})"""


def v_line(spark, sf):
    return wide_table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))


V_LINE = """select doc_id, cast(unnest(range(len(l))) as int) n, unnest(l) as text
  from (select doc_id, string_split(text, chr(10)) l from documents)"""


def row_ord() -> Column:
    key = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return F.concat(key("l_orderkey", 12), F.col("l_linenumber").cast("string"), key("l_suppkey", 10), key("l_partkey", 10))


ROW_ORD = """lpad(cast(l_orderkey as varchar), 12, '0') || l_linenumber || lpad(cast(l_suppkey as varchar), 10, '0')
  || lpad(cast(l_partkey as varchar), 10, '0')"""


def v_ival(spark, sf):
    s = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("uri"), F.col("l_partkey").alias("name"), s.alias("s"),
        (s + F.col("l_quantity").cast("int")).alias("e"), row_ord().alias("ord"),
    )


V_IVAL = f"""select l_suppkey uri, l_partkey as name, cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as int) s,
  cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) + cast(l_quantity as int) as int) e, {ROW_ORD} ord
  from lineitem"""


def v_nest(spark, sf):
    """Nested calendar ranges per order priority: the days a year, quarter and month really span."""
    o = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    base = o.select(F.col("o_orderpriority").alias("uri"), "o_orderdate", day.alias("d"))
    levels = F.array(
        F.date_format("o_orderdate", "yyyy"),
        F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("Q"), F.quarter("o_orderdate").cast("string")),
        F.date_format("o_orderdate", "yyyy-MM"),
    )
    rows = base.select("uri", "d", F.explode(levels).alias("name"))
    return rows.groupBy("uri", "name").agg(F.min("d").alias("s"), F.max("d").alias("e"))


V_NEST = """select uri, name, min(d) s, max(d) e from (
  select o_orderpriority uri, date_diff('day', date '1990-01-01', cast(o_orderdate as date)) d,
    unnest([strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate), strftime(o_orderdate, '%Y-%m')]) as name
  from orders) group by uri, name"""


def v_day(spark, sf):
    o = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return o.select(F.col("o_orderpriority").alias("uri"), day.alias("line")).distinct()


V_DAY = """select distinct o_orderpriority uri, date_diff('day', date '1990-01-01', cast(o_orderdate as date)) line from orders"""


def v_cov(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_partkey", "l_suppkey").alias("block"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("hits")
    )


V_COV = """select l_partkey || ':' || l_suppkey block, case when l_quantity > 25 then 1 else 0 end hits from lineitem"""


def v_mut(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = li.join(part, li.l_partkey == part.p_partkey)
    status = F.when(F.col("l_returnflag") == "R", "Killed").when(F.col("l_returnflag") == "A", "survived").otherwise("incompetent")
    return j.select(
        F.col("l_suppkey").alias("test"), F.col("p_brand").alias("target"),
        F.when(F.col("l_linestatus") == "O", F.col("p_brand")).alias("module"), F.col("p_type").alias("operator"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("lineno"), status.alias("status"),
    )


V_MUT = """select l_suppkey test, p_brand target, case when l_linestatus = 'O' then p_brand end module, p_type operator,
  case when p_size % 7 <> 0 then p_size end lineno,
  case l_returnflag when 'R' then 'Killed' when 'A' then 'survived' else 'incompetent' end status
  from lineitem join part on l_partkey = p_partkey"""

BASELINES = {"R": "main", "A": "naive", "N": "standard"}
TARGETS = {"O": "final", "F": "initial"}
MODEL_OF = {"1-URGENT": "gpt-4o", "2-HIGH": "gpt-4o-mini", "3-MEDIUM": "deepseek-chat", "4-NOT SPECIFIED": "other", "5-LOW": "codes"}


def v_run(spark, sf):
    c, o, li = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    target = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 0), "codes").otherwise(_map(F.col("l_linestatus"), TARGETS))
    return j.select(
        F.concat(F.lit("commons-"), F.lower("c_mktsegment")).alias("project"),
        _map(F.col("o_orderpriority"), MODEL_OF).alias("model"), _map(F.col("l_returnflag"), BASELINES).alias("baseline"),
        target.alias("target_type"), F.col("o_orderkey").alias("folder"), F.col("l_discount").alias("coverage"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("validrate"), F.when(F.col("l_tax") == 0, "x").alias("error"),
    )


V_RUN = f"""select 'commons-' || lower(c_mktsegment) project, {_case('o_orderpriority', MODEL_OF)} model,
  {_case('l_returnflag', BASELINES)} baseline,
  case when l_linestatus = 'F' and l_linenumber % 2 = 0 then 'codes' else {_case('l_linestatus', TARGETS)} end target_type,
  o_orderkey folder, l_discount coverage, case when l_linenumber <> 3 then l_tax end validrate,
  case when l_tax = 0 then 'x' end error
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"""


def v_edge(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")
    ).distinct()
    return li.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(li.select(F.col("b").alias("src"), F.col("a").alias("dst")))


V_EDGE = """select 's' || l_suppkey src, 'p' || l_partkey dst from lineitem
  union select 'p' || l_partkey src, 's' || l_suppkey dst from lineitem"""


def v_attempt(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("test"), F.col("turn").alias("round"), "role", "text",
        F.when(F.length("text") % 2 == 0, "pass").otherwise("fail").alias("result"),
    )


V_ATTEMPT = """select conv_id test, turn round, role, text, case when length(text) % 2 = 0 then 'pass' else 'fail' end result
  from conversations"""


def v_cat(spark, sf):
    """Category events: big category from the event type, small one from the attribute."""
    e = events(spark, sf)
    return e.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("test"), "ts",
        (F.col("k") % 5).cast("string").alias("decision"),
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("big"),
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("small"),
    )


V_CAT = f"""select event_id ord, 't' || event_id test, ts, cast(k % 5 as varchar) decision,
  event_type || '-' || (user_id % 3) big, 'c' || k small from ({EVENTS})"""


def v_exec(spark, sf):
    e = events(spark, sf)
    code = F.when(F.col("k") % 5 == 0, 124).when(F.col("k") % 7 == 0, 2).when(F.col("k") % 3 == 0, 1).otherwise(0)
    return e.select(F.col("user_id").alias("test_file"), F.col("event_id").alias("ord"), code.alias("exit_code"), (F.col("k") % 5 == 0).alias("timeout"), "event_type")


V_EXEC = f"""select user_id test_file, event_id ord,
  case when k % 5 = 0 then 124 when k % 7 = 0 then 2 when k % 3 = 0 then 1 else 0 end exit_code, k % 5 = 0 timeout, event_type
  from ({EVENTS})"""

STATUSES = ("Passed", "Assertion Errors", "Error", "Type Errors")


def v_test(spark, sf):
    e = events(spark, sf)
    status = F.get(F.array(*[F.lit(s) for s in STATUSES]), (F.col("k") % 4).cast("int"))
    return e.select(
        F.col("user_id").alias("file"), F.concat(F.lit("test_"), (F.col("k") % 10).cast("string")).alias("test"), F.col("event_id").alias("ord"),
        status.alias("status"), F.when(F.col("k") % 4 >= 2, F.concat(F.lit("E"), (F.col("k") % 3).cast("string"))).alias("error_type"),
    )


V_TEST = f"""select user_id file, 'test_' || (k % 10) test, event_id ord,
  list_extract([{', '.join(sql_str(s) for s in STATUSES)}], cast(k % 4 as int) + 1) status,
  case when k % 4 >= 2 then 'E' || (k % 3) end error_type from ({EVENTS})"""

TOKEN_TYPES = ("method", "function", "class", "parameter", "string", "variable")


def v_token(spark, sf):
    """Tokens: one row per word of every conversation line, placed by line and word number."""
    words = wide_table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        F.concat_ws(":", "conv_id", "turn").alias("uri"), F.posexplode(F.split("text", "\n")).alias("line", "row")
    ).select("uri", "line", "row", F.posexplode(F.regexp_extract_all("row", F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))).alias("ch", "word"))
    kind = F.get(F.array(*[F.lit(t) for t in TOKEN_TYPES]), F.length("word") % len(TOKEN_TYPES))
    return words.select(
        "uri", "line", "ch", "word", kind.alias("type"), F.concat_ws(":", "uri", "line", "ch").alias("id"),
        F.when(F.length("word") % 5 == 0, F.array(F.lit("declaration"))).otherwise(F.array().cast("array<string>")).alias("modifiers"),
    )


V_TOKEN = f"""select uri, line, cast(unnest(range(len(w))) as int) ch, unnest(w) word,
    list_extract([{', '.join(sql_str(t) for t in TOKEN_TYPES)}], cast(length(unnest(w)) % {len(TOKEN_TYPES)} as int) + 1) as type,
    uri || ':' || line || ':' || unnest(range(len(w))) id, length(unnest(w)) % 5 = 0 declared
  from (select uri, line, regexp_extract_all("row", '[a-zA-Z_][a-zA-Z0-9_]*') w from (
    select conv_id || ':' || turn uri, cast(unnest(range(len(l))) as int) line, unnest(l) as "row"
    from (select conv_id, turn, string_split(text, chr(10)) l from conversations)))"""

ALL_SQL = {
    "v_log": V_LOG, "v_diag": V_DIAG, "v_event": V_EVENT, "v_line": V_LINE, "v_ival": V_IVAL, "v_nest": V_NEST, "v_day": V_DAY,
    "v_cov": V_COV, "v_mut": V_MUT, "v_run": V_RUN, "v_edge": V_EDGE, "v_attempt": V_ATTEMPT, "v_cat": V_CAT, "v_exec": V_EXEC,
    "v_test": V_TEST, "v_token": V_TOKEN,
}


def with_views(*names: str) -> str:
    """WITH clause holding the named views."""
    return "with " + ", ".join(f"{n} as ({ALL_SQL[n]})" for n in names) + " "
