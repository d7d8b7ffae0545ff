"""Queries that run the streaming jobs to completion over the event files and read the state they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..plans.stage import new_path
from ..streaming import jobs as J
from .core import query


def _event_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return _with_k(files)


def _event_batches(spark, sf, files=3):
    """The events dealt over several files, of which each micro-batch takes one."""
    path = new_path(spark, "events")
    table = V.table(spark, sf, "events")
    table.repartition(files, "event_id").write.parquet(path)
    return _with_k(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path))


def _with_k(files):
    return files.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query("r1_action_counts", sql=f"select event_type action, count(*) n, count_if(k >= 75) errors from ({V.EVENTS}) group by event_type")
def _(spark, sf):
    out = new_path(spark, "actions")
    actions = _event_batches(spark, sf).select(F.col("event_type").alias("action"), F.floor(F.col("k") / 25).cast("int").alias("level"))
    J.stream_action_counts(actions, out).awaitTermination()
    return J.read_action_counts(spark, out)


@query(
    "r2_category_state", "v_cat",
    """with f as (select *, case when row_number() over (partition by big order by ord) = 1 then 1 else 0 end nb,
      case when row_number() over (partition by big, small order by ord) = 1 then 1 else 0 end ns from v_cat)
    select ord, big, small, count(*) over (order by ord) total, cast(sum(nb) over (order by ord) as bigint) bigs, cast(sum(ns) over (order by ord) as bigint) smalls from f""",
)
def _(spark, sf):
    out = new_path(spark, "categories")
    ev = _event_stream(spark, sf).select(
        F.col("event_id").alias("ord"), F.concat("event_type", F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("big"),
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("small"),
    )
    J.stream_category_state(ev, out).awaitTermination()
    return J.read_state(spark, f"{out}/log").select("ord", "big", "small", "total", "bigs", "smalls")


@query(
    "r2_category_batches",
    sql=f"""with e as (select event_type big, case when k < 10 then null else 'c' || k end small from ({V.EVENTS}))
    select (select count(*) from e) total, (select count(distinct big) from e) bigs, (select count(*) from (select distinct big, small from e)) smalls, (select count(*) from e) logged""",
)
def _(spark, sf):
    """Over several micro-batches, with a null category: the totals at the end do not depend on how events are dealt."""
    out = new_path(spark, "categories")
    small = F.when(F.col("k") >= 10, F.concat(F.lit("c"), F.col("k").cast("string")))
    ev = _event_batches(spark, sf, 4).select(F.col("event_id").alias("ord"), F.col("event_type").alias("big"), small.alias("small"))
    J.stream_category_state(ev, out).awaitTermination()
    log = J.read_state(spark, f"{out}/log")
    last = [F.max(c).alias(c) for c in ("total", "bigs", "smalls")]
    return log.agg(*last, F.count("*").alias("logged"))


@query("r3_progress", sql=f"select user_id task from ({V.EVENTS}) group by user_id")
def _(spark, sf):
    """Over several micro-batches: which report comes first depends on arrival, that every task is written once does not."""
    out = new_path(spark, "progress")
    done = _event_batches(spark, sf).select(F.col("user_id").alias("task"), F.col("event_id").alias("ord"), (F.col("k") % 2 == 0).alias("ok"))
    J.stream_progress(done, out).awaitTermination()
    return J.read_state(spark, f"{out}/tasks").select("task")


@query("r3_first_report", sql=f"select user_id task, min(event_id) ord, arg_min(k % 2 = 0, event_id) ok from ({V.EVENTS}) group by user_id")
def _(spark, sf):
    out = new_path(spark, "progress")
    done = _event_stream(spark, sf).select(F.col("user_id").alias("task"), F.col("event_id").alias("ord"), (F.col("k") % 2 == 0).alias("ok"))
    J.stream_progress(done, out).awaitTermination()
    return J.read_state(spark, f"{out}/tasks").select("task", "ord", "ok")
