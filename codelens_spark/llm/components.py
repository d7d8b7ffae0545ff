"""Connected components of a link table by repeated contraction.

Each round every node hooks to its least neighbour, hook chains are shortened by pointer doubling, and the links are
rewritten between the remaining roots. Links that end inside one root vanish, so tables shrink from round to round;
nothing is collected. Every round is a written table, so a lost executor costs a re-read. Hooks of few nodes are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from .small import BROADCAST_ROWS

DOUBLINGS = 2


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links`; component is the least node it reaches. Ties, loops, repeated
    and null links are allowed (null ends are left out); an empty table gives an empty table."""
    live = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    live = stage(live.filter("a <> b").distinct(), "links")
    known: DataFrame | None = None
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "hook")
        sent = F.broadcast if hook.count() <= BROADCAST_ROWS else (lambda table: table)
        for _ in range(DOUBLINGS):
            far = hook.select(F.col("a").alias("to"), F.col("to").alias("far"))
            hook = hook.join(sent(far), "to", "left").select("a", F.coalesce("far", "to").alias("to"))
        hook = stage(hook, "hook")
        if known is None:
            known = hook.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            step = hook.select(F.col("a").alias("component"), F.col("to").alias("__to"))
            known = known.join(sent(step), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
            known = stage(known, "known")
        ends_a, ends_b = hook.select("a", F.col("to").alias("__x")), hook.select(F.col("a").alias("b"), F.col("to").alias("__y"))
        live = live.join(sent(ends_a), "a").join(sent(ends_b), "b").select(F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"))
        live = stage(live.filter("a <> b").distinct(), "links")
    if known is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return known
