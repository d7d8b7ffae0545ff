"""Mixing sources to target weights.

Every document gets a hash-random key, is range-sorted by it inside its source (the key space is cut into equal ranges,
as many as the source has blocks of BLOCK rows, so a source of any size is spread over many tasks), and distributed
prefix sums of word counts say where each source's budget is cut. Budgets above a source's size repeat it in epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import stage
from .small import staged_small

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BLOCK = 1 << 12
KEY_BITS = 60
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    squeezed = F.translate(text, "\t\n\u000b\f\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(squeezed, " "), lambda w: w != "")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their weight: by code point, null last, the weights repeat."""
    # one row per source; the order over sources is an order over their names only
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(at, F.lit(len(WEIGHTS))) + 1).cast("int"))
    return sources.withColumn("weight", weight.cast("long"))


def source_targets(sources: DataFrame) -> DataFrame:
    """(source, rows, source_size) -> the same with weight and target.

    All sizes are shared by weight; a target stops at MOST_EPOCHS times its source's size and the excess is shared
    again among the others. Sources in order of size / weight: with the first i of them stopped, the others get
    weight * (total - stopped) / (weight of the others); i is the first for which none of the others is above.
    """
    ranked = _ranked(sources)
    limit = F.col("source_size") * MOST_EPOCHS
    by_ratio = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    stepped = (
        ranked.withColumn("__limit", limit)
        .withColumn("__stopped", F.coalesce(F.sum("__limit").over(by_ratio), F.lit(0)))
        .withColumn("__total", F.sum("source_size").over(everything))
        .withColumn("__others", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        # the level this source would get with all before it stopped; the first one it stays below is the level of all after it
        .withColumn("__fits", F.col("__limit") * F.col("__others") >= F.col("weight") * (F.col("__total") - F.col("__stopped")))
    )
    level = F.struct((-F.col("__others")).alias("o"), (F.col("__total") - F.col("__stopped")).alias("rest"), F.col("__others").alias("w"))
    first = F.min(F.when(F.col("__fits"), level)).over(everything)
    shared = F.col("weight") * first["rest"] / first["w"]
    target = F.when(F.col("__limit") / F.col("weight") <= first["rest"] / first["w"], F.col("__limit").cast("double")).otherwise(shared)
    return stepped.withColumn("target", F.coalesce(target, F.col("__limit").cast("double")).cast("double")).select("source", "rows", "source_size", "weight", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """Per row of `docs`: (id, source, size long, source_size long, target double, taken long), then the columns `carry`.

    A source's words are taken in whole epochs and, for the rest of its rounded-down target, in the order of the hash
    keys; the document at the cut is taken in part, so the words taken are the target to within one word. Null or
    blank texts have size 0 and are never taken. A null source is a source of its own, last in order. Ties of keys
    (repeated ids) fall back to size, text hash and the carried columns. Null ids are kept. An empty table gives an empty table. Other
    columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"), *carry
    )
    name = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long"))
    rows = stage(rows, "sizes")
    sources = source_targets(rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")))
    per_source = sources.withColumn("__ranges", F.ceil(F.col("rows") / BLOCK).cast("long")).drop("weight")
    per_source = staged_small(per_source.select(F.col("source").alias("__source"), "__ranges", "source_size", "target"), "targets")
    ranged = rows.join(per_source, rows["source"].eqNullSafe(per_source["__source"])).drop("__source")
    width = F.floor(F.lit(1 << KEY_BITS) / F.col("__ranges")).cast("long") + 1
    ranged = ranged.withColumn("__range", F.floor(F.col("key") / width).cast("long"))

    order = ["key", "size", "tie", *carry]
    inside = Window.partitionBy("source", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before_ranges = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before_ranges), F.lit(0)))
    offsets = staged_small(offsets.select(F.col("source").alias("__s"), F.col("__range").alias("__r"), "__before"), "offsets")
    placed = ranged.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["__s"]) & (placed["__range"] == offsets["__r"]))
    at = F.col("__before") + F.col("__inside")
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(rest - at, F.lit(0)))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


TARGET_SQL = f"""
rows as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, {KEY_BITS // 4}))::bigint as key from documents),
per_source as (select source, sum(size)::bigint as source_size, {MOST_EPOCHS} * sum(size)::bigint as lim,
    [{', '.join(map(str, WEIGHTS))}][((row_number() over (order by source is null, source) - 1) % {len(WEIGHTS)})::int + 1]::bigint as weight from rows group by source),
stopped as (select a.source, sum(b.lim) filter (where b.lim * a.weight < a.lim * b.weight)::double as cut,
    sum(b.weight) filter (where b.lim * a.weight >= a.lim * b.weight)::double as others, sum(b.source_size)::double as total
    from per_source a cross join per_source b group by a.source),
level as (select max((total - coalesce(cut, 0)) / others) as unit, arg_max(total - coalesce(cut, 0), (total - coalesce(cut, 0)) / others) as rest,
    arg_max(others, (total - coalesce(cut, 0)) / others) as w from stopped join per_source using (source)
    where lim * others >= weight * (total - coalesce(cut, 0))),
targets as (select source, source_size, weight, case when lim / weight <= rest / w then lim::double else weight * rest / w end as target from per_source left join level on true),
placed as (select doc_id, size, source_size, target, floor(target)::bigint as budget,
    coalesce(sum(size) over (partition by r.source order by key, size rows between unbounded preceding and 1 preceding), 0)::bigint as pos
    from rows r join targets t on r.source is not distinct from t.source)
"""
MIX_SQL = f"""with {TARGET_SQL}
select doc_id, size, source_size, target, (case when source_size > 0 then budget // source_size else 0 end) * size
    + least(size, greatest(budget - (case when source_size > 0 then budget // source_size else 0 end) * source_size - pos, 0)) as taken from placed
"""
