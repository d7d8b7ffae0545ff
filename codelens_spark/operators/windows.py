"""Ordered operators, built on block scans (`plans.scan`) instead of whole-group windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.scan import Run, number_rows, ranked_rows, running
from ..plans.skew import attach, first_per_key, limit_per_key
from ..plans.stage import stage


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in arrival order."""
    return first_per_key(df, keys, order)


def next_bound(symbols: DataFrame) -> DataFrame:
    """symbols(uri, ord, s, e): where the next symbol in file order starts, else the file's last line.

    The scan runs over distinct start lines; symbols sharing a start line follow each other by `ord`.
    """
    starts = symbols.groupBy("uri", "s").agg(F.max("ord").alias("last_ord"))
    nxt = running(starts, ["uri"], "s", [Run("next_s", "next", F.col("s"))])
    ends = symbols.groupBy("uri").agg(F.max("e").alias("doc_end"))
    rows = attach(attach(symbols, nxt, ["uri", "s"], salts=1), ends, ["uri"])
    bound = F.when(F.col("ord") < F.col("last_ord"), F.col("s")).otherwise(F.coalesce("next_s", "doc_end"))
    return rows.select(*symbols.columns, bound.alias("bound"))


def _by_start(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "s").agg(F.max("e").alias("e"), F.count("*").alias("n"))


def _islands(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, s, e, n, start): every distinct start with the start of the merged range it belongs to.

    Ranges are first reduced to one per start, so a block of the scan is bounded by its width.
    """
    seen = running(_by_start(df, keys), keys, "s", [Run("prev_e", "max", F.col("e"), inclusive=False)])
    opens = F.when(F.col("prev_e").isNull() | (F.col("s") > F.col("prev_e") + gap), F.col("s"))
    return running(seen, keys, "s", [Run("start", "max", opens)])


def merge_intervals(df: DataFrame, keys: Sequence[str], gap: int = 1) -> DataFrame:
    """Merge ranges of a key that overlap or lie at most `gap` apart; gap=0 joins only touching ranges."""
    keys = list(keys)
    return _islands(df, keys, gap).groupBy(*keys, "start").agg(F.max("e").alias("end"), F.sum("n").alias("ranges"))


def merge_contexts(df: DataFrame, key: str = "uri", gap: int = 1) -> DataFrame:
    """Context sections of a file without repeated names, each with the merged range it lies in.

    df(uri, name, s, e, ord, ...): of a name the range that starts first (then the longer) stays; the rows
    come back with (start, end) of their merged range, so the texts of a range are its rows by s.
    """
    kept = first_per_key(df, [key, "name"], [F.col("s"), -F.col("e"), F.col("ord")])
    islands = _islands(kept, [key], gap)
    ends = islands.groupBy(key, "start").agg(F.max("e").alias("end"))
    rows = attach(kept, islands.select(key, "s", "start"), [key, "s"], salts=1)
    return attach(rows, ends, [key, "start"], salts=1).select(*df.columns, "start", "end")


def drop_contained(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the ranges that no earlier range (by start, longer first, then `ord`) contains."""
    keys = list(keys)
    longest = first_per_key(df, [*keys, "s"], [-F.col("e"), F.col("ord")])
    seen = running(longest, keys, "s", [Run("__prev", "max", F.col("e"), inclusive=False)])
    return seen.filter(F.col("__prev").isNull() | (F.col("e") > F.col("__prev"))).select(*df.columns)


def gap_marks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sections with distinct starts: `gap` is true where lines are left out before the section."""
    keys = list(keys)
    seen = running(df, keys, "s", [Run("__prev", "prev", F.col("e"))])
    return seen.withColumn("gap", F.coalesce(F.col("s") > F.col("__prev") + 1, F.lit(False))).drop("__prev")


def take_prefix_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """Ordered items while their running size stays within the budget; -1 takes everything.

    A null or negative size counts as 0. Items get their places inside the key by one range sort, and the sizes are
    summed block by block, so neither costly nor free items of a key meet in one task.
    """
    if budget == -1:
        return df.withColumn("running_size", F.lit(None).cast("long"))
    keys = list(keys)
    placed = stage(ranked_rows(df, order, "__place", keys), "placed")
    cost = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    return running(placed, keys, "__place", [Run("running_size", "sum", cost)]).filter(F.col("running_size") <= budget).drop("__place")


def section(lines: DataFrame, keys: Sequence[str], start: Column, end: Column, first_only: bool = False) -> DataFrame:
    """Lines (keys, n, ...) strictly between a start marker and the first end marker after it.

    `first_only` stops at the first section's end, and a later start marker inside it is just skipped.
    """
    keys = list(keys)
    if first_only:
        open_at = lines.filter(start).groupBy(*keys).agg(F.min("n").alias("__open"))
        after = attach(lines.filter(end), open_at, keys, how="inner").filter(F.col("n") > F.col("__open"))
        close_at = after.groupBy(*keys).agg(F.min("n").alias("__close"))
        rows = attach(attach(lines, open_at, keys, how="inner"), close_at, keys)
        inside = (F.col("n") > F.col("__open")) & (F.col("__close").isNull() | (F.col("n") < F.col("__close"))) & ~start
        return rows.filter(inside).select(*lines.columns)
    runs = [Run("__open", "max", F.when(start, F.col("n"))), Run("__close", "max", F.when(end & ~start, F.col("n")))]
    seen = running(lines, keys, "n", runs)
    return seen.filter(
        F.col("__open").isNotNull() & (F.col("__open") < F.col("n")) & (F.coalesce(F.col("__close"), F.lit(-1)) < F.col("__open"))
    ).select(*lines.columns)


def block_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names imported in grouped `import ( ... )` blocks: (keys, n, name)."""
    text = strip(F.col("text"))
    inside = section(lines, keys, text.startswith("import ("), text == ")")
    kept = inside.filter((text != "") & ~text.startswith("//"))
    return kept.select(*keys, "n", F.regexp_replace(text, r'^"+|"+$', "").alias("name")).filter("name <> ''")


def running_distinct(ev: DataFrame, order: str = "ord", dense: bool = False) -> DataFrame:
    """Distinct big and (big, small) categories before and after each event, in table order.

    First sightings come from an aggregate; the running count is a block scan over the unique order. An order
    with gaps (time stamps, say) is first replaced by the rows' places, so that blocks are full; `dense` says
    that it is a count of rows already.
    """
    if not dense:
        placed = ranked_rows(ev, [order], "__place")
        names = [c for c in ev.columns if c != order]
        seen = running_distinct(placed.select(*names, F.col("__place").alias("__order"), F.col(order).alias("__kept")), "__order", dense=True)
        added = [c for c in seen.columns if c not in (*names, "__order", "__kept")]
        return seen.select(*[F.col("__kept").alias(order) if c == order else F.col(c) for c in ev.columns], *added)
    first_big = ev.groupBy("big").agg(F.min(order).alias(order)).select(order, F.lit(1).alias("new_big"))
    first_small = ev.groupBy("big", "small").agg(F.min(order).alias(order)).select(order, F.lit(1).alias("new_small"))
    flagged = ev.join(first_big, order, "left").join(first_small, order, "left")
    flagged = flagged.na.fill(0, ["new_big", "new_small"])
    runs = [Run("big_after", "sum", F.col("new_big")), Run("small_after", "sum", F.col("new_small"))]
    seen = running(flagged, [], order, runs, levels=2)
    return (
        seen.withColumn("big_before", F.col("big_after") - F.col("new_big"))
        .withColumn("small_before", F.col("small_after") - F.col("new_small"))
        .drop("new_big", "new_small")
    )


def delta_decode(tokens: DataFrame, key: str, order: str) -> DataFrame:
    """Absolute line and character from (d_line, d_char) deltas; characters restart on a new line."""
    d_line, d_char = F.col("d_line"), F.col("d_char")
    both = running(tokens, [key], order, [Run("line", "sum", d_line), Run("__sum", "sum", d_char)], levels=2)
    # the running sum just before the latest line break; sums never fall, so the latest is the largest
    base = F.when(d_line > 0, F.col("__sum") - d_char)
    out = running(both, [key], order, [Run("__base", "max", base)], levels=2)
    return out.withColumn("ch", F.col("__sum") - F.coalesce("__base", F.lit(0))).drop("__sum", "__base")


def prune_to_mean(paths: DataFrame, key: str = "fn", size: str = "len", idx: str = "path_id", k: int = 10) -> DataFrame:
    """At most k paths per function: those whose length is closest to the mean, earlier first on ties."""
    means = paths.groupBy(key).agg(F.avg(size).alias("__mean"))
    near = attach(paths, means, [key]).withColumn("__diff", F.abs(F.col(size) - F.col("__mean")))
    return limit_per_key(near, [key], [F.col("__diff"), F.col(idx)], k, rank="__rn").drop("__mean", "__diff", "__rn")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Names that clash (ignoring case) get _1, _2, ... on their stem, in order; the first keeps its name.

    Numbers that would make a name which occurs in the table are left out, so all results differ: two numbered
    names are equal only if stem and number are.
    """
    parts = F.struct(F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1).alias("stem"), F.regexp_extract(name, r"(\.[^./]*)?$", 1).alias("ext"))
    folded = df.withColumn("__p", parts).withColumn("__base", F.lower("__p.stem")).withColumn("__ext", F.lower("__p.ext"))
    seen = number_rows(folded, ["__base", "__ext"], order, "__i", start=0, levels=2)
    # numbers in use: names stem_k in the table whose stem is one of the others
    number = F.regexp_extract("__base", r"_([1-9]\d{0,17})$", 1)
    used = folded.filter(number != "").select(F.regexp_replace("__base", r"_[1-9]\d{0,17}$", "").alias("__base"), "__ext", number.cast("long").alias("__k")).distinct()
    used = number_rows(used, ["__base", "__ext"], "__k", "__j", start=0, levels=3)
    # the i-th free number is i + the used ones before it; used number k is passed by every i >= k - (used before k)
    marks = used.select("__base", "__ext", (F.col("__k") - F.col("__j")).alias("__at")).groupBy("__base", "__ext", "__at").agg(F.count("*").alias("__n"))
    asks = seen.filter("__i > 0").select("__base", "__ext", F.col("__i").alias("__at"), F.lit(0).cast("long").alias("__n"))
    line = marks.unionByName(asks).groupBy("__base", "__ext", "__at").agg(F.sum("__n").alias("__n"))
    passed = running(line, ["__base", "__ext"], "__at", [Run("__skip", "sum", F.col("__n"))], levels=3)
    passed = passed.select(F.col("__base").alias("__b"), F.col("__ext").alias("__e"), "__at", "__skip")
    placed = seen.join(passed, (F.col("__base") == F.col("__b")) & (F.col("__ext") == F.col("__e")) & (F.col("__i") == F.col("__at")), "left")
    suffix = F.when(F.col("__i") > 0, F.concat(F.lit("_"), (F.col("__i") + F.coalesce("__skip", F.lit(0))).cast("string"))).otherwise("")
    return placed.withColumn("unique_name", F.concat(F.col("__p.stem"), suffix, F.col("__p.ext"))).select(*df.columns, "unique_name")


def round_delta(diag: DataFrame) -> DataFrame:
    """Diagnostics per file and round, and how many fewer than in the file's previous round."""
    counts = diag.groupBy("file", "round").agg(F.count("*").alias("remaining"))
    seen = running(counts, ["file"], "round", [Run("__prev", "prev", F.col("remaining"))])
    return seen.withColumn("fixed", F.coalesce(F.col("__prev") - F.col("remaining"), F.lit(0))).drop("__prev")


def numbered_locations(diag: DataFrame) -> DataFrame:
    """Locations of each message counted from 1 in order: diag(message, ord, ...)."""
    return number_rows(diag, ["message"], "ord", "idx", levels=2)
