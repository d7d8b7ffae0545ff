"""Rule-driven classification as one code-generated expression per preset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dictionary import find_words
from ..plans.skew import attach
from . import rules as R


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(or_, conds)


def has_any(text: Column, words: Sequence[str]) -> Column:
    return any_of([text.contains(w) for w in words])


def category_test(text: Column, cat: R.Category) -> Column:
    """Does lower-cased `text` belong to `cat`?"""
    context = has_any(text, cat.context)
    plain = [w for w in cat.keywords if w not in cat.needs_context]
    conds = [text.contains(w) for w in plain]
    conds += [text.rlike(p) for p in cat.patterns]
    for words in cat.all_of:
        conds.append(reduce(lambda a, b: a & b, [text.contains(w) for w in words]))
    guarded = [w for w in cat.keywords if w in cat.needs_context]
    if guarded and cat.veto:
        lone = has_any(text, guarded) & ~context
        return any_of(conds + [has_any(text, guarded)]) & ~lone
    return any_of(conds + [text.contains(w) & context for w in guarded])


def is_unclear(col: Column) -> Column:
    """Empty text, or a short snippet without an error word (or spread over several lines)."""
    short = col.rlike(R.UNCLEAR_SHORT)
    low = F.lower(col)
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    snippet = col.contains("\n") & (F.length(col) < 150)
    return (col == "") | (short & (snippet | (~has_any(low, R.ERROR_WORDS) & (words < 5))))


def classify_ordered(
    df: DataFrame, col: str, preset: str | Sequence[R.Category] = "seven", out: str = "category"
) -> DataFrame:
    """First matching category in rule order; `Other Error` when none matches."""
    low = F.col("__low")
    chain = None
    if preset == "ten":
        chain = F.when(is_unclear(F.col(col)), R.UNCLEAR)
    for cat in R.PRESETS[preset] if isinstance(preset, str) else preset:
        test = category_test(low, cat)
        chain = F.when(test, cat.name) if chain is None else chain.when(test, cat.name)
    named = df.withColumn("__low", F.lower(F.col(col)))
    return named.withColumn(out, chain.otherwise(R.OTHER)).drop("__low")


def classify_by_table(df: DataFrame, col: str, rule_rows: DataFrame, out: str = "category") -> DataFrame:
    """First matching category by a table of rules (rule_ord, category, keyword) of any size; `Other Error` when none matches.

    Keywords are sought, ignoring case, in the distinct texts (`plans.dictionary`); the least (rule_ord, category) wins.
    Null and empty keywords match nothing, a null text is in no category of the table.
    """
    named = df.withColumn("__text", F.md5(F.lower(F.col(col)).cast("binary")))
    texts = df.filter(F.col(col).isNotNull()).select(F.lower(F.col(col)).alias("text")).distinct()
    texts = texts.select(F.md5(F.col("text").cast("binary")).alias("text_id"), "text")
    rules = rule_rows.select("rule_ord", "category", F.lower("keyword").alias("word"))
    best = find_words(rules, texts).join(rules, "word").groupBy("text_id").agg(F.min(F.struct("rule_ord", "category"))["category"].alias("__found"))
    found = attach(named, best.withColumnRenamed("text_id", "__text"), ["__text"], salts=1)
    return found.withColumn(out, F.coalesce("__found", F.lit(R.OTHER))).drop("__text", "__found")


def classify_error(detail: Column) -> Column:
    """struct(status, error_type) of a failed test from its detail line."""
    kind = F.regexp_extract(detail, r"^([A-Z]\w*Error)", 1)
    table = F.create_map(*[F.lit(x) for kv in R.ERROR_STATUS.items() for x in kv])
    status = (
        F.when(detail.contains("AssertionError"), "Assertion Errors")
        .when(kind != "", F.coalesce(table[kind], F.lit("Runtime Errors")))
        .otherwise("Unknown Errors")
    )
    error = (
        F.when(detail.contains("AssertionError"), "AssertionError").when(kind != "", kind).otherwise("UnknownError")
    )
    return F.struct(status.alias("status"), error.alias("error_type"))


def collection_status(detail: Column) -> Column:
    """Status of a collection error; unlike failed tests, assertion text has no special case."""
    kind = F.regexp_extract(detail, r"^([A-Z]\w*Error)", 1)
    table = F.create_map(*[F.lit(x) for kv in R.ERROR_STATUS.items() for x in kv])
    return F.when(kind == "", "Unknown Errors").otherwise(F.coalesce(table[kind], F.lit("Runtime Errors")))


def map_stage(process: Column) -> Column:
    """Process name to pipeline stage; null for processes outside the stage table."""
    fixed = F.create_map(*[F.lit(x) for kv in R.STAGES.items() for x in kv])
    return F.when(process.startswith("FixWithLLM"), "fix").otherwise(fixed[process])


def action_label(decision: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in R.DECISIONS.items() for x in kv])
    return F.coalesce(table[decision], F.lit(R.DECISIONS["3"]))
