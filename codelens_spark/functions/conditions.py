"""Branch-condition analysis: normal form and complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _inside(col: Column, head: int) -> Column:
    return strip(col.substr(F.lit(head + 1), F.greatest(F.length(col) - head - 1, F.lit(0))))


def _negated(col: Column) -> Column:
    return col.startswith("!(") & col.endswith(")")


def balanced(col: Column) -> Column:
    """Every closing parenthesis has an opening one before it, and all are closed."""
    low = F.aggregate(
        F.split(col, ""),
        F.struct(F.lit(0).alias("cur"), F.lit(0).alias("low")),
        lambda a, ch: F.struct(
            _step(a["cur"], ch).alias("cur"), F.least(a["low"], _step(a["cur"], ch)).alias("low")
        ),
    )
    return (low["cur"] == 0) & (low["low"] >= 0)


def _step(cur: Column, ch: Column) -> Column:
    return cur + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)


def normalize_condition(col: Column) -> Column:
    """`!(A)` -> `A` through any number of negations; otherwise redundant outer parentheses removed.

    Both loops are folds with as many steps as the text has opening parentheses, so they always finish
    and never stop early.
    """
    text = strip(col)
    steps = F.sequence(F.lit(0), F.regexp_count(text, F.lit(r"\(")))
    unnegated = F.aggregate(steps, text, lambda acc, _: F.when(_negated(acc), _inside(acc, 2)).otherwise(acc))
    unwrapped = F.aggregate(
        steps,
        text,
        lambda acc, _: F.when(
            acc.startswith("(") & acc.endswith(")") & balanced(_inside(acc, 1)), _inside(acc, 1)
        ).otherwise(acc),
    )
    return F.when(_negated(text), unnegated).otherwise(unwrapped)


def max_nesting(col: Column) -> Column:
    state = F.aggregate(
        F.split(col, ""),
        F.struct(F.lit(0).alias("cur"), F.lit(0).alias("top")),
        lambda a, ch: F.struct(
            _step(a["cur"], ch).alias("cur"), F.greatest(a["top"], _step(a["cur"], ch)).alias("top")
        ),
    )
    return state["top"]


def complexity(col: Column) -> Column:
    """Operator count, plus 2 per nesting level, plus 2 when a logical connective occurs."""
    operators = F.regexp_count(col, F.lit(r"[!&|<>=+\-*/%]"))
    logical = F.when(col.contains("&&") | col.contains("||"), 2).otherwise(0)
    return operators + max_nesting(col) * 2 + logical
