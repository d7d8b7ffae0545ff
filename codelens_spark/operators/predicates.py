"""Row-wise filters and classifications: no shuffle, all inside one generated stage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.classify import any_of
from ..functions.text import base_name, glob_regex, strip


def not_ignored(col: Column, prefixes: Sequence[str] = R.IGNORED_PREFIXES) -> Column:
    return ~any_of([col.startswith(p) for p in prefixes])


def drop_prefixed(df: DataFrame, col: str, prefixes: Sequence[str] = R.IGNORED_PREFIXES) -> DataFrame:
    return df.filter(not_ignored(F.col(col), prefixes))


def filter_diagnostics(df: DataFrame, severity: str = "severity", message: str = "message", lang: str = "lang") -> DataFrame:
    """Severity 0 = error, 1 = warning. Python keeps warnings but not unused-name notes; others keep errors."""
    python = (F.col(severity) <= 1) & ~F.col(message).contains("is not accessed")
    return df.filter(F.when(F.col(lang) == "python", python).otherwise(F.col(severity) < 1))


def classify_run_path(
    df: DataFrame,
    path: str,
    projects: Sequence[str],
    baselines: Sequence[str],
    targets: Sequence[str] = ("initial", "final", "codes"),
    models: Sequence[str] = R.MODELS,
) -> DataFrame:
    """project, model, baseline, target_type from the parts of a run folder; null where not found."""
    parts = F.split(F.col(path), "/")

    def first_in(names: Sequence[str]) -> Column:
        return F.get(F.filter(parts, lambda p: p.isin(*names)), F.lit(0))

    def model_of(part: Column) -> Column:
        exact = F.when(part.isin(*models), part)
        bounded = [
            F.when(part.contains(f"_{m}_") | part.startswith(f"{m}_") | part.endswith(f"_{m}"), F.lit(m)) for m in models
        ]
        return F.coalesce(exact, *bounded)

    model = F.get(F.array_compact(F.transform(parts, model_of)), F.lit(0))
    return (
        df.withColumn("project", first_in(projects))
        .withColumn("model", model)
        .withColumn("baseline", first_in(baselines))
        .withColumn("target_type", first_in(targets))
    )


def select_runs(df: DataFrame, main: str) -> DataFrame:
    """Runs known in all four dimensions: the main baseline's initial and final, the others' final and codes."""
    known = F.col("project").isNotNull() & F.col("model").isNotNull()
    wanted = F.when(F.col("baseline") == main, F.col("target_type").isin("initial", "final")).otherwise(
        F.col("target_type").isin("final", "codes")
    )
    return df.filter(known & F.col("baseline").isNotNull() & F.col("target_type").isNotNull() & wanted)


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    folders = any_of([low.contains(d) for d in ("/test/", "/tests/", "/spec/", "/__tests__/")])
    return folders | low.rlike(r"\.(test|spec)\.(js|ts|jsx|tsx)$")


def match_globs(path: Column, globs: Sequence[str]) -> Column:
    """Does the base name match one of the globs (`*` only)?"""
    return any_of([base_name(path).rlike(glob_regex(g)) for g in globs])


def min_span(df: DataFrame, start: str, end: str, n: int, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Symbols of at least n lines; `limit` takes the first ones in scan order."""
    kept = df.filter(F.col(end) - F.col(start) >= n)
    return kept.orderBy(*order).limit(limit) if limit else kept


def sample_by_key(df: DataFrame, key: str, p: float, seed: int = 12345) -> DataFrame:
    """Keep each key with probability p. The draw depends on the key alone, not on row order."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.filter(draw < int(p * 2**32))


def validate_required(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all fields, other rows with the `missing` field names)."""
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in cols])
    )
    marked = df.withColumn("missing", missing)
    return marked.filter(F.size("missing") == 0).drop("missing"), marked.filter(F.size("missing") > 0)


def filter_status(df: DataFrame, status: str = "Assertion Errors") -> DataFrame:
    return df.filter(F.col("status") == status)


def is_error_status(status: Column) -> Column:
    """Statuses that belong in the error list of a report."""
    return ~status.isin("Passed", "Assertion Errors", "Failed", "Skipped")


STUB_LINE = r"(?i)^[a-zA-Z_][a-zA-Z0-9_]*:\s*(int|str|bool|float|list|dict|set|tuple|any)$"  # fixed value


def drop_stub_blocks(df: DataFrame, col: str) -> DataFrame:
    """Drop blocks of two or more lines of which at least half are bare type stubs."""
    lines = F.split(F.col(col), "\n")
    stubs = F.size(F.filter(lines, lambda l: strip(l).rlike(STUB_LINE)))
    return df.filter((F.size(lines) < 2) | (stubs / F.size(lines) < 0.5))


def filter_tokens(
    df: DataFrame,
    types: Sequence[str] | None = None,
    word: str | None = None,
    resolved: bool = False,
    skip: bool = False,
) -> DataFrame:
    """Tokens of the given types / word; `resolved` wants a word and a definition, `skip` drops literals."""
    conds = []
    if types:
        conds.append(F.col("type").isin(*types))
    if word is not None:
        conds.append(F.col("word") == word)
    if resolved:
        conds.append(F.col("word").isNotNull() & (F.col("word") != "") & (F.size("defs") > 0))
    if skip:
        conds.append(~F.col("type").isin(*R.SKIP_TOKEN_TYPES))
    return df.filter(reduce(lambda a, b: a & b, conds, F.lit(True)))


def default_term_flags(kind: Column) -> tuple[Column, Column]:
    """(need_definition, need_example) of a token type under the default rule."""
    return kind.isin(*R.DEFINITION_TYPES), kind.isin("method", "function", "assignment")


def cfg_term_flags(kind: Column, in_condition: Column, in_signature: Column, return_detail: Column) -> tuple[Column, Column]:
    """(need_definition, need_example) under the control-flow rule.

    Definitions serve tokens related to a condition: callables with a known, non-void result, and
    everything else but classes. Examples serve the tokens of the signature.
    """
    callable_ = kind.isin("method", "function")
    helpful = F.when(callable_, return_detail.isNotNull() & ~return_detail.contains("void")).otherwise(kind != "class")
    return in_condition & helpful, in_signature


def needs_full_definition(kind: Column) -> Column:
    return kind.isin("method", "function")


def check_code(df: DataFrame, col: str, lang: str) -> DataFrame:
    """Add `valid` and `warnings` from the structure rules of the row's language."""
    code, language = F.col(col), F.lower(F.col(lang))
    notes = []
    for name, checks in R.CODE_CHECKS.items():
        for needles, note in checks:
            has_all = reduce(lambda a, b: a & b, [code.contains(n) for n in needles])
            notes.append(F.when((language == name) & ~has_all, F.lit(note)))
    unknown = F.when(
        ~language.isin(*R.CODE_CHECKS), F.concat(F.lit("No validation rules defined for language: "), F.col(lang))
    )
    short = F.when(F.length(code) < 50, F.lit(R.SHORT_CODE))
    warnings = F.array_compact(F.array(*notes, unknown, short))
    failed = F.size(F.array_compact(F.array(*notes, short)))
    return df.withColumn("valid", failed == 0).withColumn("warnings", warnings)
