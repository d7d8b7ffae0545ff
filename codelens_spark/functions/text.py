"""Text functions as Column expressions (no UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"```(\w+)?\s*\n([\s\S]*?)```"
LOOSE_FENCE = r"```(?:\w+)?(?:~~)?\s*([\s\S]*?)\s*```"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def number(col: Column) -> Column:
    """Bad, empty or missing numbers count as 0."""
    return F.coalesce(col.try_cast("long"), F.lit(0).cast("long"))


def _int_group(col: Column, pattern: str, group: int) -> Column:
    return F.regexp_replace(F.regexp_extract(col, pattern, group), ",", "").try_cast("long")


# ---- report totals ----

# fixed values: the lines by which mutation tools state their totals
PRINTED_SCORE = r"(?i)Mutation score:\s*([0-9]+(?:\.[0-9]+)?)\s*%"
PRINTED_TOTALS = (r"(?i)Total mutants:\s*([0-9]+)", r"(?i)Generated mutants:\s*([0-9]+)", r"(?i)Mutants generated:\s*([0-9]+)")
PRINTED_KILLED = r"(?i)Killed mutants:\s*([0-9]+)"
REPORTED_SCORE = r"(?m)^\s*mutation_score:\s*([0-9]+(?:\.[0-9]+)?)"


def printed_mutation_stats(col: Column) -> Column:
    """struct(score, total, killed) of a mutation tool's printed output; nulls where absent."""
    total = F.coalesce(*[F.regexp_extract(col, p, 1).try_cast("long") for p in PRINTED_TOTALS])
    killed = F.regexp_extract(col, PRINTED_KILLED, 1).try_cast("long")
    return F.struct(F.regexp_extract(col, PRINTED_SCORE, 1).try_cast("double").alias("score"), total.alias("total"), killed.alias("killed"))


def reported_mutation_score(col: Column) -> Column:
    """The score that a mutation report file states; null where it states none."""
    return F.regexp_extract(col, REPORTED_SCORE, 1).try_cast("double")


def report_totals(col: Column, kind: str) -> Column:
    """struct(covered, total, passed, files) read from a run's printed report; nulls where absent."""
    if kind == "go":
        covered = _int_group(col, r"Covered Statements: (\d+)", 1)
        total = _int_group(col, r"Total Statements: (\d+)", 1)
        passed = _int_group(col, r"Files: (\d+)/(\d+) passed", 1)
        files = _int_group(col, r"Files: (\d+)/(\d+) passed", 2)
    elif kind == "java":
        total = _int_group(col, r"Total lines (\d+)", 1)
        covered = total - _int_group(col, r"Missed Lines (\d+)", 1)
        files = _int_group(col, r"Total \.java files: (\d+)", 1)
        passed = _int_group(col, r"Files with corresponding \.class files: (\d+)", 1)
    elif kind == "python":
        line = r"TOTAL\s+(\d+)\s+(\d+)\s+(\d+)%"
        total = _int_group(col, line, 1)
        covered = total - _int_group(col, line, 2)
        passed = _int_group(col, r"PassRate.*?: (\d+)/(\d+)", 1)
        files = _int_group(col, r"PassRate.*?: (\d+)/(\d+)", 2)
    else:
        raise ValueError(f"unknown report kind {kind!r}")
    return F.struct(covered.alias("covered"), total.alias("total"), passed.alias("passed"), files.alias("files"))


def html_footer_lines(html: Column) -> Column:
    """struct(missed, total) from the second number pair of a coverage page's footer row."""
    foot = F.regexp_extract(html, r"(?s)<tfoot>(.*?)</tfoot>", 1)
    pair = r'<td class="ctr1">\s*([\d,]+)\s*</td>\s*<td class="ctr2">\s*([\d,]+)\s*</td>'

    def second(group: int) -> Column:
        found = F.get(F.regexp_extract_all(foot, F.lit(pair), F.lit(group)), F.lit(1))
        return F.regexp_replace(found, ",", "").try_cast("long")

    return F.struct(second(1).alias("missed"), second(2).alias("total"))


# ---- fenced blocks ----


def fenced_blocks(col: Column) -> Column:
    """array<struct<language, code, block>> of all closed fences."""
    langs = F.regexp_extract_all(col, F.lit(FENCE), F.lit(1))
    codes = F.regexp_extract_all(col, F.lit(FENCE), F.lit(2))
    return F.transform(
        F.arrays_zip(langs.alias("l"), codes.alias("c")),
        lambda b, i: F.struct(
            F.when(F.coalesce(b["l"], F.lit("")) == "", "unknown").otherwise(b["l"]).alias("language"),
            strip(b["c"]).alias("code"),
            i.alias("block"),
        ),
    )


def first_block(col: Column) -> Column:
    """First fenced text, or the text itself."""
    found = F.regexp_extract_all(col, F.lit(LOOSE_FENCE), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.get(found, F.lit(0)))).otherwise(col)


def last_block(col: Column) -> Column:
    """Last fenced text, or the trimmed text itself."""
    found = F.regexp_extract_all(col, F.lit(LOOSE_FENCE), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1))).otherwise(strip(col))


def before_fence(col: Column) -> Column:
    return strip(F.substring_index(col, "```", 1))


def pick_block(blocks: Column, lang: Column | str) -> Column:
    """Code of the first block in the wanted language, else of the longest block (first on ties)."""
    want = F.lower(F.lit(lang) if isinstance(lang, str) else lang)
    match = F.filter(blocks, lambda b: F.lower(b["language"]) == want)
    longest = F.aggregate(
        blocks,
        F.get(blocks, F.lit(0)),
        lambda best, b: F.when(F.length(b["code"]) > F.length(best["code"]), b).otherwise(best),
    )
    return F.coalesce(F.get(match, F.lit(0))["code"], longest["code"])


# ---- tolerant JSON ----


def tolerant_json(col: Column) -> Column:
    """VARIANT from the first fenced block, else the raw text, else the text with escapes undone; else null."""
    block = F.get(F.regexp_extract_all(col, F.lit(r"```(?:json|\w+)?\s*([\s\S]*?)```"), F.lit(1)), F.lit(0))
    raw = F.regexp_replace(strip(col), r"^```[a-z]*\n|\n```$", "")
    undone = raw
    for old, new in ((r"\\n", "\n"), (r'\\"', '"'), (r"\\t", "\t"), (r"\\r", "\r"), (r"\\\\", r"\\")):
        undone = F.regexp_replace(undone, old, new)
    return F.when(block.isNotNull(), F.try_parse_json(strip(block))).otherwise(
        F.coalesce(F.try_parse_json(raw), F.try_parse_json(undone))
    )


def json_array(value: Column) -> Column:
    """Array of a VARIANT that is an array, or an object with one key holding an array; else empty."""
    direct = F.try_variant_get(value, "$", "array<variant>")
    as_map = F.try_variant_get(value, "$", "map<string,variant>")
    wrapped = F.when(F.size(as_map) == 1, F.try_variant_get(F.get(F.map_values(as_map), F.lit(0)), "$", "array<variant>"))
    return F.coalesce(direct, wrapped, F.array().cast("array<variant>"))


def json_field(value: Column, *names: str) -> Column:
    """First non-empty string among several spellings of a key."""
    return F.coalesce(*[F.nullif(F.try_variant_get(value, f"$.{n}", "string"), F.lit("")) for n in names])


def categorization(col: Column) -> Column:
    """struct of a categorisation answer in either key style; null when a required field is missing."""
    block = F.get(F.regexp_extract_all(col, F.lit(r"```json\s*([\s\S]*?)\s*```"), F.lit(1)), F.lit(0))
    parsed = F.coalesce(F.try_parse_json(block), F.try_parse_json(strip(col)))

    def fields(v: Column) -> Column:
        summary = json_field(v, "root_cause_summary", "rootCauseSummary")
        big, small = json_field(v, "big_category", "bigCategory"), json_field(v, "small_category", "smallCategory")
        decision = json_field(v, "categorization_decision", "categorizationDecision")
        body = F.struct(
            summary.alias("root_cause_summary"),
            F.when(decision.isin("1", "2", "3"), decision).otherwise("3").alias("decision"),
            big.alias("big_category"),
            small.alias("small_category"),
            json_field(v, "reasoning").alias("reasoning"),
        )
        return F.when(summary.isNotNull() & big.isNotNull() & small.isNotNull(), body)

    # bound as a lambda variable, so the answer is parsed once and not once per field
    return F.transform(F.array(parsed), fields)[0]


# ---- clean-up ----


def cleanup_code(col: Column) -> Column:
    """Drop leading chatter lines, use LF, keep at most one blank line in a row, trim."""
    c = F.regexp_replace(col, r"(?i)^Here's the test.*?\n", "")
    c = F.regexp_replace(c, r"(?i)^The test code.*?\n", "")
    c = F.regexp_replace(c, r"\r\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def strip_comments(col: Column) -> Column:
    """Drop comments of the supported languages and lines left blank."""
    c = F.regexp_replace(col, r"//[^\n]*\n", "")
    c = F.regexp_replace(c, r"/\*[\s\S]*?\*/", "")
    c = F.regexp_replace(c, r"'''[\s\S]*?'''", "")
    c = F.regexp_replace(c, r'"""[\s\S]*?"""', "")
    c = F.regexp_replace(c, r"(?m)#.*$", "")
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: strip(line) != ""), "\n")


def exception_type(text: Column, lang: Column) -> Column:
    """Exception named by a catch clause, with the language's default."""
    t = strip(text)
    brace = F.regexp_extract(t, r"catch\s*\(\s*([a-zA-Z0-9_]+)[\s&*]?", 1)
    scoped = F.regexp_extract(t, r"catch\s*\(\s*(?:std::)?([a-zA-Z0-9_]+)[\s&*]?", 1)
    found = (
        F.when(lang == "python", F.regexp_extract(t, r"except\s+([a-zA-Z0-9_]+):", 1))
        .when(lang.isin("cpp", "c++"), F.when(t.contains("catch (...)"), "Exception").otherwise(scoped))
        .otherwise(brace)
    )
    default = F.when(lang == "go", "error").otherwise("Exception")
    return F.when(found == "", default).otherwise(found)


def identifiers(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"[a-zA-Z_]\w*"), F.lit(0))


# ---- names ----


def file_stem(col: Column) -> Column:
    return F.regexp_replace(col, r"(?<=.)\.[^.]*$", "")


def base_name(col: Column) -> Column:
    return F.element_at(F.split(col, "/"), -1)


def normalized_name(col: Column) -> Column:
    """File name with every `_<number>` removed from its stem."""
    ext = F.regexp_extract(col, r".(\.[^.]*)$", 1)
    return F.concat(F.regexp_replace(file_stem(col), r"_\d+", ""), ext)


def dotted_module(rel_path: Column) -> Column:
    """pkg/sub/mod.py -> pkg.sub.mod; a package's __init__ names the package."""
    stem = F.regexp_replace(rel_path, r"\.py$", "")
    parts = F.filter(F.split(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/"), lambda p: p != "")
    return F.array_join(parts, ".")


def output_name(method: Column) -> Column:
    """File-name stem for a method signature: no generics, parentheses to `_`, first parameter only."""
    s = F.regexp_replace(method, r"[()]", "_")
    s = F.regexp_replace(s, r"<[^>]*>", "")
    s = F.substring_index(s, ",", 1)
    s = F.regexp_replace(s, r"\*", "")
    return F.regexp_replace(s, r"^[_.]{1,2}", "")


def test_file_core(source: Column, symbol: Column, lang: Column, package: Column, rel_path: Column) -> Column:
    """Base name of the test file of a symbol, by language convention."""
    stem = F.regexp_replace(source, r"\.\w+$", "")
    plain = F.concat_ws("_", stem, symbol)
    folder = F.regexp_replace(F.get(F.split(F.regexp_replace(package, ";", ""), " "), F.lit(1)), r"\.", "/")
    java = F.when(package.isNull() | (package == ""), plain).otherwise(F.concat_ws("/", folder, plain))
    capital = F.concat(F.upper(F.substring(symbol, 1, 1)), F.expr("''"), symbol.substr(F.lit(2), F.length(symbol)))
    go_stem = F.when(rel_path.isNull() | (rel_path == ""), stem).otherwise(F.regexp_replace(rel_path, r"\.go", ""))
    return F.when(lang == "java", java).when(lang == "go", F.concat_ws("_", go_stem, capital)).otherwise(plain)


def test_suffix(base: Column, lang: Column, ext: Column) -> Column:
    return F.when(lang == "java", F.concat(base, F.lit("Test."), ext)).otherwise(F.concat(base, F.lit("_test."), ext))


def modifiers(mask: Column, legend: list[str]) -> Column:
    """Names of the set bits of a modifier mask."""
    return F.array_compact(
        F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(legend)])
    )


# ---- line numbers ----


def add_line_numbers(col: Column, start: Column) -> Column:
    return F.array_join(
        F.transform(F.split(col, "\n"), lambda line, i: F.concat(F.lit("[L"), (start + i).cast("string"), F.lit("] "), line)),
        "\n",
    )


def strip_line_numbers(col: Column) -> Column:
    """Remove the first line marker of every line."""
    return F.array_join(F.transform(F.split(col, "\n"), lambda l: F.regexp_replace(l, r"^(.*?)\[L\d+\] ", "$1")), "\n")


def first_line_number(col: Column) -> Column:
    return F.coalesce(F.regexp_extract(col, r"\[L(\d+)\]", 1).try_cast("long"), F.lit(0).cast("long"))


def last_line_number(col: Column) -> Column:
    """First marker of the last line that has one; 0 when no line has."""
    marked = F.filter(F.split(col, "\n"), lambda l: l.rlike(r"\[L\d+\]"))
    return F.coalesce(
        F.regexp_extract(F.try_element_at(marked, F.lit(-1)), r"\[L(\d+)\]", 1).try_cast("long"), F.lit(0).cast("long")
    )


def line_window(lines: Column, at: Column, reach: int = 3) -> Column:
    """Lines within `reach` of the 0-based line `at`, trimmed and numbered from 1."""
    first = F.greatest(F.lit(0), at - reach)
    last = F.least(F.size(lines) - 1, at + reach)
    part = F.transform(F.slice(lines, first + 1, last - first + 1), strip)
    return add_line_numbers(F.array_join(part, "\n"), first + 1)


# ---- logs ----


def log_health(col: Column) -> Column:
    """struct(build_errors, panics, timeouts) counted in a log text."""
    return F.struct(
        F.regexp_count(col, F.lit(r"(?m)^# .+\n.*error:")).alias("build_errors"),
        F.regexp_count(col, F.lit("panic:")).alias("panics"),
        F.regexp_count(col, F.lit("(?i)test timed out")).alias("timeouts"),
    )


def inferred_exit(col: Column) -> Column:
    """1 when the log reports failures or errors, else 0."""
    return F.when(col.rlike(r"\d+\s+failed") | col.rlike(r"\d+\s+error"), 1).otherwise(0)


PROBLEM_FILE_PATTERNS = (  # fixed values
    r"(?m)^(\.*/?[\w/]+\.go):",
    r"(?m)(?:^|\s)((?:[./\w-]+/)*[.\w-]+_test\.go)(?::\d+)?",
    r"(?m)((?:[./\w-]+/)*[.\w-]+_test_\d+\.go)",
    r"(?m)doc\s*\(([\w_.]+_test\.go)\)",
    r"(?m)main\s*\(([\w_.]+_test\.go)\)",
)
TEST_FUNCTION_PATTERNS = (  # fixed values
    r"\bfunc\s+(Test[\w\d_]+)\s*\(\s*\w+\s+\*?testing\.T\w*\s*\)",
    r"\bfunc\s+(Benchmark[\w\d_]+)\s*\(\s*\w+\s+\*testing\.B\s*\)",
    r"\bfunc\s+(Example[\w\d_]+)\s*\(\s*\)",
)


def _all_groups(col: Column, patterns: tuple[str, ...]) -> Column:
    return F.concat(*[F.regexp_extract_all(col, F.lit(p), F.lit(1)) for p in patterns])


def problem_files(col: Column) -> Column:
    """Distinct test files named in a build or run log."""
    found = F.filter(_all_groups(col, PROBLEM_FILE_PATTERNS), lambda f: f.contains("_test.go") | f.contains("_test_"))
    return F.array_distinct(found)


def go_test_functions(col: Column) -> Column:
    return _all_groups(col, TEST_FUNCTION_PATTERNS)


def package_lines(col: Column, lang: str) -> Column:
    patterns = {"go": r"package\s+.*", "java": r"package\s+.*;"}
    if lang not in patterns:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(col, F.lit(patterns[lang]), F.lit(0))


PYTHON_IMPORT = (  # single-line imports and parenthesised ones over several lines
    r"(?m)^(?:from\s+[\w.]+\s+import\s+(?:\([^)]*\)?|[\w,. \t]+)|import\s+[\w.]+(?:\s*,\s*[\w.]+)*)(?=[ \t]*(?:$|#))"
)
LINE_PATTERNS = {  # fixed values: what a package or import line looks like in a trimmed source line
    ("python", "import"): r"^(?:import\s+\w+|from\s+[\w.]+\s+import\s+[\w\s,]+)",
    ("java", "package"): r"^package\s+[\w.]+;",
    ("java", "import"): r"^import\s+[\w.]+;",
    ("go", "package"): r"^package\s+\w+",
    ("go", "import"): r'^import\s+"[\w./]+"',
}


def _python_imports(col: Column) -> Column:
    """Import statements, lines trimmed and without trailing commas; an open parenthesis is closed."""

    def tidy(stmt: Column) -> Column:
        text = strip(F.array_join(F.transform(F.split(stmt, "\n"), lambda l: F.regexp_replace(strip(l), r",\s*$", "")), "\n"))
        return F.when(text.contains("(") & ~text.contains(")"), F.concat(text, F.lit(")"))).otherwise(text)

    found = F.transform(F.regexp_extract_all(col, F.lit(PYTHON_IMPORT), F.lit(0)), tidy)
    return F.filter(found, lambda s: ~s.rlike(r"^import\s+(?:and|in|or|is|not|as)\b"))


def import_lines(col: Column, lang: str) -> Column:
    if lang == "python":
        return _python_imports(col)
    patterns = {"go": r"import\s+.*\n", "java": r"import\s+.*;"}
    return F.transform(F.regexp_extract_all(col, F.lit(patterns[lang]), F.lit(0)), strip)


def source_line_kind(line: Column, lang: str) -> Column:
    """'package' or 'import' for such a line of source, else null. Go's grouped imports: `windows.block_lines`."""
    kinds = [F.when(strip(line).rlike(p), kind) for (of, kind), p in LINE_PATTERNS.items() if of == lang]
    return F.coalesce(*kinds, F.lit(None).cast("string"))


def import_statement(col: Column, lang: str) -> Column:
    """Package line (where the language has one) followed by the import lines."""
    first = F.slice(package_lines(col, lang), 1, 1)
    return F.array_join(F.concat(first, import_lines(col, lang)), "\n")


# ---- test verdict lines ----


def passed_line(line: Column) -> Column:
    """`file::Class::test` of a PASSED progress line, else null."""
    return _joined(line, r"(\S+\.py)::([\w_]+)::(test_[\w_]+)\s+PASSED\s+\[")


def failed_line(line: Column) -> Column:
    """struct(test, detail) of a FAILED summary line, else null."""
    pattern = r"FAILED\s+(\S+\.py)::([\w_]+)::(test_[\w_]+)\s+-\s+(.*)"
    name = _joined(line, pattern)
    return F.when(name.isNotNull(), F.struct(name.alias("test"), strip(F.regexp_extract(line, pattern, 4)).alias("detail")))


def error_line(line: Column) -> Column:
    """struct(test, detail) of an ERROR summary line, else null."""
    pattern = r"ERROR\s+(\S+\.py)(?:\s+-\s+(.*))?"
    file = F.regexp_extract(line, pattern, 1)
    detail = strip(F.regexp_extract(line, pattern, 2))
    return F.when(
        file != "",
        F.struct(
            F.concat(file, F.lit("::CollectionError")).alias("test"),
            F.when(detail == "", "Collection error").otherwise(detail).alias("detail"),
        ),
    )


def _joined(line: Column, pattern: str) -> Column:
    parts = [F.regexp_extract(line, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("::", *parts))


def frequency_line(line: Column) -> Column:
    """struct(frequency, message) of a `Frequency: n - message` line, else null."""
    pattern = r"^Frequency: (\d+) - (.*)"
    n = F.regexp_extract(line, pattern, 1)
    return F.when(
        n != "", F.struct(n.cast("long").alias("frequency"), strip(F.regexp_extract(line, pattern, 2)).alias("message"))
    )


# ---- prompts ----


def retrieval_query(symbol: Column, source: Column) -> Column:
    return F.concat(
        F.lit("Find code related to "),
        symbol,
        F.lit(", to comprehensively test the code, include all relevant code. Below is the source code of the file: \n"),
        source,
    )


def join_contexts(texts: Column) -> Column:
    return F.array_join(texts, "\n\n---\n\n")


def estimated_tokens(col: Column) -> Column:
    return F.floor(F.length(col) / 4).cast("long")


def glob_regex(glob: str) -> str:
    """Anchored pattern of a base-name glob that knows only `*`."""
    return "^" + reduce(lambda s, ch: s + (".*" if ch == "*" else ch if ch.isalnum() or ch in "_-/ " else "\\" + ch), glob, "") + "$"
