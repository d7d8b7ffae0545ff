"""Joins over code-index tables.

The join strategy is left to the optimizer and its size checks; what these operators decide is the shape
of the join: equi-keys only, one row per key on the lookup side, no pairing inside a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, file_stem, normalized_name, strip
from ..plans.dictionary import find_words
from ..plans.intervals import prefix_max_at, stab_all, stab_best
from ..plans.skew import attach, first_per_key
from ..plans.stage import stage


def match_tasks(symbols: DataFrame, tasks: DataFrame, name: str = "symbol_name", path: str = "path") -> DataFrame:
    """Symbols that a task names, with the task's columns."""
    return symbols.join(tasks, [name, path], "inner")


def unmatched_tasks(symbols: DataFrame, tasks: DataFrame, name: str = "symbol_name", path: str = "path") -> DataFrame:
    """Tasks without a symbol: empty when the strict match holds."""
    return tasks.join(symbols, [name, path], "left_anti")


def match_fuzzy(symbols: DataFrame, wanted: DataFrame, key: str = "uri") -> DataFrame:
    """First symbol (by ord) of a file whose name contains the wanted name, ignoring case."""
    words = wanted.select(F.col(key).alias("key"), F.lower("name").alias("word"))
    texts = symbols.select(F.col(key).alias("key"), F.col("ord").alias("text_id"), F.lower("name").alias("text"))
    hit = contains_join(words, texts, keyed=True).groupBy("key", "word").agg(F.min("text_id").alias("ord"))
    return hit.withColumnRenamed("key", key).join(symbols, [key, "ord"])


def match_normalized(tests: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source file of each test, matching names without their `_<number>` parts.

    tests(test, method), mapping(test_name, file_name, symbol, ord). The entry whose symbol is the method
    under test is preferred, else the first in map order. Both lookups hold one row per key, so many
    entries of the same normal form do not multiply.
    """
    entries = mapping.withColumn("norm", normalized_name(F.col("test_name")))
    pick = F.struct("test_name", "file_name", "symbol", "ord")
    exact = entries.groupBy("norm", "symbol").agg(F.min_by(pick, "ord").alias("exact")).withColumnRenamed("symbol", "method")
    first = entries.groupBy("norm").agg(F.min_by(pick, "ord").alias("first"))
    rows = tests.withColumn("norm", normalized_name(base_name(F.col("test"))))
    rows = attach(attach(rows, exact, ["norm", "method"]), first, ["norm"])
    best = F.coalesce("exact", "first")
    return rows.select(
        *tests.columns, best["test_name"].alias("map_name"), best["file_name"].alias("file_name"), best["symbol"].alias("symbol")
    )


def split_test_name(name: Column, suffix: str = "_test.py") -> Column:
    """struct(parts, number) of `<module>_<function>_<number><suffix>`; null for other names."""
    parts = F.split(F.replace(name, F.lit(suffix), F.lit("")), "_")
    number = F.element_at(parts, -1)
    body = F.slice(parts, 1, F.size(parts) - 1)
    return F.when((F.size(parts) >= 3) & number.rlike(r"^\d+$"), F.struct(body.alias("parts"), number.alias("number")))


def longest_prefix_match(df: DataFrame, modules: DataFrame, name: str = "name", key: str = "name") -> DataFrame:
    """module, function, number of each test name; the module is the longest known token prefix.

    modules(module, ord) holds source-file stems. Each name is expanded into its few token prefixes, which
    meet the dictionary in an equi-join.
    """
    named = df.select(key, name).distinct() if key != name else df.select(name).distinct()
    split = named.withColumn("__s", split_test_name(F.col(name))).filter("__s is not null")
    parts = F.col("__s.parts")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), "_").alias("module")),
    )
    known = modules.select(F.regexp_replace("module", r"\.py", "").alias("module")).distinct()
    long_names = split.filter(F.size(parts) > 2)
    found = (
        long_names.select(key, F.explode(prefixes).alias("__p"))
        .select(key, "__p.n", "__p.module")
        .join(known, "module")
        .groupBy(key)
        .agg(F.max_by("module", "n").alias("__m"), F.max("n").alias("__n"))
    )
    return (
        split.join(found, key, "left")
        .withColumn("__n", F.coalesce("__n", F.lit(1)))
        .select(
            key,
            F.coalesce("__m", F.get(parts, F.lit(0))).alias("module"),
            F.array_join(F.slice(parts, F.col("__n") + 1, F.size(parts)), "_").alias("function"),
            F.col("__s.number").alias("number"),
        )
    )


def go_test_name(name: Column) -> Column:
    """struct(module, function, number): the first token is always the module."""
    s = split_test_name(name, "_test.go")
    return F.when(
        s.isNotNull(),
        F.struct(
            F.get(s["parts"], F.lit(0)).alias("module"),
            F.array_join(F.slice(s["parts"], 2, 1000), "_").alias("function"),
            s["number"].alias("number"),
        ),
    )


def smallest_enclosing(points: DataFrame, ivals: DataFrame, key: str = "uri", pos: str = "line") -> DataFrame:
    """For each distinct point: name of the covering interval with the fewest lines (first `ord` on ties)."""
    rank = [F.col("e") - F.col("s"), F.col("ord")]
    return stab_best(points, ivals, [key], pos, "s", "e", rank, ["name", "s", "e"])


def enclosing_chain(points: DataFrame, ivals: DataFrame, key: str = "uri", pos: str = "line") -> DataFrame:
    """All covering intervals of each point; `outer` orders a chain from the outermost inwards."""
    return stab_all(points, ivals, [key], pos, "s", "e").withColumn("outer", F.col("s") - F.col("e"))


def exclude_inside(defs: DataFrame, focal: DataFrame, key: str = "uri") -> DataFrame:
    """Drop definitions strictly inside a focal range of their file."""
    reach = prefix_max_at(defs, focal, [key], "s", "s", "e", "__reach", inclusive=False)
    return attach(defs, reach, [key, "s"], salts=1).filter(~F.coalesce(F.col("__reach") > F.col("e"), F.lit(False))).drop("__reach")


def exclude_overlap(refs: DataFrame, focal: DataFrame, key: str = "uri") -> DataFrame:
    """Drop references that touch a focal range of their file."""
    reach = prefix_max_at(refs, focal, [key], "e", "s", "e", "__reach", inclusive=True)
    return attach(refs, reach, [key, "e"], salts=1).filter(~F.coalesce(F.col("__reach") >= F.col("s"), F.lit(False))).drop("__reach")


def contains_join(words: DataFrame, texts: DataFrame, keyed: bool = False) -> DataFrame:
    """Distinct (key?, word, text_id) where the text contains `word` as a substring.

    One pass over the texts for words of any kind and length (`plans.dictionary`). Empty and null words match nothing.
    """
    key = ["key"] if keyed else []
    hits = find_words(words, texts, keyed).select(*key, "word", "text_id")
    # a text has each word once, so only the hits of repeated ids can repeat
    own = [*key, "text_id"]
    twice = stage(texts.groupBy(*own).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(c).alias("__" + c) for c in own]), "repeated")
    if twice.isEmpty():
        return hits
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("__" + c)) for c in own])
    return hits.join(twice, same, "left_anti").unionByName(hits.join(twice, same, "left_semi").distinct())


def propagate_same_line(tokens: DataFrame, matched: DataFrame) -> DataFrame:
    """(token_id, condition) of all tokens: matched ones keep theirs, and tokens on an assignment line
    inherit those of the line's first matched token.

    tokens(uri, line, ord, token_id, assign BOOLEAN), matched(token_id, condition).
    """
    hit = tokens.join(matched.select("token_id").distinct(), "token_id", "left_semi")
    lead = hit.filter("assign").groupBy("uri", "line").agg(F.min_by("token_id", "ord").alias("source"))
    rest = tokens.filter("assign").join(matched.select("token_id").distinct(), "token_id", "left_anti")
    inherited = attach(rest.select("uri", "line", "token_id"), lead, ["uri", "line"], how="inner", salts=1)
    given = matched.withColumnRenamed("token_id", "source")
    return matched.select("token_id", "condition").unionByName(
        inherited.join(given, "source").select("token_id", "condition")
    ).distinct()


def expand_use_def(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Tokens on a line with a target token, plus the declarations of functions that have a target."""
    lines = targets.select("uri", "line").distinct()
    files = targets.select("uri").distinct()
    near = tokens.join(lines, ["uri", "line"], "left_semi")
    declared = tokens.filter(F.get("modifiers", F.lit(0)) == "declaration").join(files, "uri", "left_semi")
    return first_per_key(near.unionByName(declared), ["uri", "id"], ["word"])


def find_redefined(reach: DataFrame, source_symbols: DataFrame, test_symbols: DataFrame) -> DataFrame:
    """Names reachable from the code under test that the test file defines again (variables aside).

    reach(test, name, uri), source_symbols(uri, name, line, ch, ord), test_symbols(test, name, kind, line, ch, ord).
    """
    def place(prefix: Column) -> Column:
        return F.concat(prefix, F.lit("@"), (F.col("line") + 1).cast("string"), F.lit(":"), F.col("ch").cast("string"))

    first_test = first_per_key(test_symbols, ["test", "name"], ["ord"]).filter("kind <> 'Variable'")
    first_source = first_per_key(source_symbols, ["uri", "name"], ["ord"])
    hits = reach.select("test", "name", "uri").distinct()
    hits = hits.join(first_test.select("test", "name", place(F.col("name")).alias("test_loc")), ["test", "name"])
    return hits.join(first_source.select("uri", "name", place(F.col("uri")).alias("source_loc")), ["uri", "name"], "left")


def group_by_parent(symbols: DataFrame) -> DataFrame:
    """(uri, parent, child) rows: symbols under their immediate parent; root symbols stand alone
    (child null) unless their file has any parent with children.

    symbols(uri, name, parent).
    """
    under = symbols.filter("parent is not null").select("uri", "parent", F.col("name").alias("child"))
    roots = symbols.filter("parent is null").select("uri", F.col("name").alias("parent"), F.lit(None).cast("string").alias("child"))
    return under.unionByName(roots.join(under.select("uri").distinct(), "uri", "left_anti"))


def pending(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks without a finished result."""
    return tasks.join(done, list(keys), "left_anti")


def finished_outputs(outputs: DataFrame) -> DataFrame:
    """Keys whose log and junit files both exist and are not empty: outputs(test, log_size, junit_size)."""
    return outputs.filter((F.col("log_size") > 0) & (F.col("junit_size") > 0))


def annotate_lines(lines: DataFrame, ranges: DataFrame, comment: Column | None = None) -> DataFrame:
    """Lines (doc, n, text) with the diagnostics (doc, s, e, message, ord) written into them.

    The first line of a range carries the range's trimmed lines and the message, the others are emptied. Where
    ranges meet, the group seen last wins, inside a group the range that starts first.
    """
    groups = ranges.groupBy("message").agg(F.min("ord").alias("__g"))
    ranked = attach(ranges, groups, ["message"])
    rank = [-F.col("__g"), F.col("s"), F.col("ord")]
    owner = stage(stab_best(lines, ranked, ["doc"], "n", "s", "e", rank, ["s", "e", "message"]), "owner")
    # only a range that owns its first line shows its text there
    body = (
        owner.filter("n = s and e > s").select("doc", "s", "e").distinct()
        .withColumn("n", F.explode(F.sequence("s", "e")))
        .join(lines.select("doc", "n", "text"), ["doc", "n"])
        .groupBy("doc", "s", "e")
        .agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda r: strip(r["text"])), "\n")).alias("__body"))
    )
    note = comment if comment is not None else F.concat(F.lit('# Error Group: "'), F.col("message"), F.lit('"'))
    out = lines.join(owner, ["doc", "n"], "left").join(body, ["doc", "s", "e"], "left")
    shown = (
        F.when(F.col("message").isNull(), F.col("text"))
        .when(F.col("n") == F.col("s"), F.concat(F.coalesce(F.col("__body"), strip(F.col("text"))), F.lit(" "), note))
        .otherwise("")
    )
    return out.withColumn("text", shown).select(*lines.columns, "message")


def import_origin(df: DataFrame, text: str = "text", module: str = "module", func: str = "function") -> DataFrame:
    """imported / reimplemented / unknown, with the import line, from per-row patterns; names are taken literally."""
    t = F.col(text)
    m, f = (F.concat(F.lit(r"\Q"), F.replace(F.col(c), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")) for c in (module, func))
    # a name ends at a word boundary, or anywhere if its last character is none of a word
    after = lambda c: F.when(F.col(c).rlike(r"\w$"), r"\b").otherwise("")
    before = F.when(F.col(func).rlike(r"^\w"), r"\b").otherwise("")
    direct = F.concat(F.lit(r"from\s+"), m, F.lit(r"\s+import\s+.*"), before, f, after(func))
    whole = F.concat(F.lit(r"import\s+"), m, after(module))
    line = F.coalesce(F.regexp_substr(t, direct), F.regexp_substr(t, whole))
    defined = F.regexp_like(t, F.concat(F.lit(r"def\s+"), f, after(func)))
    origin = F.when(line.isNotNull(), "imported").when(defined, "reimplemented").otherwise("unknown")
    return df.withColumn("origin", origin).withColumn("import_line", line).withColumn(
        "module_path", F.when(line.isNotNull(), F.col(module))
    )


def map_to_source(tests: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source stem per test name, via `match_normalized`."""
    return match_normalized(tests, mapping).withColumn("source_stem", file_stem(base_name(F.col("file_name"))))
