"""Readers for run logs, diagnostic reports, test maps, event lines and coverage profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import number, strip
from . import schemas as S
from .files import read_files


def _files(spark: SparkSession, paths: str | Sequence[str], glob: str) -> DataFrame:
    """(file, content) of every matching file below the paths; one row per file."""
    return read_files(spark, [paths] if isinstance(paths, str) else list(paths), glob)


def parse_process_logs(files: DataFrame) -> DataFrame:
    """(file, seq, process, time_ms, tokens, ...) from (file, content) rows holding one JSON array each.

    A file that is not a JSON array keeps one row with a null process, so it still counts as a file.
    """
    entry = T.ArrayType(T.StructType.fromDDL(S.PROCESS_ENTRY))
    is_list = F.ltrim(F.regexp_replace("content", r"^\s+", "")).startswith("[") & F.try_parse_json("content").isNotNull()
    rows = files.select("file", F.posexplode_outer(F.when(is_list, F.from_json("content", entry))).alias("seq", "e"))
    process = F.when(F.col("e").isNotNull(), F.coalesce("e.process", F.lit("Unknown Process")))
    return rows.select(
        "file",
        "seq",
        process.alias("process"),
        number(F.col("e.time")).alias("time_ms"),
        number(F.col("e.llmInfo.tokenUsage")).alias("tokens"),
        F.col("e.llmInfo.result").alias("result"),
        F.col("e.llmInfo.prompt").alias("prompt"),
        F.col("e.llmInfo.model").alias("model"),
        F.col("e.method").alias("method"),
        F.col("e.fileName").alias("file_name"),
        F.col("e.function").alias("function"),
    )


def read_process_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Run logs of all `*.json` files below the paths, diagnostic reports left out."""
    files = _files(spark, paths, "*.json").filter(~F.col("file").endswith("diagnostic_report.json"))
    return parse_process_logs(files)


def parse_diag_rounds(files: DataFrame) -> DataFrame:
    """(file, round, pos, message) from (file, content) rows; contents that are not objects are dropped."""
    doc = F.from_json("content", T.StructType.fromDDL(S.DIAG_REPORT))
    is_object = F.regexp_replace("content", r"^\s+", "").startswith("{") & F.try_parse_json("content").isNotNull()
    rounds = files.filter(is_object).select("file", F.posexplode(doc["roundHistory"]).alias("nth", "r"))
    return rounds.select("file", F.coalesce("r.round", F.lit(0)).alias("round"), "nth", F.posexplode("r.diagnosticMessages").alias("pos", "message"))


def read_diag_rounds(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_diag_rounds(_files(spark, path, "*.[jJ][sS][oO][nN]"))


def round_sets(rounds: DataFrame) -> DataFrame:
    """One entry per file, round number and message; where a number repeats, the later round replaces the earlier."""
    last = rounds.groupBy("file", "round").agg(F.max("nth").alias("nth"))
    return rounds.join(last, ["file", "round", "nth"], "left_semi").select("file", "round", "message").distinct()


def parse_map_json(files: DataFrame, value_type: str = S.MAP_ENTRY) -> DataFrame:
    """(file, ord, key, value fields) from (file, content) rows holding an object keyed by name."""
    entries = F.map_entries(F.from_json("content", f"map<string,{value_type}>"))
    return files.select("file", F.posexplode(entries).alias("ord", "kv")).select("file", "ord", F.col("kv.key").alias("key"), "kv.value.*")


def read_map_json(spark: SparkSession, path: str | Sequence[str], value_type: str = S.MAP_ENTRY) -> DataFrame:
    return parse_map_json(_files(spark, path, "*.json"), value_type)


def read_test_map(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """test_map(test_name, project, file_name, symbol, ord)."""
    m = read_map_json(spark, path)
    return m.select(F.col("key").alias("test_name"), F.col("project_name").alias("project"), "file_name", F.col("symbol_name").alias("symbol"), "ord")


def read_tasks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(S.TASK).option("multiLine", True).json(path)


# ---- JSON lines with noise ----


def _parsed(df: DataFrame, col: str, schema: str) -> DataFrame:
    return df.withColumn("__j", F.from_json(F.col(col), schema))


def _valid(required: Sequence[str]) -> Column:
    keep = F.lit(True)
    for name in required:
        keep = keep & F.coalesce(F.col(f"__j.{name}").cast("string") != "", F.lit(False))
    return keep


def read_jsonl_tolerant(df: DataFrame, schema: str, required: Sequence[str], col: str = "value") -> DataFrame:
    """Lines that parse and carry the required keys, their fields added as columns."""
    return _parsed(df, col, schema).filter(_valid(required)).select(*df.columns, "__j.*")


def jsonl_line_counts(df: DataFrame, schema: str, required: Sequence[str], col: str = "value") -> DataFrame:
    """One row: valid lines, noise lines (headers, blanks and plain verdict lines are neither)."""
    text = F.col(col)
    header = (strip(text) == "") | text.startswith("===")
    valid = F.coalesce(_valid(required), F.lit(False)) & ~header
    broken = F.try_parse_json(text).isNull()
    verdict = text.contains("PASS") | text.contains("FAIL") | text.contains("===")
    return _parsed(df, col, schema).agg(
        F.count_if(valid).alias("valid"), F.count_if(~header & broken & ~verdict).alias("noise")
    )


def read_go_events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "value")
    return read_jsonl_tolerant(lines, S.GO_EVENT, ["Test", "Action"])


# ---- coverage profiles ----


def parse_cover_lines(lines: DataFrame) -> DataFrame:
    """cov(block, stmts, hits) from text lines; the mode header and malformed lines are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("mode:")).select(parts.alias("p")).filter(F.size("p") == 3)
    return rows.select(
        F.get("p", F.lit(0)).alias("block"), F.get("p", F.lit(1)).try_cast("int").alias("stmts"), F.get("p", F.lit(2)).try_cast("long").alias("hits")
    ).filter("hits is not null")


def read_cover_profile(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_cover_lines(spark.read.text(path))


# ---- mutation reports ----


def parse_mutation_report(lines: DataFrame) -> DataFrame:
    """mutants(file, block, module, operator, lineno, status) from report lines (file, n, value).

    A new entry opens at each `- exception_traceback:` line; fields before the first one belong to entry 0.
    An entry without its own module inherits the last module named before it.
    """
    from ..plans.scan import Run, running

    v = F.col("value")

    def grab(pattern: str, cond: Column | None = None) -> Column:
        g = F.nullif(F.regexp_extract(v, pattern, 1), F.lit(""))
        return F.when(cond, g) if cond is not None else g

    opens = v.rlike(r"^\s*-\s+exception_traceback:")
    module = grab(r"module:\s*(?:&\w+\s*)?!!python/module:([^\s]+)")
    marked = running(
        lines,
        ["file"],
        "n",
        [
            Run("block", "sum", F.when(opens, 1).otherwise(0)),
            Run("mod_at", "max", F.when(module.isNotNull(), F.col("n"))),
            Run("list_at", "max", F.when(v.rlike(r"^\s*mutations:\s*$"), F.col("n"))),
            Run("open_at", "max", F.when(opens, F.col("n"))),
        ],
    )
    listed = F.col("list_at").isNotNull() & (F.col("list_at") > F.coalesce("open_at", F.lit(-1)))
    blocks = marked.groupBy("file", "block").agg(
        F.min_by(module, F.when(module.isNotNull(), F.col("n"))).alias("own"),
        F.min("n").alias("from_n"),
        F.min_by(grab(r"^\s*operator:\s*([A-Z]+)", listed), F.when(grab(r"^\s*operator:\s*([A-Z]+)", listed).isNotNull(), F.col("n"))).alias("operator"),
        F.min_by(grab(r"^\s*-\s*lineno:\s*([0-9]+)", listed), F.when(grab(r"^\s*-\s*lineno:\s*([0-9]+)", listed).isNotNull(), F.col("n"))).alias("lineno"),
        F.max_by(grab(r"^\s*status:\s*([a-zA-Z_]+)"), F.when(grab(r"^\s*status:\s*([a-zA-Z_]+)").isNotNull(), F.col("n"))).alias("status"),
        F.max("mod_at").alias("mod_at"),
    )
    named = lines.select("file", F.col("n").alias("mod_at"), module.alias("seen")).filter("seen is not null")
    before = marked.filter(opens).select("file", "block", F.when(F.col("mod_at") < F.col("n"), F.col("mod_at")).alias("before_at"))
    out = (
        blocks.join(before, ["file", "block"], "left")
        .join(named.withColumnRenamed("mod_at", "before_at").withColumnRenamed("seen", "earlier"), ["file", "before_at"], "left")
    )
    filled = out.filter("block > 0 or own is not null or operator is not null or status is not null")
    return filled.select("file", "block", F.coalesce("earlier", "own").alias("module"), "operator", F.col("lineno").cast("int").alias("lineno"), "status")
