"""Report writers. Everything is written by the executors; nothing is gathered first."""

from __future__ import annotations

from collections.abc import Sequence

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..operators.aggregates import status_count_rows
from ..operators.predicates import is_error_status
from ..operators.sets import merge_map


def name_lists(tests: DataFrame) -> DataFrame:
    """(list, entry): names of passed, assertion-failed and errored tests, as they stand in the text lists."""
    status = F.col("status")
    which = F.when(status == "Passed", "passed").when(status == "Assertion Errors", "assertion_errors").when(is_error_status(status), "errors")
    entry = F.when((which == "errors") & F.col("error_type").isNotNull(), F.concat("test", F.lit(" ["), "error_type", F.lit("]"))).otherwise(F.col("test"))
    return tests.select(which.alias("list"), entry.alias("entry")).filter("list is not null")


def write_report(tests: DataFrame, out: str) -> None:
    """tests/ (one JSON row per test), files/ (counts per file), lists/list=<name>/ (sorted names)."""
    tests.write.mode("overwrite").json(f"{out}/tests")
    status_count_rows(tests).write.mode("overwrite").json(f"{out}/files")
    # range partitioning on the full sort key keeps the name order across files and splits long lists
    lists = name_lists(tests).repartitionByRange("list", "entry").sortWithinPartitions("list", "entry")
    lists.write.mode("overwrite").partitionBy("list").text(f"{out}/lists")


def unified_log(execs: DataFrame, logs: DataFrame) -> DataFrame:
    """(name, n, line): for each executed file a header, its log lines (or a placeholder), and a blank line.

    execs(test_file, log_path), logs(log_path, n, line) with n from 0.
    """
    names = execs.select(base_name(F.col("test_file")).alias("name"), "log_path")
    head = names.select("name", F.lit(-1).alias("n"), F.concat(F.lit("===== "), "name", F.lit(" =====")).alias("line"))
    body = names.join(logs, "log_path", "left").select(
        "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("line", F.lit("(log file missing)")).alias("line")
    )
    tail = names.select("name", F.lit(2**31 - 1).alias("n"), F.lit("").alias("line"))
    return head.unionByName(body).unionByName(tail)


def write_unified_log(execs: DataFrame, logs: DataFrame, out: str) -> None:
    """Text files whose concatenation in name order is the unified log."""
    rows = unified_log(execs, logs).repartitionByRange("name", "n").sortWithinPartitions("name", "n")
    rows.select("line").write.mode("overwrite").text(out)


def matrix_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbers with 9 decimals, `None` for missing."""
    return df.select("row_id", *[F.when(F.col(c).isNull(), "None").otherwise(F.format_string("%.9f", F.col(c))).alias(c) for c in cols])


def write_matrix(df: DataFrame, cols: Sequence[str], out: str, order: Sequence[str] = ("project", "model_ord")) -> None:
    rows = df.orderBy(*order)
    cells = [F.when(F.col(c).isNotNull(), F.format_string("%.9f", F.col(c))).alias(c) for c in cols]
    rows.select(F.col("row_id").alias("project"), *cells).write.mode("overwrite").option("header", True).option("nullValue", "None").csv(out)


def upsert_map(existing: DataFrame, new: DataFrame, key: str, out: str) -> None:
    """Write the merged map to a new place; the old one may still be read meanwhile."""
    merge_map(existing, new, key).write.mode("errorifexists").json(out)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row of files(path, content) as a file of its own below `root`; returns (path, bytes).

    Nothing is written until the result is read or written. Paths are relative and should differ; a null content is an
    empty file. A task that is repeated writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (content.as_py() or "").encode()
                where.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")
