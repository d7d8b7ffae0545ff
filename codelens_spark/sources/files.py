"""Reading many files as rows: folders are listed and files read by the tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES, ROWS = 8 << 20, 1024  # content and files of a result batch, about
_FILE = "base string, file string"


def _shown(path: str) -> str:
    """A path as part of a URI, as Spark writes it."""
    return re.sub(r"[^\w\-!.~'()*/:@&=+$,;]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), path)


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(glob: str):
    """Batches of root URIs -> the matching files below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root in (r for b in batches for r in b.column(0).to_pylist()):
            where, base = fs.FileSystem.from_uri(root)
            open_, first = [base], where.get_file_info(base)
            found = [first] if first.type == fs.FileType.File else None
            while open_:
                folder = open_.pop()
                below = found if found is not None else where.get_file_info(fs.FileSelector(folder))
                open_ += [f.path for f in below if f.type == fs.FileType.Directory and not _hidden(f.base_name)]
                names = [f.path for f in below if f.type == fs.FileType.File and f.size != 0 and not _hidden(f.base_name) and fnmatchcase(f.base_name, glob)]
                for at in range(0, len(names), 1 << 16):
                    part = names[at: at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([root] * len(part), pa.string()), pa.array(part, pa.string())], names=["base", "file"])

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: dict[str, tuple[fs.FileSystem, str]] = {}
    names, contents, size = [], [], 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file", "content"])

    for batch in batches:
        for root, path in zip(*(c.to_pylist() for c in batch.columns)):
            if root not in opened:
                where, base = fs.FileSystem.from_uri(root)
                before = root[: root.index(_shown(base))]
                opened[root] = where, "file:" if before == "file://" else before
            where, before = opened[root]
            with where.open_input_stream(path, compression=None) as source:
                data = source.read()
            names.append(before + _shown(path))
            contents.append(data)
            size += len(data)
            if size > BYTES or len(names) >= ROWS:
                yield rows()
                names, contents, size = [], [], 0
    if names:
        yield rows()


def read_files(spark: SparkSession, paths: Sequence[str], glob: str) -> DataFrame:
    """(file, content) of every file below the paths whose name matches; hidden and empty ones are passed over, as Spark does.

    A task lists a path folder by folder, and the files are dealt to all tasks by name. Spark's own reader opens every
    file at a cost of a millisecond or more and lists all of them in the driver; it reads paths with wildcards.
    """
    roots = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        where = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if re.search(r"[*?\[{]", p) or not where.exists(path):  # wildcards, or Spark's own error
            reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            return reader.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
        roots.append(path.makeQualified(where.getUri(), where.getWorkingDirectory()).toUri().toString())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame([(r,) for r in roots], "root string").repartition(len(roots)).mapInArrow(_listed(glob), _FILE)
    return found.repartition(tasks, "file").mapInArrow(_contents, "file string, content binary").select("file", F.col("content").cast("string").alias("content"))
