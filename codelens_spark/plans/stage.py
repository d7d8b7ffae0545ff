"""Cutting lineage with tables written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}
_RUN = threading.local()  # .staged: tables that this thread has written and not deleted, oldest first


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: `spark.checkpoint.dir`, or a temp folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once as parquet and read it back.

    Unlike a cached or locally checkpointed frame the result outlives any executor, and the reader
    gets real size statistics, so joins on the staged table are planned from its true size. The shuffle files behind it
    are removed as soon as it is written, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _staged().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _staged() -> list[str]:
    if not hasattr(_RUN, "staged"):
        _RUN.staged = []
    return _RUN.staged


def settled(make: Callable[[], DataFrame], tag: str, also: Sequence[DataFrame] = ()) -> DataFrame:
    """The staged result of `make`, without the tables that were staged on the way to it.

    These are deleted once the result is written, and so are the files of `also`, staged tables that nothing needs any
    more. The result must be all that is used of what `make` computed.
    """
    staged = _staged()
    first = len(staged)
    result = stage(make(), tag)
    spark = result.sparkSession
    gone = staged[first:-1] + [p for p in staged[:first] if any(f.startswith(_plain(p)) for d in also for f in map(_plain, d.inputFiles()))]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    staged[:] = [p for p in staged if p not in set(gone)]
    return result


def _plain(path: str) -> str:
    """A path without its scheme, for comparing `file:/x` with `file:///x` and `/x`."""
    return "/" + path.split(":", 1)[-1].lstrip("/") if ":" in path.split("/", 1)[0] else path
