"""A keyed map in hash buckets: an upsert rewrites only the buckets it touches, and readers see whole versions.

    folder/data/<name>/bucket=<n>/...    rows of one bucket, written once and never changed
    folder/versions/version=<v>/         one row per bucket: where its rows are

A version exists when its list has been written, which is the last thing an upsert does; what a failed upsert leaves under
`data` is in no list. One upsert at a time may run on a folder.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "bucket int, buckets int, folder string, version int"


def _latest(spark: SparkSession, folder: str) -> list:
    """The rows of the newest list, at most one per bucket; empty for a new map."""
    try:
        lists = spark.read.schema(LIST).option("basePath", f"{folder}/versions").parquet(f"{folder}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    newest = lists.agg(F.max("version")).first()[0]
    return lists.filter(F.col("version") == newest).collect()


def read_map(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of the newest version."""
    entries = _latest(spark, folder)
    if not entries:
        raise ValueError(f"{folder}: no map")
    return spark.read.parquet(*sorted(e["folder"] for e in entries))


def upsert(new: DataFrame, key: str, folder: str, buckets: int = 256) -> int:
    """Put the rows of `new` into the map, in place of entries with their keys; returns the version.

    Keys of `new` must be unique; a null key is a key like any other. `buckets` counts for a new map only.
    """
    spark = new.sparkSession
    entries = _latest(spark, folder)
    buckets = entries[0]["buckets"] if entries else buckets
    version = entries[0]["version"] + 1 if entries else 0
    place = f"{folder}/data/{uuid.uuid4().hex}"
    rows = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most `buckets` rows
    old = [e["folder"] for e in entries if e["bucket"] in touched]
    if old:
        kept = spark.read.parquet(*old).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        fresh = rows.select(F.col(key).alias("__key"))
        kept = kept.join(fresh, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        rows = kept.select(*rows.columns).unionByName(rows)
    rows.write.partitionBy("bucket").parquet(place)
    listed = [(e["bucket"], buckets, e["folder"]) for e in entries if e["bucket"] not in touched]
    listed += [(b, buckets, f"{place}/bucket={b}") for b in sorted(touched)]
    if not listed:  # an empty map has a list of one empty bucket
        rows.drop("bucket").write.parquet(f"{place}/bucket=0")
        listed = [(0, buckets, f"{place}/bucket=0")]
    lists = spark.createDataFrame(listed, "bucket int, buckets int, folder string").coalesce(1)
    lists.write.parquet(f"{folder}/versions/version={version}")
    return version
