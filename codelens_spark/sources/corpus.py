"""Source-code corpus and log-line readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R


def classify_files(files: DataFrame, ext_map: Mapping[str, str] = R.CODE_EXTENSIONS, ignore: Sequence[str] = R.IGNORED_DIRS) -> DataFrame:
    """doc(path, lang, content, size) from (path, content): known extensions, no ignored folder on the path."""
    ext = F.regexp_extract("path", r"[^/.][^/]*\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in ext_map.items() for x in kv])
    clean = ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in ignore]))
    return files.filter(ext.isin(*ext_map) & clean).select("path", table[ext].alias("lang"), "content", F.length("content").alias("size"))


def read_corpus(spark: SparkSession, root: str, ext_map: Mapping[str, str] = R.CODE_EXTENSIONS, ignore: Sequence[str] = R.IGNORED_DIRS) -> DataFrame:
    """All code files below `root`, with paths relative to it. Other extensions are not even opened."""
    glob = "*.{" + ",".join(ext_map) + "}"
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+://?|/+$", "")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/*", "/")
    rel = path.substr(F.length(F.concat(F.lit("/"), F.regexp_replace(base, "^/", ""))) + 2, F.length(path))
    return classify_files(reader.text(root, wholetext=True).select(F.url_decode(rel).alias("path"), F.col("value").alias("content")), ext_map, ignore)


def split_lines(docs: DataFrame, key: str, text: str, first: int = 0) -> DataFrame:
    """(key, n, text): one row per line, numbered from `first`."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "text")).withColumn("n", F.col("n") + first)
