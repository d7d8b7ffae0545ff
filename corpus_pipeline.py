"""From raw documents to token ids: language ID, near-duplicate removal, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet and
reread as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens_spark.plans.stage import settled, stage


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a row number, written once so that it stays the same in every plan."""
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, row by row; texts that are null, have no letter or fit no learned language go."""
    from codelens_spark.llm.jaccard import BATCH_BYTES, BATCH_ROWS
    from codelens_spark.llm.langid import accepted, fit, identify
    from codelens_spark.llm.small import arrow_batches

    with arrow_batches(spark, BATCH_ROWS, BATCH_BYTES):
        net = fit(docs)
        if net is None:
            return docs.filter(F.lit(False))
        rows = _numbered(docs)
        found = stage(identify(rows, id_col="__row", net=net).filter(accepted()).select("__row"), "accepted")
    return rows.join(found, "__row", "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays: that of its least doc_id, null last."""
    from codelens_spark.llm.jaccard import ngram_jaccard_join

    rows = _numbered(docs)
    parts = ngram_jaccard_join(rows, id_col="__row").select(F.col("__row"), "component_id").join(rows.select("__row", "doc_id"), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"]
    kept = parts.groupBy("component_id").agg(first.alias("__row")).select("__row")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; the one at a source's cut stays whole."""
    from codelens_spark.llm.mixing import mix_sources

    rows = _numbered(docs)
    taken = mix_sources(rows, carry=["__row"]).filter("taken > 0").select("__row", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    joined = rows.join(taken, "__row")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    from codelens_spark.llm.bpe import encode_documents
    from codelens_spark.llm.jaccard import BATCH_BYTES, BATCH_ROWS
    from codelens_spark.llm.small import arrow_batches

    with arrow_batches(spark, BATCH_ROWS, BATCH_BYTES):
        return stage(encode_documents(docs), "token_ids")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("token_ids", token_ids)]
ORACLE_SQL = None  # language ID is a trained network


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, apply in STAGES[:-1]:
        # what a stage staged on its way, and the documents it was given, are deleted when its own are written
        docs = settled(lambda apply=apply, docs=docs: apply(spark, docs, sf_dir), name, also=done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
