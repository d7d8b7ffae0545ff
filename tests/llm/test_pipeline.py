"""The pipeline's stages one after the other, and every llm query with SQL against DuckDB."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from codelens_spark.llm import queries
from codelens_spark.llm.bpe import read_ranks
from codelens_spark.llm.jaccard import BATCH_ROWS, ngram_jaccard_join
from codelens_spark.llm.langid import CLASSES, FILTERS, WIDTHS, Network, accepted, identify
from codelens_spark.llm.mixing import mix_sources
from tools.check import TABLES, rows

SF = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="driver tables not present")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def small(spark):
    prose = {"en": "the of and to in that thing with for ", "de": "der die das und ßen schön über nicht "}
    out = [(i, " ".join((prose[lang].split() * 9)[i % 8: i % 8 + 30 + i % 17] + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}"] * 9), lang, f"s{i % 3}", None) for i in range(150) for lang in [["en", "de"][i % 2]]]
    out += [(200, out[3][1], "de", "s0", None), (201, None, "en", "s1", None), (202, "123 !!", None, "s1", None), (203, "", "en", None, None)]
    return spark.createDataFrame(out, DOCS)


def test_stages_by_hand(spark, tmp_path):
    docs = small(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = apply(spark, before, str(tmp_path))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        if name == "language_id":
            said = {r["doc_id"]: r["lang_pred"] for r in identify(before).collect()}
            assert {r["doc_id"] for r in kept.collect()} == {i for i, lang in said.items() if lang != "und"}
        elif name == "near_duplicates":
            part = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(before).collect()}
            assert {r["doc_id"] for r in kept.collect()} == set(part.values()) and part[200] == part[3]
        else:
            taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mix_sources(before).collect() if r["taken"]}
            assert Counter(r["doc_id"] for r in kept.collect()) == taken
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in kept.collect() for ids in [tool.encode_ordinary(r["text"])])
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 100


def test_rows_decide_for_themselves(spark):
    """Repeated and null ids: one row a component, each row's own language decision, each row's own share of the mix."""
    a, b = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta"))
    rows = [(1, a), (1, a), (2, b), (2, "other words " + a), (None, a), (None, b), (None, "quite another text of its own here"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted((str(i), str(t)) for i, t in [rows[0], rows[2], rows[6], rows[7]])

    said = small(spark).unionByName(spark.createDataFrame([(4, "123", "en", "s", None), (None, "the of and", "en", "s", None), (None, "7", "en", "s", None)], DOCS))
    out = corpus_pipeline.language_id(spark, said, "").collect()
    assert [r["text"] for r in out if r["doc_id"] is None] == ["the of and"] and "123" not in {r["text"] for r in out}
    assert len([r for r in out if r["doc_id"] == 4]) == 1

    mixed = spark.createDataFrame([(None, f"{'w ' * (i + 1)}{i}", "en", f"s{i % 3}", None) for i in range(60)], DOCS)
    want = Counter()
    for r in mix_sources(mixed.withColumn("n", F.col("text")), carry=["n"]).collect():
        want[r["n"]] += -(-r["taken"] // r["size"])
    got = Counter(r["text"] for r in corpus_pipeline.source_mix(spark, mixed, "").collect())
    assert got == +want and len(got) < 60


def test_rejected_lettered_text(spark):
    flat = Network(["a", "b", "c", "d"], [np.zeros((w, CLASSES, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros((FILTERS * len(WIDTHS), 4), np.float32), np.zeros(4, np.float32))
    docs = spark.createDataFrame([(1, "letters", "a", "s", None)], DOCS)
    found = identify(docs, net=flat)
    assert [(r["lang_pred"], r["score"]) for r in found.collect()] == [("a", 0.25)] and found.filter(accepted()).count() == 0
    flat.offset[1] = 1.0
    assert identify(docs, net=flat).filter(accepted()).count() == 1


@pytest.mark.parametrize("step, module, name", [("language_id", "langid", "identify"), ("token_ids", "bpe", "encode_documents")])
def test_texts_reach_python_some_at_a_time(spark, tmp_path, monkeypatch, step, module, name):
    """A batch lies outside of the heap twice, in the JVM and in the worker: neither may grow with the texts."""
    seen = tmp_path / "seen"

    def noted(docs, *_, id_col="doc_id", **__):
        def run(batches):
            for batch in batches:
                with open(seen, "a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield batch

        read = docs.select(id_col, "text").mapInArrow(run, f"{id_col} long, text string")
        return read.select(id_col, F.lit("en").alias("lang_pred"), F.lit(1.0).alias("score"))

    monkeypatch.setattr(f"codelens_spark.llm.{module}.{name}", noted)
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("the of and").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("n_chars")).coalesce(1)
    assert dict(corpus_pipeline.STAGES)[step](spark, docs, "").count() == 2500
    sizes = [int(x) for x in seen.read_text().split()]
    assert sum(sizes) == 2500 and max(sizes) <= BATCH_ROWS


def test_empty_documents(spark):
    none = spark.createDataFrame([], DOCS)
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, none, "").collect() == []


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@needs_tables
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, str(SF))
    got = df.collect()
    assert got
    if name in queries.ORACLES:
        rel = con.execute(queries.ORACLES[name])
        cols = [d[0] for d in rel.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows(df.columns, [tuple(r) for r in got]) == rows(cols, rel.fetchall())
