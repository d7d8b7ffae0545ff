"""One query per operator over the whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_ngram_jaccard")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and near-duplicate components of all documents."""
    from .jaccard import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def _mix_sql() -> str:
    from .mixing import MIX_SQL

    return MIX_SQL


@query("op4_mix_sources", _mix_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of each document."""
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, encoded and decoded."""
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


@query("op7_shard_bytes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to seekable files and read back."""
    from .tokenfile import token_digests

    return token_digests(table(spark, sf_dir, "documents"))


@query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC captures, read back and assembled."""
    from .warc import page_captures

    return page_captures(table(spark, sf_dir, "pages"))


@query("op2_embedding_neardup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate components of all embeddings."""
    from .forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
    where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2]))::bigint as score
    from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query("op5_topk_search", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth embedding among all others."""
    from .voronoi import topk_inner_product

    vectors = table(spark, sf_dir, "embeddings")
    return topk_inner_product(vectors.filter(F.col("vec_id") % 20 == 0), vectors)


def _licence_sql() -> str:
    from .licences import SCAN_SQL

    return SCAN_SQL


@query("op6_licence_scan", _licence_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best licence match of all documents."""
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


@query("op11_pii_anchors")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts, digest of the base kinds, and all spans."""
    from .personal import personal_digests

    return personal_digests(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with t as (select d.row, d.doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select row_number() over () as row, * from documents) d),
n as (select row, doc_id, count(*) as n from t group by all),
tot as (select count(*) as docs, sum(n)::bigint as words from n),
p as (select row, term, count(*) as tf from t group by all),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, tot group by term),
q as (select i.row as item, i.item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select row_number() over () as row, * from (select distinct item_id, text from benchmark)) i),
s as (select q.item, any_value(q.item_id) as item_id, n.row, any_value(n.doc_id) as doc_id,
        sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * n.n * tot.docs) // tot.words))))::bigint as score
    from q join w using (term) join p using (term) join n on n.row = p.row, tot group by q.item, n.row),
r as (select item_id, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20
"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item among all documents."""
    from .lexical import ranked_search

    return ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


OP12_SQL = """
with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
    from embeddings where label is not null and embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor_id, a.label = d.label as same, d.id, list_sum(list_transform(list_zip(a.e, d.e), lambda p: p[1] * p[2]))::bigint as score
    from v a join v d on a.id <> d.id where a.id % 100 = 0),
p as (select anchor_id, id, score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id)::int as rank
    from p join s on p.anchor_id = s.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and hard negatives of every hundredth embedding."""
    from .negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))
