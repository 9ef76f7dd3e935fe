"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm import (
    ann,
    langid,
    licenses,
    negatives,
    packing,
    pii,
    sharding,
    simhash,
    spelling,
    topk,
    toxicity,
    unigram,
    warc,
)
from tallow.llm.tables import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.predict_toxicity(documents, model)


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root = warc.write_bundles(table(spark, sf_dir, "pages"))
    return warc.read_bundles(index, root).drop("url")


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict_languages(documents, langid.fit(documents))


def op6_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_documents(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.find_personal_data(documents, pii.fit(documents))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    # some labels are wrong, as in data that was labelled by hand
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(embeddings.withColumn("label", noisy))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_toxicity,
        op3_warc_bundles,
        op4_inverted_multi_index,
        op5_language_id,
        op6_sentencepiece_unigram,
        op7_best_fit_packing,
        op8_simhash_near_dedup,
        op9_pii,
        op10_exact_top_k,
        op11_hard_negatives,
        op12_spelling_variants,
        op13_license_scan,
    )
}

# SHA-1 in base 32: each five hexadecimal digits are four of the 32.
_OP3_SQL = """
with p as (
    select page_id, coalesce(strlen(html), 0) as payload_bytes, sha1(coalesce(html, '')) as hex
    from pages
), firsts as (select hex, min(page_id) as first_id from p group by hex)
select page_id, payload_bytes,
    array_to_string([
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
            (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::int >> (15 - 5 * (i % 4))) & 31
        )::int, 1)
        for i in range(32)
    ], '') as payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id <> first_id then first_id end as refers_to
from p join firsts using (hex)
"""

_OP10_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, v.vec_id as vec_id,
        list_dot_product(q.e, v.e)::bigint as score
    from v q join v on q.vec_id <> v.vec_id
    where q.vec_id % 100 = 0
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""

_OP11_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as e
    from embeddings
    where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as anchor_id, v.vec_id, v.label = a.label as same, list_dot_product(a.e, v.e)::bigint as score
    from v a join v on a.vec_id <> v.vec_id
    where a.vec_id % 100 = 0
), p as (
    select anchor_id, vec_id as positive_id, score as positive_score
    from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
    select anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
        row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
    from p join s using (anchor_id)
    where not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

ORACLES: dict[str, str] = {
    "op3_warc_bundles": _OP3_SQL,
    "op10_exact_top_k": _OP10_SQL,
    "op11_hard_negatives": _OP11_SQL,
}
