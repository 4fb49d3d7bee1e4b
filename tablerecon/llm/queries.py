"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, hard_negatives, html_extract, jaccard_join, language_id, licenses, mixing, packing, pii, quality_qda, quality_rules, topk_search
from .common import id_remainder, ship, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learned(docs)).select("doc_id", (id_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_qda.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_best_fit_packing, op2_topk_search, op3_pii, op4_html_extraction, op5_jaccard_join, op6_quality_rules, op7_bpe, op8_language_id, op9_quality_classifier, op10_license_scan,
        op11_source_mixing, op12_hard_negatives, op13_filter_audit,
    )
}
#: searches, digests and counts that SQL can say; the others are tested against brute force
ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": """
with v as (select distinct vec_id, embedding, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as x from embeddings
           where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
parts as (select vec_id, unnest(x) as c, generate_subscripts(x, 1) as i, len(x) as dim from v),
pairs as (select q.vec_id as query_id, d.vec_id as vec_id, cast(sum(q.c * d.c) as bigint) as score
          from parts q join parts d on q.i = d.i and q.dim = d.dim and q.vec_id <> d.vec_id where q.vec_id % 50 = 0 group by 1, 2)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from pairs qualify rank <= 5""",
    "op10_license_scan": licenses.oracle_sql(),
    "op11_source_mixing": mixing.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
