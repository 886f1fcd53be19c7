"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.llm import (
    byte_bpe,
    clustering,
    decontaminate,
    fingerprints,
    near_dedup,
    oracles,
    packing,
    pii,
    quality,
    quotation,
    token_counts,
    topk,
    toxicity,
    whitening,
)
from sensorgrid.llm.common import documents
from sensorgrid.session import apply_runtime_conf

Query = Callable[[SparkSession, str], DataFrame]


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations`` without quotes, in reply order."""
    return quotation.reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, network)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, machine)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_spans(documents(spark, sf_dir)))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(documents(spark, sf_dir))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10)


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_windows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.contamination(found)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(apply_runtime_conf(spark), sf_dir)

    run.__doc__ = query.__doc__
    return run


QUERIES: dict[str, Query] = {q.__name__: _configured(q) for q in (
    op1_quotation_linking, op2_token_counts, op3_quality_classifier, op4_minhash_near_dedup, op5_packing,
    op6_merkle_fingerprints, op7_toxicity, op8_personal_data, op9_byte_bpe, op10_exact_top_k, op11_centroid_clustering,
    op12_benchmark_decontamination, op13_embedding_whitening, pipeline)}

ORACLES: dict[str, str] = {
    "op4_minhash_near_dedup": oracles.MINHASH_NEAR_DEDUP,
    "op10_exact_top_k": oracles.EXACT_TOP_K,
    "op11_centroid_clustering": oracles.centroid_clustering(),
    "op12_benchmark_decontamination": oracles.DECONTAMINATION,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
