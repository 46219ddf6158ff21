"""Queries over the corpus operators, each on its whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillet.llm import bpe, classifier, conversations, exact_dedup, langid, licences, lm, near_dup, packing, pii, quality, ranked, sharding
from quillet.llm.common import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    training = langid.training_rows(F.col("doc_id"))
    model = langid.train(docs.where(training))
    return langid.predict(docs.select("doc_id", "text", (~training).alias("held_out")), model).drop("text")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.report(conversations.rows_of(conversations.damaged(rows)), rows.select("conv_id"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_exact_dedup,
        op3_best_fit_packing,
        op4_rendezvous_sharding,
        op5_pii,
        op6_near_dedup,
        op7_quality,
        op8_language_id,
        op9_byte_bpe,
        op10_lm_score,
        op11_conversation_repair,
        op12_quality_classifier,
        op13_ranked_search,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {"op1_license_scan": licences.scan_sql(), "op2_exact_dedup": exact_dedup.DEDUP_SQL, "op11_conversation_repair": conversations.report_sql(), "op13_ranked_search": ranked.SEARCH_SQL}
