"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.llm import (ann, decontam, idcoder, licenses, linededup, merkle, neardup, packing, pii, quality, sharding,
                        spelling, toxicity)
from huddle.llm.common import table
from huddle.llm.tokens import default_tokenizer
from huddle.session import scratch_path


def op1_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # documents has no paths: source, language and runs of 100 ids stand for directories
    path = F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer())


def op5_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_fast_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    idcoder.write_ids(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return idcoder.read_ids(spark, path)


def op9_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "source", "lang", F.col("_evidence").alias("evidence"), F.col("_host").alias("host_posterior"),
                       F.col("_path").alias("path_posterior"), F.col("_score").alias("score"),
                       (F.col("_score") >= quality.KEEP_FROM).alias("kept"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_range_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated_digests(table(spark, sf_dir, "documents"))


def op12_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_dag_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_extendible_hashing": op1_extendible_hashing,
    "op2_disclosure": op2_disclosure,
    "op3_license_scan": op3_license_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_qgram_lemma": op5_qgram_lemma,
    "op6_permutation_index": op6_permutation_index,
    "op7_fast_similarity_sketch": op7_fast_similarity_sketch,
    "op8_range_coder": op8_range_coder,
    "op9_empirical_bayes": op9_empirical_bayes,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_range_lines": op11_range_lines,
    "op12_bit_sliced": op12_bit_sliced,
    "op13_dag_descent": op13_dag_descent,
}
