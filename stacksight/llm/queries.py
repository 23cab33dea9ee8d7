"""The registered queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, delta_lloyd, divergence, language, licenses, lsh_forest, packing, prefix_forest, recompression, semi_crf, suffix_array, tokencounts, toxicity, twins


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.deduplicate(_table(spark, sf_dir, "documents"), with_text=False)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs)).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.search(_table(spark, sf_dir, "embeddings"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.deduplicate(_table(spark, sf_dir, "documents"), with_text=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.section_tokens(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return semi_crf.find(docs, semi_crf.train(docs))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster(_table(spark, sf_dir, "embeddings"))


_OPERATORS = (
    op1_suffix_array_dedup, op2_decontamination, op3_language_id, op4_packing, op5_nearest_neighbours, op6_minhash_near_dedup, op7_license_scan, op8_recompression, op9_token_counts, op10_toxicity,
    op11_source_divergence, op12_personal_data, op13_centroid_clustering,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": twins.OP1,
    "op6_minhash_near_dedup": twins.OP6,
    "op7_license_scan": licenses.oracle_sql(),
    "op8_recompression": twins.OP8,
    "op11_source_divergence": twins.OP11,
    "op13_centroid_clustering": twins.OP13,
}
