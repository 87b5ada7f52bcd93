"""The queries of this subpackage, by the names under which __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankcut.llm.decontamination import contaminated
from rankcut.llm.exact_dup import EXACT_SQL, exact_duplicates
from rankcut.llm.knn import nearest
from rankcut.llm.lexical import LEXICAL_SQL, ranked_documents
from rankcut.llm.licenses import license_sql, scan_licenses
from rankcut.llm.lm import score_documents
from rankcut.llm.near_dup import near_duplicates
from rankcut.llm.packing import pack_documents
from rankcut.llm.paragraphs import repeated_passages
from rankcut.llm.periodic import periodic_runs, with_planted_repeats
from rankcut.llm.quality import classify
from rankcut.llm.records import store_and_read
from rankcut.llm.token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 100 = 0"), vectors, k=10)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is a folder, the language one within it, and the doc_id the name."""
    docs = _table(spark, sf_dir, "documents")
    found = scan_licenses(docs.select(F.col("doc_id").alias("key"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))
    return found.withColumnRenamed("key", "doc_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=10)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(with_planted_repeats(_table(spark, sf_dir, "documents")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_token_records": op9_token_records,
    "op10_license_scan": op10_license_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op10_license_scan": f"SELECT key AS doc_id, * EXCLUDE (key) FROM ({license_sql("SELECT doc_id AS key, source || '/' || lang || '/' || doc_id AS path, text FROM documents")})",
    "op11_lexical_search": LEXICAL_SQL,
    "op13_exact_dedup": EXACT_SQL,
}
