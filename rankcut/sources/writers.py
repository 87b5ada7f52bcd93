"""Writers of data sets and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(folder: str, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, metadata: DataFrame) -> None:
    """corpus, queries and qrels (in order of query) as CSV, one row of metadata as JSON."""
    options = {"header": True, "quote": '"', "escape": '"', "mode": "errorifexists"}
    corpus.write.csv(f"{folder}/corpus.csv", **options)
    queries.write.csv(f"{folder}/queries.csv", **options)
    qrels.orderBy("query_id", "doc_id").write.csv(f"{folder}/qrels.csv", **options)
    metadata.write.json(f"{folder}/metadata.json")


def write_trec(folder: str, passages: DataFrame, queries: DataFrame, qrels: DataFrame) -> None:
    """passages and queries as JSON lines; qrels(query_id, passage_id, relevance) as tab-separated lines with a 0."""
    passages.write.json(f"{folder}/corpus.jsonl")
    queries.write.json(f"{folder}/queries.jsonl")
    qrels.select("query_id", F.lit("0").alias("iteration"), "passage_id", "relevance").write.csv(f"{folder}/qrels.tsv", sep="\t")


def write_passages(path: str, passages: DataFrame) -> None:
    passages.select("passage_id", "entity_qid", "entity_label", "cluster_id", "text", "section").write.json(path)


def write_results(folder: str, overall: DataFrame, per_query: DataFrame, by_bucket: DataFrame) -> None:
    for name, df in (("overall", overall), ("per_query", per_query), ("by_bucket", by_bucket)):
        df.write.parquet(f"{folder}/{name}")


def store(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Writes a table unless it is there already; force writes it anew. Returns what is stored."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if force or not there:
        df.write.mode("overwrite" if force else "errorifexists").parquet(path)
    return spark.read.parquet(path)
