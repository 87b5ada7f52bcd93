"""An index of clusters by k, kinds of queries, difficulty and domain: a table in folders by k bucket and cluster type.

entries(cluster_id, cluster_type, ks, query_types, difficulties, domains, suitability, ...): ks are the k for which a
cluster suits; a cluster stands once in each of their buckets, so that a search by bucket or type reads those folders only.
Clusters without k stand in a bucket of their own (NULL) and are found by searches without bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankcut.functions.text import k_range

LISTS = {"query_type": "query_types", "difficulty": "difficulties", "domain": "domains"}


def write_index(entries: DataFrame, path: str) -> str:
    buckets = F.array_distinct(F.transform("ks", k_range))
    rows = entries.withColumn("k_bucket", F.explode_outer(buckets))
    # a folder's rows are spread over some tasks, so that one large type isn't one task
    rows.repartition("k_bucket", "cluster_type", F.pmod(F.xxhash64("cluster_id"), F.lit(8))).write.partitionBy("k_bucket", "cluster_type").parquet(path)
    return path


def _read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("k_bucket", "cluster_type") if dict(rows.dtypes)[c] != "string"})


def find(spark: SparkSession, path: str, k_bucket: str | None = None, query_type: str | None = None, difficulty: str | None = None, domain: str | None = None, cluster_type: str | None = None, min_suitability: float = 0.5) -> DataFrame:
    """The entries that meet all filters given, each once, the most suitable first."""
    rows = _read(spark, path).where(F.col("suitability") >= min_suitability)
    for column, value in (("k_bucket", k_bucket), ("cluster_type", cluster_type)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    for name, value in (("query_type", query_type), ("difficulty", difficulty), ("domain", domain)):
        if value is not None:
            rows = rows.where(F.array_contains(LISTS[name], value))
    if k_bucket is None:
        rows = rows.dropDuplicates(["cluster_id", "cluster_type"])
    return rows.orderBy(F.desc("suitability"), "cluster_id")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """(dimension, value, n_clusters, mean_suitability): a row for each value of each dimension and one for all clusters."""
    rows = _read(spark, path)
    once = rows.dropDuplicates(["cluster_id", "cluster_type"])
    measures = (F.count("*").alias("n_clusters"), F.avg("suitability").alias("mean_suitability"))
    out = rows.where("k_bucket is not null").groupBy("k_bucket").agg(*measures).select(F.lit("k_bucket").alias("dimension"), F.col("k_bucket").alias("value"), "n_clusters", "mean_suitability")
    named = lambda d: lambda x: F.struct(F.lit(d).alias("dimension"), x.alias("value"))
    lists = F.concat(F.array(named("cluster_type")(F.col("cluster_type"))), *(F.transform(c, named(d)) for d, c in LISTS.items()))
    of = once.select("suitability", F.inline(lists)).groupBy("dimension", "value").agg(*measures)
    return out.union(of).union(once.agg(*measures).select(F.lit("all"), F.lit("all"), "n_clusters", F.coalesce("mean_suitability", F.lit(0.0))))
