"""Retrieval metrics, a row for each query, also where nothing was retrieved; and their summaries.

Hits are (query_id, doc_id, rank); qrels (query_id, doc_id). Recall and average precision are divided by all relevant
documents of the qrels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["recall", "precision", "reciprocal_rank", "ndcg", "hit_rate", "average_precision"]


def deduplicated(hits: DataFrame) -> DataFrame:
    """Best rank of each document, ranks numbered anew; had_duplicates for the query."""
    w = Window.partitionBy("query_id")
    best = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("_r"), F.count("*").alias("_n"))
    return best.select("query_id", "doc_id", F.row_number().over(w.orderBy("_r", "doc_id")).alias("rank"), (F.max("_n").over(w) > 1).alias("had_duplicates"))


def per_query(queries: DataFrame, hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """queries(query_id, ...) with k, n_relevant, labelled, had_duplicates and the six metrics."""
    rel = qrels.select("query_id", "doc_id").distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    w = Window.partitionBy("query_id").orderBy("rank")
    marked = deduplicated(hits).join(rel.withColumn("_hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    found = marked.withColumn("_so_far", F.sum("_hit").over(w)).groupBy("query_id").agg(
        F.count("*").alias("k"),
        F.max("had_duplicates").alias("had_duplicates"),
        F.sum("_hit").alias("_hits"),
        F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("_first"),
        F.sum(F.col("_hit") / F.log2(F.col("rank") + 1)).alias("_dcg"),
        F.sum(F.when(F.col("_hit") == 1, F.col("_so_far") / F.col("rank"))).alias("_ap"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = queries.join(found, "query_id", "left").join(n_rel, "query_id", "left").withColumns({"k": F.coalesce("k", F.lit(0)), "n_relevant": F.coalesce("n_relevant", F.lit(0)), "had_duplicates": F.coalesce("had_duplicates", F.lit(False))})
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_relevant", "k"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = (F.col("n_relevant") > 0) & (F.col("k") > 0)
    values = {
        "labelled": F.col("n_relevant") > 0,
        "recall": zero(F.when(some, F.col("_hits") / F.col("n_relevant"))),
        "precision": zero(F.when(some, F.col("_hits") / F.col("k"))),
        "reciprocal_rank": zero(1 / F.col("_first")),
        "ndcg": zero(F.when(some, F.col("_dcg") / ideal)),
        "hit_rate": zero(F.when(F.col("_hits") > 0, 1.0)),
        "average_precision": zero(F.when(some, F.col("_ap") / F.col("n_relevant"))),
    }
    return out.withColumns(values).drop("_hits", "_first", "_dcg", "_ap")


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def overall(rows: DataFrame) -> DataFrame:
    """One row: numbers of queries, means of the metrics over all and over labelled queries, spread of k."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    means = [zero(F.avg(m)).alias(f"mean_{m}") for m in METRICS]
    labelled = [zero(F.avg(F.when(F.col("labelled"), F.col(m)))).alias(f"labelled_{m}") for m in METRICS]
    return rows.agg(
        F.count("*").alias("n_queries"), F.count_if("labelled").alias("n_labelled"), *means, *labelled,
        zero(F.avg("k")).alias("mean_k"), F.coalesce(F.min("k"), F.lit(0)).alias("min_k"), F.coalesce(F.max("k"), F.lit(0)).alias("max_k"),
        F.count_if("had_duplicates").alias("n_with_duplicates"), zero(F.avg((F.col("k") > 0).cast("double"))).alias("query_coverage"),
    )


def catalog_coverage(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Relevant documents that any query found, as a share of all relevant documents."""
    rel = qrels.select("doc_id").distinct()
    got = rel.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    one = rel.agg(F.count("*").alias("n_relevant_docs")).crossJoin(got.agg(F.count("*").alias("n_found")))  # one row each
    return one.withColumn("catalog_coverage", F.when(F.col("n_relevant_docs") > 0, F.col("n_found") / F.col("n_relevant_docs")).otherwise(0.0))


def by_bucket(rows: DataFrame, bucket: str, metrics: list[str]) -> DataFrame:
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"mean_{m}"), F.percentile(m, F.lit(0.5)).alias(f"median_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"))]
    return rows.groupBy(F.coalesce(F.col(bucket).cast("string"), F.lit("unknown")).alias("bucket")).agg(F.count("*").alias("n"), *aggs).orderBy("bucket")


def against_truth(rows: DataFrame) -> DataFrame:
    """One row: mean precision, recall and F1, spread of k, and its correlation with the true number (0 if constant)."""
    r = rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    spread = F.stddev_pop("k") * F.stddev_pop("n_relevant")
    return r.agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.avg("k").alias("mean_k"), F.percentile("k", F.lit(0.5)).alias("median_k"), F.stddev_pop("k").alias("std_k"),
        F.coalesce(F.try_divide(F.covar_pop("k", "n_relevant"), spread), F.lit(0.0)).alias("k_correlation"),
    )


def false_negatives(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Relevant documents that two methods miss: sums, reduction and its share."""
    missed = lambda df, name: df.agg(F.sum(F.bround(F.col("n_relevant") * (1 - F.col("recall")), 0)).alias(name))
    both = missed(rows, "missed").crossJoin(missed(base, "missed_base"))  # one row each
    return both.withColumns({"reduction": F.col("missed_base") - F.col("missed"), "reduction_share": F.when(F.col("missed_base") > 0, (F.col("missed_base") - F.col("missed")) / F.col("missed_base")).otherwise(0.0)})


def matched_k(rows: DataFrame, ks: list[int]) -> DataFrame:
    """The k of the list that is closest to the mean k, the first on ties."""
    mean = rows.agg(F.avg("k").alias("mean_k"))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col("mean_k") - k).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(ks))))
    return mean.select("mean_k", nearest["k"].alias("matched_k"))


def recall_ceiling(queries: DataFrame, pool: DataFrame, qrels: DataFrame) -> DataFrame:
    """Share of each query's relevant documents that are in its pool at all."""
    rel = qrels.select("query_id", "doc_id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("true_k"))
    got = rel.join(pool.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("in_pool"))
    return queries.select("query_id").join(n, "query_id", "left").join(got, "query_id", "left").select(
        "query_id", F.coalesce("true_k", F.lit(0)).alias("true_k"), F.coalesce("in_pool", F.lit(0)).alias("in_pool"), F.when(F.col("true_k") > 0, F.coalesce("in_pool", F.lit(0)) / F.col("true_k")).otherwise(0.0).alias("recall_ceiling")
    )
