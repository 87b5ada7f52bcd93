"""Null distributions: samples of the scores of documents that aren't relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankcut.operators.cutoff import with_global_null, z_scores
from rankcut.operators.products import MOMENTS, PRIME, counts_between, factor, null_state, product
from rankcut.operators.retrieval import hash_order
from rankcut.sources.checkpoints import stored


def non_relevant(scores: DataFrame, qrels: DataFrame) -> DataFrame:
    return scores.join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")


def sampled_negatives(scores: DataFrame, qrels: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """n scores of documents that aren't relevant for each query, all if n is 0; where there are fewer than n, they come
    again in the same order until there are n: (query_id, nth, value)."""
    pool = non_relevant(scores, qrels)
    if not n:
        return pool.select("query_id", F.lit(1).alias("nth"), F.col("similarity").alias("value"))
    w = Window.partitionBy("query_id")
    order = pool.withColumns({"i": F.row_number().over(w.orderBy(hash_order(seed, "query_id", "doc_id"))), "have": F.count("*").over(w)}).where(F.col("i") <= n)
    again = order.withColumn("nth", F.explode(F.sequence(F.col("i"), F.lit(n), F.least(F.col("have"), F.lit(n)).cast("int"))))
    return again.select("query_id", "nth", F.col("similarity").alias("value"))


def _states(queries: DataFrame, corpus: DataFrame, qrels: DataFrame | None, sample: int, seed: int, **options) -> DataFrame:
    """Rows of null_state() of all blocks. A query's documents are in the order of the products of its factor and theirs;
    each block gives back those of its first `sample` that lie under a limit, which leaves out what is surely beyond."""
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, similarity double, place long, {MOMENTS}"
    text = lambda c: F.col(c).cast("string")
    kept = options.get("alike") or ()
    docs = corpus.select("doc_id", "embedding", *kept[1:], factor(text("doc_id")).alias("h_"))
    asked = queries.select("query_id", "embedding", *kept[:1], factor(F.concat(F.lit(f"{seed}:"), text("query_id"))).alias("h_"))
    if not sample:
        return product(asked.drop("h_"), docs.drop("h_"), null_state(0), kinds, qrels, **options)
    free = F.lit(corpus.count())
    if qrels is not None:
        asked = asked.join(qrels.groupBy("query_id").count(), "query_id", "left").withColumn("free", free - F.coalesce("count", F.lit(0)))
    elif kept:
        of = docs.groupBy(F.col(kept[1]).alias("_of")).count()
        asked = asked.join(of, F.col(kept[0]) == F.col("_of"), "left").withColumn("free", free - F.coalesce("count", F.lit(0)))
    # a sample's size under the limit is about normal, so that hardly any query is asked again
    share = F.least(F.lit(1.0), (sample + 6 * sample**0.5 + 50) / F.greatest(F.lit(1), F.col("free") if "free" in asked.columns else free))
    first = asked.select("query_id", "embedding", *kept[:1], "h_", (share * PRIME).cast("long").alias("limit_"))
    out = stored(product(first, docs, null_state(sample), kinds, qrels, **options))
    have = out.groupBy("query_id").agg(F.sum("n").alias("n"), F.count("place").alias("got")).where(F.col("got") < F.least("n", F.lit(sample)))
    short = first.join(have.select("query_id"), "query_id", "left_semi").withColumn("limit_", F.lit(PRIME).cast("long"))
    if short.isEmpty():  # else ids repeat or don't spread: those queries again, without limit
        return out
    again = product(short, docs, null_state(sample), kinds, qrels, **options)
    return out.join(have.select("query_id"), "query_id", "left_anti").unionByName(again)


def _moments(states: DataFrame, digits: int = 6) -> DataFrame:
    n, unit = F.sum("n").cast("double"), 10.0**digits
    mean = F.sum(F.col("total").cast("decimal(38,0)")).cast("double") / n
    variance = F.greatest(F.lit(0.0), F.sum("squares").cast("double") / n - mean * mean)
    return states.where("n is not null").groupBy("query_id").agg((mean / unit).alias("mean"), (F.sqrt(variance) / unit).alias("std"), F.min("least").alias("min_val"), F.max("most").alias("max_val"), F.sum("n").alias("n_samples"))


def null_moments(queries: DataFrame, corpus: DataFrame, qrels: DataFrame | None = None, **options) -> DataFrame:
    """summary() of each query's scores against all documents that aren't relevant, without a row for each pair."""
    return _moments(_states(queries, corpus, qrels, 0, 0, **options))


def _drawn(states: DataFrame, sample: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("place", "doc_id")
    return states.where("place is not null").withColumn("i", F.row_number().over(order)).where(F.col("i") <= sample)


def sampled_null(queries: DataFrame, corpus: DataFrame, qrels: DataFrame | None = None, n: int = 50, seed: int = 0, **options) -> DataFrame:
    """sampled_negatives() from all documents, without a row for each pair: (query_id, nth, value)."""
    drawn = _drawn(_states(queries, corpus, qrels, n, seed, **options), n).withColumn("have", F.count("*").over(Window.partitionBy("query_id")))
    again = drawn.withColumn("nth", F.explode(F.sequence(F.col("i"), F.lit(n), F.col("have").cast("int"))))
    return again.select("query_id", "nth", F.col("similarity").alias("value"))


def global_z_null(queries: DataFrame, corpus: DataFrame, qrels: DataFrame | None = None, sample: int = 5000, seed: int = 0, least: float = 1e-12, **options) -> DataFrame:
    """Each query's scores against documents that aren't relevant, in units of their own deviation, at most `sample` of each
    (query_id, doc_id, value); the moments are those of all."""
    states = _states(queries, corpus, qrels, sample, seed, **options)
    drawn = _drawn(states, sample).select("query_id", "doc_id", "similarity")
    return drawn.join(_moments(states).where(F.col("std") >= least), "query_id").select("query_id", "doc_id", ((F.col("similarity") - F.col("mean")) / F.col("std")).alias("value"))


def counted_null(queries: DataFrame, corpus: DataFrame, qrels: DataFrame | None, candidates: DataFrame, **options) -> DataFrame:
    """Each query's null (all documents that aren't relevant) as far as its candidates' scores tell it apart: (query_id,
    value, times), for with_query_null(). The scores go to the blocks as thresholds, which count there."""
    bins = candidates.groupBy("query_id").agg(F.array_sort(F.collect_set("similarity")).alias("bins_"))
    kept = options.get("alike") or ()
    asked = queries.select("query_id", "embedding", *kept[:1]).join(bins, "query_id", "left")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, value double, times long"
    return product(asked, corpus.select("doc_id", "embedding", *kept[1:]), counts_between(), kinds, qrels, **options).groupBy("query_id", "value").agg(F.sum("times").alias("times"))


def pool_matched_null(candidates: DataFrame, qrels: DataFrame, fraction: float = 0.8, least: float = 1e-12) -> DataFrame:
    """z-scores of pool candidates by the pool's lower part, relevant ones then left out: (query_id, doc_id, value)."""
    return z_null(z_scores(candidates, fraction), qrels, least)


def z_null(z: DataFrame, qrels: DataFrame, least: float = 1e-12) -> DataFrame:
    """The same from z-scores."""
    return non_relevant(z.where(F.col("sigma") >= least), qrels).select("query_id", "doc_id", F.col("z").alias("value"))


def against_pool_null(candidates: DataFrame, qrels: DataFrame) -> DataFrame:
    """Candidates with z, counted against the pool-matched null of all queries: n_at_least and n_null."""
    z = stored(z_scores(candidates))
    return with_global_null(z, z_null(z, qrels), "z")


def raw_pool_null(candidates: DataFrame, qrels: DataFrame) -> DataFrame:
    return non_relevant(candidates, qrels).select("query_id", "doc_id", F.col("similarity").alias("value"))


def per_query_null(candidates: DataFrame, qrels: DataFrame, fraction: float = 0.8, least: int = 10) -> DataFrame:
    """The pool-matched values of queries that have enough of them."""
    values = pool_matched_null(candidates, qrels, fraction)
    return values.withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("_n") >= least).drop("_n")


def summary(values: DataFrame, *keys: str) -> DataFrame:
    """Mean, population deviation, least, greatest and number of values."""
    return values.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min_val"), F.max("value").alias("max_val"), F.count("value").alias("n_samples")
    )


def random_vector_null(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Products of n pairs of random unit vectors."""
    from rankcut.functions import vectors as v

    side = lambda k: F.array(*(F.randn(seed * 1000 + k * dim + i) for i in range(dim)))
    pairs = spark.range(n).select(side(0).alias("a"), side(1).alias("b"))
    return pairs.select(v.cosine(F.col("a"), F.col("b")).alias("value"))


def gaussian_null(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """N(0, 1 / dim), held within [-1, 1]."""
    return spark.range(n).select(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.randn(seed) / dim**0.5)).alias("value"))
