"""Ranked retrieval for many queries at once: long tables (query_id, doc_id, similarity, rank), rank from 1.

Ties go to the smaller doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankcut.functions import vectors as v
from rankcut.operators.products import best_scores, every_score, product
from rankcut.sources.checkpoints import stored


def by_rank(query: str = "query_id", score: str = "similarity", doc: str = "doc_id") -> Window:
    return Window.partitionBy(query).orderBy(F.desc(score), F.asc(doc))


def normalised_store(vectors: DataFrame, dim: int) -> DataFrame:
    """vectors(doc_id, embedding, ...) with unit vectors; rows of another dimension are left out."""
    return vectors.where(v.fits(F.col("embedding"), dim)).withColumn("embedding", v.normalised(F.col("embedding")))


def scored(queries: DataFrame, corpus: DataFrame, k: int | None = None, digits: int = 6, own: bool = False, block: int = 2048, rows: int = 16_384) -> DataFrame:
    """queries(query_id, embedding) against corpus(doc_id, embedding) -> (query_id, doc_id, similarity); the k best of each
    block of documents if k is given, else all. own: a document with the query's id counts. See products."""
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, similarity double"
    task = every_score(digits) if k is None else best_scores(k, digits)
    return product(queries.select("query_id", "embedding"), corpus.select("doc_id", "embedding"), task, kinds, own=own, digits=digits, block=block, rows=rows)


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    out = scores.withColumn("rank", F.row_number().over(by_rank()))
    return out if k is None else out.where(F.col("rank") <= k)


def search(queries: DataFrame, corpus: DataFrame, k: int, **options) -> DataFrame:
    """The k best documents of each query, exactly."""
    return ranked(scored(queries, corpus, k, **options), k)


def fixed_k(candidates: DataFrame, k: int) -> DataFrame:
    """The first k, with the method's name and no threshold."""
    return candidates.where(F.col("rank") <= k).withColumns({"k": F.lit(k), "method": F.lit("fixed_k"), "threshold": F.lit(None).cast("double")})


def sweep(candidates: DataFrame, ks: list[int]) -> DataFrame:
    """One row for each k of the list and each hit within it."""
    return candidates.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))


def to_parents(chunks: DataFrame, mapping: DataFrame, how: str = "max", k: int | None = None) -> DataFrame:
    """chunks(query_id, chunk_id, similarity), mapping(chunk_id, parent_doc_id) -> ranked documents by the max, mean or sum
    of their chunks; chunks without parent are left out."""
    agg = {"max": F.max, "mean": F.avg, "sum": F.sum}[how]
    docs = chunks.join(mapping, "chunk_id").groupBy("query_id", F.col("parent_doc_id").alias("doc_id")).agg(F.round(agg("similarity"), 6).alias("similarity"))
    return ranked(docs, k)


def sweep_strategies(chunks: DataFrame, mapping: DataFrame, ks: list[int], strategies: tuple[str, ...] = ("max", "mean", "sum")) -> DataFrame:
    """to_parents() for several strategies and k in one grouping: (strategy, k, query_id, doc_id, similarity, rank)."""
    agg = {"max": F.max, "mean": F.avg, "sum": F.sum}
    docs = chunks.join(mapping, "chunk_id").groupBy("query_id", F.col("parent_doc_id").alias("doc_id")).agg(
        F.array(*(F.struct(F.lit(s).alias("strategy"), F.round(agg[s]("similarity"), 6).alias("similarity")) for s in strategies)).alias("of")
    )
    rows = docs.select("query_id", "doc_id", F.inline("of"))
    order = Window.partitionBy("strategy", "query_id").orderBy(F.desc("similarity"), "doc_id")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(ks))
    return sweep(top, ks).select("strategy", "k", "query_id", "doc_id", "similarity", "rank")


def sampled_pairs(queries: DataFrame, corpus: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random (query, document) pairs with replacement and their cosine: (pair, similarity). Rows get numbers in order of
    id by a distributed count; pairs pick numbers by hash."""
    numbered = lambda df, key: _numbered(df.select(key, "embedding"), key)
    q, d = numbered(queries, "query_id"), numbered(corpus, "doc_id")
    nq, nd = queries.count(), corpus.count()
    pick = lambda part, m: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{part}:"), F.col("pair").cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(m))
    pairs = corpus.sparkSession.range(n).withColumnRenamed("id", "pair").withColumns({"qn": pick("q", max(1, nq)), "dn": pick("d", max(1, nd))})
    a, b = q.select(F.col("n").alias("qn"), F.col("embedding").alias("a")), d.select(F.col("n").alias("dn"), F.col("embedding").alias("b"))
    return pairs.join(a, "qn").join(b, "dn").select("pair", F.round(v.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Numbers from 0 in order of key: place within a range of the key plus the ranges before. The ranges are stored, as
    others may be drawn when they are computed again."""
    parts = stored(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    inside = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    sizes = parts.groupBy("_p").count()
    base = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_b"))
    return inside.join(F.broadcast(base), "_p").withColumn("n", F.col("_b") + F.col("_i") - 1).drop("_p", "_i", "_b")


def by_id(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return documents.join(ids, "doc_id", "left_semi")


def hash_order(seed: int, *cols: str) -> Column:
    """A random order that any engine computes alike: md5 of the seed and the columns."""
    return F.md5(F.concat(F.lit(f"{seed}:"), *(x for c in cols for x in (F.col(c).cast("string"), F.lit(":")))))
