"""Cuts over a grid of pool sizes and z-score fractions, from one ranked pool.

A cell's z-scores take mean and deviation of the lowest share of the pool's first candidates. Prefix moments by rank,
summed once, give both for every cell as differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankcut.operators import cutoff as c
from rankcut.operators.validation import ks_uniform
from rankcut.sources.checkpoints import stored

CELL = ("pool_size", "fraction")


def grid_moments(pool: DataFrame, sizes: list[int], fractions: list[float], least: int = 10) -> DataFrame:
    """pool(query_id, similarity, rank from 1 without gaps) -> (query_id, pool_size, fraction, n, mu, sigma): of the lowest
    `fraction` of the first `pool_size` candidates, at least `least` of them, all n where there are fewer."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = pool.select("query_id", "rank", F.sum("similarity").over(upto).alias("s"), F.sum(F.col("similarity") * F.col("similarity")).over(upto).alias("q"))
    # a pool is bounded by its size, so its sums fit into a row
    by = sums.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "s", "q"))).alias("a"))
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("pool_size"), F.lit(f).alias("fraction")) for n in sizes for f in fractions)))
    rows = by.withColumn("cell", cells).withColumn("n", F.least(F.size("a"), F.col("cell.pool_size")))
    rows = rows.withColumn("m", F.least(F.col("n"), F.greatest((F.col("n") * F.col("cell.fraction")).cast("int"), F.lit(least))))
    at = lambda i, x: F.when(i > 0, F.element_at("a", i)[x]).otherwise(0.0)
    total = lambda x: (at(F.col("n"), x) - at(F.col("n") - F.col("m"), x)) / F.col("m")
    rows = rows.withColumns({"mu": total("s"), "square": total("q")})
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mu") * F.col("mu")))
    return rows.select("query_id", "cell.*", "n", "mu", sigma.alias("sigma"))


def grid_p_values(pool: DataFrame, sizes: list[int], fractions: list[float], floor: float = 1e-10) -> DataFrame:
    """pool(query_id, doc_id, similarity, rank, rel): a row for each candidate of each cell with z, and p against the cell's
    pool-matched null (the z of all queries' candidates that aren't relevant). Cells of a query without spread are left out."""
    cells = grid_moments(pool, sizes, fractions).where(F.col("sigma") >= floor)
    rows = stored(pool.join(cells, "query_id").where(F.col("rank") <= F.col("pool_size")).withColumn("z", (F.col("similarity") - F.col("mu")) / F.col("sigma")))
    null = rows.where("rel = 0").select(*CELL, F.round("z", 9).alias("value"))
    return c.with_global_null(rows.withColumn("_z", F.round("z", 9)), null, "_z", CELL).drop("_z").withColumn("p", c.empirical_p(F.col("n_at_least"), F.col("n_null")))


def grid_report(pool: DataFrame, sizes: list[int], fractions: list[float], most: int, level: float = 0.0) -> DataFrame:
    """A row for each cell: the null, the mean distance of the queries' own p-values from uniform, the share of relevant
    candidates with p under 0.05, and the cuts with gamma = most / pool_size: queries with a statistic under the level, mean
    statistic, mean and number of different k."""
    p = stored(grid_p_values(pool, sizes, fractions))
    null = p.where("rel = 0").groupBy(*CELL).agg(F.count("*").alias("n_null"), F.avg("z").alias("null_mean"), F.stddev_pop("z").alias("null_std"))
    uniform = ks_uniform(p.where("rel = 0"), *CELL, "query_id").groupBy(*CELL).agg(F.avg("d").alias("mean_d"))
    signal = p.where("rel = 1").groupBy(*CELL).agg(F.count("*").alias("n_relevant"), F.avg((F.col("p") < 0.05).cast("double")).alias("detected"))
    of = p.withColumn("query_id", F.struct("query_id", *CELL))
    cuts = c.thresholds(c.curve(of, F.lit(float(most)) / F.col("pool_size"))).select("query_id.*", "statistic", "k")
    cut = cuts.groupBy(*CELL).agg(F.count("*").alias("n_queries"), F.count_if(F.col("statistic") < level).alias("n_negative"), F.avg("statistic").alias("mean_statistic"), F.avg("k").alias("mean_k"), F.count_distinct("k").alias("distinct_k"))
    out = null.join(uniform, [*CELL]).join(cut, [*CELL]).join(signal, [*CELL], "left")
    return out.withColumns({"n_relevant": F.coalesce("n_relevant", F.lit(0)), "detected": F.coalesce("detected", F.lit(0.0))})
