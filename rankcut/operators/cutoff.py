"""From scores to a cut: z-scores, p-values, Higher Criticism and Berk-Jones curves, thresholds.

Candidates are (query_id, doc_id, similarity, rank); all steps are windows over query_id, so one exchange serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankcut.functions.statistics import normal_tail
from rankcut.operators.ranges import running

INF = float("inf")


def _by_query():
    return Window.partitionBy("query_id")


def z_scores(candidates: DataFrame, fraction: float = 0.8, least: int = 10, floor: float = 1e-10, cap: float | None = None, exclude: Column | None = None, need: int = 0) -> DataFrame:
    """Adds z (and mu, sigma) by the lowest `fraction` of each query's scores: at least `least` of them, all if there are
    fewer. exclude: rows left out of the estimate; queries with fewer than `need` rows left get NULL."""
    n = F.count("*").over(_by_query())
    low = F.row_number().over(_by_query().orderBy("similarity", F.desc("doc_id")))
    m = F.greatest((n * F.lit(fraction)).cast("int"), F.lit(least))
    inside = (n < m) | (low <= m)
    marked = candidates.withColumn("_in", inside if exclude is None else inside & ~exclude)
    value = F.when(F.col("_in"), F.col("similarity"))
    out = marked.withColumns({"mu": F.avg(value).over(_by_query()), "sigma": F.stddev_pop(value).over(_by_query()), "_have": F.count(value).over(_by_query())})
    z = (F.col("similarity") - F.col("mu")) / F.greatest(F.col("sigma"), F.lit(floor))
    if cap is not None:
        z = F.least(z, F.lit(cap))
    return out.withColumn("z", F.when(F.col("_have") >= need, z)).drop("_in", "_have")


def recalibrated(z: DataFrame, null_sigma: float, gamma: float) -> DataFrame:
    """z times the null's deviation over that of the query's z beyond its first gamma share of ranks."""
    beyond = F.when(F.col("rank") > F.floor(F.lit(gamma) * F.count("*").over(_by_query())), F.col("z"))
    return z.withColumn("z_recalibrated", F.col("z") * null_sigma / F.greatest(F.stddev_pop(beyond).over(_by_query()), F.lit(1e-10)))


def clipped(p: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(p, lit(low)), lit(high))


def empirical_p(count: Column, n: Column) -> Column:
    """(#{null >= x} + 1) / (N + 1), held within [1 / (N + 1), 1 - 1 / (N + 1)]; NULL for an empty null."""
    return F.when(n > 0, clipped((count + 1) / (n + 1), 1 / (n + 1), 1 - 1 / (n + 1)))


def plain_p(count: Column, n: Column) -> Column:
    """The validators' p-value: 1 - #{null < x} / N, at least 1e-10; NULL for an empty null."""
    return F.when(n > 0, clipped(count / n, 1e-10, 1.0))


def with_query_null(candidates: DataFrame, null: DataFrame, value: str = "similarity") -> DataFrame:
    """Adds how many of the query's own null values are at least the candidate's value (n_at_least) and how many there are
    (n_null), by one running count over both. null(query_id, value) may have a column times."""
    times = (F.col("times") if "times" in null.columns else F.lit(1)).cast("long")
    both = candidates.withColumns({"_null": F.lit(0).cast("long"), "_of": F.lit(0), "_x": F.col(value)}).unionByName(
        null.select("query_id", times.alias("_null"), F.lit(1).alias("_of"), F.col("value").alias("_x")), allowMissingColumns=True
    )
    falling = _by_query().orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumns({"n_at_least": F.sum("_null").over(falling), "n_null": F.sum("_null").over(_by_query())})
    return counted.where("_of = 0").drop("_null", "_of", "_x")


def with_global_null(candidates: DataFrame, null: DataFrame, value: str = "similarity", keys: tuple[str, ...] = ()) -> DataFrame:
    """The same against one null for all queries (or one for all rows with the same keys), counted exactly: equal null values
    are summed up, and running counts go over ranges of values that null and candidates share. A candidate without value
    has no null value at least as great; a null value that is missing is greater than all."""
    falling = -F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(INF)), F.lit(INF))
    null = null.select(*keys, falling.alias("_x")).groupBy(*keys, "_x").agg(F.count("*").alias("_null"))
    both = candidates.withColumns({"_null": F.lit(0).cast("long"), "_of": F.lit(0), "_x": -F.col(value).cast("double")}).unionByName(null.withColumn("_of", F.lit(1)), allowMissingColumns=True)
    counted = running(both, "_x", ["_null"], keys).where("_of = 0")
    n = F.when(F.col("_x").isNull() | F.isnan("_x"), F.lit(0)).otherwise(F.col("_null_upto"))
    return counted.select(*candidates.columns, n.cast("long").alias("n_at_least"), F.col("_null_all").cast("long").alias("n_null"))


def parametric_p(z: Column) -> Column:
    return clipped(normal_tail(z), 1e-15, 1 - 1e-15)


def gpd_composite_p(x: Column, empirical: Column, shape: float, scale: float, threshold: float, rate: float) -> Column:
    """Empirical up to the tail's threshold; beyond it the generalised Pareto tail times the rate of values there."""
    y = (x - threshold) / scale
    tail = F.exp(-y) if shape == 0 else F.pow(F.greatest(1 + F.lit(shape) * y, F.lit(0.0)), F.lit(-1 / shape))
    return clipped(F.when(x > threshold, F.lit(rate) * tail).otherwise(empirical), 1e-15, 1 - 1e-15)


def curve(candidates: DataFrame, gamma: float | Column, method: str = "hc", p: str = "p") -> DataFrame:
    """The ranks 1..max(1, floor(gamma n)) of each query with their statistic; 0 where p is 0 or 1 (hc). Candidates without
    a p-value are left out."""
    candidates = candidates.where(F.col(p).isNotNull())
    n, i = F.count("*").over(_by_query()), F.col("rank")
    gamma = gamma if isinstance(gamma, Column) else F.lit(gamma)
    inside = candidates.withColumn("n", n).where(i <= F.least(F.col("n"), F.greatest(F.lit(1), F.floor(gamma * F.col("n")))))
    share, pv = i / F.col("n"), F.col(p)
    if method == "hc":
        deviation = F.sqrt(pv * (1 - pv) / F.col("n"))
        stat = F.when(deviation > 0, (share - pv) / deviation).otherwise(0.0)
    else:
        a, b = clipped(share, 1e-15, 1 - 1e-15), clipped(pv, 1e-15, 1 - 1e-15)
        stat = F.col("n") * (a * F.log(a / b) + (1 - a) * F.log((1 - a) / (1 - b)))
    return inside.withColumn("statistic", stat)


def thresholds(on_curve: DataFrame, min_hc: float = 0.0, allow_empty: bool = True, digits: int = 9) -> DataFrame:
    """(query_id, statistic, k, threshold): the first greatest statistic's rank and score; nothing (k 0, threshold
    infinite) where it is under min_hc and empty results are allowed. The statistic is compared at `digits` digits."""
    at = F.struct(F.round("statistic", digits).alias("s"), (-F.col("rank")).alias("i"))
    best = on_curve.groupBy("query_id").agg(F.max(F.struct(at.alias("at"), "similarity")).alias("b"))
    stat = F.col("b.at.s")
    empty = (stat < min_hc) & F.lit(allow_empty)
    return best.select(
        "query_id", stat.alias("statistic"), F.when(empty, 0).otherwise(-F.col("b.at.i")).alias("k"), F.when(empty, F.lit(INF)).otherwise(F.col("b.similarity")).alias("threshold")
    )


def pool_size_sweep(candidates: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """(pool_size, query_id, statistic, k): cuts within the first candidates of each size, with gamma = most / size. All
    sizes go through one grouping, as (query, size) groups of the pool that is ranked once."""
    swept = candidates.withColumn("_n", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("rank") <= F.col("_n"))
    swept = swept.withColumn("query_id", F.struct(F.col("query_id").alias("q"), F.col("_n").alias("n")))
    cuts = thresholds(curve(swept, F.lit(float(most)) / F.col("_n")))
    return cuts.select(F.col("query_id.n").alias("pool_size"), F.col("query_id.q").alias("query_id"), "statistic", "k")



def keep(candidates: DataFrame, cuts: DataFrame, max_k: int | None = None) -> DataFrame:
    k = F.col("k") if max_k is None else F.least("k", F.lit(max_k))
    return candidates.join(cuts, "query_id").where(F.col("rank") <= k)


def bonferroni(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    n = F.count("*").over(_by_query())
    return p.withColumn("_ok", F.col("p") <= F.lit(alpha) / n).groupBy("query_id").agg(F.sum(F.col("_ok").cast("int")).alias("k"))


def benjamini_hochberg(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    n = F.count("*").over(_by_query())
    ok = F.col("p") <= F.lit(alpha) * F.col("rank") / n
    return p.withColumn("_k", F.when(ok, F.col("rank")).otherwise(0)).groupBy("query_id").agg(F.max("_k").alias("k"))


def largest_gap(candidates: DataFrame, ignore_extreme: float = 0.05, ignore_tail: float = 0.1, more: int = 5) -> DataFrame:
    """Cut after the rank before the largest drop of score, ranks at both ends being ignored; some more are taken."""
    n = F.count("*").over(_by_query())
    gap = F.round(F.col("similarity") - F.lead("similarity").over(_by_query().orderBy("rank")), 6)
    inside = candidates.withColumns({"_n": n, "_gap": gap}).where((F.col("rank") > F.floor(F.col("_n") * ignore_extreme)) & (F.col("rank") < F.col("_n") - F.floor(F.col("_n") * ignore_tail)))
    return inside.groupBy("query_id").agg((F.max_by("rank", F.struct("_gap", -F.col("rank"))) + more).alias("_k"), F.max("_n").alias("_n")).select("query_id", F.least("_k", "_n").cast("long").alias("k"))
