"""Why a cut failed: tables on each query's scores, ranks, null and curve.

Pools are candidates with a column rel (1 relevant, 0 not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankcut.functions.text import word_count
from rankcut.operators import cutoff as c
from rankcut.operators.ranges import running
from rankcut.operators.validation import ks_uniform

#: Terms that speak of a price (fixed values).
PRICE_TERMS = r"(?i)\$|price|under|over|less than|more than|cheap|expensive"


def _rel() -> Column:
    return F.col("rel") == 1


def _non() -> Column:
    return F.col("rel") == 0


def _by_query():
    return Window.partitionBy("query_id")


def by_sign(cuts: DataFrame, ceiling: DataFrame, below: float = 0.0) -> DataFrame:
    """Queries with a statistic under `below` against the others; ceiling(query_id, true_k, in_pool, recall_ceiling)."""
    return cuts.join(ceiling, "query_id").groupBy((F.col("statistic") < below).alias("negative")).agg(
        F.count("*").alias("n"), F.avg("true_k").alias("mean_true_k"), F.stddev_pop("true_k").alias("std_true_k"), F.avg("in_pool").alias("mean_in_pool"),
        F.avg("recall_ceiling").alias("mean_ceiling"), F.avg("statistic").alias("mean_statistic"), F.avg("k").alias("mean_k"),
    )


def text_flags(text: Column) -> dict[str, Column]:
    """What a query's text says: its words, whether it has a digit, whether a term of price."""
    return {"n_words": word_count(text), "has_number": F.coalesce(text.rlike(r"\d"), F.lit(False)), "has_price": F.coalesce(text.rlike(PRICE_TERMS), F.lit(False))}


def flags_by_sign(cuts: DataFrame, texts: DataFrame, below: float = 0.0) -> DataFrame:
    """texts(query_id, text): mean length and shares of the flags among queries with a statistic under `below`, and others."""
    rows = cuts.join(texts.select("query_id", "text"), "query_id").withColumns(text_flags(F.col("text")))
    share = lambda x: F.avg(F.col(x).cast("double"))
    return rows.groupBy((F.col("statistic") < below).alias("negative")).agg(F.count("*").alias("n"), F.avg("n_words").alias("mean_words"), share("has_number").alias("with_number"), share("has_price").alias("with_price"))


def landscape(pool: DataFrame, top: int = 100) -> DataFrame:
    """Scores of relevant and other candidates of each query, side by side."""
    s = F.col("similarity")
    nth = pool.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "rel").orderBy("rank")))
    iqr = pool.where(_non()).groupBy("query_id").agg(F.percentile("similarity", F.lit(0.25)).alias("_q1"), F.percentile("similarity", F.lit(0.75)).alias("_q3"))
    rel, non = F.when(_rel(), s), F.when(_non(), s)
    return nth.join(iqr, "query_id").groupBy("query_id").agg(
        F.avg(rel).alias("mean_rel"), F.stddev_pop(rel).alias("std_rel"), F.avg(non).alias("mean_non"), F.stddev_pop(non).alias("std_non"), (F.avg(rel) - F.avg(non)).alias("gap"),
        (F.avg(rel) - F.avg(F.when(_non() & (F.col("_i") <= top), s))).alias("gap_top"), F.avg(F.when(_rel(), s.between(F.col("_q1"), F.col("_q3")).cast("double"))).alias("inside_iqr"),
        *(f(x).alias(f"{name}_{side}") for side, x in (("rel", rel), ("non", non)) for name, f in (("min", F.min), ("max", F.max))), F.skewness(non).alias("skew_non"),
    )


def landscape_means(by_query: DataFrame) -> DataFrame:
    """One row: the means of landscape() over the queries that have a value."""
    names = ("mean_rel", "mean_non", "gap", "gap_top", "inside_iqr", "skew_non")
    return by_query.agg(F.count("*").alias("n"), *(F.avg(x).alias(x) for x in names))


def rank_positions(relevant: DataFrame) -> DataFrame:
    """Places (from 0) of the relevant candidates."""
    rows = relevant.withColumn("r", F.col("rank") - 1)
    rows = rows.withColumn("gap", F.col("r") - F.lag("r").over(_by_query().orderBy("rank")))
    return rows.groupBy("query_id").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("r") < n).alias(f"in_top_{n}") for n in (50, 100, 200)), F.avg("r").alias("mean_rank"), F.percentile("r", F.lit(0.5)).alias("median_rank"),
        F.min("r").alias("first_rank"), F.max("r").alias("last_rank"), (F.max("r") - F.min("r")).alias("rank_range"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), ((F.max("r") - F.min("r")) / F.count("*")).alias("dispersion"),
    )


def contamination(pool: DataFrame, fractions: list[float]) -> DataFrame:
    """Relevant candidates within the set by which z-scores are estimated, and what leaving them out changes."""
    out = None
    n = F.count("*").over(_by_query())
    low = F.row_number().over(_by_query().orderBy("similarity", F.desc("doc_id")))
    for f in fractions:
        m = F.greatest((n * F.lit(f)).cast("int"), F.lit(10))
        inside = pool.withColumn("_in", (n < m) | (low <= m)).where("_in")
        clean = F.when(_non(), F.col("similarity"))
        one = inside.groupBy("query_id").agg(
            F.lit(f).alias("fraction"), F.count("*").alias("n_estimate"), F.count_if(_rel()).alias("n_relevant"), F.avg(F.col("rel").cast("double")).alias("share"),
            (F.avg("similarity") - F.avg(clean)).alias("mu_shift"), (F.stddev_pop("similarity") - F.stddev_pop(clean)).alias("sigma_shift"),
        )
        out = one if out is None else out.union(one)
    return out


def cuts_after_removal(pool: DataFrame, null: DataFrame, cuts: DataFrame, fractions: list[float], gamma: float, level: float = 0.0, need: int = 5) -> DataFrame:
    """(query_id, fraction, statistic, after, k_after, flipped): each query's cut against null(value) once relevant
    candidates are left out of the z-scores' estimate; flipped if it gets from under the level to it. Queries with fewer
    than `need` other rows in the estimate, or without spread there, have NULL and don't flip."""
    z = None
    for f in fractions:
        one = c.z_scores(pool, f, exclude=_rel(), need=need).where(F.col("sigma") > 1e-10).withColumn("fraction", F.lit(f))
        z = one if z is None else z.unionByName(one)
    z = z.where("z is not null").withColumn("query_id", F.struct(F.col("query_id").alias("q"), "fraction"))
    p = c.with_global_null(z, null, "z").withColumn("p", c.empirical_p(F.col("n_at_least"), F.col("n_null")))
    after = c.thresholds(c.curve(p, gamma)).select(F.col("query_id.q").alias("query_id"), "query_id.fraction", F.col("statistic").alias("after"), F.col("k").alias("k_after"))
    every = cuts.select("query_id", "statistic", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"))
    flipped = F.coalesce((F.col("statistic") < level) & (F.col("after") >= level), F.lit(False))
    return every.join(after, ["query_id", "fraction"], "left").select("query_id", "fraction", "statistic", "after", "k_after", flipped.alias("flipped"))


def distance_from_all(null: DataFrame) -> DataFrame:
    """(query_id, n, d): Kolmogorov distance of each query's null from that of all queries. The share of all values up to a
    value is counted once over ranges; the distance is at one of the query's values or just before it."""
    values = null.where("value is not null").groupBy("query_id", "value").agg(F.count("*").alias("_c"))
    every = running(values.groupBy("value").agg(F.sum("_c").alias("_a")), "value", ["_a"])
    upto = Window.partitionBy("query_id").orderBy("value")
    rows = values.join(every, "value").withColumns({"_u": F.sum("_c").over(upto), "_n": F.sum("_c").over(_by_query())})
    at = F.abs(F.col("_u") / F.col("_n") - F.col("_a_upto") / F.col("_a_all"))
    before = F.abs((F.col("_u") - F.col("_c")) / F.col("_n") - (F.col("_a_upto") - F.col("_a")) / F.col("_a_all"))
    return rows.groupBy("query_id").agg(F.max("_n").alias("n"), F.round(F.max(F.greatest(at, before)), 9).alias("d"))


def null_fit(null: DataFrame) -> DataFrame:
    """Each query's null deviation against that of all: narrower, matched or wider, and the shape of its null."""
    total = null.agg(F.stddev_pop("value").alias("_s"))  # one row
    x = F.col("std_ratio")
    return null.groupBy("query_id").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("_q"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis")).crossJoin(F.broadcast(total)).withColumn("std_ratio", F.col("_q") / F.col("_s")).select(
        "query_id", "n", "std_ratio", F.when(x < 0.8, "narrower").when(x > 1.2, "wider").otherwise("matched").alias("direction"), "skew", "kurtosis"
    )


def heterogeneity(z: DataFrame) -> DataFrame:
    """One row: how the shapes of the queries' z-scores differ."""
    by = z.groupBy("query_id").agg(F.stddev_pop("z").alias("s"), F.skewness("z").alias("sk"), F.kurtosis("z").alias("ku"))
    return by.agg(F.count("*").alias("n"), F.avg("s").alias("mean_std"), F.var_pop("s").alias("var_std"), F.avg("sk").alias("mean_skew"), F.avg("ku").alias("mean_kurtosis"))


def _corr(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def ratio_correlation(fit: DataFrame, cuts: DataFrame, below: float = 0.0) -> DataFrame:
    rows = fit.join(cuts, "query_id").withColumn("_neg", (F.col("statistic") < below).cast("double"))
    return rows.agg(F.count("*").alias("n"), _corr("std_ratio", "statistic").alias("with_statistic"), _corr("std_ratio", "_neg").alias("with_sign"))


def ratio_and_calibration(fit: DataFrame, p: DataFrame, need: int = 5, level: float = 0.05) -> DataFrame:
    """(query_id, std_ratio, d, detected) on p(query_id, p, rel): the distance from uniform of its other candidates' p-values
    (NULL for fewer than `need`) and the share of relevant ones under the level (NULL without any)."""
    d = ks_uniform(p.where("rel = 0"), "query_id").where(F.col("n") >= need).select("query_id", "d")
    found = p.where("rel = 1").groupBy("query_id").agg(F.avg((F.col("p") < level).cast("double")).alias("detected"))
    return fit.select("query_id", "std_ratio").join(d, "query_id", "left").join(found, "query_id", "left")


def ratio_against_calibration(by_query: DataFrame) -> DataFrame:
    """One row on ratio_and_calibration(): correlations of the ratio with distance and detection, over queries with both."""
    both = lambda x: (F.when(F.col(x).isNotNull(), F.col("std_ratio")), F.when(F.col("std_ratio").isNotNull(), F.col(x)))
    return by_query.agg(F.count("*").alias("n"), F.count("d").alias("n_with_d"), _corr(*both("d")).alias("with_d"), F.count("detected").alias("n_with_detected"), _corr(*both("detected")).alias("with_detected"))


def ratio_bins(fit: DataFrame, cuts: DataFrame) -> DataFrame:
    x = F.col("std_ratio")
    name = F.when(x < 0.8, "0-0.8").when(x < 1, "0.8-1").when(x < 1.2, "1-1.2").otherwise("1.2-")
    return fit.join(cuts, "query_id").groupBy(name.alias("bin")).agg(F.count("*").alias("n"), F.avg("statistic").alias("mean_statistic"))


def isolation_grid(pool: DataFrame, raw_p: DataFrame, fractions: list[float], gamma: float, below: float = 0.0) -> DataFrame:
    """Cuts on raw scores, on z-scores with the null of all queries, and on z-scores with each query's own."""

    def row(p: DataFrame, name: str, fraction: float) -> DataFrame:
        cuts = c.thresholds(c.curve(p, gamma))
        return cuts.agg(F.lit(name).alias("condition"), F.lit(fraction).alias("fraction"), F.count("*").alias("n"), F.count_if(F.col("statistic") < below).alias("n_negative"), F.avg("statistic").alias("mean_statistic"), F.avg("k").alias("mean_k"))

    p = c.empirical_p(F.col("n_at_least"), F.col("n_null"))
    out = row(raw_p, "raw", 1.0)
    for f in fractions:
        z = c.z_scores(pool, f)
        null = z.where(_non()).select("query_id", F.col("z").alias("value"))
        out = out.union(row(c.with_global_null(z, null, "z").withColumn("p", p), "z+global", f))
        out = out.union(row(c.with_query_null(z, null, "z").withColumn("p", p), "z+per_query", f))
    return out


def trace(p: DataFrame, top: int = 100) -> DataFrame:
    """The first candidates of each query as arrays. A z that rounds to zero keeps its sign, which round() would drop."""
    z = F.rint(F.col("z") * 1e4) / 1e4
    rows = p.where(F.col("rank") <= top).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "rel", z.alias("z"), F.round("p", 6).alias("p")))).alias("t"))
    return rows.select("query_id", F.col("t.doc_id").alias("docs"), F.col("t.rel").alias("rels"), F.col("t.z").alias("zs"), F.col("t.p").alias("ps"))


def full_trace(z: DataFrame, null: DataFrame, gamma: float, top: int = 100, least: int = 10) -> DataFrame:
    """A row for each query with at least `least` other candidates, of z(query_id, doc_id, similarity, rank, rel, z, mu, sigma)
    with one null(value) for all and the query's own (z of its other candidates): scores, z, both p-values and relevance of the
    first candidates; both curves whole with their greatest value and k; scores, z, p-values and places in the order of
    p-values (from 0) of the relevant ones; moments of all, and the deviation of its own null over that of all.

    A query's candidates meet in one row, as its curve has a value for each rank; pools are of a fixed size."""
    own = z.where(_non()).select("query_id", F.col("z").alias("value"))
    p = c.empirical_p(F.col("n_at_least"), F.col("n_null"))
    rows = c.with_global_null(z, null, "z").withColumn("p_all", p).drop("n_at_least", "n_null")
    rows = c.with_query_null(rows, own, "z").withColumn("p_own", p).where(F.col("n_null") >= least)
    r = F.struct("rank", "doc_id", "rel", *(F.round(x, 6).alias(x) for x in ("similarity", "z", "p_all", "p_own")))
    spread = null.agg(F.stddev_pop("value").alias("_s"))  # one row
    by = rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(r)).alias("_c"), F.sum("rel").alias("n_relevant"), F.max("mu").alias("mu"), F.max("sigma").alias("sigma"), F.avg("similarity").alias("mean_similarity"), F.stddev_pop("similarity").alias("std_similarity"),
        F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"), F.stddev_pop(F.when(_non(), F.col("z"))).alias("_own"),
    )
    first, rel = F.slice("_c", 1, top), F.filter("_c", lambda x: x["rel"] == 1)
    arrays = {"docs": first["doc_id"], "rels": first["rel"], "similarities": first["similarity"], "zs": first["z"], "ps_all": first["p_all"], "ps_own": first["p_own"]}
    arrays |= {f"relevant_{n}": rel[x] for n, x in (("similarities", "similarity"), ("zs", "z"), ("ps_all", "p_all"), ("ps_own", "p_own"))}
    # p-values fall with the rank, so the order of p-values is that of ranks
    arrays["relevant_places"] = F.transform(rel, lambda x: x["rank"] - 1)
    out = by.crossJoin(F.broadcast(spread)).withColumn("std_ratio", F.coalesce(F.try_divide("_own", "_s"), F.lit(0.0))).select("query_id", "n_relevant", "mu", "sigma", "mean_similarity", "std_similarity", "mean_z", "std_z", "std_ratio", *(x.alias(n) for n, x in arrays.items()))
    for side in ("all", "own"):
        curve = c.curve(rows, gamma, p=f"p_{side}")
        at = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.round("statistic", 6).alias("s")))), lambda x: x["s"])
        cuts = c.thresholds(curve).select("query_id", F.col("statistic").alias(f"statistic_{side}"), F.col("k").alias(f"k_{side}"))
        out = out.join(curve.groupBy("query_id").agg(at.alias(f"curve_{side}")), "query_id").join(cuts, "query_id")
    return out


def groups_of(cuts: DataFrame, other: DataFrame, least: float = 0.0) -> DataFrame:
    """(query_id, k, grp): positive under the null in use, fixable by the other one, irreducible."""
    both = cuts.select("query_id", F.col("statistic").alias("a"), "k").join(other.select("query_id", F.col("statistic").alias("b")), "query_id")
    name = F.when(F.col("a") >= least, "positive").when(F.col("b") >= least, "fixable").otherwise("irreducible")
    return both.select("query_id", "k", name.alias("grp"))


def grouped(cuts: DataFrame, other: DataFrame, least: float = 0.0) -> DataFrame:
    """Sizes of the groups and their mean k."""
    return groups_of(cuts, other, least).groupBy("grp").agg(F.count("*").alias("n"), F.avg("k").alias("mean_k"))


def relevant_p(relevant: DataFrame, window: int) -> DataFrame:
    share = lambda x: F.avg((F.col("p") < x).cast("double"))
    return relevant.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("p").alias("best"), F.percentile("p", F.lit(0.5)).alias("median"), share(0.05).alias("under_05"), share(0.01).alias("under_01"), F.count_if(F.col("rank") <= window).alias("in_window")
    )


def failure_modes(cuts: DataFrame, other: DataFrame, relevant: DataFrame, fixed: DataFrame, window: int, level: float = 0.0) -> DataFrame:
    """Queries whose statistic is at most the level under the null in use (cuts) and under their own (other), with the
    first that holds of: no relevant candidate with p (own null) up to 0.05, fewer than three in the window, made positive
    by clean z-scores (fixed), nearly positive, too scattered."""
    r = relevant.groupBy("query_id").agg(
        F.min("p").alias("_best"), F.count_if(F.col("rank") <= window).alias("_in"), F.count_if(F.col("p") < 0.05).alias("_sig")
    )
    both = cuts.select("query_id", F.col("statistic").alias("statistic_global")).join(other.select("query_id", F.col("statistic").alias("statistic_own")), "query_id")
    both = both.where((F.col("statistic_global") <= level) & (F.col("statistic_own") <= level))
    rows = both.join(r, "query_id", "left").join(fixed.select("query_id", F.col("flipped").alias("_flipped")), "query_id", "left")
    best, n_in, flips = F.coalesce("_best", F.lit(1.0)), F.coalesce("_in", F.lit(0)), F.coalesce("_flipped", F.lit(False))
    mode = F.when(best > 0.05, "weak_signal").when(n_in < 3, "too_sparse").when(flips, "zscore_distortion").when(F.col("statistic_own") > level - 1, "borderline").otherwise("too_scattered")
    return rows.select(
        "query_id", mode.alias("mode"), "statistic_global", "statistic_own", best.alias("best_p"), n_in.alias("n_in_window"),
        F.coalesce("_sig", F.lit(0)).alias("n_significant"), (n_in / window).alias("concentration"), flips.alias("clean_flips"),
    )


def clean_fix(pool: DataFrame, cuts: DataFrame, gamma: float, level: float = 0.0, need: int = 5) -> DataFrame:
    """Statistics with relevant candidates left out of the z-scores' estimate and each query's own null."""
    z = c.z_scores(pool, exclude=_rel(), need=need)
    null = z.where(_non()).select("query_id", F.col("z").alias("value"))
    p = c.with_query_null(z, null, "z").withColumn("p", c.empirical_p(F.col("n_at_least"), F.col("n_null")))
    after = c.thresholds(c.curve(p, gamma)).select("query_id", F.col("statistic").alias("after"))
    both = cuts.select("query_id", F.col("statistic").alias("before")).join(after, "query_id")
    return both.withColumn("flipped", (F.col("before") < level) & (F.col("after") >= level))


def boundary(z: DataFrame, window: int) -> DataFrame:
    """Share eps and mean z of relevant candidates in the window; above if it exceeds sqrt(2 ln(1 / eps))."""
    by = z.where(F.col("rank") <= window).groupBy("query_id").agg(F.avg(F.col("rel").cast("double")).alias("eps"), F.avg(F.when(_rel(), F.col("z"))).alias("signal")).where("eps > 0")
    return by.withColumn("above", F.col("signal") > F.sqrt(2 * F.log(1 / F.col("eps"))))


def boundary_by_group(bounds: DataFrame, groups: DataFrame) -> DataFrame:
    """Means of boundary() by group; groups(query_id, grp)."""
    return bounds.join(groups, "query_id").groupBy("grp").agg(
        F.count("*").alias("n"), F.avg("eps").alias("mean_eps"), F.avg("signal").alias("mean_signal"), F.count_if("above").alias("n_above"), F.avg(F.col("above").cast("double")).alias("share_above")
    )
