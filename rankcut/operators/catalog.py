"""Benchmarks from a product catalogue: profiles, price thresholds, query selection, tiered corpora and qrels.

Random choices are hash orders (retrieval.hash_order), so they are the same on every run and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankcut.operators.retrieval import hash_order


def first_by_key(items: DataFrame, key: str, ok: Column, *order: str) -> DataFrame:
    """Of the rows that pass, the first of each key."""
    rows = items.where(ok)
    others = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return first.select(key, *(F.col(f"_r.`{c}`").alias(c) for c in others))


def category_profile(items: DataFrame, content: Column) -> DataFrame:
    """items(key, categories array): (level from 0, category, n, n_content) at every level of the hierarchy."""
    paths = items.select(content.alias("_ok"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("categories")), lambda n: F.array_join(F.slice("categories", F.lit(1), n), " > "))).alias("level", "category"))
    return paths.groupBy("level", "category").agg(F.count("*").alias("n"), F.count_if("_ok").alias("n_content"))


def label_totals(items: DataFrame, labels: Column, depth: Column, content: Column) -> DataFrame:
    """One row: items, those with content, those with several labels, and the greatest depth of a label."""
    return items.agg(F.count("*").alias("n"), F.count_if(content).alias("n_content"), F.count_if(F.size(labels) > 1).alias("n_multi"), F.max(depth).alias("max_depth"))


def level_statistics(profile: DataFrame, bands: list[tuple[str, int, int]]) -> DataFrame:
    """Sizes of the categories of each level; the median is element n // 2 of the descending list."""
    w = Window.partitionBy("level")
    nth = profile.withColumns({"_i": F.row_number().over(w.orderBy(F.desc("n"), "category")), "_m": F.count("*").over(w)})
    return nth.groupBy("level").agg(
        F.count("*").alias("n_categories"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n"), F.max(F.when(F.col("_i") == F.floor(F.col("_m") / 2) + 1, F.col("n"))).alias("median_n"),
        *(F.count_if(F.col("n").between(lo, hi)).alias(name) for name, lo, hi in bands),
    )


def largest_categories(profile: DataFrame, k: int = 10, smallest: bool = False) -> DataFrame:
    w = Window.partitionBy("level").orderBy("n" if smallest else F.desc("n"), "category")
    return profile.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def recommended_level(profile: DataFrame, lo: int, hi: int, least: int = 10) -> DataFrame:
    """One row, the level of the best score: categories within [lo, hi], their share, a bonus for many, and how evenly
    items lie."""
    inside = F.col("n").between(lo, hi)
    by = profile.groupBy("level").agg(F.count("*").alias("n_categories"), F.count_if(inside).alias("in_range"), F.sum("n").alias("_t"), F.max("n").alias("_x")).where(F.col("n_categories") >= least)
    share, evenness = F.col("in_range") / F.col("n_categories"), 1 - F.col("_x") / F.col("_t")
    scored = by.withColumn("score", F.col("in_range") * share * F.least(F.lit(1.0), F.col("n_categories") / 100) * (0.5 + 0.5 * evenness))
    return scored.orderBy(F.desc("score"), "level").limit(1).select("level", "n_categories", "in_range", "score")


def price_profile(items: DataFrame) -> DataFrame:
    """items(category, price): totals and quartiles of each category's prices."""
    q = lambda x: F.percentile("price", F.lit(x))
    return items.groupBy("category").agg(
        F.count("*").alias("n"), F.count("price").alias("n_priced"), (F.count("price") / F.count("*")).alias("coverage"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), q(0.5).alias("median_price"), q(0.25).alias("q25"), q(0.75).alias("q75")
    )


def top_priced(profile: DataFrame, k: int = 20) -> DataFrame:
    return profile.orderBy(F.desc("n_priced"), "category").limit(k)


def _strictly(items: DataFrame, most: int, *keys: str) -> DataFrame:
    """(keys, direction, k, threshold): midpoints between neighbouring prices with k items strictly above (or below), k at
    most `most`. Only different prices with their counts are ranked."""
    prices = items.where("category is not null and price is not null").groupBy(*keys, "price").agg(F.count("*").alias("n"))
    out = None
    for direction in ("above", "below"):
        w = Window.partitionBy(*keys).orderBy(F.desc("price") if direction == "above" else F.asc("price"))
        run = prices.withColumns({"k": F.sum("n").over(w), "next": F.lead("price").over(w)}).where((F.col("k") <= most) & F.col("next").isNotNull())
        one = run.select(*keys, F.lit(direction).alias("direction"), "k", ((F.col("price") + F.col("next")) / 2).alias("threshold"))
        out = one if out is None else out.union(one)
    return out


def first_thresholds(items: DataFrame, lo: int, hi: int, *keys: str) -> DataFrame:
    """items(keys, price): the first threshold with a number of items within [lo, hi], above before below, then the smaller
    number: (keys, direction, threshold, k)."""
    found = _strictly(items, hi, *keys).where(F.col("k") >= lo).groupBy(*keys).agg(F.min(F.struct("direction", "k", "threshold")).alias("m"))
    return found.select(*keys, "m.direction", F.round("m.threshold", 2).alias("threshold"), F.col("m.k").cast("long").alias("k"))


def config_coverage(items: DataFrame, lo: int = 5, hi: int = 50, bands: tuple[tuple[int, int], ...] = ((5, 15), (16, 30), (31, 50))) -> DataFrame:
    """items(config, category, price, content boolean): a row for each config: products with content, with a price and with
    both, shares in percent, categories of products with content, how many of them have prices, for how many a threshold with
    lo to hi products exists, and how many of these have their first one in each band of k."""
    content, priced = F.coalesce("content", F.lit(False)), F.col("price").isNotNull()
    share = lambda c: F.round(F.count_if(c) / F.count("*") * 100, 1)
    totals = items.groupBy("config").agg(
        F.count("*").alias("n"), F.count_if(content).alias("n_content"), F.count_if(priced).alias("n_priced"), F.count_if(content & priced).alias("n_both"), share(priced).alias("price_percent"), share(content).alias("content_percent"),
        F.count_distinct(F.when(content, F.col("category"))).alias("n_categories"), F.count_distinct(F.when(content & priced, F.col("category"))).alias("n_priced_categories"),
    )
    first = first_thresholds(items.where(content), lo, hi, "config", "category").groupBy("config").agg(F.count("*").alias("n_viable"), *(F.count_if(F.col("k").between(x, y)).alias(f"k_{x}_{y}") for x, y in bands))
    counts = ["n_viable", *(f"k_{x}_{y}" for x, y in bands)]
    return totals.join(first, totals.config.eqNullSafe(first.config), "left").drop(first.config).withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})


def thresholds_for(items: DataFrame, buckets: list[tuple[str, int, int]]) -> DataFrame:
    """items(category, price): for each category and bucket [lo, hi], the midpoint between two neighbouring prices with a
    number of items strictly above (or below) it in the bucket and nearest its middle; above first, then the smaller k."""
    out = _strictly(items, max(hi for _, _, hi in buckets), "category")
    wanted = out.withColumn("b", F.explode(F.array(*(F.struct(F.lit(n).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in buckets))))
    fit = wanted.where((F.col("k") >= F.col("b.lo")) & (F.col("k") <= F.col("b.hi"))).withColumn("_d", F.abs(F.col("k") - (F.col("b.lo") + F.col("b.hi")) / 2))
    best = fit.groupBy("category", F.col("b.bucket").alias("bucket")).agg(F.min(F.struct("_d", "direction", "k", "threshold")).alias("m"))
    return best.select("category", "bucket", F.col("m.direction").alias("direction"), F.col("m.k").cast("long").alias("k"), F.round("m.threshold", 2).alias("threshold"))


def select_specs(specs: DataFrame, most: int = 80, total: int | None = None, seed: int = 0) -> DataFrame:
    """specs(category, bucket, ...): the scarcest bucket first, each category once; then at most `most` of each bucket by
    hash order, and of all at most `total`."""
    size = specs.groupBy("bucket").agg(F.count("*").alias("_size"))
    first = specs.join(F.broadcast(size), "bucket").withColumn("_o", F.row_number().over(Window.partitionBy("category").orderBy("_size", "bucket"))).where("_o = 1")
    nth = first.withColumn("_i", F.row_number().over(Window.partitionBy("bucket").orderBy(hash_order(seed, "category")))).where(F.col("_i") <= most).drop("_size", "_o", "_i")
    return nth if total is None else nth.orderBy(hash_order(seed + 1, "category")).limit(total)


def select_categories(sizes: DataFrame, bands: list[tuple[str, int, int]], most: int = 200, seed: int = 0) -> DataFrame:
    """sizes(category, n): at most `most` categories of each band of sizes."""
    from rankcut.functions.text import bucket_of

    banded = sizes.withColumn("bucket", bucket_of(F.col("n"), bands)).where("bucket is not null")
    return banded.withColumn("_i", F.row_number().over(Window.partitionBy("bucket").orderBy(hash_order(seed, "category")))).where(F.col("_i") <= most).drop("_i")


def tiers(items: DataFrame, specs: DataFrame, cap: Column | None = None, seed: int = 0) -> DataFrame:
    """items(doc_id, category, price) of the specs' categories: (query_id, doc_id, tier) with tier relevant (the right side
    of the threshold) or hard; of the hard ones, by hash order, at most cap (a column over n_relevant) for each query."""
    side = F.when(F.col("direction") == "above", F.col("price") > F.col("threshold")).otherwise(F.col("price") < F.col("threshold"))
    rows = items.join(specs, "category").withColumn("tier", F.when(side, "relevant").otherwise("hard"))
    n_rel = rows.where("tier = 'relevant'").groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    rows = rows.join(n_rel, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    if cap is not None:
        nth = F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(hash_order(seed, "doc_id")))
        rows = rows.withColumn("_i", nth).where((F.col("tier") == "relevant") | (F.col("_i") <= cap))
    return rows.select("query_id", "doc_id", "tier")


def fill(items: DataFrame, taken: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n items that aren't taken yet, by hash order (a top-n, not a sort of all)."""
    return items.join(taken.select("doc_id").distinct(), "doc_id", "left_anti").orderBy(hash_order(seed, "doc_id"), "doc_id").limit(max(0, n))


def tiered_corpus(items: DataFrame, specs: DataFrame, lo: int, hi: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(corpus(doc_id, tier), qrels): relevant and capped hard items, then easy ones of other categories (or of none) up to
    between lo and hi documents in all."""
    own = tiers(items, specs, F.greatest(5 * F.col("n_relevant"), F.lit(50)), seed)
    core = own.groupBy("doc_id").agg(F.max("tier").alias("tier"))  # relevant to any query
    have = core.count()
    others = items.join(specs.select("category").distinct(), "category", "left_anti")
    easy = fill(others, core, min(max(lo - have, 0), hi - have) if have < hi else 0, seed).select("doc_id", F.lit("easy").alias("tier"))
    return core.union(easy), own.where("tier = 'relevant'").select("query_id", "doc_id", F.lit(1).alias("relevance"))


def four_tier_corpus(items: DataFrame, specs: DataFrame, target: int, share: float = 0.6, seed: int = 0) -> DataFrame:
    """items also with dept: relevant and all hard items, then others of the same departments (`share` of what is left to
    the target), then easy ones up to the target."""
    core = tiers(items, specs).groupBy("doc_id").agg(F.max("tier").alias("tier"))
    have = core.count()
    depts = items.join(specs.select("category").distinct(), "category", "left_semi").select("dept").distinct()
    pool = items.join(specs.select("category").distinct(), "category", "left_anti")
    near = fill(pool.join(depts, "dept", "left_semi"), core, int((target - have) * share), seed).select("doc_id", F.lit("department").alias("tier"))
    so_far = core.union(near)
    easy = fill(pool, so_far, target - so_far.count(), seed + 1).select("doc_id", F.lit("easy").alias("tier"))
    return so_far.union(easy)


def category_corpus(items: DataFrame, chosen: DataFrame, target: int = 100_000, factor: float = 1.8, most: int = 150_000, seed: int = 0) -> DataFrame:
    """Items of the chosen categories, and distractors: max(target - n, factor n), not beyond `most` in all."""
    rel = items.join(chosen.select("category").distinct(), "category", "left_semi").select("doc_id", F.lit("relevant").alias("tier"))
    n = rel.count()
    return rel.union(fill(items, rel, min(max(target - n, int(factor * n)), most - n), seed).select("doc_id", F.lit("distractor").alias("tier")))


def composition(corpus: DataFrame) -> DataFrame:
    by = corpus.groupBy("tier").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("_t"))  # one row
    return by.crossJoin(F.broadcast(total)).select("tier", "n", (100 * F.col("n") / F.col("_t")).alias("percent"))


def relevant_per_query(qrels: DataFrame) -> DataFrame:
    """One row: how many queries there are and how many documents are relevant to each."""
    by = qrels.groupBy("query_id").agg(F.count("*").alias("k"))
    return by.agg(F.count("*").alias("n_queries"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.avg("k").alias("mean_k"))
