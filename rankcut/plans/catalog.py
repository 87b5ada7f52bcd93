"""Product benchmarks from `part`: category is brand and type, the department the brand, the price the retail price."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankcut.operators import catalog as k
from rankcut.plans.base import rounded
from rankcut.plans.registry import query, table

_BUCKETS = [("small", 2, 5), ("medium", 6, 10), ("large", 11, 15)]
_BANDS = [("b5_15", 5, 15), ("b16_40", 16, 40), ("b41_100", 41, 100)]

ITEMS = "items AS (SELECT p_partkey AS doc_id, p_brand || ' > ' || p_type AS category, p_brand AS dept, p_retailprice AS price, p_size AS size FROM part)"


def items(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" > ", "p_brand", "p_type").alias("category"), F.col("p_brand").alias("dept"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))


@query("b1_first_by_key", f"WITH {ITEMS} SELECT key, doc_id, price FROM (SELECT dept || ':' || size AS key, doc_id, price, row_number() OVER (PARTITION BY dept, size ORDER BY doc_id) AS i FROM items WHERE price > 950) WHERE i = 1")
def b1(spark, sf):
    keyed = items(spark, sf).select(F.concat_ws(":", "dept", "size").alias("key"), "doc_id", "price")
    return k.first_by_key(keyed, "key", F.col("price") > 950, "doc_id")


_PROFILE = "pr AS (SELECT 0 AS level, p_brand AS category, count(*) AS n, count(*) FILTER (p_retailprice > 950) AS n_content FROM part GROUP BY ALL UNION ALL SELECT 1, p_brand || ' > ' || p_type, count(*), count(*) FILTER (p_retailprice > 950) FROM part GROUP BY p_brand, p_type UNION ALL SELECT 2, p_brand || ' > ' || p_type || ' > ' || p_size, count(*), count(*) FILTER (p_retailprice > 950) FROM part GROUP BY p_brand, p_type, p_size)"


def _profile(spark, sf):
    p = table(spark, sf, "part").withColumn("categories", F.array("p_brand", "p_type", F.col("p_size").cast("string")))
    return k.category_profile(p, F.col("p_retailprice") > 950)


@query("b2_category_profile", f"WITH {_PROFILE} SELECT level, category, n, n_content FROM pr")
def b2(spark, sf):
    return _profile(spark, sf)


@query("b3_level_statistics", f"WITH {_PROFILE}, o AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, category) AS i, count(*) OVER (PARTITION BY level) AS m FROM pr) SELECT level, count(*) AS n_categories, min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS mean_n, max(CASE WHEN i = floor(m / 2) + 1 THEN n END) AS median_n, count(*) FILTER (n BETWEEN 5 AND 15) AS b5_15, count(*) FILTER (n BETWEEN 16 AND 40) AS b16_40, count(*) FILTER (n BETWEEN 41 AND 100) AS b41_100 FROM o GROUP BY level")
def b3(spark, sf):
    return rounded(k.level_statistics(_profile(spark, sf), _BANDS))


@query("b3_largest_categories", f"WITH {_PROFILE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, category) AS place FROM pr) WHERE place <= 10")
def b3t(spark, sf):
    return k.largest_categories(_profile(spark, sf))


@query("b4_recommended_level", f"WITH {_PROFILE}, g AS (SELECT level, count(*) AS n_categories, count(*) FILTER (n BETWEEN 5 AND 100) AS in_range, sum(n) AS t, max(n) AS x FROM pr GROUP BY level HAVING count(*) >= 10) SELECT level, n_categories, in_range, round(in_range * (in_range::DOUBLE / n_categories) * least(1.0, n_categories / 100.0) * (0.5 + 0.5 * (1 - x::DOUBLE / t)), 6) AS score FROM g ORDER BY in_range * (in_range::DOUBLE / n_categories) * least(1.0, n_categories / 100.0) * (0.5 + 0.5 * (1 - x::DOUBLE / t)) DESC, level LIMIT 1")
def b4(spark, sf):
    return rounded(k.recommended_level(_profile(spark, sf), 5, 100))


_PP = "pp AS (SELECT category, count(*) AS n, count(price) AS n_priced, round(count(price)::DOUBLE / count(*), 6) AS coverage, min(price) AS min_price, max(price) AS max_price, round(quantile_cont(price, 0.5), 6) AS median_price, round(quantile_cont(price, 0.25), 6) AS q25, round(quantile_cont(price, 0.75), 6) AS q75 FROM items GROUP BY category)"


@query("b5_price_profile", f"WITH {ITEMS}, {_PP} SELECT * FROM pp")
def b5(spark, sf):
    return rounded(k.price_profile(items(spark, sf)))


@query("b5_top_priced", f"WITH {ITEMS}, {_PP} SELECT category, n_priced FROM pp ORDER BY n_priced DESC, category LIMIT 20")
def b5t(spark, sf):
    return k.top_priced(k.price_profile(items(spark, sf))).select("category", "n_priced")


_CC = """it AS (SELECT p_brand AS config, split_part(p_type, ' ', 1) AS category, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS price, p_size > 10 AS content FROM part),
cp AS (SELECT config, category, price, count(*) AS n FROM it WHERE content AND price IS NOT NULL GROUP BY ALL),
cs AS (SELECT config, category, 'above' AS direction, sum(n) OVER w AS k, lead(price) OVER w AS nx FROM cp WINDOW w AS (PARTITION BY config, category ORDER BY price DESC) UNION ALL SELECT config, category, 'below', sum(n) OVER w, lead(price) OVER w FROM cp WINDOW w AS (PARTITION BY config, category ORDER BY price)),
cf AS (SELECT config, category, k FROM (SELECT *, row_number() OVER (PARTITION BY config, category ORDER BY direction, k) AS i FROM cs WHERE nx IS NOT NULL AND k BETWEEN 5 AND 50) WHERE i = 1),
cv AS (SELECT config, count(*) AS n_viable, count(*) FILTER (k BETWEEN 5 AND 15) AS k_5_15, count(*) FILTER (k BETWEEN 16 AND 30) AS k_16_30, count(*) FILTER (k BETWEEN 31 AND 50) AS k_31_50 FROM cf GROUP BY ALL),
ct AS (SELECT config, count(*) AS n, count(*) FILTER (content) AS n_content, count(price) AS n_priced, count(price) FILTER (content) AS n_both, round(count(price)::DOUBLE / count(*) * 100, 1) AS price_percent, round(count(*) FILTER (content)::DOUBLE / count(*) * 100, 1) AS content_percent, count(DISTINCT category) FILTER (content) AS n_categories, count(DISTINCT category) FILTER (content AND price IS NOT NULL) AS n_priced_categories FROM it GROUP BY ALL)"""


@query("b5_config_coverage", f"WITH {_CC} SELECT ct.*, coalesce(n_viable, 0) AS n_viable, coalesce(k_5_15, 0) AS k_5_15, coalesce(k_16_30, 0) AS k_16_30, coalesce(k_31_50, 0) AS k_31_50 FROM ct LEFT JOIN cv USING (config)")
def b5c(spark, sf):
    """Brands as configs of categories by the first word of the type; a part in seven has no price, small ones no content."""
    p = table(spark, sf, "part")
    price = F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice"))
    return k.config_coverage(p.select(F.col("p_brand").alias("config"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("category"), price.alias("price"), (F.col("p_size") > 10).alias("content")))


_TH = f"""pc AS (SELECT category, price, count(*) AS n FROM items GROUP BY ALL),
th_a AS (SELECT category, 'above' AS direction, sum(n) OVER w AS k, (price + lead(price) OVER w) / 2 AS threshold FROM pc WINDOW w AS (PARTITION BY category ORDER BY price DESC)
 UNION ALL SELECT category, 'below', sum(n) OVER w, (price + lead(price) OVER w) / 2 FROM pc WINDOW w AS (PARTITION BY category ORDER BY price)),
bk AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in _BUCKETS)}) t(bucket, lo, hi)),
th AS (SELECT category, bucket, direction, k::BIGINT AS k, round(threshold, 2) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY category, bucket ORDER BY abs(k - (lo + hi) / 2.0), direction, k) AS i FROM th_a, bk WHERE threshold IS NOT NULL AND k BETWEEN lo AND hi) WHERE i = 1)"""


def _thresholds(spark, sf):
    return k.thresholds_for(items(spark, sf), _BUCKETS)


@query("b6_price_thresholds", f"WITH {ITEMS}, {_TH} SELECT category, bucket, direction, k, threshold FROM th")
def b6(spark, sf):
    return _thresholds(spark, sf)


_SP = f"""{_TH}, sz AS (SELECT bucket, count(*) AS size_ FROM th GROUP BY ALL), sp_a AS (SELECT th.*, row_number() OVER (PARTITION BY category ORDER BY size_, bucket) AS o FROM th JOIN sz USING (bucket)),
sp_b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('0:' || category || ':')) AS i FROM sp_a WHERE o = 1),
sp AS (SELECT substr(md5(category || bucket), 1, 12) AS query_id, category, bucket, direction, k, threshold FROM sp_b WHERE i <= 80)"""


def specs(spark, sf):
    return k.select_specs(_thresholds(spark, sf), most=80).withColumn("query_id", F.substring(F.md5(F.concat("category", "bucket")), 1, 12))


@query("b7_query_selection", f"WITH {ITEMS}, {_SP} SELECT query_id, category, bucket, direction, k, threshold FROM sp")
def b7(spark, sf):
    return specs(spark, sf)


@query("b8_category_selection", f"WITH {ITEMS}, s AS (SELECT category, count(*) AS n FROM items GROUP BY ALL), c AS (SELECT *, CASE WHEN n BETWEEN 5 AND 15 THEN 'b5_15' WHEN n BETWEEN 16 AND 40 THEN 'b16_40' WHEN n BETWEEN 41 AND 100 THEN 'b41_100' END AS bucket FROM s) SELECT category, n, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('0:' || category || ':')) AS i FROM c WHERE bucket IS NOT NULL) WHERE i <= 200")
def b8(spark, sf):
    return k.select_categories(items(spark, sf).groupBy("category").agg(F.count("*").alias("n")), _BANDS, 200)


_TIER = f"""{_SP}, tr_a AS (SELECT sp.query_id, doc_id, CASE WHEN (direction = 'above' AND price > threshold) OR (direction = 'below' AND price < threshold) THEN 'relevant' ELSE 'hard' END AS tier FROM items JOIN sp USING (category)),
tr_b AS (SELECT *, count(*) FILTER (tier = 'relevant') OVER (PARTITION BY query_id) AS n_rel, row_number() OVER (PARTITION BY query_id, tier ORDER BY md5('0:' || doc_id || ':')) AS i FROM tr_a),
tr AS (SELECT query_id, doc_id, tier FROM tr_b WHERE tier = 'relevant' OR i <= greatest(5 * n_rel, 50)),
core AS (SELECT doc_id, max(tier) AS tier FROM tr GROUP BY doc_id),
oth AS (SELECT * FROM items WHERE category NOT IN (SELECT category FROM sp) AND doc_id NOT IN (SELECT doc_id FROM core)),
easy AS (SELECT doc_id, 'easy' AS tier FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id || ':'), doc_id) AS i FROM oth) WHERE i <= least(greatest(80000 - (SELECT count(*) FROM core), 0), greatest(120000 - (SELECT count(*) FROM core), 0)))"""


@query("b9_tiered_corpus", f"WITH {ITEMS}, {_TIER} SELECT doc_id, tier FROM core UNION ALL SELECT doc_id, tier FROM easy")
def b9(spark, sf):
    return k.tiered_corpus(items(spark, sf), specs(spark, sf), 80_000, 120_000)[0]


@query("b9_qrels", f"WITH {ITEMS}, {_TIER} SELECT query_id, doc_id, 1 AS relevance FROM tr WHERE tier = 'relevant'")
def b9q(spark, sf):
    return k.tiered_corpus(items(spark, sf), specs(spark, sf), 80_000, 120_000)[1]


_FOUR = f"""{_SP}, ft AS (SELECT doc_id, max(CASE WHEN (direction = 'above' AND price > threshold) OR (direction = 'below' AND price < threshold) THEN 'relevant' ELSE 'hard' END) AS tier FROM items JOIN sp USING (category) GROUP BY doc_id),
fo AS (SELECT * FROM items WHERE category NOT IN (SELECT category FROM sp) AND doc_id NOT IN (SELECT doc_id FROM ft)),
fd AS (SELECT doc_id, 'department' AS tier FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id || ':'), doc_id) AS i FROM fo WHERE dept IN (SELECT DISTINCT dept FROM items WHERE category IN (SELECT category FROM sp))) WHERE i <= trunc((120000 - (SELECT count(*) FROM ft)) * 0.6::DOUBLE)),
fe AS (SELECT doc_id, 'easy' AS tier FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id || ':'), doc_id) AS i FROM fo WHERE doc_id NOT IN (SELECT doc_id FROM fd)) WHERE i <= 120000 - (SELECT count(*) FROM ft) - (SELECT count(*) FROM fd))"""


@query("b10_four_tier_corpus", f"WITH {ITEMS}, {_FOUR} SELECT doc_id, tier FROM ft UNION ALL SELECT doc_id, tier FROM fd UNION ALL SELECT doc_id, tier FROM fe")
def b10(spark, sf):
    return k.four_tier_corpus(items(spark, sf), specs(spark, sf), 120_000)


_CC = f"""{_SP}, cr AS (SELECT doc_id, 'relevant' AS tier FROM items WHERE category IN (SELECT category FROM sp WHERE bucket = 'small')),
cd AS (SELECT doc_id, 'distractor' AS tier FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id || ':'), doc_id) AS i FROM items WHERE doc_id NOT IN (SELECT doc_id FROM cr)) WHERE i <= least(greatest(100000 - (SELECT count(*) FROM cr), trunc(1.8::DOUBLE * (SELECT count(*) FROM cr))), 150000 - (SELECT count(*) FROM cr)))"""


@query("b11_category_corpus", f"WITH {ITEMS}, {_CC} SELECT doc_id, tier FROM cr UNION ALL SELECT doc_id, tier FROM cd")
def b11(spark, sf):
    return k.category_corpus(items(spark, sf), specs(spark, sf).where("bucket = 'small'"), 100_000, 1.8, 150_000)


@query("b12_composition", f"WITH {ITEMS}, {_TIER}, a AS (SELECT * FROM core UNION ALL SELECT * FROM easy) SELECT tier, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM a), 6) AS percent FROM a GROUP BY tier")
def b12(spark, sf):
    return rounded(k.composition(b9(spark, sf)))


@query("b12_relevant_per_query", f"WITH {ITEMS}, {_TIER}, g AS (SELECT query_id, count(*) AS k FROM tr WHERE tier = 'relevant' GROUP BY query_id) SELECT count(*) AS n_queries, min(k) AS min_k, max(k) AS max_k, round(avg(k), 6) AS mean_k FROM g")
def b12k(spark, sf):
    return rounded(k.relevant_per_query(b9q(spark, sf)))


@query("b2_label_totals", "SELECT count(*) AS n, count(*) FILTER (p_retailprice > 950) AS n_content, count(*) FILTER (p_size > 25) AS n_multi, max(len(string_split(p_type, ' '))) AS max_depth FROM part")
def b2t(spark, sf):
    # parts of over 25 have their brand for a second label; a type's words are its levels
    p = table(spark, sf, "part")
    labels = F.when(F.col("p_size") > 25, F.array("p_type", "p_brand")).otherwise(F.array("p_type"))
    return k.label_totals(p, labels, F.size(F.split("p_type", " ")), F.col("p_retailprice") > 950)
