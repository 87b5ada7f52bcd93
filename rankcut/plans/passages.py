"""Entity benchmarks: customers are entities, nations clusters, orders passages; conversation turns are generated
questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankcut.functions.text import k_range
from rankcut.operators import cluster_index as ci
from rankcut.operators import passages as p
from rankcut.operators import similar
from rankcut.plans.base import rounded
from rankcut.plans.registry import query, table
from rankcut.sources.checkpoints import new_folder
from rankcut.plans.text import _words

BASE = """members AS (SELECT c_nationkey AS cluster_id, c_custkey AS entity, c_mktsegment AS type FROM customer),
pas AS (SELECT o_orderkey AS passage_id, o_custkey AS entity, o_orderpriority || ' ' || o_orderstatus AS text FROM orders),
asked AS (SELECT DISTINCT cluster_id AS query_id, entity FROM members)"""


def members(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster_id"), F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("type"))


def passages(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("passage_id"), F.col("o_custkey").alias("entity"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))


def asked(spark, sf):
    return members(spark, sf).select(F.col("cluster_id").alias("query_id"), "entity")


_Q1 = """q1 AS (SELECT query_id, entity, passage_id, round(greatest(0.1::DOUBLE, 1 - 0.2::DOUBLE * (i - 1)), 6) AS relevance, substring(text, 1, 200) AS preview FROM asked LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY passage_id) AS i FROM pas) WHERE i <= 3) USING (entity))"""


@query("q1_passage_mapping", f"WITH {BASE}, {_Q1} SELECT query_id, entity, passage_id, CASE WHEN passage_id IS NULL THEN NULL ELSE relevance END AS relevance, preview FROM q1")
def q1(spark, sf):
    return p.map_queries(asked(spark, sf), passages(spark, sf)).withColumn("relevance", F.when(F.col("passage_id").isNotNull(), F.col("relevance")))


@query("q1_coverage", f"WITH {BASE}, {_Q1}, g AS (SELECT query_id, entity, count(passage_id) AS n FROM q1 GROUP BY ALL) SELECT query_id, count(*) AS n_entities, count(*) FILTER (n > 0) AS n_covered, sum(n)::BIGINT AS n_passages, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM g GROUP BY query_id")
def q1c(spark, sf):
    return rounded(p.coverage(p.map_queries(asked(spark, sf), passages(spark, sf))))


@query("q2_passage_statistics", f"WITH {BASE}, g AS (SELECT entity, count(*) AS n FROM pas GROUP BY ALL) SELECT sum(n)::BIGINT AS n_passages, count(*) AS n_entities, round(avg(n), 6) AS mean_per_entity, max(n) AS max_per_entity, min(n) AS min_per_entity FROM g")
def q2(spark, sf):
    return rounded(p.passage_statistics(passages(spark, sf)))


_Q3 = "q3 AS (SELECT query_id, entity, passage_id FROM asked JOIN (SELECT entity, min(passage_id) AS passage_id FROM pas GROUP BY ALL) USING (entity))"


@query("q3_lead_mapping", f"WITH {BASE}, {_Q3} SELECT * FROM q3")
def q3(spark, sf):
    return p.lead_mapping(asked(spark, sf), passages(spark, sf))


@query("q3_lead_mismatch", f"WITH {BASE}, {_Q3}, t AS (SELECT query_id, count(*) AS target_k FROM asked GROUP BY ALL), g AS (SELECT query_id, count(*) AS n FROM q3 GROUP BY ALL) SELECT query_id, target_k, coalesce(n, 0) AS n_passages, coalesce(n, 0) <> target_k AS mismatch FROM t LEFT JOIN g USING (query_id)")
def q3m(spark, sf):
    a = asked(spark, sf).distinct()
    return p.lead_mismatch(a, p.lead_mapping(a, passages(spark, sf)), a.groupBy("query_id").agg(F.count("*").alias("target_k")))


@query("q4_cluster_coverage", f"WITH {BASE}, n AS (SELECT entity, count(*) AS n FROM pas GROUP BY ALL), g AS (SELECT cluster_id, count(*) AS n_entities, count(n) AS n_covered, coalesce(sum(n), 0)::BIGINT AS n_passages, coalesce(avg(n), 0) AS m, count(n)::DOUBLE / count(*) AS r, coalesce(list(entity ORDER BY entity) FILTER (n IS NULL), []) AS missing FROM members LEFT JOIN n USING (entity) GROUP BY ALL) SELECT cluster_id, n_entities, n_covered, n_passages, round(m, 6) AS mean_passages, round(r, 6) AS rate, CASE WHEN m >= 10 THEN 'high' WHEN m >= 5 THEN 'medium' ELSE 'low' END AS quality, r >= 0.8 AND m >= 3 AS valid, missing FROM g")
def q4(spark, sf):
    return rounded(p.cluster_coverage(members(spark, sf), passages(spark, sf)))


_YEARS = "ym AS (SELECT c_nationkey AS cluster_id, c_custkey AS entity, min(year(o_orderdate)) AS year FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"
_YR = f"""{_YEARS}, yn AS (SELECT cluster_id, year, count(DISTINCT entity) AS n FROM ym WHERE year IS NOT NULL GROUP BY ALL), yr AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id ORDER BY year) AS upto FROM yn),
ys AS (SELECT a.cluster_id, 8 AS target_k, a.year AS start, b.year AS "end", (b.upto - a.upto + a.n)::BIGINT AS n FROM yr a JOIN yr b ON a.cluster_id = b.cluster_id AND a.year <= b.year),
yb AS (SELECT cluster_id, target_k, start, "end", n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(n - target_k), start, "end") AS i FROM ys) WHERE i = 1)"""


def _with_years(spark, sf):
    m = members(spark, sf)
    years = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.min(F.year("o_orderdate")).alias("year"))
    return m.join(years, "entity", "left")


def _ranges(spark, sf):
    m = _with_years(spark, sf)
    return p.best_year_range(m, m.select("cluster_id").distinct().withColumn("target_k", F.lit(8)))


@query("q5_best_year_range", f'WITH {_YR} SELECT cluster_id, target_k, start, "end", n FROM yb')
def q5(spark, sf):
    return _ranges(spark, sf)


@query("q5_sub_cluster", f"""WITH {_YR}, c AS (SELECT cluster_id, target_k, entity, min(CASE WHEN year BETWEEN start AND "end" THEN 0 WHEN year IS NULL THEN 1 END) AS c FROM ym JOIN yb USING (cluster_id) GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY c, md5('0:' || entity || ':')) AS i FROM c WHERE c IS NOT NULL) SELECT cluster_id, entity FROM i WHERE i <= target_k""")
def q5s(spark, sf):
    return p.sub_cluster(_with_years(spark, sf), _ranges(spark, sf))


# generated questions: every turn, with a target that depends on its length

GEN = """gen AS (SELECT conv_id || ':' || turn AS query_id, row_number() OVER (ORDER BY conv_id, turn) AS pos, text, role AS cluster_type, 2 + length(text) % 19 AS target_k, 2 + length(text) % 23 AS actual_k, (length(text) % 11) / 10.0::DOUBLE AS coverage, length(text) % 4 AS n_passages, ['easy', 'medium', 'hard'][turn % 3 + 1] AS difficulty, length(text) % 5 <> 0 AS is_valid, conv_id FROM conversations)"""


def generated(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), "conv_id", "turn", "text", F.col("role").alias("cluster_type"), (2 + n % 19).alias("target_k"), (2 + n % 23).alias("actual_k"),
        ((n % 11) / F.lit(10.0)).alias("coverage"), (n % 4).alias("n_passages"), F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("turn") % 3 + 1).cast("int")).alias("difficulty"), (n % 5 != 0).alias("is_valid"),
    )


_KV = """kv AS (SELECT *, abs(target_k - actual_k) AS d, CASE WHEN actual_k < 2 THEN 'too few' WHEN coverage < 0.6 THEN 'low coverage' WHEN abs(target_k - actual_k) > 5 THEN 'large difference' WHEN actual_k > 25 THEN 'too many' ELSE 'accepted' END AS reason FROM gen)"""


@query("q6_k_validation", f"WITH {GEN}, {_KV} SELECT query_id, CASE WHEN d = 0 THEN 'exact' WHEN d <= 2 THEN 'close' WHEN d <= 5 THEN 'moderate' ELSE 'large' END AS difference, reason, reason = 'accepted' AS accepted FROM kv")
def q6(spark, sf):
    return p.k_validation(generated(spark, sf)).select("query_id", "difference", "reason", "accepted")


@query("q6_k_report", f"WITH {GEN}, {_KV} SELECT difficulty, count(*) AS n, count(*) FILTER (reason = 'accepted') AS n_accepted, round(avg(d), 6) AS mean_difference FROM kv GROUP BY difficulty")
def q6r(spark, sf):
    return rounded(p.k_report(p.k_validation(generated(spark, sf)), "difficulty"))


_any = lambda ws: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")"
_FIL = f"""fa AS (SELECT *, len({_words('text')}) AS nw, {_any(['who', 'what', 'list', 'name', 'which'])} AS e_, {_any(['how', 'compare', 'analyze', 'pattern', 'relationship'])} AS h_, abs(target_k - actual_k) AS d FROM gen),
fb AS (SELECT *, actual_k >= 2 AND actual_k <= 25 AND d <= 2 AS k_ok, CASE WHEN actual_k < 2 OR actual_k > 25 THEN 0 WHEN d > 2 THEN 1 - d::DOUBLE / coalesce(nullif(target_k, 0), 1) ELSE 1 - d::DOUBLE / 3 END AS k_score,
 n_passages >= 1 AND coverage >= 0.5 AND regexp_matches(text, '\\?\\s*$') AS a_ok, CASE WHEN n_passages < 1 THEN 0 WHEN coverage < 0.5 THEN coverage WHEN NOT regexp_matches(text, '\\?\\s*$') THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, (coverage + n_passages / 10.0::DOUBLE) / 2) END AS a_score,
 CASE difficulty WHEN 'easy' THEN CASE WHEN nw < 12 AND e_ THEN 1.0::DOUBLE WHEN nw > 25 OR h_ THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END WHEN 'hard' THEN CASE WHEN nw > 25 OR h_ THEN 1.0::DOUBLE WHEN nw < 12 AND e_ THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END ELSE CASE WHEN nw BETWEEN 12 AND 25 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END END AS d_score FROM fa),
fc AS (SELECT *, d_score >= 0.4 AS d_ok, (k_score + a_score + d_score) / 3 AS total_score FROM fb)"""
_NAMES = ["k_alignment", "answerability", "difficulty"]


def _filters():
    text = F.col("text")
    return {
        "k_alignment": p.k_alignment(F.col("target_k"), F.col("actual_k")),
        "answerability": p.answerability(F.col("n_passages"), F.col("coverage"), text),
        "difficulty": p.difficulty_fit(text, F.col("difficulty"), strict=True),
    }


@query("q7_q9_q10_q11_filters", f"WITH {GEN}, {_FIL} SELECT query_id, k_ok AS k_alignment_ok, a_ok AS answerability_ok, d_ok AS difficulty_ok, round(total_score, 6) AS total_score, concat_ws(',', CASE WHEN NOT k_ok THEN 'k_alignment' END, CASE WHEN NOT a_ok THEN 'answerability' END, CASE WHEN NOT d_ok THEN 'difficulty' END) AS failed FROM fc")
def q11(spark, sf):
    f = p.filtered(generated(spark, sf), _filters())
    return rounded(f.select("query_id", *(f"{n}_ok" for n in _NAMES), "total_score", F.array_join("failed", ",").alias("failed")))


@query("q11_filter_report", f"WITH {GEN}, {_FIL}, n AS (SELECT count(*) AS n, count(*) FILTER (NOT k_ok) AS f0, count(*) FILTER (NOT a_ok) AS f1, count(*) FILTER (NOT d_ok) AS f2, count(*) FILTER (k_ok) AS p0, count(*) FILTER (k_ok AND a_ok) AS p1, count(*) FILTER (k_ok AND a_ok AND d_ok) AS p2 FROM fc) SELECT 0 AS step, 'k_alignment' AS filter, f0 AS n_failed, n - f0 AS subtracted, p0 AS passed_so_far FROM n UNION ALL SELECT 1, 'answerability', f1, n - f0 - f1, p1 FROM n UNION ALL SELECT 2, 'difficulty', f2, n - f0 - f1 - f2, p2 FROM n")
def q11r(spark, sf):
    return p.filter_report(p.filtered(generated(spark, sf), _filters()), _NAMES)


_TOK = "list_filter(list_distinct(regexp_extract_all(lower(text), '(\\w+)', 1)), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in "the a an is are was were in on at to for of and or that this with by".split()) + "))"


@query("q8_similar_pairs", f"WITH tk AS (SELECT doc_id, {_TOK} AS t FROM documents), tf AS (SELECT doc_id, t, len(t) AS n FROM tk WHERE len(t) > 0) SELECT a.doc_id AS i, b.doc_id AS j FROM tf a JOIN tf b ON a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) WHERE len(list_intersect(a.t, b.t))::DOUBLE / (a.n + b.n - len(list_intersect(a.t, b.t))) > 0.85")
def q8(spark, sf):
    return similar.similar_pairs(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text"))


_Q8 = f"tk AS (SELECT doc_id, text, {_TOK} AS t FROM documents), tf AS (SELECT doc_id, t, len(t) AS n FROM tk WHERE len(t) > 0), pr AS (SELECT a.doc_id AS i, b.doc_id AS j FROM tf a JOIN tf b ON a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) WHERE len(list_intersect(a.t, b.t))::DOUBLE / (a.n + b.n - len(list_intersect(a.t, b.t))) > 0.85)"


@query(
    "q8_diverse_rows",
    f"""WITH {_Q8}, nb AS (SELECT j AS pos, list(i) AS nb FROM pr GROUP BY j), al AS (SELECT DISTINCT i AS pos FROM pr UNION SELECT j FROM pr),
st AS (SELECT list({{'kept': [pos], 'nb': coalesce(nb, [])}} ORDER BY pos) AS rows FROM al LEFT JOIN nb USING (pos)),
kp AS (SELECT list_reduce(rows, lambda a, x: {{'kept': CASE WHEN len(list_intersect(a.kept, x.nb)) > 0 THEN a.kept ELSE list_concat(a.kept, x.kept) END, 'nb': a.nb}}).kept AS kept FROM st)
SELECT doc_id AS pos, CASE WHEN coalesce(text, '') = '' THEN false WHEN doc_id IN (SELECT pos FROM al) THEN doc_id IN (SELECT unnest(kept) FROM kp) ELSE true END AS kept FROM tk""",
)
def q8d(spark, sf):
    return p.diverse(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")).select("pos", "kept")


_VALID = f"""vg AS (SELECT *, CASE WHEN is_valid AND text <> '' THEN text END AS vt, CASE WHEN is_valid THEN coalesce(nullif(actual_k, 0), nullif(target_k, 0)) END AS vk FROM gen), vw AS (SELECT *, CASE WHEN vt IS NOT NULL THEN len({_words('text')}) END AS nw FROM vg),
vo AS (SELECT array_to_string(list_slice({_words('vt')}, 1, 3), ' ') AS opening, count(*) AS n FROM vw WHERE vt IS NOT NULL GROUP BY ALL HAVING opening <> '')"""


def _questions(spark, sf):
    """Generated questions with the errors of those that aren't valid."""
    return generated(spark, sf).withColumn("errors", F.when(F.col("is_valid"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("remainder "), (F.length("text") % 7).cast("string")))))


@query("q12_generation_metrics", f"WITH {GEN}, {_VALID} SELECT count(*) AS n, count(*) FILTER (is_valid) AS n_valid, round(count(*) FILTER (is_valid)::DOUBLE / count(*), 6) AS valid_rate, count(DISTINCT vt) AS n_unique, round(count(DISTINCT vt)::DOUBLE / count(vt), 6) AS unique_rate, round(avg(nw), 6) AS mean_words, min(nw) AS min_words, max(nw) AS max_words, round(avg(vk), 6) AS mean_k, min(vk) AS min_k, max(vk) AS max_k, quantile_cont(vk, 0.5) AS median_k FROM vw")
def q12(spark, sf):
    return rounded(p.generation_metrics(generated(spark, sf)))


@query("q12_openings", f"WITH {GEN}, {_VALID} SELECT opening, n FROM vo ORDER BY n DESC, opening LIMIT 5")
def q12o(spark, sf):
    return p.openings(generated(spark, sf))


@query("q12_question_types", f"WITH {GEN}, {_VALID} SELECT coalesce(" + ", ".join(f"CASE WHEN starts_with(lower(trim(vt)), '{w}') THEN '{w}' END" for w in p.QUESTION_TYPES) + ", 'other') AS question_type, count(*) AS n FROM vw WHERE vt IS NOT NULL GROUP BY ALL")
def q12q(spark, sf):
    return p.question_types(generated(spark, sf))


_KR = "CASE WHEN {0} <= 5 THEN '2-5' WHEN {0} <= 10 THEN '6-10' WHEN {0} <= 15 THEN '11-15' ELSE '16-20' END"
_RANGES = "(VALUES ('2-5'), ('6-10'), ('11-15'), ('16-20')) r(k_range)"


@query("q12_k_distribution", f"WITH {GEN}, {_VALID}, d AS (SELECT {_KR.format('vk')} AS k_range, count(*) AS n FROM vw WHERE vk IS NOT NULL GROUP BY ALL) SELECT k_range, coalesce(n, 0) AS n FROM {_RANGES} LEFT JOIN d USING (k_range)")
def q12k(spark, sf):
    return p.k_distribution(generated(spark, sf))


@query(
    "q12_issues",
    f"""WITH {GEN}, {_VALID}, f AS (SELECT count(*) AS n, count(*) FILTER (is_valid) AS v, count(vt) AS t, count(DISTINCT vt) AS u, count(*) FILTER (nw < 10) AS s FROM vw),
er AS (SELECT 'remainder ' || length(text) % 7 AS error, count(*) AS n FROM gen WHERE NOT is_valid GROUP BY ALL ORDER BY n DESC, error LIMIT 3)
SELECT 'low_success_rate' AS issue, 'warning' AS severity, v AS n, '' AS detail FROM f WHERE v < 0.8 * f.n UNION ALL SELECT 'low_uniqueness', 'warning', u, '' FROM f WHERE u < 0.9 * t UNION ALL SELECT 'short_queries', 'info', s, '' FROM f WHERE s > 0.1 * t
UNION ALL SELECT 'repetitive_opening', 'info', o.n, opening FROM (SELECT * FROM vo ORDER BY n DESC, opening LIMIT 1) o, f WHERE o.n > 0.2 * t UNION ALL SELECT 'common_error', 'warning', n, error FROM er WHERE n >= 3""",
)
def q12i(spark, sf):
    return p.generation_issues(_questions(spark, sf))


_SK = {"2-5": 0.3, "6-10": 0.3, "11-15": 0.2, "16-20": 0.2}
_SD = {"easy": 0.3, "medium": 0.4, "hard": 0.3}
_TYPES = ["user", "assistant"]
_case = lambda col, m: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in m.items()) + " END"


_SEL = f"""{GEN}, {_FIL}, c AS (SELECT query_id, conv_id, difficulty, cluster_type, total_score, {_KR.format('target_k')} AS k_range FROM fc),
t AS (SELECT *, greatest(1, trunc(240 * {_case('k_range', _SK)} * {_case('difficulty', _SD)})::INT) AS target, count(*) OVER (PARTITION BY k_range, difficulty) AS n, coalesce(list_position(['user', 'assistant'], cluster_type), 0) AS ty, row_number() OVER (PARTITION BY k_range, difficulty, cluster_type ORDER BY round(total_score, 6) DESC, query_id) AS turn FROM c),
i AS (SELECT *, row_number() OVER (PARTITION BY k_range, difficulty ORDER BY turn, ty, query_id) AS i FROM t WHERE n <= target OR ty > 0),
sel AS (SELECT query_id, conv_id, k_range, difficulty, cluster_type, total_score FROM i WHERE i <= target)"""


def _selected(spark, sf):
    f = rounded(p.filtered(generated(spark, sf), _filters()).withColumn("k", F.col("target_k")))
    return p.stratified(f, 240, _SK, _SD, _TYPES)


@query("q13_stratified_selection", f"WITH {_SEL} SELECT query_id, k_range, difficulty, cluster_type FROM sel")
def q13(spark, sf):
    return _selected(spark, sf).select("query_id", "k_range", "difficulty", "cluster_type")


_CELLS = ", ".join(f"('{k}', '{d}', {max(1, int(240 * x * y))})" for k, x in _SK.items() for d, y in _SD.items())


@query("q13_shortfalls", f"WITH {_SEL}, w AS (SELECT * FROM (VALUES {_CELLS}) w(k_range, difficulty, target)), h AS (SELECT k_range, difficulty, target, count(query_id) AS selected FROM w LEFT JOIN sel USING (k_range, difficulty) GROUP BY ALL) SELECT k_range, difficulty, target, selected, target - selected AS shortfall FROM h WHERE selected < target")
def q13s(spark, sf):
    return p.shortfalls(_selected(spark, sf), 240, _SK, _SD)


@query("q13_selection_counts", f"WITH {_SEL} SELECT 'k_range' AS dimension, k_range AS value, count(*) AS n FROM sel GROUP BY ALL UNION ALL SELECT 'difficulty', difficulty, count(*) FROM sel GROUP BY ALL UNION ALL SELECT 'cluster_type', cluster_type, count(*) FROM sel GROUP BY ALL")
def q13c(spark, sf):
    return p.counts_by(_selected(spark, sf), "k_range", "difficulty", "cluster_type")


@query("q13_selection_summary", f"WITH {_SEL} SELECT 240 AS total_target, count(*) AS n_selected, round(count(*) / 240.0::DOUBLE, 6) AS selection_rate, count(DISTINCT conv_id) AS n_clusters, round(avg(round(total_score, 6)), 6) AS mean_score FROM sel")
def q13t(spark, sf):
    return rounded(p.selection_summary(_selected(spark, sf).withColumn("cluster_id", F.col("conv_id")), 240))


_ASM = f"""{_Q3}, ar AS (SELECT DISTINCT passage_id FROM q3), an AS (SELECT greatest(0, trunc((SELECT count(*) FROM ar) / 0.02::DOUBLE)::BIGINT - (SELECT count(*) FROM ar)) AS n),
ax AS (SELECT passage_id, row_number() OVER (ORDER BY md5('0:' || passage_id || ':'), passage_id) AS i FROM pas WHERE passage_id NOT IN (SELECT passage_id FROM ar)),
asm AS (SELECT passage_id, 'relevant' AS kind FROM ar UNION ALL SELECT passage_id, CASE WHEN i <= trunc((SELECT n FROM an) * 0.15::DOUBLE) THEN 'hard' ELSE 'random' END FROM ax WHERE i <= (SELECT n FROM an))"""


@query("q14_assembled_corpus", f"WITH {BASE}, {_ASM} SELECT passage_id, kind FROM asm")
def q14(spark, sf):
    qrels = p.lead_mapping(asked(spark, sf), passages(spark, sf))
    return p.assembled(passages(spark, sf), qrels, 0.02)


@query("q14_qrels", f"WITH {BASE}, {_Q3} SELECT query_id, passage_id, 1 AS relevance, entity FROM q3")
def q14q(spark, sf):
    return p.qrels_of(p.lead_mapping(asked(spark, sf), passages(spark, sf)))


@query("q14_corpus_statistics", f"WITH {BASE}, {_ASM}, k AS (SELECT count(*) AS n_passages, count(*) FILTER (kind = 'relevant') AS n_relevant, count(*) FILTER (kind = 'hard') AS n_hard, count(*) FILTER (kind = 'random') AS n_random FROM asm), n AS (SELECT query_id, count(passage_id)::DOUBLE AS n FROM (SELECT DISTINCT query_id FROM asked) LEFT JOIN q3 USING (query_id) GROUP BY ALL), m AS (SELECT round(avg(n), 6) AS mean_per_query, min(n) AS min_per_query, max(n) AS max_per_query, quantile_cont(n, 0.5) AS median_per_query FROM n) SELECT k.*, round(n_relevant::DOUBLE / n_passages, 6) AS sparsity, m.* FROM k, m")
def q14s(spark, sf):
    mapped = p.lead_mapping(asked(spark, sf), passages(spark, sf))
    return rounded(p.corpus_statistics(p.assembled(passages(spark, sf), mapped, 0.02), p.passages_per_query(asked(spark, sf), mapped)))


@query("q14_passages_histogram", f"WITH n AS (SELECT c_custkey AS query_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL), d AS (SELECT {_KR.format('n')} AS k_range, count(*) AS n FROM n GROUP BY ALL) SELECT k_range, coalesce(d.n, 0) AS n FROM {_RANGES} LEFT JOIN d USING (k_range)")
def q14h(spark, sf):
    """Each customer as a query for their own orders."""
    own = members(spark, sf).select(F.col("entity").alias("query_id"))
    return p.by_k_range(p.passages_per_query(own, passages(spark, sf).select(F.col("entity").alias("query_id"), "passage_id")), F.col("n"))


_SPLIT = "sg AS (SELECT DISTINCT conv_id FROM gen), si AS (SELECT conv_id, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('0:' || conv_id || ':')) AS i FROM sg), sp AS (SELECT conv_id, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM si)"


@query("q15_splits", f"WITH {GEN}, {_SPLIT} SELECT query_id, split FROM gen JOIN sp USING (conv_id)")
def q15(spark, sf):
    return p.split(generated(spark, sf), "conv_id").select("query_id", "split")


@query("q16_metadata_counts", f"WITH {GEN} SELECT 'difficulty' AS dimension, difficulty AS value, count(*) AS n FROM gen GROUP BY difficulty UNION ALL SELECT 'cluster_type', cluster_type, count(*) FROM gen GROUP BY cluster_type UNION ALL SELECT 'k_range', CASE WHEN actual_k <= 5 THEN '2-5' WHEN actual_k <= 10 THEN '6-10' WHEN actual_k <= 15 THEN '11-15' ELSE '16-20' END AS v, count(*) FROM gen GROUP BY v")
def q16(spark, sf):
    return p.counts_by(generated(spark, sf).withColumn("k_range", k_range(F.col("actual_k"))), "difficulty", "cluster_type", "k_range")


@query("q17_bucket_coverage", f"WITH {BASE}, s AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY ALL), t AS (SELECT * FROM (VALUES ('small', 1, 40, 10), ('medium', 41, 60, 10), ('large', 61, 100000, 10)) t(bucket, lo, hi, target)), h AS (SELECT bucket, count(*) AS have FROM s JOIN t ON n BETWEEN lo AND hi GROUP BY ALL) SELECT bucket, target, coalesce(have, 0) AS have, greatest(0, target - coalesce(have, 0)) AS gap FROM t LEFT JOIN h USING (bucket)")
def q17(spark, sf):
    targets = spark.createDataFrame([("small", 1, 40, 10), ("medium", 41, 60, 10), ("large", 61, 100000, 10)], "bucket string, lo int, hi int, target int")
    return p.bucket_coverage(members(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n")), targets)


_Q18 = "b AS (SELECT cluster_id, type, count(*) AS n FROM members GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, type DESC) AS i FROM b), g AS (SELECT cluster_id, sum(n)::BIGINT AS n, max(CASE WHEN i = 1 THEN type END) AS dominant, max(n) AS n_dominant, sum(CASE WHEN type NOT IN ('HOUSEHOLD', 'MACHINERY', 'BUILDING') THEN n ELSE 0 END)::BIGINT AS n_outliers FROM o GROUP BY cluster_id), tc AS (SELECT cluster_id, n, dominant, n_dominant, n_outliers, round(n_dominant::DOUBLE / n, 6) AS share, n_dominant::DOUBLE / n >= 0.7 AND n_outliers::DOUBLE / n <= 0.1 AS valid FROM g)"


def _consistent(spark, sf):
    m = members(spark, sf)
    allowed = spark.createDataFrame([("HOUSEHOLD",), ("MACHINERY",), ("BUILDING",)], "type string")
    return rounded(p.type_consistency(m.drop("type"), m.select("entity", "type"), allowed))


@query("q18_type_consistency", f"WITH {BASE}, {_Q18} SELECT * FROM tc")
def q18(spark, sf):
    return _consistent(spark, sf)


@query("q18_type_counts", f"WITH {BASE}, {_Q18} SELECT cluster_id, type, n FROM b WHERE type IS NOT NULL")
def q18t(spark, sf):
    m = members(spark, sf)
    return p.type_counts(m.drop("type"), m.select("entity", "type"))


@query("q18_report", f"WITH {BASE}, {_Q18} SELECT count(*) AS n_clusters, count(*) FILTER (valid) AS n_valid, round(avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0 END), 6) AS valid_rate, round(avg(share), 6) AS mean_share FROM tc")
def q18r(spark, sf):
    return rounded(p.consistency_report(_consistent(spark, sf)))


@query("q18_warnings", f"WITH {BASE}, {_Q18} SELECT cluster_id, share, n_outliers, concat_ws(',', CASE WHEN share < 0.7 THEN 'low consistency' END, CASE WHEN n_outliers > 0.1 * n THEN 'many outliers' END) AS warnings FROM tc WHERE NOT valid")
def q18w(spark, sf):
    return p.consistency_warnings(_consistent(spark, sf)).withColumn("warnings", F.array_join("warnings", ","))


@query("q19_reconciliation", f"WITH {BASE}, e AS (SELECT query_id, entity FROM asked), v AS (SELECT DISTINCT c_nationkey AS query_id, o_custkey AS entity FROM orders JOIN customer ON c_custkey = o_custkey), g AS (SELECT query_id, count(e.entity) AS n_expected, count(v.entity) AS n_verified, count(*) FILTER (v.entity IS NULL) AS n_missing, count(*) FILTER (e.entity IS NULL) AS n_extra FROM e FULL JOIN v USING (query_id, entity) GROUP BY ALL) SELECT *, CASE WHEN n_missing + n_extra = 0 THEN 'exact' WHEN n_missing + n_extra <= 2 THEN 'close' WHEN n_missing + n_extra <= 5 THEN 'moderate' ELSE 'large' END AS band FROM g")
def q19(spark, sf):
    c = members(spark, sf).select(F.col("cluster_id").alias("query_id"), "entity")
    ordered = c.join(passages(spark, sf).select("entity").distinct(), "entity", "left_semi").select("query_id", "entity")
    return p.reconciled(asked(spark, sf), ordered)


_AL = "cl AS (SELECT c_custkey AS cluster_id, c_mktsegment AS type, CASE WHEN c_acctbal < 3000 THEN 'small' ELSE 'large' END AS bucket FROM customer), tg AS (SELECT * FROM (VALUES ('small', 600), ('large', 900)) t(bucket, target)), sh AS (SELECT DISTINCT type, 0.2::DOUBLE AS share FROM cl)"


@query("q20_allocation", f"WITH {_AL} SELECT cluster_id, type, bucket, least(4, greatest(1, trunc(target * share)::BIGINT // count(*) OVER (PARTITION BY type, bucket)))::INT AS n_queries FROM cl JOIN tg USING (bucket) JOIN sh USING (type)")
def q20(spark, sf):
    clusters = table(spark, sf, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_mktsegment").alias("type"), F.when(F.col("c_acctbal") < 3000, "small").otherwise("large").alias("bucket"))
    targets = spark.createDataFrame([("small", 600), ("large", 900)], "bucket string, target int")
    return p.allocation(clusters, targets, clusters.select("type").distinct().withColumn("share", F.lit(0.2)))


@query("q21_k_profile", "WITH s AS (SELECT o_custkey AS cluster_id, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT * FROM (VALUES ('narrow', 2, 8), ('wide', 9, 20)) t(kind, lo, hi)) SELECT cluster_id, n, kind, round(greatest(0.0::DOUBLE, 1 - greatest(0, lo - n, n - hi)::DOUBLE / hi), 6) AS score FROM s, w")
def q21(spark, sf):
    sizes = passages(spark, sf).groupBy(F.col("entity").alias("cluster_id")).agg(F.count("*").alias("n"))
    return rounded(p.k_profile(sizes, [("narrow", 2, 8), ("wide", 9, 20)]))


TRIPLES = """triples AS (SELECT c_custkey AS entity, 'segment' AS property, c_mktsegment AS value, NULL AS year FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR, NULL FROM customer UNION ALL SELECT c_custkey, 'balance', c_acctbal::VARCHAR, NULL FROM customer UNION ALL SELECT o_custkey, 'priority', o_orderpriority, year(o_orderdate) FROM orders)"""


def triples(spark, sf):
    c = table(spark, sf, "customer")
    one = lambda name, col: c.select(F.col("c_custkey").alias("entity"), F.lit(name).alias("property"), F.col(col).cast("string").alias("value"), F.lit(None).cast("int").alias("year"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.lit("priority").alias("property"), F.col("o_orderpriority").alias("value"), F.year("o_orderdate").alias("year"))
    return one("segment", "c_mktsegment").union(one("nation", "c_nationkey")).union(one("balance", "c_acctbal")).union(orders)


@query("q22_entity_selection", f"WITH {TRIPLES} SELECT DISTINCT entity FROM triples t WHERE EXISTS (SELECT 1 FROM triples x WHERE x.entity = t.entity AND property = 'segment' AND value = 'HOUSEHOLD') AND EXISTS (SELECT 1 FROM triples x WHERE x.entity = t.entity AND property = 'priority') AND EXISTS (SELECT 1 FROM triples x WHERE x.entity = t.entity AND year BETWEEN 1995 AND 1997) AND EXISTS (SELECT 1 FROM triples x WHERE x.entity = t.entity AND property = 'balance' AND try_cast(value AS DOUBLE) >= 1000)")
def q22(spark, sf):
    return p.select_entities(triples(spark, sf), [("segment", "HOUSEHOLD")], ["priority"], (1995, 1997), ("balance", 1000.0))


@query("q22_top_by_property", f"WITH {TRIPLES}, e AS (SELECT DISTINCT entity FROM triples WHERE property = 'priority' AND year BETWEEN 1995 AND 1997), v AS (SELECT entity, max(TRY_CAST(value AS DOUBLE)) AS value FROM triples WHERE property = 'balance' AND entity IN (SELECT entity FROM e) GROUP BY ALL) SELECT entity, value FROM v WHERE value IS NOT NULL ORDER BY value DESC, entity LIMIT 25")
def q22t(spark, sf):
    t = triples(spark, sf)
    return p.top_by_property(t, "balance", 25, among=p.select_entities(t, [], ["priority"], (1995, 1997)))


@query("q22_article_coverage", f"WITH {TRIPLES}, e AS (SELECT DISTINCT entity FROM triples WHERE property = 'segment' AND value = 'BUILDING') SELECT count(*) AS n_entities, count(*) FILTER (entity IN (SELECT o_custkey FROM orders)) AS n_covered, round(count(*) FILTER (entity IN (SELECT o_custkey FROM orders))::DOUBLE / count(*), 6) AS coverage FROM e")
def q22c(spark, sf):
    return rounded(p.article_coverage(p.select_entities(triples(spark, sf), [("segment", "BUILDING")]), passages(spark, sf)))


_INDEX = """s AS (SELECT c_custkey AS cluster_id, c_mktsegment AS cluster_type, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
en AS (SELECT cluster_id, cluster_type, n, CASE WHEN n = 0 THEN []::BIGINT[] ELSE list_distinct([n // 2 + 1, n, 2 * n]) END AS ks, CASE WHEN n % 2 = 0 THEN ['even', 'any'] ELSE ['any'] END AS query_types, round(1 / (1 + abs(n - 10)::DOUBLE / 10), 6) AS suitability FROM s),
bk AS (SELECT DISTINCT cluster_id, cluster_type, n, query_types, suitability, CASE WHEN k <= 5 THEN '2-5' WHEN k <= 10 THEN '6-10' WHEN k <= 15 THEN '11-15' ELSE '16-20' END AS k_bucket FROM (SELECT *, unnest(ks) AS k FROM en) en)"""


def _cluster_index(spark, sf) -> str:
    """Customers as clusters of their orders, written as an index to the shared folder."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    sizes = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy(F.col("c_custkey").alias("cluster_id"), F.col("c_mktsegment").alias("cluster_type")).agg(F.count("o_orderkey").alias("n"))
    n = F.col("n")
    ks = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.array(F.expr("n div 2 + 1"), n, 2 * n)))
    kinds = F.when(n % 2 == 0, F.array(F.lit("even"), F.lit("any"))).otherwise(F.array(F.lit("any")))
    none = F.array().cast("array<string>")
    entries = sizes.select("cluster_id", "cluster_type", "n", ks.alias("ks"), kinds.alias("query_types"), none.alias("difficulties"), none.alias("domains"), F.round(1 / (1 + F.abs(n - 10) / 10), 6).alias("suitability"))
    return ci.write_index(entries, new_folder(spark, "clusters"))


@query("q21_index_search", f"WITH {_INDEX} SELECT DISTINCT cluster_id, cluster_type, n, suitability FROM bk WHERE k_bucket = '6-10' AND list_contains(query_types, 'even') AND cluster_type = 'BUILDING' AND suitability >= 0.5")
def q21s(spark, sf):
    return ci.find(spark, _cluster_index(spark, sf), k_bucket="6-10", query_type="even", cluster_type="BUILDING").select("cluster_id", "cluster_type", "n", "suitability")


@query("q21_index_statistics", f"WITH {_INDEX} SELECT 'k_bucket' AS dimension, k_bucket AS value, count(*) AS n_clusters FROM bk GROUP BY ALL UNION ALL SELECT 'cluster_type', cluster_type, count(*) FROM en GROUP BY ALL UNION ALL SELECT 'query_type', t, count(*) FROM (SELECT unnest(query_types) AS t FROM en) GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*) FROM en")
def q21t(spark, sf):
    return ci.statistics(spark, _cluster_index(spark, sf)).select("dimension", "value", "n_clusters")


@query("q23_intersections", f"WITH {TRIPLES}, v AS (SELECT DISTINCT entity, property, value FROM triples) SELECT a.value AS v1, b.value AS v2, c.value AS v3, count(DISTINCT a.entity) AS n FROM v a JOIN v b ON a.entity = b.entity AND b.property = 'nation' JOIN v c ON a.entity = c.entity AND c.property = 'priority' WHERE a.property = 'segment' GROUP BY ALL HAVING count(DISTINCT a.entity) BETWEEN 5 AND 50")
def q23(spark, sf):
    return p.intersections(triples(spark, sf), "segment", "nation", "priority")
