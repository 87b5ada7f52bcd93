"""Text functions, chunks, contexts and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankcut.functions import text as t
from rankcut.operators import answers as a
from rankcut.operators import chunking as ch
from rankcut.plans import base as b
from rankcut.plans import retrieval as rt
from rankcut.plans.base import rounded
from rankcut.plans.registry import query, table
from rankcut.plans.retrieval import _FX


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _words(x: str) -> str:
    return f"list_filter(string_split_regex(trim(coalesce({x}, '')), '\\s+'), lambda w: w <> '')"


def _title(x: str, n: int = 100) -> str:
    return f"trim(substring(CASE WHEN strpos({x}, '. ') > 1 THEN split_part({x}, '. ', 1) ELSE {x} END, 1, {n}))"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


_PUNCT = t.PUNCTUATION.replace("'", "''")


def _answer_list(x: str) -> str:
    return f"list_filter(string_split_regex(translate(lower({x}), '{_PUNCT}', ''), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@query("t1_parse_price", r"SELECT doc_id, CASE WHEN v > 0 AND v <= 100000 THEN v END AS price FROM (SELECT doc_id, try_cast(replace(regexp_extract(text, '\$?([\d,]+(?:\.\d{1,2})?)', 1), ',', '') AS DOUBLE) AS v FROM documents)")
def t1(spark, sf):
    return _docs(spark, sf).select("doc_id", t.parse_price(F.col("text")).alias("price"))


@query("t2_content_filter", f"SELECT doc_id, trim({_title('text')}) <> '' AND len({_words(_title('text') + chr(32) + '|| chr(32) || text')}) >= 30 AS passes FROM documents")
def t2(spark, sf):
    return _docs(spark, sf).select("doc_id", t.passes_content(t.title_of(F.col("text")), F.array("text"), F.array().cast("array<string>")).alias("passes"))


@query("t3_document_text", "SELECT p_partkey, trim(p_name || '. ' || p_brand || ' ' || p_type || ' ' || 'size ' || p_size) || printf(' Price: $%.2f.', p_retailprice) AS text FROM part")
def t3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.document_text(F.col("p_name"), F.array("p_brand", "p_type"), F.array(F.concat(F.lit("size "), F.col("p_size").cast("string"))), F.col("p_retailprice")).alias("text"))


@query("t4_category_path", "SELECT p_partkey, p_brand || ' > ' || p_type AS level_1, p_brand || ' > ' || p_type || ' > ' || p_size AS level_2, NULL::VARCHAR AS level_3 FROM part")
def t4(spark, sf):
    c = F.array("p_brand", "p_type", F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", *(t.category_path(c, n).alias(f"level_{n}") for n in (1, 2, 3)))


@query("t5_stable_ids", "SELECT p_partkey, substr(md5(p_partkey::VARCHAR), 1, 12) AS doc_id, 'q_' || substr(regexp_replace(regexp_replace(lower(p_brand || ' > ' || p_type), ' > | ', '_', 'g'), '[^a-z0-9_]', '', 'g'), 1, 70) || '_above' AS query_id FROM part")
def t5(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.short_id(F.col("p_partkey")).alias("doc_id"), t.query_slug(F.concat_ws(" > ", "p_brand", "p_type"), suffix=F.lit("above")).alias("query_id"))


@query("t6_titles", f"SELECT doc_id, {_title('text')} AS title, {_title('text', 50)} AS short_title FROM documents")
def t6(spark, sf):
    return _docs(spark, sf).select("doc_id", t.title_of(F.col("text")).alias("title"), t.title_of(F.col("text"), 50).alias("short_title"))


@query("t7_without_controls", r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS digest FROM documents")
def t7(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.without_controls(F.col("text"))).alias("digest"))


@query("t8_normal_titles", f"SELECT doc_id, md5({_normal('text')}) AS digest FROM documents")
def t8(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.normal_title(F.col("text"))).alias("digest"))


@query("t9_normal_answers", f"SELECT conv_id, turn, array_to_string({_answer_list('text')}, ' ') AS answer FROM conversations")
def t9(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", t.normal_answer(F.col("text")).alias("answer"))


@query("t10_split_titles", f"SELECT doc_id, len(list_filter(list_transform(string_split(text, ','), lambda x: {_normal('x')}), lambda x: x <> '')) AS n, md5(array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: {_normal('x')}), lambda x: x <> ''), '|')) AS digest FROM documents")
def t10(spark, sf):
    titles = t.split_titles(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(titles).alias("n"), F.md5(F.array_join(titles, "|")).alias("digest"))


@query("t11_query_flags", rf"SELECT doc_id, len({_words('text')}) AS n_words, regexp_matches(text, '[0-9]') AS has_digit, regexp_matches(text, '(?i)\$|price|under|over|less than|more than|cheap|expensive') AS has_price_term FROM documents")
def t11(spark, sf):
    return _docs(spark, sf).select("doc_id", *(x.alias(n) for n, x in t.query_flags(F.col("text")).items()))


_KB = [("small", 1, 10), ("medium", 11, 30), ("large", 31, 45)]


@query("t12_k_ranges", "SELECT p_partkey, CASE WHEN p_size <= 5 THEN '2-5' WHEN p_size <= 10 THEN '6-10' WHEN p_size <= 15 THEN '11-15' ELSE '16-20' END AS k_range, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'medium' WHEN p_size BETWEEN 31 AND 45 THEN 'large' END AS bucket FROM part")
def t12(spark, sf):
    k = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", t.k_range(k).alias("k_range"), t.bucket_of(k, _KB).alias("bucket"))


_TEMPLATES = ["Products in %1$s priced %2$s $%3$.2f", "Which %1$s cost %2$s $%3$.2f?", "Show me %1$s %2$s $%3$.2f"]


@query(
    "t13_templated_questions",
    """WITH g AS (SELECT p_brand || ' > ' || p_type AS category, round(min(p_retailprice), 2) AS threshold FROM part GROUP BY ALL), n AS (SELECT *, (row_number() OVER (ORDER BY category) - 1) % 3 AS i FROM g)
SELECT category, CASE i WHEN 0 THEN printf('Products in %s priced %s $%.2f', category, 'above', threshold) WHEN 1 THEN printf('Which %s cost %s $%.2f?', category, 'above', threshold) ELSE printf('Show me %s %s $%.2f', category, 'above', threshold) END AS question FROM n""",
)
def t13(spark, sf):
    # a row for each category: the only window over all of them is on this small table
    g = table(spark, sf, "part").groupBy(F.concat_ws(" > ", "p_brand", "p_type").alias("category")).agg(F.round(F.min("p_retailprice"), 2).alias("threshold"))
    nth = F.row_number().over(Window.orderBy("category")) - 1
    return g.withColumn("nth", nth).select("category", t.price_question(F.col("category"), F.lit("above"), F.col("threshold"), _TEMPLATES, F.col("nth")).alias("question"))


@query(
    "t14_json_from_output",
    r"""WITH r AS (SELECT conv_id, turn, 'Sure. ```json' || chr(10) || '{"query": "' || regexp_replace(text, '[^a-zA-Z ]', ' ', 'g') || '?"}' || chr(10) || '```' AS raw FROM conversations),
j AS (SELECT conv_id, turn, json_extract_string(regexp_extract(raw, '(?s)```json\s*(\{.*?\})\s*```', 1), '$.query') AS question FROM r), w AS (SELECT *, len(list_filter(string_split_regex(trim(question), '\s+'), lambda w: w <> '')) AS n FROM j)
SELECT conv_id, turn, question, (CASE WHEN n < 10 OR n > 60 THEN 'length' ELSE '' END) AS errors FROM w""",
)
def t14(spark, sf):
    raw = F.concat(F.lit('Sure. ```json\n{"query": "'), F.regexp_replace("text", "[^a-zA-Z ]", " "), F.lit('?"}\n```'))
    q = t.json_of(raw, "query string")["query"]
    return table(spark, sf, "conversations").select("conv_id", "turn", q.alias("question"), F.array_join(t.question_errors(q), ",").alias("errors"))


def _hits(spark, sf):
    """Documents of each language by id, every one moved on by one, so that the last is missing."""
    docs = _docs(spark, sf).select(F.col("lang").alias("query_id"), (F.col("doc_id") + 1).alias("doc_id"))
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))


@query(
    "t15_t16_context_blocks",
    f"""WITH h AS (SELECT lang AS query_id, doc_id + 1 AS doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents),
e AS (SELECT query_id, rank, '[' || rank || '] ' || coalesce(text, '[Document ' || h.doc_id || ' not found]') AS entry FROM h LEFT JOIN documents USING (doc_id)),
s AS (SELECT *, sum(len({_words('entry')})) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM e)
SELECT query_id, count(*) AS n_docs, md5(string_agg(entry, chr(10) || chr(10) ORDER BY rank)) AS digest FROM s WHERE used <= 5000 GROUP BY query_id""",
)
def t15(spark, sf):
    return a.context_blocks(_hits(spark, sf), _docs(spark, sf), 5000).select("query_id", "n_docs", F.md5("context").alias("digest"))


_DOMAINS = {"legal": ["licen", "copyright"], "contact": ["@", "phone"], "web": ["http", "www."]}


@query("t17_domain_tags", "WITH x AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(text), 'licen|copyright') THEN 'legal' END, CASE WHEN regexp_matches(lower(text), '@|phone') THEN 'contact' END, CASE WHEN regexp_matches(lower(text), 'http|www\\.') THEN 'web' END], lambda x: x IS NOT NULL) AS tags FROM documents) SELECT doc_id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ',') ELSE 'general' END AS tags FROM x")
def t17(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(t.domain_tags(F.col("text"), _DOMAINS, "general"), ",").alias("tags"))


# chunks

_C1 = """c AS (SELECT doc_id, text, length(text) AS n, i FROM documents, LATERAL (SELECT unnest(range(0, greatest(ceil((length(text) - 1024) / 824.0)::INT, 0) + 1)) AS i) WHERE trim(text) <> ''),
c1 AS (SELECT doc_id || '_chunk_' || i AS chunk_id, doc_id::VARCHAR AS parent_doc_id, substring(text, i * 824 + 1, 1024) AS text, i::INT AS chunk_index, (i * 824)::INT AS start_char, least(i * 824 + 1024, n)::INT AS end_char FROM c)"""


@query("c1_fixed_chunks", f"WITH {_C1} SELECT chunk_id, parent_doc_id, md5(text) AS digest, chunk_index, start_char, end_char FROM c1")
def c1(spark, sf):
    return ch.fixed_chunks(_docs(spark, sf), 256, 50).withColumn("digest", F.md5("text")).drop("text")


@query("c2_sentence_chunks")
def c2(spark, sf):
    return ch.sentence_chunks(_docs(spark, sf), 256, 50).withColumn("digest", F.md5("text")).drop("text")


@query("c3_recursive_chunks")
def c3(spark, sf):
    return ch.recursive_chunks(_docs(spark, sf), 256, 50).withColumn("digest", F.md5("text")).drop("text")


@query("c7_chunked_corpus")
def c7(spark, sf):
    return ch.chunk_corpus(_docs(spark, sf), 256, 50).withColumn("digest", F.md5("text")).drop("text")


@query("c4_c5_section_passages")
def c5(spark, sf):
    return ch.passages(_docs(spark, sf)).withColumn("digest", F.md5("text")).drop("text")


@query("c6_chunk_statistics", f"WITH {_C1}, g AS (SELECT parent_doc_id, count(*) AS n FROM c1 GROUP BY ALL) SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_chunks, round(avg(n), 6) AS mean_chunks, min(n) AS min_chunks, max(n) AS max_chunks FROM g")
def c6(spark, sf):
    return rounded(ch.chunk_statistics(ch.fixed_chunks(_docs(spark, sf), 256, 50)))


# answers: a turn against the next one of its conversation

_PAIRS = "pairs AS (SELECT x.conv_id || ':' || x.turn AS key, x.text AS gen, y.text AS gold FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)"


def _pairs(spark, sf):
    x = table(spark, sf, "conversations")
    y = x.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return x.join(y, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("text").alias("gen"), "gold")


def _prf(o: str, n: str, m: str) -> str:
    f = f"CASE WHEN {n} = 0 AND {m} = 0 THEN 1.0 WHEN {o} = 0 THEN 0.0 ELSE {{}} END"
    p, r = f"{o}::DOUBLE / {n}", f"{o}::DOUBLE / {m}"
    return f"round({f.format(p)}, 6) AS \"precision\", round({f.format(r)}, 6) AS recall, round({f.format(f'2 * ({p}) * ({r}) / (({p}) + ({r}))')}, 6) AS f1"


@query("a1_exact_match", f"WITH {_PAIRS} SELECT key, CASE WHEN array_to_string({_answer_list('gen')}, ' ') = array_to_string({_answer_list('gold')}, ' ') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match FROM pairs")
def a1(spark, sf):
    return _pairs(spark, sf).select("key", a.exact_match(F.col("gen"), F.col("gold")).alias("exact_match"))


@query(
    "a2_token_f1",
    f"""WITH {_PAIRS}, tk AS (SELECT key, {_answer_list('gen')} AS x, {_answer_list('gold')} AS y FROM pairs), ux AS (SELECT key, unnest(x) AS w FROM tk), uy AS (SELECT key, unnest(y) AS w FROM tk),
o AS (SELECT key, sum(least(c, d)) AS o FROM (SELECT key, w, count(*) AS c FROM ux GROUP BY ALL) JOIN (SELECT key, w, count(*) AS d FROM uy GROUP BY ALL) USING (key, w) GROUP BY key)
SELECT key, {_prf('coalesce(o, 0)', 'len(x)', 'len(y)')} FROM tk LEFT JOIN o USING (key)""",
)
def a2(spark, sf):
    return rounded(a.token_overlap(_pairs(spark, sf), "key", "gen", "gold").select("key", "precision", "recall", "f1"))


@query(
    "a2_token_overlap_of_documents",
    f"""WITH pr AS (SELECT x.doc_id, x.text AS gen, y.text AS gold FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1), tk AS (SELECT doc_id, {_answer_list('gen')} AS x, {_answer_list('gold')} AS y FROM pr), ux AS (SELECT doc_id, unnest(x) AS w FROM tk), uy AS (SELECT doc_id, unnest(y) AS w FROM tk),
o AS (SELECT doc_id, sum(least(c, d)) AS o FROM (SELECT doc_id, w, count(*) AS c FROM ux GROUP BY ALL) JOIN (SELECT doc_id, w, count(*) AS d FROM uy GROUP BY ALL) USING (doc_id, w) GROUP BY doc_id)
SELECT doc_id, len(x) AS n_generated, len(y) AS n_gold, coalesce(o, 0)::BIGINT AS overlap, {_prf('coalesce(o, 0)', 'len(x)', 'len(y)')} FROM tk LEFT JOIN o USING (doc_id)""",
)
def a2d(spark, sf):
    d = _docs(spark, sf)
    pairs = d.select("doc_id", F.col("text").alias("gen")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("gold")), "doc_id")
    return rounded(a.token_overlap(pairs, "doc_id", "gen", "gold"))


def _titles(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split({x}, ','), lambda x: {_normal('x')}), lambda x: x <> ''))"


@query("a3_title_f1", f"WITH {_PAIRS}, tt AS (SELECT key, {_titles('gen')} AS x, {_titles('gold')} AS y FROM pairs) SELECT key, {_prf('len(list_intersect(x, y))', 'len(x)', 'len(y)')} FROM tt")
def a3(spark, sf):
    return rounded(_pairs(spark, sf).select("key", a.title_f1(F.col("gen"), F.col("gold")).alias("m")).select("key", "m.*"))


@query("a4_token_set_ratio", f"WITH {_PAIRS}, s AS (SELECT key, list_distinct({_words('gen')}) AS x, list_distinct({_words('gold')}) AS y FROM pairs), n AS (SELECT key, len(list_intersect(x, y))::DOUBLE AS c, len(x) AS a, len(y) AS b FROM s) SELECT key, round(CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE greatest(2 * c / (c + a), 2 * c / (c + b), 2 * c / (a + b)) END, 6) AS ratio FROM n")
def a4(spark, sf):
    return rounded(_pairs(spark, sf).select("key", a.token_set_ratio(F.col("gen"), F.col("gold")).alias("ratio")))


@query("a5_fuzzy_title_f1")
def a5(spark, sf):
    return rounded(_pairs(spark, sf).select("key", a.fuzzy_title_f1(F.col("gen"), F.col("gold")).alias("m")).select("key", "m.*"))


@query("a6_end_to_end_rows")
def a6(spark, sf):
    return rounded(a.answer_metrics(_pairs(spark, sf), "key", "gen", "gold").drop("title_ratio"))


_A6 = f"""{_FX}, an AS (SELECT query_id, coalesce(x.text, '') AS gen, coalesce(y.text, '') AS gold FROM q JOIN documents x ON x.doc_id = query_id JOIN documents y ON y.doc_id = query_id + 1),
w AS (SELECT query_id, list_distinct({_words('gen')}) AS u, list_distinct({_words('gold')}) AS v, {_titles('gen')} AS x, {_titles('gold')} AS y, CASE WHEN array_to_string({_answer_list('gen')}, ' ') = array_to_string({_answer_list('gold')}, ' ') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match FROM an),
n AS (SELECT *, len(list_intersect(u, v))::DOUBLE AS c, len(u) AS nu, len(v) AS nv FROM w),
am AS (SELECT query_id, exact_match, round(CASE WHEN nu = 0 AND nv = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE greatest(2 * c / (c + nu), 2 * c / (c + nv), 2 * c / (nu + nv)) END, 6) AS title_ratio, {_prf('len(list_intersect(x, y))', 'len(x)', 'len(y)').replace('AS "precision"', 'AS title_precision').replace('AS recall', 'AS title_recall').replace('AS f1', 'AS title_f1')} FROM n),
js AS (SELECT doc_id AS query_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels)"""


@query("a6_rows_with_retrieval", f"""WITH {_A6} SELECT am.*, k, n_relevant, round(recall, 6) AS recall, round("precision", 6) AS "precision", round(ndcg, 6) AS ndcg, quality AS judged_quality, toxic AS judged_toxic FROM am JOIN e USING (query_id) LEFT JOIN js USING (query_id)""")
def a6r(spark, sf):
    """A query's document answers, the next one is gold; labels are what the judge says. Fuzzy titles and tokens have
    queries of their own."""
    d = _docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gold = d.select((F.col("doc_id") - 1).alias("query_id"), F.col("text").alias("gold"))
    answers = d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("generated")).join(gold, "query_id").join(b.queries(spark, sf).select("query_id"), "query_id", "left_semi")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), F.lit("labels").alias("judge"), F.inline(F.array(*(F.struct(F.lit(x).alias("aspect"), F.col(x).cast("double").alias("score")) for x in ("quality", "toxic")))))
    rows = a.end_to_end(answers, rt.fixed_rows(spark, sf), labels)
    said = [F.col("judge_scores")["labels"][x].alias(f"judged_{x}") for x in ("quality", "toxic")]
    return rounded(rows.select("query_id", "exact_match", "title_ratio", "title_precision", "title_recall", "title_f1", "k", "n_relevant", "recall", "precision", "ndcg", *said))


@query("a7_answer_summary", f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(CASE WHEN array_to_string({_answer_list('gen')}, ' ') = array_to_string({_answer_list('gold')}, ' ') THEN 1.0 ELSE 0.0 END), 6) AS mean_exact_match, round(coalesce(avg(CASE WHEN length(gen) % 3 = 0 THEN length(gen) % 5 END), 0), 6) AS mean_rating FROM pairs")
def a7(spark, sf):
    rows = _pairs(spark, sf).withColumn("exact_match", a.exact_match(F.col("gen"), F.col("gold")))
    rating = F.when(F.length("gen") % 3 == 0, F.length("gen") % 5)  # a rating that only some rows have
    return rounded(a.answer_summary(rows, ["exact_match"], {"rating": rating}))


@query(
    "a8_gold_answers",
    f"""WITH qs AS (SELECT DISTINCT source AS query_id FROM documents), g AS (SELECT source AS query_id, md5(string_agg({_title('text')}, ', ' ORDER BY doc_id)) AS digest FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY ALL)
SELECT query_id, coalesce(digest, md5('No relevant documents found')) AS digest FROM qs LEFT JOIN g USING (query_id)""",
)
def a8(spark, sf):
    docs = _docs(spark, sf)
    qrels = docs.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id").select(F.col("source").alias("query_id"), "doc_id")
    gold = a.gold_answers(docs.select(F.col("source").alias("query_id")).distinct(), qrels, docs)
    return gold.select("query_id", F.md5("gold_answer").alias("digest"))
