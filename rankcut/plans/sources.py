"""Web pages as documents, and round trips of data sets through files."""

from __future__ import annotations


from pyspark.sql import functions as F

from rankcut.operators import ir_metrics as m
from rankcut.plans import base as b
from rankcut.plans import retrieval as rt
from rankcut.plans.base import P, eval_sql
from rankcut.plans.registry import query, table
from rankcut.sources import readers, writers
from rankcut.sources.checkpoints import new_folder


_URL = "regexp_replace(url, '[?#].*$', '')"


@query("s5_unique_documents", f"SELECT md5({_URL}) AS doc_id, {_URL} AS url, md5(arg_min(html, page_id)) AS digest FROM pages WHERE trim(html) <> '' GROUP BY ALL")
def s5(spark, sf):
    """Pages as search results: an id is that of the address without what follows ? or #."""
    pages = table(spark, sf, "pages").withColumn("u", F.regexp_replace("url", "[?#].*$", ""))
    docs = pages.select("page_id", readers.result_id(F.col("u"), F.lit(None), F.lit(None)).alias("doc_id"), F.col("html").alias("text"), F.lit("").alias("title"), F.col("u").alias("url"))
    return readers.first_not_blank(docs, "page_id").select("doc_id", "url", F.md5("text").alias("digest"))


_NEST = "SELECT split_part(url, '/', 3) AS query_id, md5(url) AS doc_id FROM pages"


@query("s4_s6_s7_s8_nested_queries", f"WITH r AS ({_NEST}) SELECT DISTINCT query_id, doc_id FROM r")
def s7(spark, sf):
    """Pages of a host as its query's search results, written as nested JSON lines and read again."""
    result = F.struct(F.col("url").alias("page_url"), F.lit("").alias("page_name"), F.col("html").alias("page_snippet"), F.col("html").alias("page_result"))
    nested = table(spark, sf, "pages").groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("interaction_id")).agg(F.sort_array(F.collect_list(result)).alias("search_results"))
    path = new_folder(spark, "web-queries")
    nested.select("interaction_id", F.lit("?").alias("query"), F.lit("web").alias("domain"), "search_results").write.json(path)
    queries = readers.read_web_queries(spark, path)
    return readers.own_results(queries, readers.documents_of(queries, full_text=True))


@query("s6_s8_two_tasks", "WITH t AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS of_task FROM pages), u AS (SELECT url, of_task, page_id, html AS text FROM t UNION ALL SELECT 'http://all/' || page_id % 10, of_task, page_id, html FROM t) SELECT of_task, md5(url) AS doc_id, md5(arg_min(text, page_id)) AS digest FROM u WHERE trim(text) <> '' AND page_id % 3 <> 1 GROUP BY ALL")
def s8(spark, sf):
    """Pages by parity as files of two tasks, each as its own query with two results: by its address and by an address that
    both tasks have. One in three has a full text that is null, one none but the snippet."""
    pages = table(spark, sf, "pages")
    text = F.when(F.col("page_id") % 3 == 0, F.create_map(F.lit("page_result"), F.col("html"))).when(F.col("page_id") % 3 == 1, F.create_map(F.lit("page_result"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    result = lambda url: F.map_concat(F.create_map(F.lit("page_url"), url, F.lit("page_snippet"), F.col("html")), text)
    shared = F.concat(F.lit("http://all/"), (F.col("page_id") % 10).cast("string"))
    folder, tasks = new_folder(spark, "tasks"), {}
    for name, rest in (("even", 0), ("odd", 1)):
        own = pages.where(F.col("page_id") % 2 == rest)
        own.select(F.lpad(F.col("page_id").cast("string"), 20, "0").alias("query_id"), F.lit("?").alias("query"), F.array(result(F.col("url")), result(shared)).alias("search_results")).write.option("ignoreNullFields", False).json(f"{folder}/{name}")
        tasks[name] = [f"{folder}/{name}"]
    _, docs = readers.read_tasks(spark, tasks, full_text=True)
    return docs.select("of_task", "doc_id", F.md5("text").alias("digest"))


@query("s1_s2_s3_s12_csv_round_trip", f"WITH {b.S} SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, md5(text) AS digest FROM qr JOIN documents USING (doc_id)")
def s12(spark, sf):
    """Documents, query vectors' ids and their qrels as a CSV data set, read again and joined."""
    folder, docs = new_folder(spark, "dataset"), table(spark, sf, "documents").select("doc_id", "text")
    qrels, asked = b.qrels(spark, sf), b.queries(spark, sf).select("query_id", F.col("query_label").cast("string").alias("text"))
    writers.write_dataset(folder, docs, asked, qrels.withColumn("relevance", F.lit(1)), qrels.agg(F.count("*").alias("n_qrels")))
    read = readers.read_qrels(spark, f"{folder}/qrels.csv").join(readers.read_queries(spark, f"{folder}/queries.csv").select("query_id"), "query_id", "left_semi")
    return read.join(readers.read_corpus(spark, f"{folder}/corpus.csv"), "doc_id").select("query_id", "doc_id", F.md5("text").alias("digest"))


@query("s13_trec_round_trip", f"WITH {b.S} SELECT query_id, 0 AS iteration, doc_id AS passage_id, 1 AS relevance FROM qr")
def s13(spark, sf):
    folder = new_folder(spark, "trec")
    qrels = b.qrels(spark, sf).select("query_id", F.col("doc_id").alias("passage_id"), F.lit(1).alias("relevance"))
    writers.write_trec(folder, b.corpus(spark, sf).select(F.col("doc_id").alias("passage_id"), "label"), b.queries(spark, sf).select("query_id"), qrels)
    return spark.read.schema("query_id bigint, iteration int, passage_id bigint, relevance int").csv(f"{folder}/qrels.tsv", sep="\t")


@query("s14_s15_stored_results", f"WITH {P}, top AS (SELECT * FROM p WHERE rank <= 10), {eval_sql('e', 'top')} SELECT query_id, k, hit_rate FROM e")
def s14(spark, sf):
    folder, rows = new_folder(spark, "results"), rt.fixed_rows(spark, sf)
    kept = writers.store(rows, f"{folder}-rows")
    writers.write_results(folder, m.overall(kept), kept, m.by_bucket(kept, "query_label", ["recall"]))
    return spark.read.parquet(f"{folder}/per_query").select("query_id", "k", "hit_rate")


@query(
    "s9_s10_s11_entity_passages",
    """WITH e AS (SELECT DISTINCT o_custkey AS qid, o_custkey // 10 AS cluster_id FROM orders JOIN customer ON c_custkey = o_custkey), big AS (SELECT cluster_id FROM e GROUP BY ALL HAVING count(*) >= 2)
SELECT o_orderkey::VARCHAR AS passage_id, o_custkey::VARCHAR AS entity_qid, c_name AS entity_label, (o_custkey // 10)::VARCHAR AS cluster_id, o_orderpriority AS text FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey // 10 IN (SELECT cluster_id FROM big)""",
)
def s9(spark, sf):
    """Ten customers are a cluster, their orders the passages of their articles: written nested, read flat, and written and
    read again as clean records."""
    text = lambda c: F.col(c).cast("string")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.struct(text("o_orderkey").alias("passage_id"), F.col("o_orderpriority").alias("text"), F.lit("Lead").alias("section")).alias("p"))
    articles = orders.groupBy("c_custkey").agg(F.sort_array(F.collect_list("p")).alias("passages"))
    people = table(spark, sf, "customer").join(articles, "c_custkey", "left").withColumn("cluster_id", F.expr("string(c_custkey div 10)"))
    article = F.when(F.col("passages").isNotNull(), F.struct(text("c_custkey").alias("qid"), "passages"))
    nested = people.groupBy("cluster_id").agg(F.collect_list(F.struct(text("c_custkey").alias("qid"), F.col("c_name").alias("label"))).alias("entities"), F.collect_list(article).alias("articles"))
    path = new_folder(spark, "clusters")
    nested.write.json(path)
    passages, _ = readers.read_entity_passages(spark, path)
    writers.write_passages(f"{path}-passages", passages)
    return spark.read.schema("passage_id string, entity_qid string, entity_label string, cluster_id string, text string").json(f"{path}-passages")
