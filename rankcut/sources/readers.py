"""Readers of queries, qrels, corpora, nested web queries, entity passages, and what is derived from them on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.MapType(T.StringType(), T.StringType())  # page_url, page_name, page_snippet, page_result: a missing key isn't a null
WEB_QUERY = T.StructType([T.StructField(c, T.StringType()) for c in ("interaction_id", "query_id", "query", "answer", "domain")] + [T.StructField("search_results", T.ArrayType(RESULT))])
ARTICLES = "cluster_id string, entities array<struct<qid:string,label:string>>, articles array<struct<qid:string,passages:array<struct<passage_id:string,text:string,section:string>>>>"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quoted fields may hold line breaks and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """queries.csv: query_id, text, and all other columns in a map."""
    df = _csv(spark, path)
    extra = [c for c in df.columns if c not in ("query_id", "text")]
    metadata = F.create_map(*(x for c in extra for x in (F.lit(c), F.col(f"`{c}`")))) if extra else F.create_map().cast("map<string,string>")
    return df.select("query_id", "text", metadata.alias("metadata"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qrels.csv: pairs with a relevance above 0, each once."""
    return _csv(spark, path).where(F.col("relevance").try_cast("int") > 0).select("query_id", "doc_id").dropDuplicates()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """corpus.csv; of rows with the same doc_id the last one. The place is that of the file and within it."""
    df = _csv(spark, path)
    placed = df.withColumns({"_f": F.input_file_name(), "_p": F.monotonically_increasing_id()})
    others = [c for c in df.columns if c != "doc_id"]
    last = placed.groupBy("doc_id").agg(F.max_by(F.struct(*others), F.struct("_f", "_p")).alias("_r"))
    return last.select("doc_id", *(F.col(f"_r.`{c}`").alias(c) for c in others))


def read_web_queries(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines (also bz2) of nested queries; blank and malformed lines are skipped, missing fields get defaults. Several
    files are appended, nothing is deduplicated between them."""
    schema = T.StructType([*WEB_QUERY.fields, T.StructField("_bad", T.StringType())])
    out = None
    for path in paths:
        raw = spark.read.schema(schema).json(path, columnNameOfCorruptRecord="_bad", mode="PERMISSIVE")
        good = raw.where("_bad is null and (query is not null or interaction_id is not null or query_id is not null)")
        one = good.select(F.coalesce("interaction_id", "query_id", F.lit("")).alias("query_id"), F.coalesce("query", F.lit("")).alias("query"), "answer", F.coalesce("search_results", F.array().cast(T.ArrayType(RESULT))).alias("search_results"), F.coalesce("domain", F.lit("")).alias("task"))
        out = one if out is None else out.unionByName(one)
    return out


def result_id(url: Column, snippet: Column, name: Column) -> Column:
    """md5 of the address, or of snippet and name where there is none."""
    given = F.trim(F.coalesce(url, F.lit(""))) != ""
    return F.when(given, F.md5(url)).otherwise(F.md5(F.concat(F.coalesce(snippet, F.lit("")), F.coalesce(name, F.lit("")))))


def documents_of(queries: DataFrame, full_text: bool = False, order: str = "query_id") -> DataFrame:
    """Unique documents of all search results; of each id the first result whose text isn't blank, by query and place. The full
    text is page_result where a result has that key, though it be null, else the snippet."""
    rows = queries.select(F.col(order).alias("_o"), F.posexplode("search_results").alias("_p", "r"))
    full = F.when(F.map_contains_key("r", "page_result"), F.col("r.page_result")).otherwise(F.col("r.page_snippet"))
    text = full if full_text else F.col("r.page_snippet")
    docs = rows.select("_o", "_p", result_id(F.col("r.page_url"), F.col("r.page_snippet"), F.col("r.page_name")).alias("doc_id"), text.alias("text"), F.col("r.page_name").alias("title"), F.col("r.page_url").alias("url"))
    return first_not_blank(docs, "_o", "_p")


def read_tasks(spark: SparkSession, tasks: dict[str, list[str]], full_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files of several tasks by the task's name -> queries and documents with the task: documents are unique within a
    task, nothing is deduplicated between tasks."""
    queries, docs = None, None
    for name, paths in tasks.items():
        q = read_web_queries(spark, *paths)
        d = documents_of(q, full_text).withColumn("of_task", F.lit(name))
        q = q.withColumn("of_task", F.lit(name))
        queries, docs = (q, d) if queries is None else (queries.unionByName(q), docs.unionByName(d))
    return queries, docs


def first_not_blank(docs: DataFrame, *order: str) -> DataFrame:
    """docs(doc_id, text, title, url) once each: the first whose text isn't blank; a blank one claims no id."""
    first = docs.where("trim(coalesce(text, '')) <> ''").groupBy("doc_id").agg(F.min_by(F.struct("text", "title", "url"), F.struct(*order)).alias("r"))
    return first.select("doc_id", "r.*")


def own_results(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Relevant to a query are its own search results, as far as they are documents: (query_id, doc_id)."""
    rows = queries.select("query_id", F.explode("search_results").alias("r"))
    pairs = rows.select("query_id", result_id(F.col("r.page_url"), F.col("r.page_snippet"), F.col("r.page_name")).alias("doc_id")).distinct()
    return pairs.join(documents.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id")


def read_entity_passages(spark: SparkSession, path: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Clusters with entities and articles -> passages(passage_id, entity_qid, entity_label, cluster_id, text, section) and
    members(cluster_id, qid, label): only entities with passages, only clusters with at least two of them."""
    raw = spark.read.schema(ARTICLES).json(path)
    entities = raw.select("cluster_id", F.explode("entities").alias("e")).select("cluster_id", "e.qid", "e.label")
    articles = raw.select("cluster_id", F.explode("articles").alias("a")).select("cluster_id", "a.qid", F.explode("a.passages").alias("p"))
    members = entities.join(articles.select("cluster_id", "qid").distinct(), ["cluster_id", "qid"], "left_semi")
    large = members.groupBy("cluster_id").agg(F.count_distinct("qid").alias("n")).where(F.col("n") >= least).select("cluster_id")
    members = members.join(large, "cluster_id", "left_semi")
    passages = articles.join(members, ["cluster_id", "qid"]).select("p.passage_id", F.col("qid").alias("entity_qid"), F.col("label").alias("entity_label"), "cluster_id", "p.text", "p.section")
    return passages, members


def _places(rows: DataFrame) -> DataFrame:
    """rows with place: their number from 1 in order of _file, _block (where the piece of the file that was read begins) and
    _row (rising within a piece). Rows are numbered within pieces, and a piece adds how many rows lie before it; only these
    counts, one for each piece, come together."""
    inside = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_row")))
    counts = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.join(counts.select("_file", "_block", before.alias("_before")), ["_file", "_block"]).withColumn("place", F.col("_before") + F.col("_nth")).drop("_nth", "_before")


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages from JSON lines (.jsonl), a JSON list or an object with a list `passages`; one without id gets p_n, n its
    place in the file, counted from 1 over all passages; blank lines don't count. JSON lines are read in pieces by many
    tasks; a file that is one JSON value is read by one. Several files are numbered on in order of their paths."""
    one = "passage_id string, entity string, text string"
    where = [F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")]
    if path.endswith(".json"):
        raw = spark.read.schema(f"{one}, passages array<struct<passage_id:string,entity:string,text:string>>").json(path, multiLine=True)
        raw = raw.select(F.coalesce("passages", F.array(F.struct("passage_id", "entity", "text"))).alias("ps"), *where)
        rows = raw.select(F.posexplode("ps").alias("_at", "p"), "_file", F.lit(0).cast("long").alias("_block"), F.struct("_row", "_at").alias("_row"))
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), *where).where("trim(value) <> ''")
        rows = lines.select(F.from_json("value", one, {"mode": "FAILFAST"}).alias("p"), "_file", "_block", "_row")
    return _places(rows).select(F.coalesce("p.passage_id", F.concat(F.lit("p_"), F.col("place").cast("string"))).alias("passage_id"), "p.entity", "p.text")
