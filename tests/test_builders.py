"""Text, chunks, answers, passages and catalogue on small literal inputs."""

import re

import pytest
from pyspark.sql import functions as F

from rankcut.functions import text as t
from rankcut.operators import answers as a
from rankcut.operators import catalog as k
from rankcut.operators import chunking as ch
from rankcut.operators import passages as p
from rankcut.sources import readers, writers


def test_prices(spark):
    df = spark.createDataFrame([("$1,299.99",), ("from 12.5 up",), ("none",), ("0",), ("999999",), (None,)], "raw string")
    assert [x[0] for x in df.select(t.parse_price(F.col("raw"))).collect()] == [1299.99, 12.5, None, None, None, None]


def test_titles_and_answers(spark):
    df = spark.createDataFrame([("Title One. Rest", ), (". starts", ), ("no end",)], "x string")
    assert [x[0] for x in df.select(t.title_of(F.col("x"))).collect()] == ["Title One", ". starts", "no end"]
    pairs = spark.createDataFrame([("a", "The cat, the cat sat", "cat sat down"), ("b", "", ""), ("c", "x", "")], "key string, gen string, gold string")
    got = {x.key: x.f1 for x in a.token_overlap(pairs, "key", "gen", "gold").collect()}
    assert got["a"] == pytest.approx(2 / 3) and got["b"] == 1 and got["c"] == 0
    assert a.matched_titles(["red car", "red car"], ["red car"], 0.8) == 1


def test_fixed_chunks_stop_at_the_end_or_a_blank_one(spark):
    df = spark.createDataFrame([("a", "x" * 100), ("b", "   "), ("c", "y" * 40 + " " * 200), ("d", None)], "doc_id string, text string")
    got = [(x.parent_doc_id, x.start_char, x.end_char) for x in ch.fixed_chunks(df, 10, 2).orderBy("parent_doc_id", "chunk_index").collect()]
    assert got == [("a", 0, 40), ("a", 32, 72), ("a", 64, 100), ("c", 0, 40), ("c", 32, 72)]


def test_chunkers_cover_their_text():
    text = " ".join(f"Word{i} ends here." for i in range(200))
    for chunks in (ch.pack_sentences(text, 40, 10), ch.passages_of(text, 300, 50)):
        assert all(text[x:y].strip() for _, x, y in chunks) and chunks[0][1] == 0 and chunks[-1][2] == len(text)
        assert all(b[1] <= a[2] + 1 and b[1] > a[1] for a, b in zip(chunks, chunks[1:], strict=False))
    assert all(sum(len(w) // 4 for w in re.split(r"\. |[ \n]", x)) <= 40 for x in ch.split_by(text, 40, 10, 0))
    # parts of 2, 1 and 3 tokens: empty ones go, sizes add up, the last part comes again if it is short enough
    assert ch.split_by("eightchr\n\n\n\nfour\n\ntwelve chars", 4, 1, 0) == ["eightchr\n\nfour", "four\n\ntwelve chars"]
    assert ch.split_by("eightchr\n\nfour\n\ntwelve chars", 4, 0, 0) == ["eightchr\n\nfour", "twelve chars"]
    assert ch.split_by("x" * 40, 4, 0, 0) == ["x" * 40]
    assert ch.sections_of("a\n== T ==\nb\n=== U ===\nc") == [("Lead", 0, "a"), ("T", 1, "b"), ("U", 2, "c")]


def test_passage_mapping(spark):
    asked = spark.createDataFrame([(1, "Q1"), (1, "Q2"), (1, "Q3")], "query_id int, entity string")
    passages = spark.createDataFrame([("p1", "Q1", "x"), ("p2", "Q1", "y"), ("p3", "Q2", "z")], "passage_id string, entity string, text string")
    m = p.map_queries(asked, passages)
    assert sorted((x.passage_id, x.relevance) for x in m.where("passage_id is not null").collect()) == [("p1", 1.0), ("p2", 0.8), ("p3", 1.0)]
    assert p.coverage(m).first().coverage == pytest.approx(2 / 3)
    checked = p.k_validation(spark.createDataFrame([(1, 5, 5, 1.0), (2, 5, 4, 0.8), (3, 5, 1, 0.2)], "query_id int, target_k int, actual_k int, coverage double"))
    assert [(x.difference, x.accepted) for x in checked.orderBy("query_id").collect()] == [("exact", True), ("close", True), ("moderate", False)]
    ten = spark.createDataFrame([(f"p{i}",) for i in range(10)], "passage_id string")
    kinds = [x.kind for x in p.assembled(ten, ten.limit(2), 0.2).collect()]
    assert (kinds.count("relevant"), kinds.count("hard"), kinds.count("random")) == (2, 1, 7)


def test_diverse_keeps_in_order(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta theta", "something else entirely different here", "", ""]
    got = {x.pos: x.kept for x in p.diverse(spark.createDataFrame(list(enumerate(texts)), "pos long, text string")).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False}


def test_thresholds(spark):
    items = spark.createDataFrame([("c", float(x)) for x in (10, 20, 30, 40, 50)], "category string, price double")
    got = k.thresholds_for(items, [("two", 2, 2), ("many", 9, 12)]).collect()
    assert [(x.bucket, x.direction, x.k, x.threshold) for x in got] == [("two", "above", 2, 35.0)]


def test_splits_keep_groups_whole(spark):
    rows = spark.createDataFrame([(i, i % 20) for i in range(200)], "id int, g int")
    s = p.split(rows, "g")
    assert s.groupBy("g").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0] == 1
    assert {x.split: x["count"] for x in s.select("g", "split").distinct().groupBy("split").count().collect()} == {"train": 14, "dev": 3, "test": 3}


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("d1", 'He said "x",\nthen left'), ("d2", "b")], "doc_id string, text string")
    q = spark.createDataFrame([("q1", "what", "small")], "query_id string, text string, k_bucket string")
    rel = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 0)], "query_id string, doc_id string, relevance int")
    folder = f"file://{tmp_path}/set"
    writers.write_dataset(folder, d, q, rel, rel.agg(F.count("*").alias("n")))
    assert [tuple(x) for x in readers.read_qrels(spark, f"{folder}/qrels.csv").collect()] == [("q1", "d1")]
    assert {x.doc_id: x.text for x in readers.read_corpus(spark, f"{folder}/corpus.csv").collect()} == {"d1": 'He said "x",\nthen left', "d2": "b"}
    assert readers.read_queries(spark, f"{folder}/queries.csv").first().metadata == {"k_bucket": "small"}


def test_malformed_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"interaction_id": "1", "query": "x", "search_results": [{"page_url": "u", "page_snippet": ""}, {"page_url": "u", "page_snippet": "text"}]}\n\n{broken\n{"query": "y"}\n')
    qs = readers.read_web_queries(spark, f"file://{path}")
    assert sorted((x.query_id, x.query, x.task) for x in qs.collect()) == [("", "y", ""), ("1", "x", "")]
    docs = readers.documents_of(qs)
    assert [x.text for x in docs.collect()] == ["text"] and readers.own_results(qs, docs).count() == 1
