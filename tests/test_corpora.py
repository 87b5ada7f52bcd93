"""Chunking of skewed corpora, end-to-end rows, reports on generated questions, coverage of configs, tasks of files."""

import random

from pyspark.sql import functions as F
from rankcut.operators import answers, catalog, chunking, passages
from rankcut.sources import readers


def _text(r: random.Random, seps: list[str], n: int, longest: int) -> str:
    return "".join("a" * r.choice([0, 1, 3, 5, 9, 17, r.randint(0, longest)]) + r.choice(seps) for _ in range(n))


def test_pieces_give_the_chunks_of_the_whole_text():
    r, cuts = random.Random(5), 0
    for _ in range(1500):
        size, limit = r.choice([3, 8, 20]), r.choice([8, 30, 200])
        overlap = r.choice([0, 1, 3, size])
        text = _text(r, r.choice([["\n\n"], ["\n\n", "\n"], ["\n", " ", ". "], ["\n\n", "\n", ". ", " "]]), r.randint(0, 120), r.choice([20, 150]))
        pieces = chunking.pieces_of(text, size, overlap, limit)
        cuts += len(pieces) - 1
        assert [c for level, p in pieces for c in chunking.split_by(p, size, overlap, level)] == chunking.split_by(text, size, overlap, 0)
    assert cuts > 5000


def test_long_prose_is_cut_into_short_pieces():
    r = random.Random(6)
    text = "\n\n".join(". ".join(" ".join("w" * r.randint(2, 9) for _ in range(r.randint(4, 20))) for _ in range(r.randint(1, 9))) for _ in range(3000))
    pieces = chunking.pieces_of(text, 256, 50, 20_000)
    assert len(pieces) > len(text) // 20_000 and max(len(p) for _, p in pieces) < 40_000


def test_corpus_with_a_long_text_has_the_same_chunks_and_uses_all_tasks(spark):
    r = random.Random(7)
    seps = ["\n\n", "\n", ". ", " "]
    rows = [(i, _text(r, seps, 40, 60)) for i in range(30)] + [(30, _text(r, seps, 8000, 60)), (31, None), (32, ""), (33, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("x"))
    got = chunking.chunk_corpus(docs, 40, 10, longest=2000, target=20_000)
    assert sorted(got.collect()) == sorted(chunking.recursive_chunks(docs, 40, 10).collect())
    assert chunking.chunk_corpus(docs.limit(0), 40, 10).count() == 0


def test_end_to_end_rows_keep_every_answer_and_all_judges(spark):
    rows = spark.createDataFrame([(1, "The Red House", "red house"), (2, None, "x"), (3, "a, b", "")], "query_id int, generated string, gold string")
    retrieval = spark.createDataFrame([(1, 0.5)], "query_id int, recall double")
    judged = spark.createDataFrame([(1, "m", "style", 2.0), (1, "m", "style", 4.0), (1, "n", "facts", 1.0), (3, None, "style", 1.0)], "query_id int, judge string, aspect string, score double")
    got = {x.query_id: x for x in answers.end_to_end(rows, retrieval, judged).collect()}
    assert len(got) == 3 and got[1].judge_scores == {"m": {"style": 3.0}, "n": {"facts": 1.0}} and got[1].recall == 0.5
    assert got[2].judge_scores == {} == got[3].judge_scores and got[2].recall is None
    assert got[1].exact_match == 1.0 and got[1].token_f1 == 1.0 and got[2].token_f1 == 0.0


GENERATED = "text string, is_valid boolean, actual_k int, target_k int, errors array<string>"


def test_reports_on_generated_questions_count_valid_ones(spark):
    rows = [("Who is it", True, 3, 9, []), ("Who is it", True, 0, 12, []), ("name   one thing now", True, None, None, []), (None, True, 30, 1, []), ("", None, 5, 5, ["e"]), *[("What", False, 5, 5, ["e", "f"])] * 3]
    df = spark.createDataFrame(rows, GENERATED)
    m = passages.generation_metrics(df).first()
    assert (m.n, m.n_valid, m.n_unique, m.min_words, m.max_words) == (8, 4, 2, 3, 4) and (m.min_k, m.max_k, m.median_k) == (3, 30, 12)
    assert {tuple(x) for x in passages.question_types(df).collect()} == {("who", 2), ("name", 1)}
    assert [tuple(x) for x in passages.openings(df).collect()] == [("Who is it", 2), ("name one thing", 1)]
    assert {tuple(x) for x in passages.k_distribution(df).collect()} == {("2-5", 1), ("6-10", 0), ("11-15", 1), ("16-20", 1)}
    assert {(x.issue, x.n, x.detail) for x in passages.generation_issues(df).collect()} == {("low_success_rate", 4, ""), ("low_uniqueness", 2, ""), ("short_queries", 3, ""), ("repetitive_opening", 2, "Who is it"), ("common_error", 4, "e"), ("common_error", 3, "f")}
    assert passages.generation_metrics(df.limit(0)).first().mean_words == 0 and passages.generation_issues(df.limit(0)).count() == 0


def test_selection_leaves_out_unknown_cells_and_lists_shortfalls(spark):
    rows = spark.createDataFrame([(1, 3, "easy", "a", 1.0, 7), (2, 3, "odd", "a", 1.0, 7), (3, 9, None, "b", 1.0, 8)], "query_id int, k int, difficulty string, cluster_type string, total_score double, cluster_id int")
    picked = passages.stratified(rows, 10, {"2-5": 0.5, "6-10": 0.5}, {"easy": 0.4, "hard": 0.6}, ["a"])
    assert [x.query_id for x in picked.collect()] == [1]
    short = passages.shortfalls(picked, 10, {"2-5": 0.5, "6-10": 0.5}, {"easy": 0.4, "hard": 0.6})
    assert {(x.k_range, x.difficulty, x.target, x.shortfall) for x in short.collect()} == {("2-5", "easy", 2, 1), ("2-5", "hard", 3, 3), ("6-10", "easy", 2, 2), ("6-10", "hard", 3, 3)}
    assert passages.selection_summary(picked, 10).first().selection_rate == 0.1


def _first(prices: list[float], lo: int, hi: int):
    for direction in ("above", "below"):
        for k in range(lo, hi + 1):
            for p, q in zip(sorted(set(prices)), sorted(set(prices))[1:], strict=False):
                mid = (p + q) / 2
                if sum(x > mid if direction == "above" else x < mid for x in prices) == k:
                    return direction, k
    return None


def test_first_thresholds_and_coverage_of_configs(spark):
    r = random.Random(8)
    rows = [(f"c{g % 3}" if g else None, f"g{g}", float(r.randint(1, 6)) if r.random() < 0.9 else None, r.random() < 0.8) for g in range(9) for _ in range(r.randint(0, 20))]
    items = spark.createDataFrame(rows, "config string, category string, price double, content boolean")
    got = {x.category: (x.direction, x.k) for x in catalog.first_thresholds(items, 4, 6, "category").collect()}
    want = {g: _first([p for _, c, p, _ in rows if c == g and p is not None], 4, 6) for g in {x[1] for x in rows}}
    assert got == {g: x for g, x in want.items() if x}
    by = {x.config: x for x in catalog.config_coverage(items, 4, 6, ((4, 4), (5, 6))).collect()}
    for c in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == c]
        first = [_first([p for _, g, p, ok in own if g == h and ok and p is not None], 4, 6) for h in {x[1] for x in own}]
        assert by[c].n == len(own) and by[c].n_both == sum(x[3] and x[2] is not None for x in own)
        assert by[c].n_viable == sum(x is not None for x in first) == by[c].k_4_4 + by[c].k_5_6


def test_full_text_goes_by_the_key_and_tasks_are_not_deduplicated(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"query_id": "1", "query": "x", "search_results": [{"page_url": "u", "page_snippet": "s", "page_result": null}, {"page_url": "v", "page_snippet": "s"}, {"page_url": "w", "page_snippet": "s", "page_result": "r"}]}\n')
    (tmp_path / "b.jsonl").write_text('{"query_id": "1", "query": "x", "search_results": [{"page_url": "w", "page_snippet": "s", "page_result": "r"}, {"page_url": "w", "page_snippet": "s"}]}\n')
    queries, docs = readers.read_tasks(spark, {"one": [str(tmp_path / "a.jsonl")], "two": [str(tmp_path / "b.jsonl")]}, full_text=True)
    assert queries.count() == 2 and sorted((x.of_task, x.url, x.text) for x in docs.collect()) == [("one", "v", "s"), ("one", "w", "r"), ("two", "w", "r")]
