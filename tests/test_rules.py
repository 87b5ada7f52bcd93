"""Rules of filters and failure modes on literal rows, and what empty nulls, sure p-values and ragged vectors give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankcut.operators import cutoff, diagnostics, passages, retrieval, validation


def test_k_alignment(spark):
    rows = [(10, 10), (10, 12), (10, 13), (10, 1), (10, 26), (0, 3), (5, 9)]
    ok, score = passages.k_alignment(F.col("t"), F.col("a"))
    got = [(r.ok, r.score) for r in spark.createDataFrame(rows, "t int, a int").select(ok.alias("ok"), score.alias("score")).collect()]
    want = [(True, 1.0), (True, 1 / 3), (False, 0.7), (False, 0.0), (False, 0.0), (False, -2.0), (False, 0.2)]
    assert [o for o, _ in got] == [o for o, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


def test_answerability(spark):
    rows = [(0, 1.0, "why?"), (4, 0.4, "why?"), (4, 0.8, "why"), (4, 0.8, "why? \n"), (30, 1.0, "why?")]
    ok, score = passages.answerability(F.col("n"), F.col("c"), F.col("t"))
    got = [(r.ok, round(r.score, 9)) for r in spark.createDataFrame(rows, "n int, c double, t string").select(ok.alias("ok"), score.alias("score")).collect()]
    assert got == [(False, 0.0), (False, 0.4), (False, 0.5), (True, 0.6), (True, 1.0)]


def test_difficulty(spark):
    long = " ".join(["word"] * 26)
    mid = " ".join(["word"] * 15)
    rows = [("Who is it", "easy"), (long, "easy"), (mid, "easy"), ("how so", "easy"), (long, "hard"), ("Analyze it", "hard"), ("List it", "hard"), (mid, "hard"), (mid, "medium"), ("x", "medium"), ("somehow", "hard")]
    ok, score = passages.difficulty_fit(F.col("t"), F.col("d"), strict=True)
    got = [(r.ok, r.score) for r in spark.createDataFrame(rows, "t string, d string").select(ok.alias("ok"), score.alias("score")).collect()]
    assert [s for _, s in got] == [1.0, 0.3, 0.7, 0.3, 1.0, 1.0, 0.3, 0.6, 0.8, 0.6, 1.0]
    assert [o for o, _ in got] == [s >= 0.4 for _, s in got]


def test_long_chains_are_settled(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i : i + 40])) for i in range(120)]  # each is alike only to its neighbours
    got = {r.pos: r.kept for r in passages.diverse(spark.createDataFrame(rows, "pos int, text string")).collect()}
    kept, want = [], {}
    for i, text in rows:
        t = set(text.split())
        want[i] = not any(len(t & k) / len(t | k) > 0.85 for k in kept)
        if want[i]:
            kept.append(t)
    assert got == want


def test_failure_modes(spark):
    cuts = spark.createDataFrame([(i, -2.0) for i in range(1, 7)] + [(7, 1.0)], "query_id int, statistic double")
    own = spark.createDataFrame([(1, -2.0), (2, -2.0), (3, -2.0), (4, -0.5), (5, -1.0), (6, 0.5), (7, -2.0)], "query_id int, statistic double")
    few, many = [(0.01, 1), (0.2, 50)], [(0.01, 1), (0.02, 2), (0.06, 3)]
    rel = [(q, p, r) for q, ps in ((1, [(0.06, 1)]), (2, few), (3, many), (4, many), (5, many)) for p, r in ps]
    fixed = spark.createDataFrame([(3, True), (4, False)], "query_id int, flipped boolean")
    out = diagnostics.failure_modes(cuts, own, spark.createDataFrame(rel, "query_id int, p double, rank int"), fixed, 30)
    got = {r.query_id: (r.mode, r.n_in_window, r.n_significant) for r in out.collect()}
    assert got == {1: ("weak_signal", 1, 0), 2: ("too_sparse", 1, 1), 3: ("zscore_distortion", 3, 2), 4: ("borderline", 3, 2), 5: ("too_scattered", 3, 2)}


def test_null_checks_by_brute_force(spark):
    g = np.random.default_rng(3)
    rows = [(q, i, float(v)) for q, xs in ((1, g.standard_normal(101)), (2, g.random(60) ** 8)) for i, v in enumerate(xs)]
    out = {r.query_id: r for r in validation.null_checks(spark.createDataFrame(rows, "query_id int, doc_id int, value double"), ["query_id", "doc_id"], seeds=5).collect()}
    import hashlib

    for q in (1, 2):
        own = [(i, v) for k, i, v in rows if k == q]
        found = {"empirical": [], "gaussian": []}
        for seed in range(5):
            v = np.array([x for _, x in sorted(own, key=lambda r: hashlib.md5(f"{seed}:{q}:{r[0]}".encode()).hexdigest())])
            half = len(v) // 2
            ref, rest = v[:half], v[half : 2 * half]
            emp = np.array([((ref >= x).sum() + 1) / (half + 1) for x in rest])
            gauss = np.clip([0.5 * math.erfc((x - ref.mean()) / ref.std() / math.sqrt(2)) for x in rest], 1e-10, 1 - 1e-10)
            for kind, p in (("empirical", emp), ("gaussian", gauss)):
                p = np.sort(p)
                i = np.arange(1, half + 1)
                found[kind].append(max((i / half - p).max(), (p - (i - 1) / half).max()))
        assert out[q].empirical_d == pytest.approx(np.median(found["empirical"]), abs=1e-8)
        assert out[q].gaussian_d == pytest.approx(np.median(found["gaussian"]), abs=1e-8)
    assert out[1].passed and out[1].gaussian_passed and not out[2].gaussian_passed


def test_empty_nulls_and_sure_p_values(spark):
    asked = spark.createDataFrame([(1, 7, 0.5, 1), (2, 8, 0.4, 1)], "query_id int, doc_id int, similarity double, rank int")
    null = spark.createDataFrame([(1, 0.1), (1, 0.9)], "query_id int, value double")
    counted = cutoff.with_query_null(asked, null)
    p = counted.withColumns({"p": cutoff.empirical_p(F.col("n_at_least"), F.col("n_null")), "v": cutoff.plain_p(F.col("n_at_least"), F.col("n_null"))})
    got = {r.query_id: (r.p, r.v) for r in p.collect()}
    assert got[1] == (pytest.approx(2 / 3), 0.5) and got[2] == (None, None)
    assert [r.query_id for r in cutoff.thresholds(cutoff.curve(p, 0.5)).collect()] == [1]
    empty = cutoff.with_global_null(asked, null.where("value > 5")).withColumn("p", cutoff.empirical_p(F.col("n_at_least"), F.col("n_null")))
    assert empty.where("p is not null").count() == 0
    sure = spark.createDataFrame([(1, 7, 0.5, 1, 1.0), (1, 8, 0.4, 2, 0.0), (1, 9, 0.3, 3, 0.5)], "query_id int, doc_id int, similarity double, rank int, p double")
    assert [r.statistic for r in cutoff.curve(sure, 1.0).orderBy("rank").collect()] == [0.0, 0.0, pytest.approx((1 - 0.5) / math.sqrt(0.25 / 3))]


def test_vectors_of_different_lengths(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0])], "query_id int, embedding array<double>")
    corpus = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0]), (12, [0.0, 2.0])], "doc_id int, embedding array<double>")
    got = {(r.query_id, r.doc_id): r.similarity for r in retrieval.scored(queries, corpus).collect()}
    assert got == {(1, 10): 1.0, (1, 12): 0.0, (3, 10): 0.0, (3, 12): 1.0}
    assert retrieval.scored(queries.where("query_id < 0"), corpus).count() == 0
