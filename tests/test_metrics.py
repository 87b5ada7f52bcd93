"""Metrics, cuts and p-values against values worked out by hand and a plain numpy version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankcut.functions.statistics import ks_probability
from rankcut.operators import cutoff as c
from rankcut.operators import ir_metrics as m
from rankcut.operators import nulls
from rankcut.operators import retrieval as r
from rankcut.operators import validation as va


def rows(spark, hits):
    return spark.createDataFrame([(q, d, i + 1) for q, ds in hits.items() for i, d in enumerate(ds)], "query_id string, doc_id string, rank int")


def test_metrics_by_hand(spark):
    hits = rows(spark, {"a": ["d1", "d2", "d3", "d4", "d5"], "b": ["x", "y", "d1", "z", "w"], "c": ["d1", "d2", "d1", "d3", "d2"]})
    qrels = spark.createDataFrame([(q, f"d{i}") for q in "abcd" for i in (1, 2, 3)], "query_id string, doc_id string")
    queries = spark.createDataFrame([(q,) for q in "abcde"], "query_id string")
    got = {x.query_id: x for x in m.per_query(queries, hits, qrels).collect()}
    a, b, cc, d, e = (got[q] for q in "abcde")
    assert (a.recall, a.precision, a.reciprocal_rank, a.ndcg, a.average_precision) == (1, 0.6, 1, 1, 1)
    assert b.recall == pytest.approx(1 / 3) and b.reciprocal_rank == pytest.approx(1 / 3) and b.ndcg == pytest.approx(0.2346, abs=1e-4) and b.average_precision == pytest.approx(1 / 9)
    assert cc.had_duplicates and cc.k == 3 and cc.recall == 1 and cc.precision == 1
    assert d.k == 0 and d.labelled and d.recall == 0 and not e.labelled and e.ndcg == 0
    total = m.overall(m.per_query(queries, hits, qrels)).first()
    assert total.n_queries == 5 and total.n_labelled == 4 and total.mean_recall == pytest.approx((1 + 1 / 3 + 1) / 5)


def test_cut_by_hand(spark):
    cands = spark.createDataFrame([("q", f"d{i}", s, i + 1) for i, s in enumerate((0.95, 0.85, 0.5, 0.2))], "query_id string, doc_id string, similarity double, rank int")
    null = spark.createDataFrame([("q", i / 10) for i in range(10)], "query_id string, value double")
    p = c.with_query_null(cands, null).withColumn("p", c.empirical_p(F.col("n_at_least"), F.col("n_null")))
    assert [round(x.p * 11) for x in p.orderBy("rank").collect()] == [1, 2, 6, 9]
    best = c.thresholds(c.curve(p, 0.5)).first()
    assert best.statistic == pytest.approx(1.650, abs=1e-3) and best.k == 2 and best.threshold == 0.85
    none = c.thresholds(c.curve(p, 0.5), min_hc=2).first()
    assert none.k == 0 and math.isinf(none.threshold)
    same = c.with_global_null(cands, null.select("value")).orderBy("rank").collect()
    assert [x.n_at_least for x in same] == [0, 1, 5, 8]


def test_search_is_exact_and_independent_of_partitions(spark):
    g = np.random.default_rng(0)
    x = g.standard_normal((300, 8)).round(1)
    x[50:60] = x[7]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000, None), (1001, [1.0, 2.0])], "doc_id long, embedding array<double>")
    queries = df.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    got = {n: sorted(map(tuple, r.search(queries, df.repartition(n), 10, block=4, rows=64).collect())) for n in (1, 7)}
    assert got[1] == got[7]
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    for q in range(9):
        s = np.round(unit @ unit[q], 6)
        order = [d for d in np.lexsort((np.arange(300), -s)) if d != q][:10]
        assert [t[1] for t in got[1] if t[0] == q] != [] and [t[1] for t in sorted((t for t in got[1] if t[0] == q), key=lambda t: t[3])] == order


def test_z_scores(spark):
    g = np.random.default_rng(1)
    s = np.sort(g.random(40))[::-1]
    df = spark.createDataFrame([(1, i, float(v), i + 1) for i, v in enumerate(s)], "query_id int, doc_id int, similarity double, rank int")
    z = [x.z for x in c.z_scores(df, 0.5).orderBy("rank").collect()]
    low = np.sort(s)[:20]
    assert np.allclose(z, (s - low.mean()) / low.std())
    few = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.5, 2)], df.schema)
    assert [x.z for x in c.z_scores(few).collect()] == [0, 0]


def test_sampled_negatives_come_again(spark):
    scores = spark.createDataFrame([(1, i, i / 10) for i in range(4)], "query_id int, doc_id int, similarity double")
    qrels = spark.createDataFrame([(1, 0)], "query_id int, doc_id int")
    assert nulls.sampled_negatives(scores, qrels, 7).count() == 7
    assert nulls.sampled_negatives(scores, qrels, 2).count() == 2
    assert nulls.sampled_negatives(scores, qrels, 0).count() == 3


def test_kolmogorov():
    assert ks_probability(0.274, 10) == pytest.approx(0.371, abs=2e-3)
    assert ks_probability(0.409, 10) == pytest.approx(0.05, abs=2e-3)
    assert ks_probability(0.134, 100) == pytest.approx(0.05, abs=2e-3)


def test_ks_uniform(spark):
    g = np.random.default_rng(2)
    p = g.random(50)
    d = va.ks_uniform(spark.createDataFrame([(1, float(x)) for x in p], "query_id int, p double"), "query_id").first().d
    s, i = np.sort(p), np.arange(1, 51)
    assert d == pytest.approx(max((i / 50 - s).max(), (s - (i - 1) / 50).max()), abs=1e-8)
