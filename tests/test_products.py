"""What block products give, against all pairs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankcut import plans
from rankcut.operators import cutoff as c
from rankcut.operators import nulls, products, retrieval
from rankcut.plans import base

BLOCKS = {"block": 3, "rows": 40}


@pytest.fixture(scope="module")
def setting(spark):
    g = np.random.default_rng(0)
    x = g.standard_normal((210, 6)).round(1)
    x[50:70] = x[7]
    rows = [(f"d{i}", [float(v) for v in r]) for i, r in enumerate(x)]
    corpus = spark.createDataFrame([*rows, ("short", [1.0, 2.0]), ("none", None), (None, rows[0][1]), ("holes", [None] * 6)], "doc_id string, embedding array<double>").repartition(3)
    queries = corpus.where("doc_id in ('d0', 'd7', 'd20', 'd90', 'd200', 'none', 'short')").withColumnRenamed("doc_id", "query_id")
    relevant = {(q, f"d{i}") for q in ("d0", "d7", "d90") for i in range(0, 210, 5 if q == "d0" else 2)} | {("d20", f"d{i}") for i in range(210) if i not in (3, 20, 40)}
    qrels = spark.createDataFrame([*relevant, ("d0", "elsewhere"), ("nobody", "d1")], "query_id string, doc_id string")
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    scores = {q: {f"d{i}": np.round(s, 6) for i, s in enumerate(unit @ unit[int(q[1:])]) if f"d{i}" != q and (q, f"d{i}") not in relevant} for q in ("d0", "d7", "d20", "d90", "d200")}
    return queries, corpus, qrels, scores


def test_moments(setting):
    queries, corpus, qrels, scores = setting
    got = {r.query_id: r for r in nulls.null_moments(queries, corpus, qrels, **BLOCKS).collect()}
    assert set(got) == set(scores)
    for q, s in scores.items():
        v, r = np.array(list(s.values())), got[q]
        assert np.allclose((r.mean, r.std, r.min_val, r.max_val, r.n_samples), (v.mean(), v.std(), v.min(), v.max(), len(v)), atol=1e-9)


def place(q, d, seed=0):
    of = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % (products.PRIME - 1) + 1
    return of(f"{seed}:{q}") * of(d) % products.PRIME


@pytest.mark.parametrize("n", [4, 50])
def test_samples(setting, n):
    """Also for queries with almost no free documents, whose sample lies beyond any limit."""
    queries, corpus, qrels, scores = setting
    got = nulls.sampled_null(queries, corpus, qrels, n, **BLOCKS).collect()
    for q, s in scores.items():
        first = sorted(s, key=lambda d: (place(q, d), d))[:n]
        want = [s[first[i % len(first)]] for i in range(n)]
        assert [r.value for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.nth)] == want
    z = {(r.query_id, r.doc_id): r.value for r in nulls.global_z_null(queries, corpus, qrels, n, **BLOCKS).collect()}
    want = {}
    for q, s in scores.items():
        v = np.array(list(s.values()))
        want |= {(q, d): (s[d] - v.mean()) / v.std() for d in sorted(s, key=lambda d: (place(q, d), d))[:n]}
    assert z.keys() == want.keys() and all(z[k] == pytest.approx(want[k], abs=1e-7) for k in z)


def test_samples_beyond_the_limit(spark):
    """All documents have one id, so either all or none of them lie under the limit of the first product."""
    rows = [(7, [1.0, float(i)]) for i in range(300)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(10)], "query_id long, embedding array<double>")
    got = nulls.sampled_null(queries, corpus, None, 5).groupBy("query_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(i, 5) for i in range(10) if i != 7]


def test_counts_between_thresholds(spark, setting):
    queries, corpus, qrels, scores = setting
    rows = [(q, f"c{i}", float(t), i + 1) for q, s in scores.items() if q != "d90" for i, t in enumerate([1.0, *sorted(s.values())[:: max(1, len(s) // 9)], -1.0, 0.1234564])]
    candidates = spark.createDataFrame([*rows, ("none", "c", 0.5, 1)], "query_id string, doc_id string, similarity double, rank int")
    null = nulls.counted_null(queries, corpus, qrels, candidates, **BLOCKS)
    got = {(r.query_id, r.doc_id): (r.n_at_least, r.n_null) for r in c.with_query_null(candidates, null).collect()}
    want = {(q, d): (sum(v >= t for v in scores[q].values()), len(scores[q])) for q, d, t, _ in rows}
    assert got.pop(("none", "c")) in {(None, None), (0, 0)} and got == want
    whole = {(r.query_id): r.times for r in null.groupBy("query_id").agg({"times": "sum"}).withColumnRenamed("sum(times)", "times").collect()}
    assert whole == {q: len(s) for q, s in scores.items()}


def test_nothing_to_multiply(setting):
    queries, corpus, qrels, _ = setting
    assert nulls.null_moments(queries.where("query_id = 'x'"), corpus, qrels).count() == nulls.null_moments(queries, corpus.where("doc_id = 'x'"), qrels).count() == 0
    assert nulls.sampled_null(queries, corpus.where("doc_id = 'x'"), qrels, 3).count() == 0


def test_sampled_pairs_lose_none(spark):
    """Ranges that differ between sizes and places (the latter carry the vectors) would give numbers twice or never."""
    corpus = spark.range(30_000).selectExpr("id AS doc_id", "transform(sequence(1, 64), x -> sin(x * (id + 1) * 1e3D)) AS embedding").repartition(7)
    queries = corpus.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    rows = retrieval._numbered(corpus, "doc_id").select("doc_id", "n", "embedding").collect()
    assert sorted((r.doc_id, r.n) for r in rows) == [(i, i) for i in range(30_000)]
    assert retrieval.sampled_pairs(queries, corpus, 3000).select("pair").distinct().count() == 3000


def test_a_column_says_what_is_relevant(spark, setting):
    """The same as with a list of pairs, also for values that are missing or of one side only."""
    queries, corpus, _, _ = setting
    label = F.when(F.col("doc_id") != "d20", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    docs = corpus.withColumn("label", label)
    asked = docs.withColumnsRenamed({"doc_id": "query_id", "label": "kind"}).join(queries.select("query_id"), "query_id", "left_semi")
    pairs = asked.join(docs.drop("embedding"), F.col("kind") == F.col("label")).select("query_id", "doc_id").where("query_id <> doc_id")
    alike = {"alike": ("kind", "label")} | BLOCKS
    rows = lambda df: sorted(map(tuple, df.collect()))
    for n in (4, 50):
        assert rows(nulls.sampled_null(asked, docs, None, n, **alike)) == rows(nulls.sampled_null(asked, docs, pairs, n, **BLOCKS))
    near = lambda df: [(q, round(v, 9), t) for q, v, t in rows(df)]
    candidates = spark.createDataFrame([("d0", 0.5), ("d7", 0.1), ("d20", -0.3)], "query_id string, similarity double")
    assert near(nulls.counted_null(asked, docs, None, candidates, **alike)) == near(nulls.counted_null(asked, docs, pairs, candidates, **BLOCKS))


@pytest.mark.parametrize("name", ["n1_sampled_negatives", "n3_global_z_null", "d7_ratio_against_calibration"])
def test_no_list_of_all_relevant_pairs(spark, monkeypatch, name):
    """Such a list grows with the square of the corpus."""
    monkeypatch.setattr(base, "qrels", lambda *a: pytest.fail("all relevant pairs were listed"))
    assert not plans.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
