"""Running counts over ranges, the grid, entities and the cluster index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankcut.operators import cluster_index as ci
from rankcut.operators import cutoff as c
from rankcut.operators import grid
from rankcut.operators import passages as p
from rankcut.operators import validation as va
from rankcut.operators.ranges import running


def test_running_sums(spark):
    g = np.random.default_rng(0)
    rows = [(int(k), float(v), int(n)) for k, v, n in zip(g.integers(0, 3, 400), g.integers(0, 20, 400) / 7, g.integers(0, 5, 400), strict=True)]
    df = spark.createDataFrame(rows, "k int, v double, n long")
    for keys in ((), ("k",)):
        for r in running(df, "v", ["n"], keys).collect():
            own = [x for x in rows if not keys or x[0] == r.k]
            assert (r.n_upto, r.n_all) == (sum(x[2] for x in own if x[1] <= r.v), sum(x[2] for x in own))


def test_two_samples(spark):
    g = np.random.default_rng(1)
    rows = [(int(i % 2), int(s), float(v)) for i, (s, v) in enumerate(zip(g.integers(0, 2, 300), g.integers(0, 15, 300), strict=True))] + [(5, 0, 1.0)]
    got = {r.k: r for r in va.ks_two_samples(spark.createDataFrame(rows, "k int, side int, value double"), "k").collect()}
    for k in (0, 1):
        a, b = (np.sort([v for q, s, v in rows if q == k and s == side]) for side in (0, 1))
        d = max(abs(np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b)) for x in range(15))
        assert (got[k].n0, got[k].n1) == (len(a), len(b)) and got[k].d == pytest.approx(d, abs=1e-8)
    assert got[5].d is None


def test_split_halves(spark):
    """Halves are about even, differ by seed, and the distance is that of the p-values sorted out in full."""
    import hashlib

    g = np.random.default_rng(2)
    rows = [(i, float(v)) for i, v in enumerate(g.integers(0, 50, 500) / 50)]
    got = {r.seed: r for r in va.split_half(spark.createDataFrame(rows, "doc_id long, value double"), ["doc_id"], 5).collect()}
    for s in range(5):
        ref = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) >> s & 1 for i, _ in rows], bool)
        v = np.array([x for _, x in rows])
        own = np.sort(v[ref])
        pv = np.sort(np.clip(1 - np.searchsorted(own, v[~ref]) / len(own), 1e-10, 1))
        i = np.arange(1, len(pv) + 1)
        assert got[s].n == len(pv) and 150 < len(pv) < 350 and got[s].d == pytest.approx(max((i / len(pv) - pv).max(), (pv - (i - 1) / len(pv)).max()), abs=1e-8)
    assert va.split_half(spark.createDataFrame([], "doc_id long, value double"), ["doc_id"], 5).count() == 0


def test_even_halves(spark):
    """Every seed has a row with even halves, also of very few values."""
    import hashlib

    g = np.random.default_rng(4)
    for n in (2, 3, 201):
        rows = [(i, float(v)) for i, v in enumerate(g.integers(0, 40, n) / 40)]
        got = {r.seed: r for r in va.split_even_halves(spark.createDataFrame(rows, "doc_id long, value double"), ["doc_id"], 6).collect()}
        assert set(got) == set(range(6))
        for s in range(6):
            v = np.array([x for _, x in sorted(rows, key=lambda r: hashlib.md5(f"{s}:{r[0]}".encode()).hexdigest())])
            own, test = np.sort(v[: n // 2]), v[n // 2 :]
            pv = np.sort(np.clip(1 - np.searchsorted(own, test) / len(own), 1e-10, 1))
            i = np.arange(1, len(pv) + 1)
            assert got[s].n == n - n // 2 and got[s].d == pytest.approx(max((i / len(pv) - pv).max(), (pv - (i - 1) / len(pv)).max()), abs=1e-8)


def test_grid_moments(spark):
    g = np.random.default_rng(3)
    rows = []
    for q, n in ((1, 60), (2, 25), (3, 4)):
        rows += [(q, i, float(s), i + 1) for i, s in enumerate(np.sort(g.random(n))[::-1])]
    pool = spark.createDataFrame(rows, "query_id int, doc_id int, similarity double, rank int")
    got = {(r.query_id, r.pool_size, r.fraction): r for r in grid.grid_moments(pool, [20, 50], [0.5, 0.9]).collect()}
    assert len(got) == 12
    for size in (20, 50):
        for f in (0.5, 0.9):
            want = c.z_scores(pool.where(F.col("rank") <= size), f).groupBy("query_id").agg(F.first("mu"), F.first("sigma"), F.count("*")).collect()
            for q, mu, sigma, n in want:
                r = got[q, size, f]
                assert r.n == n and r.mu == pytest.approx(mu) and r.sigma == pytest.approx(sigma, abs=1e-7)


def test_global_null_by_key(spark):
    g = np.random.default_rng(4)
    null = [(int(k), float(v)) for k, v in zip(g.integers(0, 2, 300), g.integers(0, 30, 300), strict=True)] + [(0, None)]
    asked = [(i, int(i % 3), float(v)) for i, v in enumerate(g.integers(-2, 33, 60))]
    out = c.with_global_null(spark.createDataFrame(asked, "query_id int, cell int, similarity double"), spark.createDataFrame(null, "cell int, value double"), keys=("cell",))
    for r in out.collect():
        own = [v for k, v in null if k == r.cell]
        assert (r.n_at_least, r.n_null) == (sum(v is None or v >= r.similarity for v in own), len(own))


def test_entities(spark):
    rows = [(1, "a", "x", None), (1, "n", "5", 1990), (1, "n", "9", None), (2, "a", "x", 1990), (2, "n", "no number", None), (3, "a", "y", 1991), (3, "n", "7.5", None), (4, "n", "9", 1990), (None, "a", "x", 1990), (5, None, None, None)]
    t = spark.createDataFrame(rows, "entity int, property string, value string, year int")
    ids = lambda df: sorted(r.entity for r in df.collect())
    assert ids(p.select_entities(t, [("a", "x")])) == [1, 2]
    assert ids(p.select_entities(t, [("a", "x")], ["n"], (1990, 1990), ("n", 5.0))) == [1]
    assert ids(p.select_entities(t, [], at_least=("n", 6.0), at_most=("n", 8.0))) == [3]
    assert ids(p.select_entities(t, [])) == [1, 2, 3, 4, 5]
    top = lambda **o: [tuple(r) for r in p.top_by_property(t, "n", 2, **o).collect()]
    assert top() == [(1, 9.0), (4, 9.0)] and top(descending=False) == [(1, 5.0), (3, 7.5)] and top(among=t.where("entity > 2")) == [(4, 9.0), (3, 7.5)]
    cover = p.article_coverage(t.where("entity < 4"), spark.createDataFrame([(1, "text"), (1, "more"), (2, " "), (3, None), (9, "x")], "entity int, text string")).first()
    assert tuple(cover) == (3, 1, pytest.approx(1 / 3))


def test_cluster_index(spark, tmp_path):
    rows = [(1, "t", [3, 4, 7], ["q"], ["easy"], ["sport"], 0.9), (2, "t", [8], ["q", "r"], ["hard"], [], 0.6), (3, "u", [8, 30], ["r"], [], ["sport", "art"], 0.4), (4, "u", [], ["q"], ["easy"], [], 0.7)]
    entries = spark.createDataFrame(rows, "cluster_id int, cluster_type string, ks array<int>, query_types array<string>, difficulties array<string>, domains array<string>, suitability double")
    path = ci.write_index(entries, f"file://{tmp_path}/index")
    ids = lambda **o: [r.cluster_id for r in ci.find(spark, path, **o).collect()]
    assert ids() == [1, 4, 2] and ids(k_bucket="6-10") == [1, 2] and ids(k_bucket="6-10", min_suitability=0.0) == [1, 2, 3] and ids(query_type="q", difficulty="easy") == [1, 4]
    assert ids(domain="sport", min_suitability=0.0, cluster_type="u") == [3] and ids(k_bucket="11-15") == []
    plan = ci.find(spark, path, k_bucket="6-10", cluster_type="t")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k_bucket" in plan
    got = {(r.dimension, r.value): (r.n_clusters, r.mean_suitability) for r in ci.statistics(spark, path).collect()}
    assert got["k_bucket", "6-10"][0] == 3 and got["k_bucket", "2-5"] == (1, 0.9) and got["domain", "sport"] == (2, pytest.approx(0.65)) and got["all", "all"] == (4, pytest.approx(0.65)) and got["cluster_type", "u"][0] == 2
