"""Similar questions and common tokens against brute force."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankcut.operators import answers, passages, similar


def tokens(text):
    return set(re.findall(r"\w+", (text or "").lower())) - set(similar.STOP_WORDS)


def pairs_wanted(rows, threshold):
    out = set()
    for i, a in rows:
        for j, b in rows:
            x, y = tokens(a), tokens(b)
            if i < j and x and y and len(x & y) / len(x | y) > threshold:
                out.add((i, j))
    return out


def questions(seed, many):
    """Few words, so that many are alike; some by a common beginning only, some the same."""
    g = np.random.default_rng(seed)
    rows = []
    for i in range(many):
        base = g.choice(["which city is the largest of all", "what is the name of the river that runs to the sea", "list every author by year and by place of birth"])
        rows.append((i, " ".join([str(base), *g.choice(list("abcdefgh"), int(g.integers(0, 5))), *(["the"] * int(g.integers(0, 2)))])))
    return [*rows, (many, ""), (many + 1, None), (many + 2, "the of"), (many + 3, " . "), (many + 4, "one"), (many + 5, "one"), (many + 6, "ONE, one!")]


@pytest.mark.parametrize(("threshold", "hot"), [(0.85, None), (0.6, None), (0.85, 3), (0.6, 3), (0.5, 0)])
def test_similar_pairs(spark, monkeypatch, threshold, hot):
    if hot is not None:  # as if every token were too common to meet by itself
        real = similar._prefixes
        monkeypatch.setattr(similar, "_prefixes", lambda t, ranked, _: real(t, ranked, hot))
    rows = questions(3, 150)
    got = similar.similar_pairs(spark.createDataFrame(rows, "pos long, text string").repartition(3), threshold).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == pairs_wanted(rows, threshold)


def test_diverse_rows(spark):
    rows = questions(5, 120)
    kept = []
    for i, t in rows:
        if t and not any(tokens(t) and tokens(u) and len(tokens(t) & tokens(u)) / len(tokens(t) | tokens(u)) > 0.6 for _, u in kept):
            kept.append((i, t))
    got = passages.diverse(spark.createDataFrame(rows, "pos long, text string").repartition(3), 0.6)
    assert {r.pos for r in got.where("kept").collect()} == {i for i, _ in kept} and got.count() == len(rows) and got.where("kept is null").count() == 0


def test_no_questions(spark):
    none = spark.createDataFrame([], "pos long, text string")
    assert similar.similar_pairs(none).count() == passages.diverse(none).count() == 0


def test_token_overlap(spark):
    g = np.random.default_rng(1)
    rows = [(i, *(" ".join(g.choice(list("xyzäö") + ["the", "a"], int(g.integers(0, 12)))) for _ in range(2))) for i in range(60)]
    rows += [(100, None, "x"), (101, "", None), (102, "x " * 5000, "x " * 3000 + "y " * 9), (103, "a the an", "x"), (104, "Don't", "dont")]
    got = {r.key: r for r in answers.token_overlap(spark.createDataFrame(rows, "key long, gen string, gold string").repartition(3), "key", "gen", "gold").collect()}
    split = lambda t: [w for w in re.sub(r"\b(a|an|the)\b", " ", re.sub(r"[^\w\s]", "", (t or "").lower())).split()]
    for key, a, b in rows:
        x, y = collections.Counter(split(a)), collections.Counter(split(b))
        n, m, o = x.total(), y.total(), (x & y).total()
        f1 = 1.0 if n == m == 0 else 2 * o / (n + m) if o else 0.0
        assert (got[key].n_generated, got[key].n_gold, got[key].overlap) == (n, m, o) and got[key].f1 == pytest.approx(f1)
    plan = answers.token_overlap(spark.createDataFrame(rows, "key long, gen string, gold string"), "key", "gen", "gold").groupBy(F.spark_partition_id()).count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_pairs_that_differ_much_do_not_travel(spark, monkeypatch):
    """Many classes share a token of their prefixes and little else: sketches tell them apart where they meet. No pair is lost."""
    g = np.random.default_rng(7)
    rows = [(i, " ".join(["aa", *(f"w{g.integers(0, 10**6)}" for _ in range(20))])) for i in range(300)]
    rows += [(300 + i, rows[i][1].replace("aa", "bb")) for i in range(0, 300, 50)]
    monkeypatch.setattr(similar, "SLOTS", 1)  # as if all tokens were equally rare
    classes, _ = similar.same_tokens(spark.createDataFrame(rows, "pos long, text string").repartition(3))
    found = similar.similar_classes(classes, 0.85)
    assert {tuple(r) for r in found.collect()} == pairs_wanted(rows, 0.85) and len(pairs_wanted(rows, 0.85)) == 6
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()
