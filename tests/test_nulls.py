"""Synthetic nulls and passages read from files."""

import json

import pytest
from pyspark.sql import functions as F

from rankcut.operators import cutoff, diagnostics, nulls
from rankcut.sources import readers, writers


def test_synthetic_nulls(spark):
    for df in (nulls.random_vector_null(spark, 4000, 16), nulls.gaussian_null(spark, 4000, 16)):
        s = nulls.summary(df).first()
        assert s.n_samples == 4000 and abs(s.mean) < 0.02 and s.std == pytest.approx(0.25, abs=0.02) and -1 <= s.min_val < s.max_val <= 1


def test_passages_in_three_forms(spark, tmp_path):
    rows = [{"passage_id": "a", "entity": "Q1", "text": "x"}, {"entity": "Q2", "text": "y"}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "l.json").write_text(json.dumps(rows))
    (tmp_path / "o.json").write_text(json.dumps({"passages": rows}))
    for name in ("l.jsonl", "l.json", "o.json"):
        got = sorted((r.passage_id, r.entity) for r in readers.read_passages(spark, f"file://{tmp_path}/{name}").collect())
        assert got == [("a", "Q1"), ("p_2", "Q2")]


def test_passages_are_numbered_by_their_place_in_the_file(spark, tmp_path):
    """A file read in many pieces, with blank lines."""
    lines = []
    for i in range(1, 3001):
        lines += [json.dumps({"entity": f"Q{i}", "text": "x" * (i % 97)} | ({"passage_id": f"own{i}"} if i % 3 == 0 else {}))] + ["  "] * (i % 50 == 0)
    (tmp_path / "many.jsonl").write_text("\n".join(lines))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = readers.read_passages(spark, f"file://{tmp_path}/many.jsonl")
        assert spark.read.text(f"file://{tmp_path}/many.jsonl").rdd.getNumPartitions() > 10
        got = {r.entity: r.passage_id for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {f"Q{i}": f"own{i}" if i % 3 == 0 else f"p_{i}" for i in range(1, 3001)}


def test_store_keeps_what_is_there(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert writers.store(spark.range(3), path).count() == 3
    assert writers.store(spark.range(5), path).count() == 3
    assert writers.store(spark.range(5), path, force=True).agg(F.max("id")).first()[0] == 4


def test_a_null_of_over_a_million_values_counts_whole(spark):
    null = spark.range(1_200_000).select(F.round(F.col("id") / 1e6, 6).alias("value"))
    asked = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 0.25), (4, 0.2500005), (5, 1.199999), (6, 7.0), (7, None), (8, 0.25)], "query_id long, similarity double")
    got = {r.query_id: (r.n_at_least, r.n_null) for r in cutoff.with_global_null(asked, null).collect()}
    want = {1: 1_200_000, 2: 1_200_000, 3: 950_000, 4: 949_999, 5: 1, 6: 0, 7: 0, 8: 950_000}
    assert got == {q: (n, 1_200_000) for q, n in want.items()}


def test_trace_keeps_the_sign_of_a_zero(spark):
    rows = [(1, 5, 1, 1, 0.00002, 0.1), (1, 6, 2, 0, -0.00002, 0.2), (1, 7, 3, 0, -1.23456, 0.9), (2, 5, 1, 0, 2.5, 0.05)]
    got = {r.query_id: r for r in diagnostics.trace(spark.createDataFrame(rows, "query_id int, doc_id int, rank int, rel int, z double, p double")).collect()}
    assert list(map(str, got[1].zs)) == ["0.0", "-0.0", "-1.2346"] and got[1].docs == [5, 6, 7] and got[2].zs == [2.5]
