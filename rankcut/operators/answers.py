"""Answer metrics, a row for each pair of a generated and a gold answer; Column functions but for the greedy matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankcut.functions.text import answer_tokens, normal_answer, split_titles, title_of, words


def exact_match(generated: Column, gold: Column) -> Column:
    return (normal_answer(generated) == normal_answer(gold)).cast("double")


def _prf(overlap: Column, n: Column, m: Column) -> Column:
    """Precision, recall and F1 of an overlap of n and m things: 1 if both are none, 0 if one is."""
    p, r = overlap / n, overlap / m
    some = F.when(overlap > 0, F.struct(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1")))
    same = lambda x: F.struct(*(F.lit(x).alias(c) for c in ("precision", "recall", "f1")))
    return F.when((n == 0) & (m == 0), same(1.0)).otherwise(F.coalesce(F.when((n > 0) & (m > 0), some), same(0.0)))


def _shared(row: np.ndarray, token: np.ndarray, other_row: np.ndarray, other: np.ndarray, rows: int) -> np.ndarray:
    """Size of the common multiset of two sides' tokens (numbers), for each row."""
    most = 1 + max(token.max(initial=0), other.max(initial=0))
    (a, n), (b, m) = (np.unique(r * most + t, return_counts=True) for r, t in ((row, token), (other_row, other)))
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(both // most, np.minimum(n[i], m[j]), minlength=rows).astype(np.int64)


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many tokens two arrays have in common, each as often as both have it: in the row, by whole Arrow batches."""

    @F.arrow_udf("long")
    def overlap(x: pa.Array, y: pa.Array) -> pa.Array:
        tokens = pa.concat_arrays([x.flatten(), y.flatten()]).dictionary_encode().indices.to_numpy().astype(np.int64)
        rows = [np.repeat(np.arange(len(c)), pc.fill_null(pc.list_value_length(c), 0).to_numpy()) for c in (x, y)]
        cut = len(rows[0])
        return pa.array(_shared(rows[0], tokens[:cut], rows[1], tokens[cut:], len(x)))

    return overlap(a, b)


def token_overlap(pairs: DataFrame, key: str, generated: str, gold: str) -> DataFrame:
    """Over multisets of normalised tokens, for texts of any length: (key, n_generated, n_gold, overlap, precision, recall, f1).
    A missing text has no tokens."""
    tokens = lambda c: F.coalesce(answer_tokens(F.col(c)), F.array().cast("array<string>"))
    rows = pairs.select(key, tokens(generated).alias("a_"), tokens(gold).alias("b_"))
    size = lambda c: F.size(c).cast("long")
    out = rows.select(key, size("a_").alias("n_generated"), size("b_").alias("n_gold"), multiset_overlap(F.col("a_"), F.col("b_")).alias("overlap"))
    return out.withColumn("_m", _prf(F.col("overlap"), F.col("n_generated"), F.col("n_gold"))).select(key, "n_generated", "n_gold", "overlap", "_m.*")


def title_f1(generated: Column, gold: Column) -> Column:
    """Over sets of exact titles."""
    a, b = F.array_distinct(split_titles(generated)), F.array_distinct(split_titles(gold))
    return _prf(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The greatest of three Dice values of token sets: what is common against each, and one against the other."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    common = F.size(F.array_intersect(x, y)).cast("double")
    n, m = F.size(x), F.size(y)
    dice = lambda i, p, q: F.when(p + q > 0, 2 * i / (p + q)).otherwise(0.0)
    best = F.greatest(dice(common, common, n), dice(common, common, m), dice(common, n, m))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(best)


def _ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    common = len(x & y)
    if not x and not y:
        return 1.0
    return max(2 * common / (common + len(x)), 2 * common / (common + len(y)), 2 * common / (len(x) + len(y))) if common else 0.0


def matched_titles(generated: list[str], gold: list[str], least: float) -> int:
    """One-to-one matches: generated titles by their best score, later ones first on ties; each takes the first of the best
    gold titles that are free."""
    best = sorted(((max((_ratio(g, t) for t in gold), default=0.0), i) for i, g in enumerate(generated)), reverse=True)
    free, n = list(range(len(gold))), 0
    for score, i in best:
        if score < least or not free:
            continue
        top = max(free, key=lambda j: (_ratio(generated[i], gold[j]), -j))
        if _ratio(generated[i], gold[top]) >= least:
            free.remove(top)
            n += 1
    return n


def fuzzy_title_f1(generated: Column, gold: Column, least: float = 0.8) -> Column:
    """Like title_f1 with titles that are alike; repeated titles count."""

    @F.pandas_udf("long")
    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([matched_titles(list(x), list(y), least) for x, y in zip(a, b, strict=True)])

    a, b = (F.coalesce(split_titles(c), F.array().cast("array<string>")) for c in (generated, gold))
    return _prf(match(a, b), F.size(a), F.size(b))


def answer_metrics(answers: DataFrame, key: str = "query_id", generated: str = "generated", gold: str = "gold") -> DataFrame:
    """(key, exact_match, title_ratio, precision, recall and f1 of title, fuzzy and token): a row for each of answers."""
    gen, own = F.col(generated), F.col(gold)
    parts = {"title": title_f1(gen, own), "fuzzy": fuzzy_title_f1(gen, own)}
    cols = [x[m].alias(f"{n}_{m}") for n, x in parts.items() for m in ("precision", "recall", "f1")]
    tokens = token_overlap(answers, key, generated, gold).select(key, *(F.col(m).alias(f"token_{m}") for m in ("precision", "recall", "f1")))
    return answers.select(key, exact_match(gen, own).alias("exact_match"), token_set_ratio(gen, own).alias("title_ratio"), *cols).join(tokens, key)


def end_to_end(answers: DataFrame, retrieval: DataFrame, judged: DataFrame, key: str = "query_id") -> DataFrame:
    """A row for each of answers(key, generated, gold): its answer metrics, the retrieval metrics of the same key (NULL where
    nothing was evaluated), and judge_scores, a map from judge to a map of its scores by aspect, of judged(key, judge, aspect,
    score); of several scores of a judge for an aspect the mean, an empty map where there are none."""
    score = judged.where("judge is not null and aspect is not null").groupBy(key, "judge", "aspect").agg(F.avg("score").alias("score"))
    judge = score.groupBy(key, "judge").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("aspect", "score")))).alias("m"))
    by = judge.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("judge", F.map_entries("m").alias("m"))))).alias("m"))
    scores = by.select(key, F.transform_values("m", lambda _, v: F.map_from_entries(v)).alias("judge_scores"))
    none = F.create_map().cast("map<string,map<string,double>>")
    return answer_metrics(answers, key).join(retrieval, key, "left").join(scores, key, "left").withColumn("judge_scores", F.coalesce("judge_scores", none))


def gold_answers(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, most: int = 100, none: str = "No relevant documents found") -> DataFrame:
    """Titles of each query's relevant documents in order of doc_id, joined by commas: (query_id, gold_answer)."""
    titles = qrels.join(corpus.select("doc_id", title_of(F.col("text"), most).alias("title")), "doc_id")
    listed = titles.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "title"))), lambda x: x["title"]), ", ").alias("gold_answer"))
    return queries.select("query_id").join(listed, "query_id", "left").withColumn("gold_answer", F.coalesce("gold_answer", F.lit(none)))


def answer_summary(rows: DataFrame, metrics: list[str], ratings: dict[str, Column]) -> DataFrame:
    """One row of means; ratings only over rows that have them, 0 if none has."""
    zero = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{name}")
    return rows.agg(F.count("*").alias("n"), *(zero(F.col(m), m) for m in metrics), *(zero(c, name) for name, c in ratings.items()))


def context_blocks(hits: DataFrame, corpus: DataFrame, budget: int) -> DataFrame:
    """hits(query_id, doc_id, rank) -> (query_id, n_docs, context): numbered texts in order of rank, up to the first that
    would exceed the budget of blank-separated tokens; a placeholder where the corpus lacks a document."""
    from pyspark.sql import Window

    missing = F.concat(F.lit("[Document "), F.col("doc_id").cast("string"), F.lit(" not found]"))
    rows = hits.join(corpus.select("doc_id", "text"), "doc_id", "left")
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("text", missing))
    w = Window.partitionBy("query_id").orderBy("rank")
    sized = rows.withColumn("entry", entry).withColumn("used", F.sum(F.size(words(F.col("entry")))).over(w))
    # the sum only grows, so what stays within the budget is a prefix
    kept = sized.where(F.col("used") <= budget)
    return kept.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n\n").alias("context"))
