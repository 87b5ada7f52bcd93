"""Benchmarks from entities and passages: mapping, checks, filters, selection, corpora, splits, triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankcut.functions.text import k_range, word_count, words
from rankcut.operators.retrieval import hash_order
from rankcut.operators.similar import question_tokens, same_tokens, similar_classes
from rankcut.sources.checkpoints import stored

#: Words that speak for an easy and for a hard question (fixed values).
EASY_INDICATORS = ["who", "what", "list", "name", "which"]
HARD_INDICATORS = ["how", "compare", "analyze", "pattern", "relationship"]
#: Words by which questions are told apart, and ranges of k (fixed values).
QUESTION_TYPES = ["who", "what", "which", "where", "when", "how", "list", "name"]
K_RANGES = ["2-5", "6-10", "11-15", "16-20"]


def map_queries(asked: DataFrame, passages: DataFrame, most: int = 3) -> DataFrame:
    """asked(query_id, entity), passages(passage_id, entity, text): each entity's first passages with a falling relevance:
    (query_id, entity, passage_id, relevance, preview); entities without passages have NULL."""
    first = passages.withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy("passage_id"))).where(F.col("_i") <= most)
    out = asked.distinct().join(first, "entity", "left")
    relevance = F.greatest(F.lit(0.1), 1 - 0.2 * (F.col("_i") - 1))
    return out.select("query_id", "entity", "passage_id", F.round(relevance, 6).alias("relevance"), F.substring("text", 1, 200).alias("preview"))


def coverage(mapped: DataFrame) -> DataFrame:
    by = mapped.groupBy("query_id", "entity").agg(F.count("passage_id").alias("n"))
    return by.groupBy("query_id").agg(F.count("*").alias("n_entities"), F.count_if(F.col("n") > 0).alias("n_covered"), F.sum("n").alias("n_passages"), F.avg((F.col("n") > 0).cast("double")).alias("coverage"))


def passage_statistics(passages: DataFrame) -> DataFrame:
    by = passages.groupBy("entity").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("n_passages"), F.count("*").alias("n_entities"), F.avg("n").alias("mean_per_entity"), F.max("n").alias("max_per_entity"), F.min("n").alias("min_per_entity"))


def lead_mapping(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """Exactly one passage, the first, of each covered entity."""
    lead = passages.groupBy("entity").agg(F.min("passage_id").alias("passage_id"))
    return asked.distinct().join(lead, "entity").select("query_id", "entity", "passage_id")


def lead_mismatch(asked: DataFrame, mapped: DataFrame, targets: DataFrame) -> DataFrame:
    n = mapped.groupBy("query_id").agg(F.count("*").alias("n_passages"))
    return targets.join(n, "query_id", "left").select("query_id", "target_k", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), (F.coalesce("n_passages", F.lit(0)) != F.col("target_k")).alias("mismatch"))


def cluster_coverage(members: DataFrame, passages: DataFrame) -> DataFrame:
    """members(cluster_id, entity): entities with passages, rates and quality, those without (missing, in order); valid at 0.8 covered and 3 passages each."""
    n = passages.groupBy("entity").agg(F.count("*").alias("_n"))
    by = members.join(n, "entity", "left").groupBy("cluster_id").agg(
        F.count("*").alias("n_entities"), F.count("_n").alias("n_covered"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_passages"), F.coalesce(F.avg("_n"), F.lit(0.0)).alias("mean_passages"), (F.count("_n") / F.count("*")).alias("rate"),
        F.sort_array(F.collect_list(F.when(F.col("_n").isNull(), F.col("entity")))).alias("missing"),
    )
    quality = F.when(F.col("mean_passages") >= 10, "high").when(F.col("mean_passages") >= 5, "medium").otherwise("low")
    return by.withColumns({"quality": quality, "valid": (F.col("rate") >= 0.8) & (F.col("mean_passages") >= 3)})


def best_year_range(members: DataFrame, targets: DataFrame) -> DataFrame:
    """members(cluster_id, entity, year), targets(cluster_id, target_k): the run of years whose number of entities is
    closest to the target, first by start and end. Pairs of years of one cluster are few: years are summed up first."""
    n = members.where("year is not null").groupBy("cluster_id", "year").agg(F.count_distinct("entity").alias("n"))
    run = n.withColumn("upto", F.sum("n").over(Window.partitionBy("cluster_id").orderBy("year")))
    a = run.select("cluster_id", F.col("year").alias("start"), (F.col("upto") - F.col("n")).alias("before"))
    b = run.select("cluster_id", F.col("year").alias("end"), "upto")
    spans = a.join(b, "cluster_id").where(F.col("start") <= F.col("end")).join(targets, "cluster_id").withColumn("n", F.col("upto") - F.col("before"))
    best = spans.groupBy("cluster_id", "target_k").agg(F.min(F.struct(F.abs(F.col("n") - F.col("target_k")).alias("d"), "start", "end", "n")).alias("m"))
    return best.select("cluster_id", "target_k", "m.start", "m.end", "m.n")


def sub_cluster(members: DataFrame, ranges: DataFrame, seed: int = 0) -> DataFrame:
    """At most target_k entities of each cluster from its range of years, topped up from entities without a year."""
    rows = members.join(ranges, "cluster_id")
    inside = F.when(F.col("year").between(F.col("start"), F.col("end")), 0).when(F.col("year").isNull(), 1)
    picked = rows.withColumn("_c", inside).where("_c is not null").groupBy("cluster_id", "target_k", "entity").agg(F.min("_c").alias("_c"))
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("_c", hash_order(seed, "entity")))
    return picked.withColumn("_i", nth).where(F.col("_i") <= F.col("target_k")).select("cluster_id", "entity")


def k_validation(rows: DataFrame) -> DataFrame:
    """rows(query_id, target_k, actual_k, coverage) with the class of their difference and whether they are accepted."""
    d = F.abs(F.col("target_k") - F.col("actual_k"))
    kind = F.when(d == 0, "exact").when(d <= 2, "close").when(d <= 5, "moderate").otherwise("large")
    reason = F.when(F.col("actual_k") < 2, "too few").when(F.col("coverage") < 0.6, "low coverage").when(d > 5, "large difference").when(F.col("actual_k") > 25, "too many").otherwise("accepted")
    return rows.withColumns({"difference": kind, "reason": reason, "accepted": reason == "accepted"})


def k_report(checked: DataFrame, *by: str) -> DataFrame:
    return checked.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.avg(F.abs(F.col("target_k") - F.col("actual_k"))).alias("mean_difference"))


def k_alignment(target: Column, actual: Column, tolerance: int = 2, min_k: int = 2, max_k: int = 25) -> tuple[Column, Column]:
    """Within the bounds, and close to the target; the score falls with the distance."""
    d, inside = F.abs(target - actual), actual.between(min_k, max_k)
    far = 1 - d / F.when(target == 0, 1).otherwise(target)
    return inside & (d <= tolerance), F.when(~inside, 0.0).when(d > tolerance, far).otherwise(1 - d / (tolerance + 1))


def answerability(n_passages: Column, coverage_: Column, text: Column, min_coverage: float = 0.5, min_passages: int = 1) -> tuple[Column, Column]:
    """Enough passages, enough of the entities covered, and a question mark at the end."""
    asks = text.rlike(r"\?\s*$")
    ok = (n_passages >= min_passages) & (coverage_ >= min_coverage) & asks
    full = F.least(F.lit(1.0), (coverage_ + n_passages / 10) / 2)
    return ok, F.when(n_passages < min_passages, 0.0).when(coverage_ < min_coverage, coverage_).when(~asks, 0.5).otherwise(full)


def difficulty_fit(text: Column, difficulty: Column, strict: bool = False) -> tuple[Column, Column]:
    """How well length and indicator words go with the difficulty; only if strict, a poor fit fails."""
    low, n = F.lower(text), word_count(text)
    easy, hard = (reduce(lambda a, b: a | b, [low.contains(w) for w in ws]) for ws in (EASY_INDICATORS, HARD_INDICATORS))
    short, long = n < 12, n > 25
    plain, deep = short & easy, long | hard
    score = (
        F.when(difficulty == "easy", F.when(plain, 1.0).when(deep, 0.3).otherwise(0.7))
        .when(difficulty == "hard", F.when(deep, 1.0).when(plain, 0.3).otherwise(0.6))
        .otherwise(F.when(short | long, 0.6).otherwise(0.8))
    )
    return (score >= 0.4) | F.lit(not strict), score


def filtered(rows: DataFrame, filters: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Every filter on every row: passed and score for each, their mean, and the names of those that failed."""
    cols = {}
    for name, (ok, score) in filters.items():
        cols |= {f"{name}_ok": F.coalesce(ok, F.lit(False)), f"{name}_score": score}
    out = rows.withColumns(cols)
    scores = [F.col(f"{n}_score") for n in filters]
    return out.withColumns({"total_score": sum(scores[1:], scores[0]) / len(scores), "failed": F.array_compact(F.array(*(F.when(~F.col(f"{n}_ok"), n) for n in filters)))})


def filter_report(rows: DataFrame, names: list[str]) -> DataFrame:
    """A row for each filter, in order: failures, what is left when each filter's failures are subtracted, and how many
    rows pass all filters so far."""
    ok = lambda upto: reduce(lambda a, b: a & b, [F.col(f"{n}_ok") for n in names[: upto + 1]])
    one = rows.agg(F.count("*").alias("n"), *(F.count_if(~F.col(f"{n}_ok")).alias(f"f{i}") for i, n in enumerate(names)), *(F.count_if(ok(i)).alias(f"p{i}") for i in range(len(names))))
    left = lambda i: F.col("n") - reduce(lambda a, b: a + b, [F.col(f"f{j}") for j in range(i + 1)])
    stacked = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("filter"), F.col(f"f{i}").alias("n_failed"), left(i).alias("subtracted"), F.col(f"p{i}").alias("passed_so_far")) for i, n in enumerate(names)))
    return one.select(F.explode(stacked).alias("r")).select("r.*")


def diverse(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """rows(pos, text) with kept: in order of pos, a row goes if it is too similar to one that was kept, and so does one
    without text. Of rows with the same tokens only the first can be kept, so the rounds are over these: a row without an
    open or kept earlier neighbour is kept; one with a kept earlier neighbour goes; until all are settled, as each round
    settles the first open row of each chain at least. Each round is stored."""
    classes, _ = same_tokens(rows.where(F.col("text") != ""))
    pairs = stored(similar_classes(classes, threshold))
    firsts = classes.select(F.col("first").alias("pos"))
    state = stored(firsts.join(pairs.select(F.col("j").alias("pos")).distinct().withColumn("_open", F.lit(True)), "pos", "left").select("pos", F.when(F.col("_open").isNull(), True).alias("kept")))
    while not state.where("kept is null").isEmpty():
        earlier = pairs.join(state.select(F.col("pos").alias("i"), F.col("kept").alias("ki")), "i")
        seen = earlier.groupBy(F.col("j").alias("pos")).agg(F.max(F.coalesce("ki", F.lit(False))).alias("_hit"), F.max(F.col("ki").isNull()).alias("_wait"))
        state = stored(state.join(seen, "pos", "left").select("pos", F.coalesce("kept", F.when(F.col("_hit"), False).when(~F.col("_wait"), True)).alias("kept")))
    plain = F.coalesce(F.col("text") != "", F.lit(False)) & (F.size(question_tokens(F.col("text"))) == 0)  # nothing is similar to it
    return rows.join(state, "pos", "left").withColumn("kept", F.coalesce("kept", plain))


def _valid_text() -> Column:
    """The text of a valid row that has one."""
    return F.when(F.col("is_valid") & (F.col("text") != ""), F.col("text"))


def _valid_k() -> Column:
    """What k a valid row has: actual_k, the target where that is missing or 0; NULL if neither is above 0."""
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    k = F.coalesce(some("actual_k"), some("target_k"))
    return F.when(F.col("is_valid") & (k > 0), k)


def generation_metrics(rows: DataFrame) -> DataFrame:
    """One row on rows(text, is_valid, actual_k, target_k): rates over all rows; different texts, numbers of words and k of
    the valid ones. Without such rows means and bounds are 0."""
    text, k = _valid_text(), _valid_k()
    n, zero, none = F.when(text.isNotNull(), word_count(F.col("text"))), F.lit(0.0), F.lit(0)
    share = lambda x, of: F.coalesce(F.try_divide(x.cast("double"), of), zero)
    return rows.agg(
        F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"), share(F.count_if("is_valid"), F.count("*")).alias("valid_rate"), F.count_distinct(text).alias("n_unique"), share(F.count_distinct(text), F.count(text)).alias("unique_rate"),
        F.coalesce(F.avg(n), zero).alias("mean_words"), F.coalesce(F.min(n), none).alias("min_words"), F.coalesce(F.max(n), none).alias("max_words"),
        F.coalesce(F.avg(k), zero).alias("mean_k"), F.coalesce(F.min(k), none).alias("min_k"), F.coalesce(F.max(k), none).alias("max_k"), F.coalesce(F.percentile(k, F.lit(0.5)), zero).alias("median_k"),
    )


def openings(rows: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent first three words of valid texts."""
    first = F.array_join(F.slice(words(F.col("text")), 1, 3), " ")
    return rows.where(_valid_text().isNotNull()).groupBy(first.alias("opening")).agg(F.count("*").alias("n")).where("opening <> ''").orderBy(F.desc("n"), "opening").limit(k)


def question_types(rows: DataFrame) -> DataFrame:
    """(question_type, n): valid texts by the word that they begin with."""
    low = F.lower(F.trim("text"))
    kind = F.coalesce(*(F.when(low.startswith(w), w) for w in QUESTION_TYPES), F.lit("other"))
    return rows.where(_valid_text().isNotNull()).groupBy(kind.alias("question_type")).agg(F.count("*").alias("n"))


def by_k_range(ks: DataFrame, k: Column) -> DataFrame:
    """(k_range, n): how many rows lie in each range of k, also where none does; rows without k don't count."""
    each = [F.struct(F.lit(name).alias("k_range"), F.count_if(k_range(k) == name).alias("n")) for name in K_RANGES]
    return ks.where(k.isNotNull()).agg(F.array(*each).alias("_r")).select(F.inline("_r"))


def k_distribution(rows: DataFrame) -> DataFrame:
    """(k_range, n) of the valid rows."""
    return by_k_range(rows, _valid_k())


def generation_issues(rows: DataFrame, most: int = 3, short: int = 10) -> DataFrame:
    """rows(text, is_valid, errors array) -> (issue, severity, n, detail): few valid rows (under 0.8), few different texts
    (under 0.9), an opening of over a fifth and short texts of over a tenth of the valid ones, and the `most` most frequent
    errors of invalid rows that occur three times or more."""
    text = _valid_text()
    facts = rows.agg(F.count("*").alias("_n"), F.count_if("is_valid").alias("_v"), F.count(text).alias("_t"), F.count_distinct(text).alias("_u"), F.count_if(text.isNotNull() & (word_count(F.col("text")) < short)).alias("_s"))
    issue = lambda name, severity, n, detail="": F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), F.col(n).alias("n"), (F.col(detail) if detail else F.lit("")).alias("detail"))
    found = F.array_compact(F.array(
        F.when(F.col("_v") < 0.8 * F.col("_n"), issue("low_success_rate", "warning", "_v")),
        F.when(F.col("_u") < 0.9 * F.col("_t"), issue("low_uniqueness", "warning", "_u")),
        F.when(F.col("_s") > 0.1 * F.col("_t"), issue("short_queries", "info", "_s")),
    ))
    top = openings(rows, 1).crossJoin(F.broadcast(facts)).where(F.col("n") > 0.2 * F.col("_t"))  # one row each
    errors = rows.where("not coalesce(is_valid, false)").select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(most).where("n >= 3")
    return facts.select(F.inline(found)).union(top.select(F.inline(F.array(issue("repetitive_opening", "info", "n", "opening"))))).union(errors.select(F.inline(F.array(issue("common_error", "warning", "n", "error")))))


def stratified(rows: DataFrame, total: int, shares_k: dict[str, float], shares_d: dict[str, float], types: list[str]) -> DataFrame:
    """rows(query_id, k, difficulty, cluster_type, total_score): of each cell of K range and difficulty its target, round
    robin over the cluster types, best score first; other types are never picked where a cell is over-full, nor are rows of
    another range or difficulty."""
    lookup = lambda col, shares: F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(v))))[col]
    cell = rows.withColumn("k_range", k_range(F.col("k")))
    share = F.lit(total) * lookup(F.col("k_range"), shares_k) * lookup(F.col("difficulty"), shares_d)
    target = F.when(share.isNotNull(), F.greatest(F.lit(1), share.cast("int")))
    w = Window.partitionBy("k_range", "difficulty")
    order = F.array_position(F.array(*map(F.lit, types)), F.col("cluster_type"))
    turn = F.row_number().over(Window.partitionBy("k_range", "difficulty", "cluster_type").orderBy(F.desc("total_score"), "query_id"))
    nth = cell.withColumns({"target": target, "_n": F.count("*").over(w), "_t": order, "_turn": turn}).where((F.col("_n") <= F.col("target")) | (F.col("_t") > 0))
    return nth.withColumn("_i", F.row_number().over(w.orderBy("_turn", "_t", "query_id"))).where(F.col("_i") <= F.col("target")).drop("_n", "_t", "_turn", "_i")


def shortfalls(selected: DataFrame, total: int, shares_k: dict[str, float], shares_d: dict[str, float]) -> DataFrame:
    """Cells of which fewer rows were selected than their target: (k_range, difficulty, target, selected, shortfall)."""
    wanted = [F.struct(F.lit(k).alias("k_range"), F.lit(d).alias("difficulty"), F.lit(max(1, int(total * x * y))).alias("target"), F.count_if((F.col("k_range") == k) & (F.col("difficulty") == d)).alias("selected")) for k, x in shares_k.items() for d, y in shares_d.items()]
    cells = selected.agg(F.array(*wanted).alias("_c")).select(F.inline("_c"))
    return cells.where("selected < target").withColumn("shortfall", F.col("target") - F.col("selected"))


def selection_summary(selected: DataFrame, total: int) -> DataFrame:
    """One row: how many were wanted and selected, of how many clusters, and their mean score."""
    n = F.count("*")
    return selected.agg(F.lit(total).alias("total_target"), n.alias("n_selected"), (n / total).alias("selection_rate"), F.count_distinct("cluster_id").alias("n_clusters"), F.coalesce(F.avg("total_score"), F.lit(0.0)).alias("mean_score"))


def assembled(passages: DataFrame, qrels: DataFrame, sparsity: float = 0.02, hard: float = 0.15, seed: int = 0) -> DataFrame:
    """Relevant passages, and others up to a share of relevant ones of `sparsity`; `hard` of them are flagged: (passage_id,
    kind). Both kinds are drawn from one hash order, so they are disjoint."""
    rel = passages.join(qrels.select("passage_id").distinct(), "passage_id", "left_semi").select("passage_id")
    n = rel.count()
    negatives = max(0, int(n / sparsity) - n)
    rest = passages.join(rel, "passage_id", "left_anti").select("passage_id").orderBy(hash_order(seed, "passage_id"), "passage_id").limit(negatives)
    edge = rest.orderBy(hash_order(seed, "passage_id"), "passage_id").limit(int(negatives * hard)).withColumn("_h", F.lit(True))
    flagged = rest.join(edge, "passage_id", "left").select("passage_id", F.when(F.col("_h"), "hard").otherwise("random").alias("kind"))
    return rel.withColumn("kind", F.lit("relevant")).union(flagged)


def qrels_of(mapped: DataFrame) -> DataFrame:
    """mapped(query_id, entity, passage_id) -> (query_id, passage_id, relevance, entity), without entities that have none."""
    return mapped.where("passage_id is not null").select("query_id", "passage_id", F.lit(1).alias("relevance"), "entity")


def passages_per_query(asked: DataFrame, mapped: DataFrame) -> DataFrame:
    """(query_id, n): how many passages each query of asked has, 0 where it has none."""
    n = mapped.groupBy("query_id").agg(F.count("passage_id").alias("_n"))
    return asked.select("query_id").distinct().join(n, "query_id", "left").select("query_id", F.coalesce("_n", F.lit(0)).alias("n"))


def corpus_statistics(corpus: DataFrame, per_query: DataFrame) -> DataFrame:
    """One row: passages of assembled() by kind, the share of relevant ones, and the spread of passages_per_query()."""
    kinds = corpus.agg(F.count("*").alias("n_passages"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("relevant", "hard", "random")))
    spread = per_query.agg(*(F.coalesce(f, F.lit(0.0)).alias(f"{name}_per_query") for name, f in (("mean", F.avg("n")), ("min", F.min("n")), ("max", F.max("n")), ("median", F.percentile("n", F.lit(0.5))))))
    return kinds.withColumn("sparsity", F.coalesce(F.try_divide(F.col("n_relevant").cast("double"), "n_passages"), F.lit(0.0))).crossJoin(spread)  # one row each


def split(rows: DataFrame, by: str, train: float = 0.7, dev: float = 0.15, seed: int = 0) -> DataFrame:
    """rows with split: whole groups of `by` go to train, dev or test, in hash order, cut at int(n * share). The groups are
    numbered in one window: they are clusters, not rows."""
    groups = rows.select(by).distinct()
    n = F.count("*").over(Window.partitionBy())
    nth = groups.withColumns({"_n": n, "_i": F.row_number().over(Window.orderBy(hash_order(seed, by)))})
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * train) + F.floor(F.col("_n") * dev)
    named = nth.select(by, F.when(F.col("_i") <= a, "train").when(F.col("_i") <= b, "dev").otherwise("test").alias("split"))
    return rows.join(named, by)


def counts_by(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Independent counts by each dimension, in one pass: (dimension, value, n)."""
    stacked = rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("x"))
    return stacked.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def bucket_coverage(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes(cluster_id, n), targets(bucket, lo, hi, target): clusters in each bucket against its target."""
    inside = sizes.crossJoin(F.broadcast(targets)).where(F.col("n").between(F.col("lo"), F.col("hi")))  # a few target rows
    have = inside.groupBy("bucket").agg(F.count("*").alias("have"))
    return targets.join(have, "bucket", "left").select("bucket", "target", F.coalesce("have", F.lit(0)).alias("have"), F.greatest(F.lit(0), F.col("target") - F.coalesce("have", F.lit(0))).alias("gap"))


def type_consistency(members: DataFrame, types: DataFrame, allowed: DataFrame) -> DataFrame:
    """members(cluster_id, entity), types(entity, type), allowed(type): the dominant type's share and outliers."""
    typed = members.join(types, "entity", "left").join(allowed.withColumn("_ok", F.lit(1)), "type", "left")
    by = typed.groupBy("cluster_id", "type").agg(F.count("*").alias("n"), F.max("_ok").alias("_ok"))
    out = by.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.max_by("type", F.struct("n", "type")).alias("dominant"), F.max(F.when(F.col("type").isNotNull(), F.col("n"))).alias("n_dominant"), F.sum(F.when(F.col("_ok").isNull() & F.col("type").isNotNull(), F.col("n")).otherwise(0)).alias("n_outliers"))
    share, outliers = F.col("n_dominant") / F.col("n"), F.col("n_outliers") / F.col("n")
    return out.withColumns({"share": share, "valid": (share >= 0.7) & (outliers <= 0.1)})


def type_counts(members: DataFrame, types: DataFrame) -> DataFrame:
    """(cluster_id, type, n): how many entities of a cluster have each type; entities without a type don't count."""
    return members.join(types.where("type is not null").distinct(), "entity").groupBy("cluster_id", "type").agg(F.count("*").alias("n"))


def consistency_report(consistent: DataFrame) -> DataFrame:
    """One row on type_consistency(): clusters, how many are valid, and their mean share of the dominant type."""
    return consistent.agg(F.count("*").alias("n_clusters"), F.count_if("valid").alias("n_valid"), F.coalesce(F.avg(F.coalesce("valid", F.lit(False)).cast("double")), F.lit(0.0)).alias("valid_rate"), F.coalesce(F.avg(F.coalesce("share", F.lit(0.0))), F.lit(0.0)).alias("mean_share"))


def consistency_warnings(consistent: DataFrame) -> DataFrame:
    """(cluster_id, share, n_outliers, warnings): clusters of type_consistency() that aren't valid, and why."""
    why = F.array_compact(F.array(F.when(~(F.coalesce("share", F.lit(0.0)) >= 0.7), "low consistency"), F.when(F.col("n_outliers") > 0.1 * F.col("n"), "many outliers")))
    return consistent.where("not coalesce(valid, false)").select("cluster_id", "share", "n_outliers", why.alias("warnings"))


def reconciled(expected: DataFrame, verified: DataFrame) -> DataFrame:
    """Entities expected of each query against those that were verified."""
    e, v = expected.distinct().withColumn("_e", F.lit(1)), verified.distinct().withColumn("_v", F.lit(1))
    by = e.join(v, ["query_id", "entity"], "full").groupBy("query_id").agg(F.count("_e").alias("n_expected"), F.count("_v").alias("n_verified"), F.count_if(F.col("_v").isNull()).alias("n_missing"), F.count_if(F.col("_e").isNull()).alias("n_extra"))
    d = F.col("n_missing") + F.col("n_extra")
    return by.withColumn("band", F.when(d == 0, "exact").when(d <= 2, "close").when(d <= 5, "moderate").otherwise("large"))


def allocation(clusters: DataFrame, targets: DataFrame, shares: DataFrame) -> DataFrame:
    """clusters(cluster_id, type, bucket), targets(bucket, target), shares(type, share): queries to make of each cluster."""
    n = F.count("*").over(Window.partitionBy("type", "bucket"))
    rows = clusters.withColumn("_n", n).join(targets, "bucket").join(shares, "type")
    each = F.least(F.lit(4), F.greatest(F.lit(1), F.floor((F.col("target") * F.col("share")).cast("int") / F.col("_n"))))
    return rows.select("cluster_id", "type", "bucket", each.cast("int").alias("n_queries"))


def k_profile(sizes: DataFrame, wanted: list[tuple[str, int, int]]) -> DataFrame:
    """sizes(cluster_id, n): suitability for each kind of query (name, lo, hi): 1 inside its range, falling beyond it."""
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in wanted)))
    rows = sizes.select("cluster_id", "n", kinds.alias("w"))
    away = F.greatest(F.lit(0), F.col("w.lo") - F.col("n"), F.col("n") - F.col("w.hi"))
    return rows.select("cluster_id", "n", F.col("w.kind").alias("kind"), F.greatest(F.lit(0.0), 1 - away / F.col("w.hi")).alias("score"))


def select_entities(triples: DataFrame, having: list[tuple[str, str]], has: list[str] = (), years: tuple[int, int] | None = None, at_least: tuple[str, float] | None = None, at_most: tuple[str, float] | None = None) -> DataFrame:
    """Entities of triples(entity, property, value, year) that meet all constraints: property and value, any value of a
    property, a year within a range, a number of at least or at most so much. One pass: a triple has a bit for each
    constraint that it meets, and an entity must have all. Rows without entity are left out."""
    number = F.col("value").try_cast("double")
    conditions = [(F.col("property") == p) & (F.col("value") == v) for p, v in having] + [F.col("property") == p for p in has]
    if years:
        conditions.append(F.col("year").between(*years))
    bounds: dict[str, Column] = {}  # one number must lie within both bounds of its property
    for bound, inside in ((at_least, number.__ge__), (at_most, number.__le__)):
        if bound:
            bounds[bound[0]] = bounds.get(bound[0], F.col("property") == bound[0]) & inside(bound[1])
    conditions += bounds.values()
    met = reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, 1 << i).otherwise(0).cast("long") for i, c in enumerate(conditions)), F.lit(0).cast("long"))
    by = triples.where("entity is not null").groupBy("entity").agg(F.bit_or(met).alias("_met"))
    return by.where(F.col("_met") == (1 << len(conditions)) - 1).select("entity")


def top_by_property(triples: DataFrame, ranking: str, n: int, descending: bool = True, among: DataFrame | None = None) -> DataFrame:
    """(entity, value): the n entities with the greatest (or least) number of a property, of those in among(entity) if it is
    given; an entity counts with its best number, ties go to the smaller entity. Other values are no numbers and don't count."""
    number = F.col("value").try_cast("double")
    rows = triples.where((F.col("property") == ranking) & number.isNotNull() & ~F.isnan(number) & F.col("entity").isNotNull())
    best = rows.groupBy("entity").agg((F.max if descending else F.min)(number).alias("value"))
    if among is not None:
        best = best.join(among.select("entity").distinct(), "entity", "left_semi")
    return best.orderBy(F.desc("value") if descending else F.asc("value"), "entity").limit(n)


def article_coverage(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: how many of entities(entity) have an article with text in articles(entity, text)."""
    have = articles.where(F.trim("text") != "").select("entity").distinct().withColumn("_has", F.lit(1))
    rows = entities.select("entity").distinct().join(have, "entity", "left")
    found = F.count("_has")
    return rows.agg(F.count("*").alias("n_entities"), found.alias("n_covered"), F.coalesce(F.try_divide(found.cast("double"), F.count("*")), F.lit(0.0)).alias("coverage"))


def intersections(triples: DataFrame, p1: str, p2: str, p3: str, lo: int = 5, hi: int = 50) -> DataFrame:
    """Combinations of the values of three properties that between lo and hi entities share."""
    side = lambda p, name: triples.where(F.col("property") == p).select("entity", F.col("value").alias(name)).distinct()
    rows = side(p1, "v1").join(side(p2, "v2"), "entity").join(side(p3, "v3"), "entity")
    return rows.groupBy("v1", "v2", "v3").agg(F.count_distinct("entity").alias("n")).where(F.col("n").between(lo, hi))
