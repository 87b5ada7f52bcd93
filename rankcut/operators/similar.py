"""Questions whose sets of tokens are alike: pairs with a Jaccard similarity above a threshold, exactly.

Rows with the same tokens are one class, of which the first row stands for all. Classes meet on a token of both prefixes:
the rarest tokens of each, as many as a pair above the threshold can't avoid, and only where the places of the token leave
room for enough common ones. A token that very many classes hold is no meeting point by itself: in prefixes longer by one
a pair above the threshold shares two tokens, so such a token meets together with another one. Where classes meet, sketches
of a fixed size leave out pairs that surely differ in too many tokens, before any of the tokens travel. All tokens decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankcut.sources.checkpoints import stored

#: Words that don't count when questions are compared (fixed values).
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "that", "this", "with", "by"]

#: Tokens are counted in so many hashed slots, to take the rarest first: any order serves that is the same for all classes.
SLOTS = 1 << 20
#: Bits of a sketch: a token turns over one of them, so two sketches differ in no more bits than their classes in tokens.
BITS = 256


def question_tokens(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), 1))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def same_tokens(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(pos, text) -> ((t, h, first), (pos, first)): each set of tokens, their hashes and the first row that has it, and
    all rows with theirs. Rows without tokens are left out. Texts are split once and stored."""
    tokens = rows.select("pos", F.sort_array(question_tokens(F.col("text"))).alias("t"))
    tokens = tokens.select("pos", "t", F.transform("t", lambda w: F.xxhash64(w)).alias("h"), F.sha2(F.array_join("t", " "), 256).alias("key"))
    tokens = stored(tokens).where(F.size("t") > 0)
    firsts = stored(tokens.groupBy("key").agg(F.min("pos").alias("first")))
    return stored(tokens.join(firsts.select(F.col("first").alias("pos"), "first"), "pos").select("t", "h", "first")), tokens.select("pos", "key").join(firsts, "key").select("pos", "first")


SKETCH = [f"s{k}" for k in range(BITS // 64)]


def _prefixes(threshold: float, ranked: tuple, hot: int):
    """For mapInArrow over (first, h): meeting points (key, first, n, i, sketch), i the place of the token among the class's n.
    ranked: how often the tokens of each slot come."""

    def prefixes(batches):
        for batch in batches:
            lists = batch.column("h")
            n = np.diff(lists.offsets.to_numpy())
            row, h = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy()
            turned = np.bincount(row * BITS + (h >> 32) % BITS, minlength=len(n) * BITS).astype(np.uint8) & 1
            sketch = np.packbits(turned.reshape(-1, BITS), axis=1).view(np.int64)
            times = ranked[h % len(ranked)]
            order = np.lexsort((h, times, row))
            h, times = h[order], times[order]
            start = np.cumsum(n) - n
            i, need = np.arange(len(h)) - start[row], np.ceil(threshold * n - 1e-9).astype(np.int64)
            inside = i < (n - need + 1)[row]
            paired = inside & (times > hot) & (need >= 2)[row]
            single = np.flatnonzero(inside & ~paired)
            keys, rows, places = [h[single].view(np.uint64)], [row[single]], [i[single]]
            for x in np.flatnonzero(paired).tolist():
                r = row[x]
                others = np.arange(start[r], start[r] + min(n[r], n[r] - need[r] + 2))
                a, b = np.minimum(h[x], h[others[others != x]]).view(np.uint64), np.maximum(h[x], h[others[others != x]]).view(np.uint64)
                keys.append((a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b)
                rows.append(np.full(len(a), r))
                places.append(np.zeros(len(a), np.int64))
            row = np.concatenate(rows)
            columns = [pa.array(np.concatenate(keys).view(np.int64)), batch.column("first").take(pa.array(row)), pa.array(n[row], pa.int32()), pa.array(np.concatenate(places), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x[row]) for x in sketch.T)], ["key", "first", "n", "i", *SKETCH])

    return prefixes


def similar_classes(classes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """classes(t, h, first), threshold from 0.5 to under 1 -> (i, j), i < j: the pairs of classes above it. Hashes of tokens
    leave out what has too few in common before the tokens themselves are compared."""
    hashed = classes.select("first", "h")
    slot = F.pmod("h", F.lit(SLOTS)).alias("slot")
    counts = hashed.select(F.explode("h").alias("h")).groupBy(slot).agg(F.count("*").alias("times")).toPandas()  # SLOTS rows at most
    ranked = np.zeros(SLOTS, np.int64)
    ranked[counts.slot.to_numpy(np.int64)] = counts.times
    hot = max(1000, int(ranked.sum()) // 65_536)
    kind = classes.schema["first"].dataType.simpleString()
    points = hashed.mapInArrow(_prefixes(threshold, ranked, hot), f"key long, first {kind}, n int, i int, " + ", ".join(f"{x} long" for x in SKETCH))
    side = lambda s: points.select("key", F.col("first").alias(s), *(F.col(x).alias(f"{x}{s}") for x in ("n", "i", *SKETCH)))
    room = 1 + F.least(F.col("ni") - F.col("ii"), F.col("nj") - F.col("ij")) - 1 >= (F.col("ni") + F.col("nj")) * (threshold / (1 + threshold))
    apart = sum(F.bit_count(F.col(f"{x}i").bitwiseXOR(F.col(f"{x}j"))) for x in SKETCH)
    meet = side("i").join(side("j"), "key").where((F.col("i") < F.col("j")) & (F.least("ni", "nj") >= F.greatest("ni", "nj") * threshold) & room & (apart <= (F.col("ni") + F.col("nj")) * ((1 - threshold) / (1 + threshold)) + 1e-6)).select("i", "j").distinct()
    of = lambda df, x, t: df.select(F.col("first").alias(x), F.col(t).alias(f"{t}{x}"))
    least = F.ceil((F.size("hi") + F.size("hj")) * (threshold / (1 + threshold)) - 1e-6)
    near = meet.join(of(hashed, "i", "h"), "i").join(of(hashed, "j", "h"), "j").where(F.size(F.array_intersect("hi", "hj")) >= least).select("i", "j")
    both = near.join(of(classes, "i", "t"), "i").join(of(classes, "j", "t"), "j")
    shared = F.size(F.array_intersect("ti", "tj"))
    return both.where(shared / (F.size("ti") + F.size("tj") - shared) > threshold).select("i", "j")


def similar_pairs(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """rows(pos, text) -> (i, j), i < j: all pairs above the threshold, from 0.5 to under 1, rows with the same tokens too.
    Rows without tokens are similar to none."""
    classes, of = same_tokens(rows)
    side = lambda s: of.select(F.col("first").alias(f"f{s}"), F.col("pos").alias(s))
    same = side("i").join(side("j"), F.col("fi") == F.col("fj")).where("i < j").select("i", "j")
    pairs = stored(similar_classes(classes, threshold)).select(F.col("i").alias("fi"), F.col("j").alias("fj"))
    across = pairs.join(side("i"), "fi").join(side("j"), "fj").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return same.union(across)
