"""Periodic runs of words: stretches that repeat a block of q words at least four times.

A word is a maximal match of [^\\x20\\x09-\\x0D]+; words are numbered from 0. A run is a stretch of consecutive words whose
smallest period is q and that no neighbouring word extends, of at least max(6, 4 q) words.

Scale-tiled distribution. For each octave of periods [P, 2 P), P = 1, 2, 4, ... <= n / 4, a document's words are cut into
tiles of max(8 P, 4096) words with margins of P words before and 8 P after. Anchors stand at all multiples of P: every run
of the octave has an anchor with at least 2 q words of the equality of words q apart after it, and at most P of them
before. Where a run goes on over tiles, the margins make the parts that neighbouring tiles find overlap or touch, and parts
of different runs of one period never do, so joining them is exact.

A tile can hold a run only if at some anchor all of the next 2 P words come again within less than 2 P words, and the first
words do so at one distance; this is checked for all anchors at once, and only tiles that may hold a run are sent out as
rows, dealt by document, octave and place. A tile is solved by itself: the Z-function of the 8 P words at an anchor gives
the period q in the octave whose equality lasts for 2 q words. There is at most one without a smaller period (Fine and
Wilf); that it has none is read off the same Z-function: no smaller shift may agree over q words. The equality is then
followed to the tile's ends, and anchors that lie 2 q words before its end are passed over. Fragments are shuffled by
document and period, joined where they overlap or touch, and those long enough are the runs. They meet their document's
text again (texts without candidate tiles aren't shuffled) for the digests.

NULL and empty texts, and such of white space only, have no words and no run. Rows without doc_id and rows that repeat are
documents each. A run list of a document has fewer runs than the document has words. Texts of any length go through whole;
the tiles of a long one are spread over tasks, but the widest tile of the last octave may be as long as the document.
Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch, slices

TILE = 4096
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FOUND = "row long, doc_id long, text string, p int, at long, words array<int>, runs_sha256 string, collapsed_sha256 string"


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    of: dict[bytes, int] = {}
    return np.fromiter((of.setdefault(w, len(of)) for w in words), np.int32, len(words))


def next_distance(ids: np.ndarray) -> np.ndarray:
    """How many words later each word comes again; the number of words if it doesn't."""
    out = np.full(len(ids), len(ids), np.int64)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def candidate_anchors(ids: np.ndarray, soon: np.ndarray, p: int) -> np.ndarray:
    """Multiples of p at which a run with a period in [p, 2 p) may hold: the next 2 p words come again within less than 2 p
    words, and the words at the anchor and half of p, p - 1 and 2 p - 1 later do so at one distance in the octave."""
    n = len(ids)
    late = np.concatenate([[0], np.cumsum(soon >= 2 * p)])
    anchors = np.arange(0, n - 3 * p + 1, p)
    anchors = anchors[late[anchors + 2 * p] == late[anchors]]
    if len(anchors) <= p:
        return np.array([a for a in anchors.tolist() if len(_distances(ids, a, p))], np.int64)
    fits = np.zeros(len(anchors), bool)
    for q in range(p, 2 * p):
        ok = np.flatnonzero(~fits & (anchors + 3 * q <= n))
        for j in {0, 1, p // 2, p - 1, 2 * p - 1}:
            ok = ok[ids[anchors[ok] + j] == ids[anchors[ok] + j + q]]
        fits[ok] = True
    return anchors[fits]


def _distances(ids: np.ndarray, a: int, p: int) -> np.ndarray:
    q = p + np.flatnonzero(ids[a + p : a + 2 * p] == ids[a])
    q = q[a + 3 * q <= len(ids)]
    for j in (1, p // 2, p - 1, 2 * p - 1):
        q = q[ids[a + j] == ids[a + j + q]]
    return q


def tiles(ids: np.ndarray):
    """(p, first word, words) of the tiles that may hold a run."""
    n = len(ids)
    if n < 6:
        return
    soon, p = next_distance(ids), 1
    while 4 * p <= n:
        stride = max(8 * p, TILE)
        for t in np.unique(candidate_anchors(ids, soon, p) // stride * stride).tolist():
            lo = max(0, t - p)
            yield p, lo, ids[lo : t + stride + 8 * p]
        p *= 2


def z_function(w: list[int]) -> list[int]:
    """For each i, how many words from i on equal those from 0 on."""
    n, left, right = len(w), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def primitive_period(w: np.ndarray, p: int) -> int:
    """The q in [p, 2 p) such that words q apart agree for 2 q words from the first on, if no smaller period does as much; 0
    if there is none."""
    d = next(iter(np.flatnonzero(w[1:] == w[0]).tolist()), -1) + 1
    if 0 < d < p and len(w) >= 3 * p and (w[: 2 * p] == w[d : 2 * p + d]).all():
        return 0  # the commonest smaller period: all q of the octave would repeat it
    z = z_function(w.tolist())
    most = max(z[1:p], default=0)
    for q in range(p, min(2 * p, len(w))):
        if z[q] >= 2 * q:
            return q if most < q else 0
        most = max(most, z[q])
    return 0


def solve(p: int, words: np.ndarray, at: int) -> list[tuple[int, int, int]]:
    """(period, from, to) of the stretches in which words of a tile equal those a period later, numbered within the
    document; at: the tile's first word."""
    n, found, past, skip = len(words), [], -1, -at % p
    for a in (skip + candidate_anchors(words[skip:], next_distance(words[skip:]), p)).tolist():
        if a < past:
            continue
        q = primitive_period(words[a : a + 8 * p], p)
        if q:
            differ = np.flatnonzero(words[:-q] != words[q:])
            i = np.searchsorted(differ, a)
            lo = int(differ[i - 1]) + 1 if i else 0
            hi = int(differ[i]) if i < len(differ) else n - q
            found.append((q, at + lo, at + hi))
            past = hi - 2 * q
    return found


def digests(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """RESULT of a document's runs (start, length, period) in order."""
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, listed, hashlib.sha256(b" ".join(words)).hexdigest()
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    gone = np.cumsum(change[:-1]) > 0
    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
    return len(runs), *best, 1000 * best[1] // best[2], listed, hashlib.sha256(kept).hexdigest()


def _explode(batches):
    """Documents without candidate tiles as their result; others as a row with the text and a row for each tile."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("p", pa.int32()), ("at", pa.int64()), ("words", pa.list_(pa.int32())), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    for batch in batches:
        texts = batch.column("text")
        for at, to in slices(texts):
            rows, size = [], 0
            for row, doc, text in zip(batch.column("row")[at:to].to_pylist(), batch.column("doc_id")[at:to].to_pylist(), texts[at:to], strict=True):
                text = text.as_py()
                words = (text or "").encode().split()
                any_ = False
                for p, first, part in tiles(numbered(words)):
                    rows.append((row, None, None, p, first, numbered(part.tolist()), None, None))
                    any_, size = True, size + len(part)
                    if size > 1 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                rows.append((row, doc, text, None, None, None, None, None) if any_ else (row, doc, None, None, None, None, *digests(words, [])[5:]))
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _solve_tiles(batches):
    for batch in batches:
        out = []
        for row, p, at, words in zip(*(batch.column(c) for c in ("row", "p", "at")), batch.column("words"), strict=True):
            out += [(row.as_py(), *x) for x in solve(p.as_py(), words.values.to_numpy(), at.as_py())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "period", "lo", "hi"])


def _digest_texts(batches):
    for batch in batches:
        out = []
        for doc, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            out.append((doc, *digests((text.as_py() or "").encode().split(), [(r["start"], r["length"], r["period"]) for r in runs or []])))
        if out:
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", *(c.split()[0] for c in RESULT.split(", "))])


def runs_of(tiles: DataFrame) -> DataFrame:
    """tiles(row, p, at, words) -> (row, start, length, period): the runs, joined over tiles."""
    parts = tiles.repartition("row", "p", "at").mapInArrow(_solve_tiles, "row long, period long, lo long, hi long")
    w = Window.partitionBy("row", "period").orderBy("lo", "hi")
    reach = parts.withColumn("reach", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    joined = reach.withColumn("nth", F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(w))
    whole = joined.groupBy("row", "period", "nth").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("period")).alias("length"))
    return whole.where("length >= greatest(6, 4 * period)").select("row", "start", "length", "period")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id and RESULT, a row for each row of docs: the number of runs; the one with the most
    repetitions (ties: smallest start, then period); SHA-256 of the list of runs and of the text without the repetitions."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.keep(rows.mapInArrow(_explode, FOUND), "periodic-tiles")
    runs = runs_of(found.where("p is not null").select("row", "p", "at", "words"))
    of = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = found.where("p is null and collapsed_sha256 is null").select("row", "doc_id", "text")
    digested = texts.join(of, "row", "left").select("doc_id", "text", "runs").mapInArrow(_digest_texts, f"doc_id long, {RESULT}")
    none = F.lit(None).cast("long")
    plain = found.where("collapsed_sha256 is not null").select("doc_id", F.lit(0).cast("long").alias("n_runs"), *(none.alias(c) for c in ("start", "length", "period", "exponent_milli")), "runs_sha256", "collapsed_sha256")
    return plain.unionByName(digested)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """The query's contract: of documents with crc32(doc_id) % 10 = 0, the words from a on repeat the p words at a."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    asked = docs.select("doc_id", "text").withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_g", F.floor(h / 10).cast("long")).withColumn("_n", F.size("_words"))
    a = F.expr("_g % _n")
    p = F.expr("1 + (_n - _g % _n) div (3 + _g % 8)")
    planted = asked.withColumns({"_a": F.when(F.col("_n") > 0, a), "_p": F.when(F.col("_n") > 0, p)})
    text = F.expr("array_join(transform(sequence(0, _n - 1), i -> _words[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]), ' ')")
    return planted.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))
