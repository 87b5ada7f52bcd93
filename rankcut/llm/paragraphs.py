"""Repeated passages: paragraphs that stand, alike or nearly so, in several documents; all but the first are removed.

Passages are put into texts anywhere, also amid a line, so a paragraph here is a run of `size` words or more, wherever
lines begin. A MinHash of a run of `size` words is the least hash of its five-word shingles. Runs that follow each other
mostly have the same one; they are one row, placed where that shingle stands (its anchor): about 2 rows for each `size`
words and band. Bands have one row each, as many as the wanted recall at the threshold takes; equal runs always collide.

Candidates. In a bucket of several documents each anchor goes with the first document's. Anchors of one document pair on
one diagonal and within BLOCK words are one span, so that near copies of whole documents are few rows. Only words around
spans are gathered from the texts (documents go through that shuffle once).

Verification. Of both sides of a span, the shingles that the other side has are marked; the part with the greatest sum of
matches less misses is the paragraph, its counterpart likewise, and the two are a repeated passage if the exact Jaccard
similarity of their shingle sets is at least the threshold and both have at least `size` words. If the whole part isn't
alike enough, a stricter part and all runs of equal words are tried.

Anchors that the first document of their bucket does not settle, and the places where a first document has its shingle
again, meet once more under finer keys: bucket and the exact words around (windows of `size` words that begin 0, 5, 10, ...
words before the anchor, and the ten words on either side). The first document of each finer bucket is verified likewise.
So documents that share at least size + 4 equal words are found, whatever else their buckets hold, and no bucket is
compared pair by pair.

Clusters are the components of verified passages; overlapping passages of a document are one node. A passage is removed
where an earlier document has it, so what stands in the first document of a cluster stays.

Words are those of `words`. Rows with null text or doc_id take no part. A passage of fewer than `size` words is none, so
shorter documents and lines have none. Rows with the same doc_id count as one document. Ties (the least doc_id, then the
least place) are fixed. An empty table gives an empty result. Texts of any length are gone through whole, in blocks. Other
columns are ignored, and kept by remove_repeats.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch, connected, mixed, slices, unused
from rankcut.llm.words import PLACES, plain, shingles, word_hashes

SHINGLE = 5
BLOCK = 1024  # words of a span at most, besides those around it
GRAIN = 32  # ranges of words of first documents begin and end at multiples of it, so that many spans share them
PIECE = 1 << 22  # shingles gone through at a time


def tuned_bands(threshold: float, recall: float) -> int:
    """The fewest bands of one row that give a pair at the threshold this chance to meet."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold) - 1e-9)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least value of each n values in a row."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def anchors(h: np.ndarray, bounds: np.ndarray, size: int, bands: int):
    """(bucket, text, word) of all anchors. Of one shingle that stands again and again, the first and the last in each 32
    words: each run of `size` words has one of them."""
    n = size - SHINGLE + 1
    s, first, sb = shingles(h, bounds, SHINGLE)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(sb))
    starts = np.zeros(len(s) + 1, np.int32)  # where a run of n shingles lies in one text
    whole = np.diff(sb) >= n
    np.add.at(starts, sb[:-1][whole], 1)
    np.add.at(starts, (sb[1:] - n + 1)[whole], -1)
    ok = np.cumsum(starts)[: max(len(s) - n + 1, 0)] > 0
    out = []
    for band in range(bands):
        x = mixed(s + np.uint64(band * 0x9E3779B9))
        picked = []
        for at in range(0, len(ok), PIECE):
            part, live = x[at : at + PIECE + n - 1], ok[at : at + PIECE]
            if live.any():
                least = sliding_least(part & np.uint64(0xFFFFFFFFFF000000) | np.arange(len(part), dtype=np.uint64), n)[live]
                picked.append(np.unique(least & np.uint64(0xFFFFFF)).astype(np.int64) + at)
        if picked:
            at = np.unique(np.concatenate(picked))
            word = first[at] - bounds[owner[at]]
            key = x[at] ^ mixed((owner[at] << 32 | word >> 5).astype(np.uint64))
            order = np.argsort(key, kind="stable")
            new = np.ones(len(at) + 1, bool)
            new[1:-1] = key[order[1:]] != key[order[:-1]]
            keep = np.sort(order[new[:-1] | new[1:]])
            out.append((x[at[keep]] + np.uint64(band), owner[at[keep]], word[keep]))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def best_part(hit: np.ndarray, owner: np.ndarray, bounds: np.ndarray, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """For each slice of flags: from and to of the part with the greatest sum, a hit 1 and another -miss; empty slices and
    those without a hit give from = to."""
    n = len(bounds) - 1
    lo, hi = bounds[:-1].copy(), bounds[:-1].copy()
    if not len(hit):
        return lo, hi
    total = np.cumsum(np.where(hit, 1.0, -miss))
    before = np.concatenate([[0.0], total[:-1]])
    step = 4.0 * (np.abs(total).max() + 1)  # later slices lie lower, so that the running least begins anew
    low = np.minimum.accumulate(before - owner * step) + owner * step
    gain = total - low
    some = np.flatnonzero(np.diff(bounds) > 0)
    top = np.full(n, -1.0)
    top[some] = np.maximum.reduceat(gain, bounds[some])
    at = np.flatnonzero(gain >= top[owner] - 1e-9)
    at = at[np.unique(owner[at], return_index=True)[1]]  # the first end with that sum
    at = at[top[owner[at]] > 0]
    # the last start with the least sum before it
    begins = np.maximum.accumulate(np.where(before <= low + 1e-9, np.arange(len(hit)), -1))
    lo[owner[at]], hi[owner[at]] = begins[at], at + 1
    return lo, hi


def keyed(s: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mixed(s ^ (owner.astype(np.uint64) + np.uint64(1)) * PLACES[7])


def slices_of(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a binary column in a row, bounds of each row); null counts as empty."""
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return flat, (offsets - offsets[0]) // np.dtype(kind).itemsize


def gathered_rows(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """A binary column of the slices lo to hi of an array."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(n) else 0) + np.repeat(lo - (ends - n), n)
    offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def flat_shingles(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, slice, bounds) of slices of word hashes, told apart by slice."""
    size = np.diff(bounds)
    h = mixed(words)
    count = np.maximum(size - SHINGLE + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(size)), count)
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], count)
    s = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        s += h[at + k] * PLACES[k]
    return keyed(s, owner), owner, out


def jaccard(a: np.ndarray, oa: np.ndarray, b: np.ndarray, ob: np.ndarray, n: int) -> np.ndarray:
    """Exact Jaccard similarity of the sets of keyed shingles of each of n slices; 0 where both are empty."""
    ka, ia = np.unique(a, return_index=True)
    kb, ib = np.unique(b, return_index=True)
    na, nb = np.bincount(oa[ia], minlength=n), np.bincount(ob[ib], minlength=n)
    common = np.bincount(oa[ia][np.isin(ka, kb, assume_unique=True)], minlength=n)
    return common / np.maximum(na + nb - common, 1)


def inside(at: np.ndarray, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (at >= lo[owner]) & (at < hi[owner])


def passages_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int, threshold: float) -> tuple[np.ndarray, ...]:
    """a and b: words around the two sides of spans, and the bounds of each span. (span, from and to in a, from and to in
    b, Jaccard) of the repeated passages."""
    n, least = len(a[1]) - 1, size - SHINGLE + 1
    sa, oa, ba = flat_shingles(*a)
    sb, ob, bb = flat_shingles(*b)
    hit = np.isin(sa, sb)
    out = []

    def judge(which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Parts lo to hi of the slices `which` of a (each part on its own): which of them are repeated passages."""
        ok = np.flatnonzero(hi - lo >= least)
        which, lo, hi = which[ok], lo[ok], hi[ok]
        m = len(which)
        if not m:
            return ok
        la = hi - lo
        own = np.repeat(np.arange(m), la)
        pa_ = np.repeat(lo - (np.cumsum(la) - la), la) + np.arange(la.sum())
        lb = bb[which + 1] - bb[which]
        ownb = np.repeat(np.arange(m), lb)
        pb = np.repeat(bb[which] - (np.cumsum(lb) - lb), lb) + np.arange(lb.sum())
        xa, xb = keyed(sa[pa_], own), keyed(sb[pb], ownb)
        y0, y1 = best_part(np.isin(xb, xa), ownb, np.concatenate([[0], np.cumsum(lb)]), 1.0)
        live = inside(np.arange(len(xb)), ownb, y0, y1)
        j = jaccard(xa, own, xb[live], ownb[live], m)
        good = (j >= threshold - 1e-12) & (y1 - y0 >= least)
        base = np.cumsum(lb) - lb
        out.append((which[good], (lo - ba[which])[good], (hi - ba[which])[good] + SHINGLE - 1, (y0 - base)[good], (y1 - base)[good] + SHINGLE - 1, j[good]))
        return ok[good]

    every = np.arange(n)
    lo, hi = best_part(hit, oa, ba, 1.0)
    open_ = np.ones(n, bool)
    open_[judge(every, lo, hi)] = False
    rest = np.flatnonzero(open_)
    if len(rest):
        lo, hi = best_part(hit, oa, ba, 3.0)
        judge(rest, lo[rest], hi[rest])
        edge = np.diff(np.concatenate([[0], (hit & open_[oa]).astype(np.int8), [0]]))
        x, y = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cut = ba[oa[x] + 1] if len(x) else x  # runs end with their slice
        while (over := y > cut).any():
            x, y, cut = np.concatenate([x, cut[over]]), np.concatenate([np.minimum(y, cut), y[over]]), np.concatenate([cut, ba[oa[cut[over]] + 1]])
        judge(oa[x], x, y) if len(x) else None
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def finer_keys(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, bucket: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, which anchor) of the exact surroundings of anchors: at is the place of each in `words`, of which lo to hi are
    those of its text."""
    up, down = powers(int(PLACES[9]), len(words)), powers(pow(int(PLACES[9]), -1, 1 << 64), len(words) + 1)
    run = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words) * up[: len(words)], dtype=np.uint64)])
    out = []
    around = [(-k, size - k, k) for k in range(0, size - SHINGLE + 1, 5)] + [(-10, SHINGLE, 101), (0, SHINGLE + 10, 102)]
    for x, y, tag in around:
        ok = np.flatnonzero((at + x >= lo) & (at + y <= hi))
        x, y = at[ok] + x, at[ok] + y
        out.append((mixed((run[y] - run[x]) * down[x] ^ mixed(bucket[ok].view(np.uint64) + np.uint64(tag))), ok))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


CHECKED = "a long, x0 int, x1 int, b long, y0 int, y1 int, jaccard double, key long, word int, from int, to int"


def _verifier(size: int, threshold: float, keys: bool):
    """Rows (a, from, to, words of a, b, b_from, words of b, and anchors where keys are wanted) -> rows of CHECKED:
    repeated passages, with b; keys of anchors outside them, with b null."""
    names = [c.split()[0] for c in CHECKED.split(", ")]

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                wa, wb = slices_of(part.column("wa"), "<u4"), slices_of(part.column("wb"), "<u4")
                start, b_start = part.column("from").to_numpy(), pc.fill_null(part.column("b_from"), 0).to_numpy()
                i, x0, x1, y0, y1, j = passages_of(wa, wb, size, threshold)
                ints = [pa.array((v + w[i]).astype(np.int32)) for v, w in ((x0, start), (x1, start), (y0, b_start), (y1, b_start))]
                row = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(row), *ints[:2], part.column("b").take(row), *ints[2:], pa.array(j), pa.nulls(len(i), pa.int64()), *[pa.nulls(len(i), pa.int32())] * 3], names
                )
                if keys:
                    lists = part.column("anchors")
                    flat, of = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                    place, bucket = flat.field("word").to_numpy() - start[of] + wa[1][of], flat.field("bucket").to_numpy()
                    # an anchor is settled where a passage of its span covers it
                    edge = np.zeros(len(wa[0]) + 2, np.int32)
                    np.add.at(edge, wa[1][i] + x0, 1)
                    np.add.at(edge, np.maximum(wa[1][i] + x1 - SHINGLE + 1, wa[1][i] + x0), -1)
                    covered = np.cumsum(edge) > 0
                    fits = place + SHINGLE <= wa[1][of + 1]  # of rows with the same id, the anchors may be of another text
                    open_ = np.flatnonzero(fits & ~covered[np.minimum(place, len(covered) - 1)])
                    key, which = finer_keys(wa[0], wa[1][of[open_]], wa[1][of[open_] + 1], place[open_], bucket[open_], size)
                    row, n = pa.array(of[open_][which]), len(key)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("a").take(row), *[pa.nulls(n, pa.int32())] * 2, pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.int32())] * 2, pa.nulls(n, pa.float64()),
                         pa.array(key.view(np.int64)), flat.field("word").take(pa.array(open_[which])), part.column("from").take(row), part.column("to").take(row)],
                        names,
                    )

    return verify


def repeated_passages(docs: DataFrame, threshold: float = 0.8, recall: float = 0.95, size: int = 45) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, first_word, end_word, cluster_doc_id, cluster_word, removed), a row for each place of
    a repeated passage; a cluster is named by its first document and the first word there."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    bands = tuned_bands(threshold, recall)
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def find(batches):
        for b in batches:
            for at, to in slices(b.column("text")):
                bucket, text, word = anchors(*word_hashes(b.column("text").slice(at, to - at)), size, bands)
                if len(bucket):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.view(np.int64)), b.column("doc_id").take(pa.array(at + text)), pa.array(word.astype(np.int32))],
                        ["bucket", "doc_id", "word"],
                    )

    def gather(batches):
        for b in batches:
            for at, to in slices(b.column("text")):
                h, bounds = word_hashes(b.column("text").slice(at, to - at))
                h = (h >> np.uint64(32)).astype("<u4")
                lists = b.column("ranges").slice(at, to - at)
                n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
                of = np.repeat(np.arange(to - at), n)
                x, y = (flat.field(c) for c in ("from", "to"))
                lo, hi = (np.minimum(v.to_numpy() + bounds[of], bounds[of + 1]) for v in (x, y))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at + of)), x, y, gathered_rows(h, lo, hi)], ["doc_id", "from", "to", "words"])

    found = scratch.keep(docs.mapInArrow(find, "bucket long, doc_id long, word int"), "anchors")
    led = found.groupBy("bucket").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).where("b <> last").drop("last")
    shared = scratch.keep(found.join(led.hint("merge"), "bucket"), "shared")
    lead = shared.where("doc_id = b").groupBy("bucket").agg(F.min("word").alias("lead"))
    # the first place in the first document leads; its other places stand for themselves
    rows = shared.join(lead.hint("merge"), "bucket").where("doc_id <> b or word <> lead")
    rows = rows.selectExpr("doc_id as a", "word", "bucket", "if(doc_id = b, null, b) as b", "if(doc_id = b, 0, word - lead) as shift")
    spans = rows.groupBy("a", "b", "shift", F.expr(f"word div {BLOCK}")).agg(
        F.min("word").alias("low"), F.max("word").alias("high"), F.collect_list(F.struct("word", "bucket")).alias("anchors")
    )
    reach = size + SHINGLE
    spans = spans.selectExpr(
        "a", f"cast(greatest(low - {reach}, 0) as int) as from", f"cast(high + {reach} + {SHINGLE} as int) as to", "b",
        f"if(b is null, null, cast(greatest(low - shift - {reach + 8}, 0) div {GRAIN} * {GRAIN} as int)) as b_from",
        f"if(b is null, null, cast((high - shift + {reach + 8 + SHINGLE}) div {GRAIN} * {GRAIN} + {GRAIN} as int)) as b_to",
        "anchors",
    )
    spans = scratch.keep(spans, "spans")
    wanted = spans.select(F.col("a").alias("doc_id"), "from", "to").union(spans.where("b is not null").select("b", "b_from", "b_to"))
    by_doc = wanted.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    words = docs.join(by_doc.hint("merge"), "doc_id").mapInArrow(gather, "doc_id long, from int, to int, words binary")
    words = scratch.keep(words, "words")
    scratch.drop(found, shared)
    of_a = words.select(F.col("doc_id").alias("a"), "from", "to", F.col("words").alias("wa"))
    of_b = words.select(F.col("doc_id").alias("b"), F.col("from").alias("b_from"), F.col("to").alias("b_to"), F.col("words").alias("wb"))

    def both_sides(spans: DataFrame) -> DataFrame:
        return spans.join(of_a.hint("merge"), ["a", "from", "to"]).join(of_b.hint("merge"), ["b", "b_from", "b_to"], "left")

    checked = scratch.keep(both_sides(spans).select("a", "from", "to", "wa", "b", "b_from", "wb", "anchors").mapInArrow(_verifier(size, threshold, True), CHECKED), "checked")
    finer = checked.where("b is null").select("key", "a", "word", "from", "to")
    first = finer.groupBy("key").agg(F.min(F.struct("a", "word", "from", "to")).alias("l"), F.max("a").alias("last")).where("l.a <> last").select("key", "l")
    again = finer.join(first.hint("merge"), "key").where("a <> l.a")
    again = again.select("a", "from", "to", F.col("l.a").alias("b"), F.col("l.from").alias("b_from"), F.col("l.to").alias("b_to")).distinct()
    more = both_sides(again).select("a", "from", "to", "wa", "b", "b_from", "wb").mapInArrow(_verifier(size, threshold, False), CHECKED)
    links = ["a", "x0", "x1", "b", "y0", "y1"]
    good = scratch.keep(checked.where("b is not null").select(links).union(more.select(links)).distinct(), "verified")
    scratch.drop(spans, words, checked)
    return clustered(good, scratch)


def clustered(good: DataFrame, scratch: Scratch) -> DataFrame:
    """good(a, x0, x1, b, y0, y1), b < a: passages of a that stand in b -> rows of repeated_passages."""
    places = good.selectExpr("a as doc_id", "x0", "x1", "true as removed").union(good.selectExpr("b", "y0", "y1", "false"))
    places = places.groupBy("doc_id", "x0", "x1").agg(F.max("removed").alias("removed"))
    before = F.expr("max(x1) over (partition by doc_id order by x0, x1 rows between unbounded preceding and 1 preceding)")
    begins = places.withColumn("begin", F.when(before.isNull() | (F.col("x0") >= before), F.col("x0")))
    begins = begins.withColumn("begin", F.expr("max(begin) over (partition by doc_id order by x0, x1)"))
    nodes = scratch.keep(begins.withColumn("node", F.xxhash64("doc_id", "begin")), "nodes")
    a = nodes.select(F.col("doc_id").alias("a"), "x0", "x1", F.col("node").alias("na"))
    b = nodes.select(F.col("doc_id").alias("b"), F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("node").alias("nb"))
    edges = good.join(a.hint("merge"), ["a", "x0", "x1"]).join(b.hint("merge"), ["b", "y0", "y1"]).selectExpr("na as a", "nb as b")
    roots = scratch.keep(connected(edges, scratch, "clusters"), "roots")
    in_cluster = nodes.join(roots.hint("merge"), "node")
    # stored, so that the join can split the rows of a large cluster
    named = scratch.keep(in_cluster.groupBy("root").agg(F.min(F.struct("doc_id", "x0")).alias("first")), "named")
    return in_cluster.join(named.hint("merge"), "root").select(
        "doc_id", F.col("x0").cast("long").alias("first_word"), F.col("x1").cast("long").alias("end_word"),
        F.col("first.doc_id").alias("cluster_doc_id"), F.col("first.x0").alias("cluster_word"), "removed",
    )


def remove_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """docs without the words that are marked as removed; n_chars, where there is such a column, follows. A document of
    which no word is left goes."""
    name = unused("_spans", docs)
    spans = repeats.where("removed").groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias(name))
    token = re.compile(r"[^ \t\n\x0b\f\r]+")

    def cut(text: str, spans: list[dict]) -> str:
        words = [m for m in token.finditer(text) if plain(m[0])]
        out, at = [], 0
        for x, y in sorted((s["first_word"], s["end_word"]) for s in spans):
            y = min(y, len(words))
            if x < y:
                out.append(text[at : max(at, words[x].start())])
                at = max(at, words[y - 1].end())
        return "".join([*out, text[at:]])

    def apply(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, spans in enumerate(b.column(name).to_pylist()):
                if spans is not None and texts[i] is not None:
                    texts[i] = cut(texts[i], spans)
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    joined = docs.join(spans, "doc_id", "left").select(*docs.columns, name)
    left = joined.mapInArrow(apply, joined.schema).where(F.col(name).isNull() | F.expr("text rlike '[^ \\\\t\\\\n\\\\r]'")).drop(name)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)
