"""Exact duplicates by two passes of a Bloom filter: only rows whose hash may repeat are shuffled, the rest pass through.

Texts are equal if they are identical once every character of [\\x20\\x09-\\x0D] is deleted. One scan reads the texts and
writes a slim table of (document, SHA-256, code points) to the shared folder; texts go nowhere else.

Pass one counts hashes up to two in a blocked Bloom filter: a hash picks a segment of 65,536 bits and two bits in it, and
each bit is kept for "set" and for "set again". Tasks send their segments as bit numbers or bitmaps, whichever is shorter,
and segments are merged by number, so that a text which fills a task sends two numbers. Pass two looks rows up in the
"set again" bits: a hash that stands in two rows has both bits set again, so no repeated text is missed; of the others
about one in seventy is taken along (16 bits for each row). The rows found are grouped by SHA-256 with partial aggregates,
and those alone meet their group by a join. A group with over 1/1000 of all rows would be a hot key there: there are fewer
than 1,000 of these, so they are broadcast instead.

The filter that is broadcast never has more than `most` bytes (32 MB). With more rows than it serves, hashes are dealt to
slices by their upper bits: the slim table is written with a folder for each slice, and each slice has its own filter.

Of a group the row with the most code points stays, then that with the smallest doc_id, then one of the rows that repeat
both. NULL text is empty; empty texts equal each other. A NULL doc_id comes after all others and is a document like any
other. Texts of any length are hashed whole. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch

BITS = 16  # for each row
SEGMENT = 1 << 16  # bits
SPACE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without white space; empty for NULL."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _sent(bits: np.ndarray) -> bytes:
    """Bit numbers within a segment as two bytes each, or the whole bitmap where that is shorter (told by its length)."""
    if len(bits) * 16 < SEGMENT:
        return bits.astype("<u2").tobytes()
    whole = np.zeros(SEGMENT, np.uint8)
    whole[bits] = 1
    return np.packbits(whole, bitorder="little").tobytes()


def _bitmap(sent: bytes) -> np.ndarray:
    if len(sent) == SEGMENT // 8:
        return np.frombuffer(sent, np.uint8)
    whole = np.zeros(SEGMENT, np.uint8)
    whole[np.frombuffer(sent, "<u2")] = 1
    return np.packbits(whole, bitorder="little")


def _segments(batches):
    """For mapInArrow over (segment, one, two): this task's bits, set and set again, by segment."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # sorted bit numbers over all segments, and how often up to 2

    def merged() -> None:
        bits = np.concatenate([b for b, _ in parts])
        times = np.concatenate([t for _, t in parts])
        order = np.argsort(bits, kind="stable")
        bits, times = bits[order], times[order]
        first = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1]])
        parts[:] = [(bits[first], np.minimum(np.add.reduceat(times, first), 2).astype(np.int8))]

    for batch in batches:
        if batch.num_rows:
            segment, one, two = (batch.column(c).to_numpy().astype(np.int64) for c in range(3))
            bits, times = np.unique(np.concatenate([segment * SEGMENT + one, (segment * SEGMENT + two)[one != two]]), return_counts=True)
            parts.append((bits, np.minimum(times, 2).astype(np.int8)))
            if len(parts) > 16:
                merged()
    if parts:
        merged()
        bits, times = parts[0]
        starts = np.flatnonzero(np.r_[True, bits[1:] // SEGMENT != bits[:-1] // SEGMENT])
        for at in range(0, len(starts), 256):
            rows = []
            for i in range(at, min(at + 256, len(starts))):
                cut = slice(starts[i], starts[i + 1] if i + 1 < len(starts) else len(bits))
                rows.append((int(bits[cut.start] // SEGMENT), _sent(bits[cut] % SEGMENT), _sent(bits[cut][times[cut] > 1] % SEGMENT)))
            number, once, again = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(once, pa.binary()), pa.array(again, pa.binary())], ["segment", "once", "again"])


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For applyInArrow by segment: bits that are set again by one task, or set by two."""
    once, again = np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
    for batch in batches:
        for o, a in zip(batch.column("once").to_pylist(), batch.column("again").to_pylist(), strict=True):
            o = _bitmap(o)
            again = again | _bitmap(a) | (once & o)
            once = once | o
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([again.tobytes()], pa.binary())], ["segment", "again"])


def _is_set(bits: str, bit: str) -> str:
    return f"shiftright(cast(conv(hex(substring({bits}, 1 + {bit} div 8, 1)), 16, 10) as int), cast({bit} % 8 as int)) & 1 = 1"


def exact_duplicates(docs: DataFrame, most: int = 32 << 20, hot: int = 1000) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    n = docs.count()
    slices = max(1, -(-n * BITS // (most * 8)))
    segments = max(1, min(most * 8, -(-n * BITS // slices)) // SEGMENT + 1)
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"), F.monotonically_increasing_id().alias("row"))
    h = slim.withColumn("h", F.xxhash64("sha"))
    bits = h.withColumns(
        {
            "one": F.expr(f"h & {SEGMENT - 1}"),
            "two": F.expr(f"shiftrightunsigned(h, 16) & {SEGMENT - 1}"),
            "segment": F.expr(f"pmod(shiftrightunsigned(h, 32), {segments}L)"),
            "slice": F.expr(f"pmod(shiftrightunsigned(h, 32) div {segments}L, {slices}L)"),
        }
    ).drop("h")
    stored = scratch.keep(bits, "exact-hashes", *(["slice"] if slices > 1 else []))
    out = None
    for s in range(slices):
        rows = stored.where(F.col("slice") == s).drop("slice")
        sent = rows.select("segment", "one", "two").mapInArrow(_segments, "segment long, once binary, again binary")
        again = sent.groupBy("segment").applyInArrow(_merge, "segment long, again binary")
        again = scratch.keep(again, "exact-filter")  # at most `most` bytes
        looked = rows.join(F.broadcast(again), "segment").withColumn("may", F.expr(f"{_is_set('again', 'one')} and {_is_set('again', 'two')}")).drop("segment", "one", "two", "again")
        straight = looked.where("not may").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
        maybe = looked.where("may").drop("may")
        best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        groups = scratch.keep(maybe.groupBy("sha").agg(F.count("*").alias("group_size"), best.alias("best")).select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "exact-groups")
        large = F.broadcast(groups.where(F.col("group_size") * hot > n))  # fewer than `hot` rows
        most_rows = maybe.join(large.select("sha"), "sha", "left_anti").join(groups.where(F.col("group_size") * hot <= n), "sha")
        met = maybe.join(large, "sha").unionByName(most_rows).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")
        part = straight.unionByName(met)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents of which exact_duplicates() keeps a row; of rows that repeat a doc_id and text, all. Documents without
    doc_id are left out."""
    found = exact_duplicates(docs)
    return docs.join(found.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


EXACT_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, coalesce(length(text), 0) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)"""
