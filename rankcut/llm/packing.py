"""Best-fit packing of documents into sequences, bulk-synchronously.

Documents and gaps are ranged by size. As both sizes are whole numbers up to the capacity, they are first summed into
size classes: at most `capacity` rows, whatever the input. From the largest class down, a step sweeps the gaps upward
from the class's size (each document's successor is the smallest gap that holds it), gives out the class's documents to
those gaps, updates the gaps and goes on; what finds no gap opens new sequences. A class's documents would all claim the
same gap: their rank within the class decides who gets which. So the steps work on classes, and every row finds its place
from its rank, which is counted in Spark: each class is split over many buckets, so that a class with a third of all
rows is no hot group. A step leaves at most two more groups of equal gaps, and a group that is filled has less than half
its gap left; the plan that is broadcast has therefore at most 12 * 3 * capacity entries.

Null text counts as an empty document (its end id alone). Repeated rows are packed each on its own; which of two equal
rows comes first doesn't matter. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch
from rankcut.llm.token_ids import TOKENIZER, encoded, tokenizer_path

CAPACITY = 4096
END = 1


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids_crc32); only documents over the capacity are cut."""

    def cut(batches):
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for at, _, ids, counts in encoded(b.column("text"), tokenizer):
                stop = 0
                for i, n in enumerate(counts):
                    own = np.append(ids[stop : stop + n], np.uint32(end)).astype("<u4")
                    stop += n
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        row.append(at + i), piece.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_best_fit(counts: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """counts: size -> how many. For each size, in order of rank: first rank, first sequence, how many to each sequence,
    offset of the first in its sequence."""
    gaps: list[int] = []  # sizes of gaps, in ascending order
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many sequences)
    opened, plan = 0, {}

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in groups:
                bisect.insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank, found = counts[size], 0, []

        def fill(gap: int, first: int, n: int) -> int:
            """Gives documents to n sequences with this gap; returns how many sequences were reached."""
            nonlocal left, rank
            each = gap // size
            whole = min(n, left // each)
            if whole:
                found.append((rank, first, each, capacity - gap))
                rank, left = rank + whole * each, left - whole * each
                put(gap - each * size, first, whole)
            if left and whole < n:
                found.append((rank, first + whole, each, capacity - gap))
                put(gap - left * size, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            return whole

        for gap in gaps[bisect.bisect_left(gaps, size) :]:
            if not left:
                break
            own = groups.pop(gap)
            gaps.pop(bisect.bisect_left(gaps, gap))
            for first, n in own:
                reached = fill(gap, first, n) if left else 0
                put(gap, first + reached, n - reached)
        if left:
            each = capacity // size
            n = -(-left // each)
            fill(capacity, opened, n)
            opened += n
        plan[size] = tuple(np.array(x, np.int64) for x in zip(*found, strict=True))
    return plan


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, tie: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces(..., length) with 1 <= length <= capacity -> the same with sequence_id and offset.

    `pieces` is read three times; give a stored table.
    """
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    by_bucket = pieces.groupBy("length", "_b").count()
    base = by_bucket.select("length", "_b", (F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count")).alias("_base"))
    sums = {r[0]: r[1] for r in by_bucket.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(plan_best_fit(sums, capacity))
    ranked = pieces.join(base, ["length", "_b"]).withColumn(
        "_rank", F.col("_base") + F.row_number().over(Window.partitionBy("length", "_b").orderBy(*tie)) - 1
    )
    columns = [c for c in pieces.columns if c != "_b"]

    def place(batches):
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            seq, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                here = np.flatnonzero(size == s)
                first, base, each, at = plan.value[int(s)]
                i = np.searchsorted(first, rank[here], side="right") - 1
                nth = rank[here] - first[i]
                seq[here], offset[here] = base[i] + nth // each[i], at[i] + nth % each[i] * s
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(seq), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.keep(pieces_of(docs, tokenizer or tokenizer_path(TOKENIZER), capacity, end), "pieces")
    return pack_pieces(pieces, capacity)
