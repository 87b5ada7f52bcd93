"""Nearest neighbours by a block matrix join: int8 products bound the distances, survivors are measured in double.

Vectors are quantised to int8 with a scale each; x = s q + e, and |e| is kept. For a tile of queries and candidates one
matrix product of the int8 parts gives |s q - s' q'| squared, in whole numbers but for the scales, so that its rounding
error stays below 8 units of the last place of |s q| squared + |s' q'| squared; the root of what lies this much above and
below, and |e| + |e'| by the triangle inequality, bound the true distance. (The product runs in float32, which holds such
sums exactly up to 1,040 dimensions; longer vectors are multiplied in runs of 1,024.) A pair survives if its least possible
distance is not above the k-th smallest largest possible one of the query, first in its block of rows, then in all.
Survivors are measured in double precision on the original vectors, and a heap for each query keeps its k best, by distance
and then vec_id. So the result is exact, also for vectors that are quantised without error and for equal ones.

Of equal vectors only the k + 1 smallest ids can enter a query's result (one may be its own), so the others are left out
before the product; both steps are partial aggregates and limits before the shuffle, and a vector that a third of all rows
hold costs no more than another. Queries and rows are dealt to blocks by hash; each pair of blocks is one task, to which
both come by a join on their numbers (`block` queries and `rows` rows on average), so nothing is broadcast or passes the
driver. What is sent once for each block of queries are a row's int8 values, scale and error; original vectors meet the
survivors alone.

Vectors of different length are not compared. Vectors that are null, empty, zero or hold null or non-finite components take
no part. Rows with a query's vec_id are its own and no candidates; a query id that stands in several rows is asked once,
with the vector that is least in order; rows that repeat are candidates each. Null ids take no part. Empty tables give an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch

RUN = 1024  # dimensions whose int8 products float32 adds exactly
ULP = np.finfo(np.float64).eps


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = "exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        f"not {bad} and exists(v, x -> x <> 0)"
    )


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, bound of the length of the error) of each row."""
    scale = np.maximum(np.abs(x).max(1), np.finfo(np.float64).tiny * 1e10) / 127
    q = np.rint(x / scale[:, None])
    err = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))
    return q.astype(np.int8), scale, err * (1 + 1e-12) + 4 * ULP * np.sqrt((x * x).sum(1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = None
    for k in range(0, a.shape[1], RUN):
        part = a[:, k : k + RUN].astype(np.float32) @ b[:, k : k + RUN].astype(np.float32).T
        out = part.astype(np.float64) if out is None else out + part
    return out


def _squares(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.int64)
    return (x * x).sum(1)


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible distances of the rows of two sides, each (int8 values, scale, error)."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    na, nb = sa * sa * _squares(qa), sb * sb * _squares(qb)
    size = na[:, None] + nb[None, :]
    near = size - 2 * (sa[:, None] * sb[None, :]) * int8_products(qa, qb)
    slack = ea[:, None] + eb[None, :] + 1e-14 * np.sqrt(size)  # also of the measured distances that limits come from
    return np.sqrt(np.maximum(near - 8 * ULP * size, 0)) - slack, np.sqrt(np.maximum(near, 0) + 8 * ULP * size) + slack


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds of rows) of an array of lists or binaries."""
    if pa.types.is_binary(column.type):
        at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        return np.frombuffer(column.buffers()[2] or b"", dtype), at
    return column.values.to_numpy(), column.offsets.to_numpy()


def _quantise(batches):
    """For mapInArrow over (vec_id, row, v): int8 values as bytes, scale and error beside them."""
    for batch in batches:
        if batch.num_rows:
            flat, at = _flat(batch.column("v"), None)
            length = np.diff(at)
            q, scale, err = [b""] * len(length), np.zeros(len(length)), np.zeros(len(length))
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                values, scale[rows], err[rows] = quantised(flat[at[rows][:, None] + np.arange(n)])
                for r, x in zip(rows.tolist(), values, strict=True):
                    q[r] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "row", "v")), pa.array(q, pa.binary()), pa.array(scale), pa.array(err)], ["vec_id", "row", "v", "q", "scale", "err"])


def _by_length(table: pa.Table) -> dict[int, tuple]:
    """Length -> (ids, rows, (int8 values, scale, error))."""
    ids, rows, scale, err = (table.column(c).to_numpy() for c in ("vec_id", "row", "scale", "err"))
    flat, at = _flat(table.column("q").combine_chunks(), np.int8)
    length, out = np.diff(at), {}
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length == n)
        out[n] = ids[own], rows[own], (flat[at[own][:, None] + np.arange(n)], scale[own], err[own])
    return out


def _take(side: tuple, cut: slice) -> tuple:
    return tuple(x[cut] for x in side)


def survivors(asked: tuple, given: tuple, k: int, tile: int) -> list[np.ndarray]:
    """(query row, row, least distance, largest distance) of the pairs of two blocks that may be among the k nearest."""
    (ids, q_rows, a), (own, rows, b) = asked, given
    limit, found = np.full(len(ids), np.inf), []
    for s in range(0, len(own), tile):
        cut = slice(s, s + tile)
        low, high = bounds(a, _take(b, cut))
        high[ids[:, None] == own[None, cut]] = np.inf
        if high.shape[1] >= k:
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((low <= limit[:, None]) & np.isfinite(high))
        found.append((i, j + s, low[i, j], high[i, j]))
    i, j, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((high, i))
    at = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i[order], i[order]) == k - 1)
    limit[i[order][at]] = np.minimum(limit[i[order][at]], high[order][at])
    keep = low <= limit[i]
    return [q_rows[i[keep]], rows[j[keep]], low[keep], high[keep]]


def _measured(k: int):
    """For mapInArrow over (query_id, vec_id, a, b) in which all rows of a query are in one task: its k nearest by a heap."""

    def measured(batches):
        heaps: dict[int, list[tuple[float, int]]] = {}  # (-distance, -vec_id), the worst on top
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, at), (y, to) = _flat(batch.column("a"), None), _flat(batch.column("b"), None)
            length, dist = np.diff(at), np.zeros(batch.num_rows)
            for n in np.unique(length).tolist():
                r, c = np.flatnonzero(length == n), np.arange(n)
                dist[r] = np.sqrt(((x[at[r][:, None] + c] - y[to[r][:, None] + c]) ** 2).sum(1))
            for q, v, d in zip(batch.column("query_id").to_pylist(), batch.column("vec_id").to_pylist(), dist.tolist(), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -v))
                elif (-d, -v) > heap[0]:
                    heapq.heapreplace(heap, (-d, -v))
        out = [(q, i + 1, -v, -d) for q, heap in heaps.items() for i, (d, v) in enumerate(sorted(heap, reverse=True))]
        if out:
            q, i, v, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i, pa.int32()), pa.array(v), pa.array(d)], ["query_id", "rank", "vec_id", "score"])

    return measured


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 16_384, rows: int = 16_384, tile: int = 2048) -> DataFrame:
    """queries and vectors (vec_id, embedding) -> (query_id, rank, vec_id, score): the k nearest rows of vectors."""
    scratch, number, kind = Scratch(vectors.sparkSession), F.monotonically_increasing_id().alias("row"), "vec_id long, row long, v array<double>, q binary, scale double, err double"
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", number, "v")
    times = usable(vectors).groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    first = times.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    given = first.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).select("vec_id", number, "v")
    asked = scratch.keep(asked.mapInArrow(_quantise, kind), "nearest-queries")
    given = scratch.keep(given.mapInArrow(_quantise, kind), "nearest-rows")
    n_q, n_v = max(1, -(-asked.count() // block)), max(1, -(-given.count() // rows))
    deal = lambda df, n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    slim = ["vec_id", "row", "q", "scale", "err"]
    a = asked.select(*slim, deal(asked, n_q).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    b = given.select(*slim, deal(given, n_v).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        known, out = _by_length(rows), []
        for n, own in _by_length(queries).items():
            if n in known:
                for s in range(0, len(own[0]), 1024):
                    cut = slice(s, s + 1024)
                    out.append(survivors((own[0][cut], own[1][cut], _take(own[2], cut)), known[n], k, tile))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table([pa.array(c) for c in cols], ["query_row", "row", "low", "high"])

    pairs = a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInArrow(search, "query_row long, row long, low double, high double")
    w = Window.partitionBy("query_row")
    limit = F.max(F.when(F.col("nth") == k, F.col("high"))).over(w)
    left = pairs.withColumn("nth", F.row_number().over(w.orderBy("high"))).withColumn("limit", limit).where("limit is null or low <= limit")
    left = left.select("query_row", "row").join(asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("a")), "query_row")
    left = left.join(given.select("row", "vec_id", F.col("v").alias("b")), "row").select("query_id", "vec_id", "a", "b")
    return left.repartition("query_id").mapInArrow(_measured(k), "query_id long, rank int, vec_id long, score double")
