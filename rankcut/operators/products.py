"""Block matrix products of queries and documents: what is asked of all pairs is answered within the product.

Both sides are dealt to blocks by hash of their ids; each pair of blocks is one task, to which both come by a join on their
numbers, so nothing is broadcast or passes the driver, the documents are read once whatever the number of queries, and a
task holds at most some `block` queries and `rows` documents. What a task gives back is small: the k best, the moments of a
null, counts between thresholds. Pairs marked as relevant go to the block of their ids and become a mask there; where a
column of both sides says what is relevant, it is the mask and there are no pairs at all.

Scores are cosines in whole units of 10^-digits. Only vectors of equal length are compared; vectors that are NULL or hold
NULLs and rows without id take no part. Ties go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and documents of a matrix at a time.
HEIGHT, WIDTH = 512, 4096
#: For the pseudo-random order of the documents of a query: a prime under 2^31.
PRIME = 2_147_483_647

Tile = tuple[np.ndarray, np.ndarray, int]  # scores, which of them count, place of the first document
Task = Callable[[pa.Table, pa.Table, Iterator[Tile]], pa.Table]


def _usable(df: DataFrame, key: str) -> DataFrame:
    return df.where(f"{key} is not null and embedding is not null").where(~F.exists("embedding", lambda x: x.isNull()))


def _by_length(table: pa.Table) -> dict[int, tuple[pa.Table, np.ndarray]]:
    """Length of vectors -> (rows without the vectors, unit vectors)."""
    lists = table.column("embedding").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    length, rest, out = np.diff(at), table.drop_columns(["embedding"]), {}
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length == n)
        x = flat[at[own][:, None] + np.arange(n)].astype(np.float64)
        out[n] = rest.take(pa.array(own)), x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-8)
    return out


def _mask(pairs: pa.Table | None, asked: pa.Table, docs: pa.Table, own: bool) -> Callable[[slice], np.ndarray]:
    """Which pairs of some queries and documents count (1), are relevant (2) or a query with its own document (0)."""
    q, q_known = pd.factorize(asked.column("query_id").to_pandas())
    d, d_known = pd.factorize(docs.column("doc_id").to_pandas())
    out = np.ones((len(q_known), len(d_known)), np.int8)
    if pairs is not None and pairs.num_rows:
        i, j = pd.Index(q_known).get_indexer(pairs.column("query_id").to_pandas()), pd.Index(d_known).get_indexer(pairs.column("doc_id").to_pandas())
        here = (i >= 0) & (j >= 0)
        out[i[here], j[here]] = 2
    if not own:
        j = pd.Index(d_known).get_indexer(pd.Index(q_known))
        out[np.flatnonzero(j >= 0), j[j >= 0]] = 0
    out = out if len(q_known) == len(q) else out[q]
    out = out if len(d_known) == len(d) else out[:, d]
    if "alike_" not in asked.column_names:
        return lambda cols: out[:, cols]
    kinds = pa.concat_arrays([x.column("alike_").combine_chunks() for x in (asked, docs)]).dictionary_encode().indices.fill_null(-1).to_numpy()
    a, b = np.where(kinds[: len(q)] < 0, -2, kinds[: len(q)]), kinds[len(q) :]
    return lambda cols: np.where((out[:, cols] == 1) & (a[:, None] == b[None, cols]), np.int8(2), out[:, cols])


def product(queries: DataFrame, corpus: DataFrame, task: Task, schema: str, relevant: DataFrame | None = None, own: bool = False, digits: int = 6, block: int = 2048, rows: int = 16_384, alike: tuple[str, str] | None = None, sides: bool = False) -> DataFrame:
    """task's results (of that schema) over all pairs of blocks of queries(query_id, embedding, ...) and corpus(doc_id,
    embedding, ...). relevant(query_id, doc_id): pairs that don't count; alike: a column of the queries and one of the corpus, pairs with the same value there don't count either;
    own: a document with the query's id counts. sides: the task gets what _mask() has, not only what counts."""
    n_q, n_d = (max(1, -(-df.select(key).count() // size)) for df, key, size in ((queries, "query_id", block), (corpus, "doc_id", rows)))
    queries, corpus, unit = _usable(queries, "query_id"), _usable(corpus, "doc_id"), 10.0**digits
    q_kind, d_kind = queries.schema["query_id"].dataType, corpus.schema["doc_id"].dataType
    if alike is not None:
        queries = queries.withColumn("alike_", F.col(alike[0])).drop(alike[0])
        corpus = corpus.withColumn("alike_", F.col(alike[1]).cast(queries.schema["alike_"].dataType)).drop(alike[1])
    of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("*", of("query_id", n_q).alias("x_"), every(n_d).alias("y_"))
    if relevant is not None:
        pairs = relevant.select(F.col("query_id").cast(q_kind).alias("query_id"), F.col("doc_id").cast(d_kind).alias("doc_id")).distinct()
        pairs = pairs.select("query_id", "doc_id", of("query_id", n_q).alias("x_"), of("doc_id", n_d).alias("y_"))
        asked = asked.unionByName(pairs, allowMissingColumns=True)
    # named anew, as a column that both sides take from one table would be lost to one of them
    given = corpus.select(*(F.col(c).alias(c) for c in corpus.columns), of("doc_id", n_d).alias("y_"), every(n_q).alias("x_"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        left, right = left.drop_columns(["x_", "y_"]), right.drop_columns(["x_", "y_"])
        pairs = None
        if "doc_id" in left.column_names:
            pair = left.column("embedding").is_null()
            pairs, left = left.filter(pair), left.filter(left.column("embedding").is_valid()).drop_columns(["doc_id"])
        known, out = _by_length(right), []
        for n, (asked, x) in _by_length(left).items():
            if n not in known:
                continue
            docs, y = known[n]
            for s in range(0, len(x), HEIGHT):
                part = asked.slice(s, HEIGHT)
                counts = _mask(pairs, part, docs, own)

                def tiles(x=x[s : s + HEIGHT], y=y, counts=counts):
                    for t in range(0, len(y), WIDTH):
                        cut = slice(t, t + WIDTH)
                        ok = counts(cut)
                        yield np.rint((x @ y[cut].T) * unit).astype(np.int32), ok if sides else ok == 1, t

                out.append(task(part, docs, tiles()))
        return pa.concat_tables(out) if out else empty

    empty = pa.table([pa.array([], f.type) for f in _arrow(queries, schema)], names=[f.name for f in _arrow(queries, schema)])
    return asked.groupBy("x_", "y_").cogroup(given.groupBy("x_", "y_")).applyInArrow(run, schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _order(docs: pa.Table) -> np.ndarray:
    """Each document's place by id."""
    out = np.empty(docs.num_rows, np.int64)
    out[np.argsort(docs.column("doc_id").to_pandas().to_numpy(), kind="stable")] = np.arange(docs.num_rows)
    return out


def _firsts(row: np.ndarray, n: int, *keys: np.ndarray) -> np.ndarray:
    """Places of the n first of each row by the keys, the last of which counts most."""
    order = np.lexsort((*keys, row))
    nth = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    return order[nth < n]


def every_score(digits: int = 6) -> Task:
    """(query_id, doc_id, similarity) of all pairs that count."""

    def task(asked, docs, tiles):
        out = []
        for scores, ok, at in tiles:
            r, c = np.nonzero(ok)
            out.append(pa.table([asked.column("query_id").take(pa.array(r)), docs.column("doc_id").take(pa.array(c + at)), pa.array(scores[r, c] / 10.0**digits)], ["query_id", "doc_id", "similarity"]))
        return pa.concat_tables(out)

    return task


def best_scores(k: int, digits: int = 6) -> Task:
    """(query_id, doc_id, similarity) of each query's k best in a block of documents."""

    def task(asked, docs, tiles):
        order, least = _order(docs), np.iinfo(np.int32).min
        limit = np.full(asked.num_rows, least)
        row, doc, score = (np.zeros(0, np.int64) for _ in range(3))
        for scores, ok, at in tiles:
            scores = np.where(ok, scores, least)
            if scores.shape[1] > k:
                limit = np.maximum(limit, np.partition(scores, -k, axis=1)[:, -k])
            r, c = np.nonzero((scores >= limit[:, None]) & ok)
            row, doc, score = np.r_[row, r], np.r_[doc, c + at], np.r_[score, scores[r, c]]
            keep = _firsts(row, k, order[doc], -score)
            row, doc, score = row[keep], doc[keep], score[keep]
        return pa.table([asked.column("query_id").take(pa.array(row)), docs.column("doc_id").take(pa.array(doc)), pa.array(score / 10.0**digits)], ["query_id", "doc_id", "similarity"])

    return task


MOMENTS = "n long, total long, squares decimal(38,0), least double, most double"


def null_state(sample: int = 0, digits: int = 6) -> Task:
    """The state of each query's null in a block of documents, mergeable by addition: a row (query_id, MOMENTS) in units of
    10^-digits, and rows (query_id, doc_id, similarity, place) of the `sample` first in the query's pseudo-random order of
    documents; asked has h_ (the query's factor) and limit_ (places from there on are not given back), docs has h_."""

    def task(asked, docs, tiles):
        n = asked.num_rows
        count, total, squares = (np.zeros(n, np.int64) for _ in range(3))
        most, least = np.full(n, np.iinfo(np.int32).min), np.full(n, np.iinfo(np.int32).max)
        row, doc, score, place = (np.zeros(0, np.int64) for _ in range(4))
        order = _order(docs) if sample else None
        for scores, ok, at in tiles:
            own = np.where(ok, scores, 0).astype(np.int64)
            count, total, squares = count + ok.sum(1), total + own.sum(1), squares + (own * own).sum(1)
            most, least = np.maximum(most, np.where(ok, scores, most[:, None]).max(1)), np.minimum(least, np.where(ok, scores, least[:, None]).min(1))
            if sample:
                places = asked.column("h_").to_numpy()[:, None] * docs.column("h_").to_numpy()[None, at : at + scores.shape[1]] % PRIME
                r, c = np.nonzero(ok & (places < asked.column("limit_").to_numpy()[:, None]))
                row, doc, score, place = np.r_[row, r], np.r_[doc, c + at], np.r_[score, scores[r, c]], np.r_[place, places[r, c]]
                keep = _firsts(row, sample, order[doc], place)
                row, doc, score, place = row[keep], doc[keep], score[keep], place[keep]
        some, unit = np.flatnonzero(count), 10.0**digits
        none = lambda k, kind: pa.nulls(k, kind)
        ids, names = docs.column("doc_id"), ["query_id", "doc_id", "similarity", "place", "n", "total", "squares", "least", "most"]
        exact = pa.array(squares[some]).cast(pa.decimal128(38, 0))
        state = pa.table([asked.column("query_id").take(pa.array(some)), none(len(some), ids.type), none(len(some), pa.float64()), none(len(some), pa.int64()), pa.array(count[some]), pa.array(total[some]), exact, pa.array(least[some] / unit), pa.array(most[some] / unit)], names)
        if not sample:
            return state
        kinds = [pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64()]
        drawn = pa.table([asked.column("query_id").take(pa.array(row)), ids.take(pa.array(doc)), pa.array(score / unit), pa.array(place), *(none(len(row), k) for k in kinds)], names)
        return pa.concat_tables([state, drawn])

    return task


def counts_between(digits: int = 6) -> Task:
    """Each query's null counted between thresholds: asked has bins_, rising values; (query_id, value, times) has for each of
    them how many scores lie from it up to the next one, where there are any, and those below all at minus infinity."""

    def task(asked, docs, tiles):
        n, step = asked.num_rows, 4 * 10**digits
        lists = asked.column("bins_").combine_chunks()
        size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
        value = np.concatenate([np.zeros(0), *(x.values.to_numpy() for x in lists if x.is_valid)])
        row = np.repeat(np.arange(n), size)
        bins = np.ceil(np.round(value * 10.0**digits, 3)).astype(np.int64)  # the least whole score that is at least the value
        keys = row * step + bins
        first, counts, below = np.cumsum(size) - size, np.zeros(len(keys), np.int64), np.zeros(n, np.int64)
        low = np.full(n, np.iinfo(np.int32).max, np.int64)
        low[size > 0] = bins[first[size > 0]]
        for scores, ok, _ in tiles:
            high = ok & (scores >= low[:, None])
            below += ok.sum(1) - high.sum(1)
            r, c = np.nonzero(high)
            counts += np.bincount(np.searchsorted(keys, r * step + scores[r, c], "right") - 1, minlength=len(keys))[: len(keys)]
        some, rest = np.flatnonzero(counts), np.flatnonzero(below)
        ids = asked.column("query_id").take(pa.array(np.r_[row[some], rest]))
        return pa.table([ids, pa.array(np.r_[value[some], np.full(len(rest), -np.inf)]), pa.array(np.r_[counts[some], below[rest]])], ["query_id", "value", "times"])

    return task


def factor(text: Column) -> Column:
    """A number from 1 to PRIME - 1 of a text, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % (PRIME - 1) + 1


def packed(units: np.ndarray, digits: int = 6) -> bytes:
    """Rising whole scores as their steps, a byte each; 255 is a step on to the next byte."""
    step = np.diff(units.astype(np.int64), prepend=-2 * 10**digits)
    size = step // 255 + 1
    out = np.full(size.sum(), 255, np.uint8)
    out[np.cumsum(size) - 1] = step % 255
    return out.tobytes()


def unpacked(steps: bytes, digits: int = 6) -> np.ndarray:
    own = np.frombuffer(steps, np.uint8)
    return np.cumsum(own, dtype=np.int64)[own < 255] - 2 * 10**digits


def packed_scores(digits: int = 6) -> Task:
    """(query_id, side, scores): each query's scores in a block of documents, packed, those that count (side 0) and those of
    relevant documents (side 1); for a product with sides."""

    def task(asked, docs, tiles):
        some = [(s, ok) for s, ok, _ in tiles]
        scores, ok = (np.concatenate([x[k] for x in some], axis=1) for k in (0, 1))
        found = [(i, side, packed(np.sort(scores[i][ok[i] == side + 1]), digits)) for i in range(asked.num_rows) for side in (0, 1) if (ok[i] == side + 1).any()]
        row, side, scores = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([asked.column("query_id").take(pa.array(row, pa.int64())), pa.array(side, pa.int32()), pa.array(scores, pa.binary())], ["query_id", "side", "scores"])

    return task
