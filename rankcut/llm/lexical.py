"""Ranked lexical search by an Aho-Corasick scan: one automaton of all terms of the items runs over the documents' texts.

Texts become bytes in which every ASCII sign but letters and digits is a space and A-Z is lower-cased (one table look-up a
byte; the bytes of other signs stay). Each term stands in the automaton between two spaces, so that it is found as a whole
term only, and neighbours may share a space. The automaton's outputs are term numbers, and a table maps each to the items
that hold it and how often. The scan gives every document's number of terms and the counts of the items' terms in it, which
go to the shared folder; no index of the documents is made. Numbers of documents and terms and each term's documents are
sums over that table. Then documents are scored in batches in 64-bit integers: a term's share goes to the items that hold
it. A task keeps the `k` best of each item, and those of all tasks are merged by rank.

The automaton and its tables are broadcast. Items are dealt to blocks of some `block` bytes of text, each with an automaton
and a scan of its own; an item with more text than that is a block to itself, as it is one value of one row. Documents go
through in runs of some 4 MB of text, a longer document alone. Scores of `cells` (documents x items) are held at a time.

NULL or empty texts have no terms: such documents don't count, such items get no rows. Rows that share an item_id are one
item with the terms of all; items without id are left out. Rows of documents that repeat are documents each. A document
without doc_id counts in the statistics and is never returned. Equal scores go by ascending doc_id. Empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch, slices

TERM_SIGNS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER = bytes(range(65, 91))
TABLE = bytes(c + 32 if c in _UPPER else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
FOUND = "doc_id long, n long, terms array<int>, tf array<long>"
SPACE = 32


def plain(text: bytes) -> bytes:
    """Terms of A-Z in lower case, all other ASCII signs as spaces, a space at both ends."""
    return b" " + text.translate(TABLE) + b" "


def number_of_terms(text: bytes) -> int:
    """How many runs of signs that aren't spaces plain text has; it begins with a space."""
    space = np.frombuffer(text, np.uint8) == SPACE
    return int(np.count_nonzero(space[:-1] & ~space[1:]))


class Items:
    """Terms of a block of items: numbers of terms, and for each the items that hold it and how often."""

    def __init__(self, texts: list[tuple[object, bytes]]):
        counts: dict[object, Counter] = {}
        for item, text in texts:
            counts.setdefault(item, Counter()).update(plain(text).split())
        self.ids = sorted(item for item, c in counts.items() if c)
        self.terms = sorted({t for c in counts.values() for t in c})
        of = {t: i for i, t in enumerate(self.terms)}
        triples = sorted((of[t], i, times) for i, item in enumerate(self.ids) for t, times in counts[item].items())
        term, self.item, self.times = np.array(triples, np.int64).reshape(-1, 3).T.copy()
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.key = uuid.uuid4().hex

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", i)
        found.make_automaton()
        return found


_BUILT: dict[str, object] = {}


def _automaton(items: Items):
    """This process's automaton of the items; only the last is kept."""
    if items.key not in _BUILT:
        _BUILT.clear()
        _BUILT[items.key] = items.automaton()
    return _BUILT[items.key]


def _scan(given):
    def scan(batches):
        found = _automaton(given.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at, to in slices(texts):
                n, terms, counts = [], [], []
                for text in texts[at:to]:
                    text = plain(text.as_py() or b"")
                    n.append(number_of_terms(text))
                    tf = sorted(Counter(i for _, i in found.iter(text.decode("latin-1"))).items())
                    terms.append([i for i, _ in tf])
                    counts.append([c for _, c in tf])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at:to], pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"]
                )

    return scan


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.limit = np.ones(items, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """scores: documents x items."""
        row, item = np.nonzero(scores >= self.limit[None, :])
        if not len(row):
            return
        item, doc = np.r_[self.item, item], np.r_[self.doc, docs[row]]
        score = np.r_[self.score, scores[row, item[len(self.item) :]]]
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        keep = nth < self.k
        self.item, self.doc, self.score, nth = item[keep], doc[keep], score[keep], nth[keep]
        full = nth == self.k - 1
        self.limit[self.item[full]] = self.score[full]


def _rank(given, weights: np.ndarray, documents: int, terms: int, k: int, cells: int):
    """For mapInArrow over FOUND: the k best of each item in this task."""

    def rank(batches):
        items = given.value
        best, size = Best(len(items.ids), k), max(1, cells // max(1, len(items.ids)))
        held = items.first[1:] - items.first[:-1]
        for batch in batches:
            doc, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            m = 100 - 75 + (75 * n * documents) // terms
            lists = batch.column("terms")
            row, term = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
            tf = batch.column("tf").flatten().to_numpy()
            share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            for at in range(0, len(doc), size):
                here = slice(*np.searchsorted(row, (at, at + size)))
                to = np.repeat(np.arange(here.start, here.stop), held[term[here]])  # a hit for each item that holds the term
                within = np.arange(len(to)) - np.repeat(np.cumsum(held[term[here]]) - held[term[here]], held[term[here]])
                place = items.first[term[to]] + within
                scores = np.zeros((min(size, len(doc) - at), len(items.ids)), np.int64)
                np.add.at(scores, (row[to] - at, items.item[place]), share[to] * items.times[place])
                best.add(doc[at : at + size], scores)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(items.ids, np.int64)[best.item]), pa.array(best.doc), pa.array(best.score)], ["item_id", "doc_id", "score"])

    return rank


def ranked_documents(items: DataFrame, docs: DataFrame, k: int = 10, block: int = 8 << 20, cells: int = 1 << 20) -> DataFrame:
    """items(item_id, text), documents(doc_id, text) -> (item_id, rank, doc_id, score): each item's k best documents."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    asked = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        own = Items([(r.item_id, r.text.encode()) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()])
        if not own.ids:
            continue
        given = spark.sparkContext.broadcast(own)
        found = scratch.keep(texts.mapInArrow(_scan(given), FOUND), "lexical-terms")
        total = found.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
        if not total.terms:
            continue
        df = np.zeros(len(own.terms), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
            df[r.term] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        known = found.where("doc_id is not null and size(terms) > 0")
        out = out.union(known.mapInArrow(_rank(given, weights, total.documents, total.terms, k, cells), "item_id long, doc_id long, score long"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


LEXICAL_SQL = r"""
WITH split AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM split GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM split GROUP BY ALL),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
times AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM times JOIN tfs USING (term) JOIN w USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
