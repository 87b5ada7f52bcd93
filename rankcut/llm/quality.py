"""Quality grades by ordinal regression with cumulative logits over hashed text.

A document's grade is a step of an ordered scale; P(grade > j) = 1 / (1 + exp(threshold_j - w.x)): the weights w are
shared by all steps, the thresholds ascend. x has a place for each of 2^18 hashed features that occur in the text: its
words and signs in lower case, the share of words that repeat the word before and of words in capitals, in tenths. Only
features that go with the grade at |z| >= 5 in the sample enter; the others' weights stay 0, or a text of thousands of
rare words would drown the few that matter.

The fit takes a bounded sample of the labelled documents, `sample` of them by the least hash of doc_id (20,000, a
parameter); their features, some tens of MB at most, go to one task, and the weights to the driver. Scoring covers all
documents.

Rows of labels with a null are left out; of several for one doc_id the lowest grade counts. Of labelled rows with one doc_id
and different texts the fit takes the text with the least hash. Without labelled documents
no feature has a weight and the thresholds are such that every document is kept. Null text counts as empty. Rows that
repeat get equal scores. Very long texts are scored whole. An empty table gives an empty result. Other columns, whatever their
names (but for _grade), are ignored, and kept by select_quality.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.shared import slices, unused
from rankcut.llm.words import LIMIT, known, looked_up, split_words

SLOTS = 1 << 18
SIGNS = re.compile(r"[^\W_]+|[^\w\s]+")


def slot(feature: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(feature) % SLOTS


def _parts(words: list[str]) -> list[list[int]]:
    own = known("quality", "parts")
    if len(own) > LIMIT:
        own.clear()
    out = list(map(own.get, words))
    for i, got in enumerate(out):
        if got is None:
            out[i] = [slot(x.lower()) for x in SIGNS.findall(words[i])]
            if len(words[i]) <= 64:
                own[words[i]] = out[i]
    return out


def _shape(word: str) -> int:
    """A hash of the word without signs at its ends (its lowest bit cleared), and whether it is in capitals."""
    import xxhash

    bare = word.strip(".,;:!?")
    return xxhash.xxh3_64_intdigest(bare) & ~1 | (len(bare) > 1 and bare.isupper())


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the distinct features of each text; `wanted`: a flag for each slot."""
    codes, words, bounds = split_words(texts)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    parts = _parts(words)
    if wanted is not None:
        parts = [[s for s in p if wanted[s]] for p in parts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter((s for p in parts for s in p), np.int64, int(size.sum()))
    first = np.cumsum(size) - size
    if len(codes):
        hit = np.flatnonzero(size[codes] > 0)
        k = size[codes[hit]]
        at = np.repeat(first[codes[hit]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        keys = [np.unique(np.repeat(owner[hit], k) * SLOTS + flat[at])]
        shape = looked_up(words, "quality", "shape", _shape)[codes]
        again = np.zeros(len(codes), bool)
        again[1:] = (shape[1:] == shape[:-1]) & (owner[1:] == owner[:-1])
        for name, flag in (("again", again), ("capitals", shape & np.uint64(1) == 1)):
            share = np.bincount(owner, flag, minlength=len(n)) * 10 // np.maximum(n, 1)
            where = np.array([slot(f"# {name} {x}") for x in range(11)])[share.astype(np.int64)]
            some = np.flatnonzero((n > 0) & (True if wanted is None else wanted[where]))
            keys.append(some * SLOTS + where[some])
        key = np.unique(np.concatenate(keys))
        return key // SLOTS, key % SLOTS
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """(texts, steps): P(grade > j)."""
        text, where = features(texts, self.weights != 0)
        z = np.bincount(text, self.weights[where], minlength=len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, steps: int, least_z: float = 5.0, ridge: float = 0.1, rounds: int = 200, rate: float = 0.05) -> Ordinal:
    """Full-batch Adam on the penalised likelihood; rows[i] holds the slots of document i."""
    thresholds = np.linspace(-2.0, 0.0, steps) if steps > 1 else np.zeros(steps)
    if not len(rows) or grades.min() == grades.max():
        return Ordinal(np.zeros(SLOTS), np.full(steps, -10.0))
    n = len(rows)
    size = np.fromiter(map(len, rows), np.int64, n)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n, dtype=np.int32), size)
    df = np.bincount(flat, minlength=SLOTS)
    off = np.bincount(flat, (grades - grades.mean())[owner], minlength=SLOTS)
    z = off / np.sqrt(np.maximum(df * (1 - df / n) * grades.var(), 1e-9))
    kept = np.flatnonzero((df >= 10) & (np.abs(z) >= least_z))
    number = np.full(SLOTS, -1)
    number[kept] = np.arange(len(kept))
    own = number[flat] >= 0
    flat, owner = number[flat[own]], owner[own]
    k = len(kept)
    x, m, v = np.concatenate([np.zeros(k), thresholds]), np.zeros(k + steps), np.zeros(k + steps)
    at, edge = np.arange(n), np.zeros((n, 1))
    for step in range(1, rounds + 1):
        score = np.bincount(owner, x[flat], minlength=n)
        tail = 1 / (1 + np.exp(np.clip(x[None, k:] - score[:, None], -50, 50)))
        above = np.concatenate([np.ones((n, 1)), tail, edge], 1)
        slope = np.concatenate([edge, tail * (1 - tail), edge], 1)
        p = np.maximum(above[at, grades] - above[at, grades + 1], 1e-9)
        by_score = -(slope[at, grades] - slope[at, grades + 1]) / p / n
        by_step = [(np.where(grades == j + 1, slope[:, j + 1], 0) / p - np.where(grades == j, slope[:, j + 1], 0) / p).sum() / n for j in range(steps)]
        grad = np.concatenate([np.bincount(flat, by_score[owner], minlength=k) + ridge * 10 * x[:k] / n, by_step])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(SLOTS)
    weights[kept] = x[:k]
    return Ordinal(weights, np.sort(x[k:]))


def graded(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality 0/1, toxic 0/1) -> (doc_id, grade): 2 good and not toxic, 1 one of these, 0 neither."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return rated.groupBy("doc_id").agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, steps: int = 2, sample: int = 20_000) -> Ordinal:
    """docs(doc_id, text), grades(doc_id, grade from 0 to steps)."""
    picked = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def slots(batches):
        for b in batches:
            texts = b.column("text")
            for at, to in slices(texts):
                text, where = features(texts.slice(at, to - at))
                ends = np.searchsorted(text, np.arange(to - at + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, to - at), b.column("grade").slice(at, to - at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(where, pa.int32()))],
                    ["doc_id", "grade", "slots"],
                )

    def learn(batches):
        found = sorted(((d, g, np.asarray(x.values, np.int32)) for b in batches for d, g, x in zip(b.column("doc_id").to_pylist(), b.column("grade").to_pylist(), b.column("slots"), strict=True)), key=lambda r: r[0])
        model = fit_ordinal([r[2] for r in found], np.array([r[1] for r in found], np.int64), steps)
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1 - np.arange(steps))), pa.array(np.append(model.weights[used], model.thresholds))], ["slot", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "grade")  # `sample` rows
    found = rows.mapInArrow(slots, f"doc_id {kind}, grade int, slots array<int>")
    found = found.groupBy("doc_id").agg(F.min_by(F.struct("grade", "slots"), F.xxhash64("slots")).alias("r")).select("doc_id", "r.*")
    learnt = found.repartition(1).mapInArrow(learn, "slot long, weight double").toPandas()  # SLOTS + steps rows at most
    weights, thresholds = np.zeros(SLOTS), np.full(steps, -10.0)
    of_slot = learnt[learnt.slot >= 0]
    weights[of_slot.slot.to_numpy(np.int64)] = of_slot.weight
    ends = learnt[learnt.slot < 0]
    thresholds[-1 - ends.slot.to_numpy(np.int64)] = ends.weight
    return Ordinal(weights, thresholds)


def scored(docs: DataFrame, model: Ordinal, least: float, name: str = "_grade") -> DataFrame:
    """docs with one more column of that name: struct<expected_grade, p_top (of the highest grade), kept>."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    names = ["expected_grade", "p_top", "kept"]

    def score(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            parts = [given.value.tails(text.slice(at, to - at)) for at, to in slices(text)]
            tail = np.concatenate(parts) if parts else np.zeros((0, 1))
            grade = pa.StructArray.from_arrays([pa.array(tail.sum(1)), pa.array(tail[:, -1]), pa.array(tail[:, -1] >= least)], names)
            yield pa.RecordBatch.from_arrays([*b.columns, grade], [*b.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{kinds}, `{name}` struct<expected_grade: double, p_top: double, kept: boolean>")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7, sample: int = 20_000) -> DataFrame:
    """docs(doc_id, text), labels -> (doc_id, expected_grade, p_top, kept)."""
    model = fit(docs, graded(labels), sample=sample)
    return scored(docs.select("doc_id", "text"), model, least).select("doc_id", "_grade.*")


def select_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7, sample: int = 20_000) -> DataFrame:
    """The documents that are kept."""
    name = unused("_grade", docs)
    return scored(docs, fit(docs, graded(labels), sample=sample), least, name).where(F.col(name)["kept"]).select(*docs.columns)
