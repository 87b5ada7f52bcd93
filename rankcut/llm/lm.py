"""Document scores by a small gated recurrent language model, trained in numpy inside Spark tasks.

Tokens are the words of the text, letters A-Z in lower case, and one end. Counts of all training tokens are gathered by a
shuffle. The `lexicon` most frequent words (the end among them) are the model's own; all others are one more word to it,
OTHER, and share OTHER's probability in proportion to their count plus one (with one more for words never seen), so the
probabilities of all texts add up. The output softmax is factored: classes of words of like frequency, then the words of
the class.

Training: gated recurrent units, truncated backpropagation over windows of `steps` tokens in many lanes at once, the state
being carried from window to window of a document and cleared between documents. All training documents are used once,
in `rounds` parts by a hash of doc_id; in each round every task trains from the common weights on its own documents, and
the weights are averaged by tokens, in two levels, so neither the driver nor a task gets more than some hundred copies of
the small model at a time. Scoring runs complete documents, state carried, many side by side.

Counts of words with at least a certain count (at most `frequent` words, found from a histogram of the counts) are
broadcast, a bounded dictionary; the rest of the counts are joined to the documents' rare words by a shuffle.

Null text counts as empty (its end alone). A null doc_id counts as not held out. Rows that repeat are scored each. An
empty table, or one without training documents, gives the scores of uniform weights. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch, slices

END = ""  # no word is empty
MOST = np.float32(60)  # logits are held below it, so that their exponentials are finite
BATCH = 24_000_000  # bytes of text that are trained on or scored side by side


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of each word, distinct words, bounds of each text), without ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():  # white space at the ends of a text
        flat = flat.filter(pa.array(real))
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), bounds


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(text) -> (word, n), ends as the empty word."""

    def count(batches):
        ends = 0
        for b in batches:
            for at, to in slices(b.column(0)):
                codes, words, _ = tokens_of(b.column(0).slice(at, to - at))
                ends += to - at
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.bincount(codes, minlength=len(words)))], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END] if ends else [], pa.string()), pa.array([ends] if ends else [], pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Shape:
    """Lexicon of classes * size words, OTHER being the last place used; h hidden units."""

    classes: int = 32
    size: int = 32
    h: int = 16
    words: int = 1024  # places used

    def parts(self) -> dict[str, tuple[int, ...]]:
        return {"x": (self.words, 3 * self.h), "u": (self.h, 2 * self.h), "un": (self.h, self.h), "c": (self.h, self.classes), "cb": (self.classes,), "w": (self.classes, self.h, self.size), "wb": (self.classes, self.size)}

    def start(self) -> np.ndarray:
        g = np.random.default_rng(11)
        return np.concatenate([(g.standard_normal(s) * (0.0 if len(s) == 1 or n == "wb" else 0.1)).ravel() for n, s in self.parts().items()]).astype(np.float32)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, s in self.parts().items():
            n = int(np.prod(s))
            out[name] = flat[at : at + n].reshape(s)
            at += n
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


@dataclass
class Lanes:
    """Documents side by side: (steps, lanes) of inputs, targets and whether a document begins; lanes by length."""

    inputs: np.ndarray
    targets: np.ndarray
    fresh: np.ndarray
    lengths: np.ndarray
    where: np.ndarray = field(default=None)  # place of each token of the stream, as step * lanes + lane


def even_lanes(ids: np.ndarray, bounds: np.ndarray, end: int, lanes: int) -> Lanes:
    """The stream of all documents cut into lanes of equal length, for training: a document that is cut goes on in the
    next lane from a cleared state."""
    lanes = max(1, min(lanes, len(ids) // 2000 + 16))
    room = -(-len(ids) // lanes)
    full = np.full((3, room * lanes), end, np.int32)
    full[0, : len(ids)] = ids
    full[1, 1 : len(ids)] = ids[:-1]
    full[1, bounds[:-1]] = end
    full[2] = 0
    full[2, bounds[:-1]] = 1
    targets, inputs, fresh = (np.ascontiguousarray(a.reshape(lanes, room).T) for a in full)
    return Lanes(inputs, targets, fresh.astype(bool), np.clip(len(ids) - room * np.arange(lanes), 0, room))


def in_lanes(ids: np.ndarray, bounds: np.ndarray, end: int, most: int = 1024) -> Lanes:
    """ids: all documents' targets in a row, each with its end. Documents stay whole; there are about as many lanes as
    keep all of them busy while the longest document runs."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    # a long document doesn't make the others' lanes long: those that hold nothing are not made
    lanes = max(1, min(most, len(size), max(64, 2 * len(ids) // int(size.max())), -(-len(ids) // int(size.max())) + 1))
    ends = np.concatenate([[0], np.cumsum(size[order])])
    room = max(-(-int(ends[-1]) // lanes), int(size.max()))
    lane = np.minimum(ends[:-1] // room, lanes - 1)
    length = np.bincount(lane, size[order], minlength=lanes).astype(np.int64)
    rank = np.argsort(-length, kind="stable")
    new = np.empty(lanes, np.int64)
    new[rank] = np.arange(lanes)
    lane = new[lane]
    length = length[rank]
    before = np.zeros(len(size), np.int64)
    by_lane = np.argsort(lane, kind="stable")
    c = np.concatenate([[0], np.cumsum(size[order][by_lane])])[:-1]
    first = np.searchsorted(lane[by_lane], lane[by_lane])
    before[by_lane] = c - c[first]
    step0, lane0 = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    step0[order], lane0[order] = before, lane
    within = np.arange(len(ids)) - np.repeat(bounds[:-1], size)
    where = (np.repeat(step0, size) + within) * lanes + np.repeat(lane0, size)
    steps = int(length.max())
    inputs, targets, fresh = np.full(steps * lanes, end, np.int32), np.full(steps * lanes, end, np.int32), np.zeros(steps * lanes, bool)
    targets[where] = ids
    shifted = np.empty_like(ids)
    shifted[1:] = ids[:-1]
    shifted[bounds[:-1]] = end
    inputs[where] = shifted
    fresh[where[bounds[:-1]]] = True
    return Lanes(*(a.reshape(steps, lanes) for a in (inputs, targets, fresh)), length, where)


def run_window(p: dict, shape: Shape, h: np.ndarray, x: np.ndarray, fresh: np.ndarray) -> tuple:
    """States of a window; x: (steps, lanes) inputs."""
    n, k = x.shape[0], shape.h
    hs, rz, cand, prev = (np.empty((n, x.shape[1], m), np.float32) for m in (k, 2 * k, k, k))
    for t in range(n):
        if fresh[t].any():
            h = h * ~fresh[t][:, None]
        prev[t] = h
        a = p["x"][x[t]]
        g = sigmoid(a[:, : 2 * k] + h @ p["u"])
        rz[t] = g
        cand[t] = np.tanh(a[:, 2 * k :] + (g[:, :k] * h) @ p["un"])
        z = g[:, k:]
        h = cand[t] + z * (h - cand[t])
        hs[t] = h
    return h, hs, rz, cand, prev


def outputs(p: dict, shape: Shape, hs: np.ndarray, y: np.ndarray, want_grad: bool):
    """ln P of targets y given states hs (rows); with gradients of the sum of -ln P, if wanted."""
    cls, nth = y // shape.size, y % shape.size
    logits = np.minimum(hs @ p["c"] + p["cb"], MOST)
    e = np.exp(logits)
    total = e @ np.ones(shape.classes, np.float32)
    lp = logits[np.arange(len(y)), cls] - np.log(total)
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cut = np.searchsorted(cls[order], np.arange(shape.classes + 1))
    if want_grad:
        d = e / total[:, None]
        d[np.arange(len(y)), cls] -= 1
        dh = d @ p["c"].T
        grad = {"c": hs.T @ d, "cb": d.sum(0), "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
    for c in range(shape.classes):
        rows = order[cut[c] : cut[c + 1]]
        if not len(rows):
            continue
        used = min(shape.size, shape.words - c * shape.size)
        own = hs[rows]
        q = np.minimum(own @ p["w"][c][:, :used] + p["wb"][c][:used], MOST)
        eq = np.exp(q)
        tq = eq @ np.ones(used, np.float32)
        at = np.arange(len(rows))
        lp[rows] += q[at, nth[rows]] - np.log(tq)
        if want_grad:
            dq = eq / tq[:, None]
            dq[at, nth[rows]] -= 1
            dh[rows] += dq @ p["w"][c][:, :used].T
            grad["w"][c][:, :used] = own.T @ dq
            grad["wb"][c][:used] = dq.sum(0)
    return (lp, dh, grad) if want_grad else lp


def train(flat: np.ndarray, shape: Shape, lanes: Lanes, moments: tuple, steps: int, rate: float) -> int:
    """One pass over the lanes by Adam, in place; moments: (first, second, [updates])."""
    m, v, count = moments
    p, k = shape.views(flat), shape.h
    g_flat = np.zeros_like(flat)
    g = shape.views(g_flat)
    h = np.zeros((lanes.inputs.shape[1], k), np.float32)
    seen = 0
    for t0 in range(0, lanes.inputs.shape[0], steps):
        n = int(np.searchsorted(-lanes.lengths, -t0, side="left"))  # lanes that still run
        if not n:
            break
        window = slice(t0, t0 + steps)
        x, y, fresh = lanes.inputs[window, :n], lanes.targets[window, :n], lanes.fresh[window, :n]
        live = np.arange(t0, t0 + x.shape[0])[:, None] < lanes.lengths[None, :n]
        h, hs, rz, cand, prev = run_window(p, shape, h[:n], x, fresh)
        rows = np.flatnonzero(live.ravel())
        _, dh_rows, grad = outputs(p, shape, hs.reshape(-1, k)[rows], y.ravel()[rows], True)
        dhs = np.zeros((x.size, k), np.float32)
        dhs[rows] = dh_rows
        dhs = dhs.reshape(*x.shape, k)
        da = np.empty((*x.shape, 3 * k), np.float32)
        carry = np.zeros((n, k), np.float32)
        g_flat[:] = 0
        for t in range(x.shape[0] - 1, -1, -1):
            d = dhs[t] + carry
            r, z = rz[t][:, :k], rz[t][:, k:]
            dn = d * (1 - z) * (1 - cand[t] ** 2)
            drh = dn @ p["un"].T
            da[t][:, :k] = drh * prev[t] * r * (1 - r)
            da[t][:, k : 2 * k] = d * (prev[t] - cand[t]) * z * (1 - z)
            da[t][:, 2 * k :] = dn
            g["un"] += (r * prev[t]).T @ dn
            g["u"] += prev[t].T @ da[t][:, : 2 * k]
            carry = d * z + drh * r + da[t][:, : 2 * k] @ p["u"].T
            if fresh[t].any():
                carry = carry * ~fresh[t][:, None]
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        at = np.flatnonzero(np.diff(ids[order], prepend=-1))
        g["x"][ids[order][at]] = np.add.reduceat(da.reshape(-1, 3 * k)[order], at, axis=0)
        for name, value in grad.items():
            g[name][:] = value
        g_flat /= max(1, len(rows))
        norm = float(np.sqrt((g_flat * g_flat).sum()))
        if norm > 1:
            g_flat /= norm
        count[0] += 1
        m += 0.1 * (g_flat - m)
        v += 0.01 * (g_flat * g_flat - v)
        flat -= np.float32(rate / (1 - 0.9 ** count[0])) * m / (np.sqrt(v / np.float32(1 - 0.99 ** count[0])) + np.float32(1e-7))
        seen += len(rows)
    return seen


def log_probabilities(flat: np.ndarray, shape: Shape, lanes: Lanes, steps: int = 64) -> np.ndarray:
    """ln P of each token of the stream."""
    p, k = shape.views(flat), shape.h
    out = np.zeros(lanes.inputs.shape, np.float32)
    h = np.zeros((lanes.inputs.shape[1], k), np.float32)
    for t0 in range(0, lanes.inputs.shape[0], steps):
        n = int(np.searchsorted(-lanes.lengths, -t0, side="left"))
        if not n:
            break
        window = slice(t0, t0 + steps)
        h, hs, *_ = run_window(p, shape, h[:n], lanes.inputs[window, :n], lanes.fresh[window, :n])
        out[window, :n] = outputs(p, shape, hs.reshape(-1, k), lanes.targets[window, :n].ravel(), False).reshape(hs.shape[:2])
    return out.ravel()[lanes.where]


def with_ends(codes: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(codes, bounds[1:], end), bounds + np.arange(len(bounds))


def lexicon_ids(words: list[str], lexicon: dict[str, int], other: int) -> np.ndarray:
    return np.fromiter((lexicon.get(w, other) for w in words), np.int32, len(words))


def trained(docs: DataFrame, lexicon, shape: Shape, rounds: int, lanes: int, steps: int, rate: float) -> np.ndarray:
    """The averaged weights after all rounds. lexicon: broadcast (word -> place)."""
    spark = docs.sparkSession
    flat = shape.start()
    kind = "n long, weights array<float>"

    def add(batches):
        total, sum_ = 0, None
        for b in batches:
            for n, w in zip(b.column("n").to_pylist(), b.column("weights"), strict=True):
                part = w.values.to_numpy().astype(np.float64) * n
                total, sum_ = total + n, part if sum_ is None else sum_ + part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(sum_ / total).astype(np.float32)], pa.list_(pa.float32()))], ["n", "weights"])

    for r in range(rounds):
        given = spark.sparkContext.broadcast(flat)

        def fit(batches, given=given):
            own, seen = given.value.copy(), 0
            moments = (np.zeros_like(own), np.zeros_like(own), [0])
            words, other = lexicon.value, shape.words - 1
            for b in batches:
                for at, to in slices(b.column(0), BATCH):
                    codes, known, bounds = tokens_of(b.column(0).slice(at, to - at))
                    ids = lexicon_ids(known, words, other)[codes] if len(codes) else np.zeros(0, np.int32)
                    ids, bounds = with_ends(ids, bounds, words[END])
                    seen += train(own, shape, even_lanes(ids, bounds, words[END], lanes), moments, steps, rate)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([own], pa.list_(pa.float32()))], ["n", "weights"])

        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text").mapInArrow(fit, kind)
        groups = max(1, round(docs.rdd.getNumPartitions() ** 0.5))
        got = part.repartition(groups).mapInArrow(add, kind).repartition(1).mapInArrow(add, kind).first()
        if got is not None:
            flat = np.array(got["weights"], np.float32)
    return flat


def score_documents(
    docs: DataFrame, lexicon: int = 1024, frequent: int = 150_000, rounds: int = 3, lanes: int = 512, steps: int = 16, rate: float = 0.02
) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    learning = docs.where("not held_out").select("doc_id", "text")
    counts = scratch.keep(word_counts(learning), "counts")
    n_all, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the least count with at most `frequent` words at or above it, from a histogram over the counts' first two digits
    head = F.expr("bigint(rpad(substring(string(n), 1, 2), length(string(n)), '0'))")
    bins = sorted(((r[0], r[1]) for r in counts.groupBy(head.alias("at")).count().collect()), reverse=True)  # under 2,000 rows
    have, least = 0, (bins[0][0] + 10 ** max(0, len(str(bins[0][0])) - 2) if bins else 1)
    for at, k in bins:
        if have + k > frequent:
            break
        have, least = have + k, at
    top = counts.where(F.col("n") >= least).toPandas()
    top = top.sort_values(["n", "word"], ascending=[False, True], kind="stable")
    own = dict(zip(top.word, top.n.astype(int), strict=True))
    if END not in own:
        own[END] = (counts.where(F.col("word") == END).first() or [END, 0])[1]
    ranked = [END, *(w for w in top.word if w != END)][: lexicon - 1]
    places = {w: i for i, w in enumerate(ranked)}
    shape = Shape(classes=-(-(len(ranked) + 1) // 32), size=32, words=len(ranked) + 1)
    given, frequent_words = spark.sparkContext.broadcast(places), spark.sparkContext.broadcast(own)
    flat = spark.sparkContext.broadcast(trained(learning, given, shape, rounds, lanes, steps, rate))
    other, in_lexicon = shape.words - 1, sum(own[w] for w in ranked)
    known_words = frozenset(w for w in ranked if own[w] > 0)

    names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "in_lexicon", "beyond", "model", "n_other", "word", "tf"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, in_lexicon double, beyond double, model double, n_other long, word string, tf int"

    def score(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 36
        words, frequent_n, weights = given.value, frequent_words.value, flat.value
        for b in batches:
            for at, to in slices(b.column("text"), BATCH):
                codes, distinct, bounds = tokens_of(b.column("text").slice(at, to - at))
                n, empty = to - at, len(codes) == 0
                distinct = [*distinct, END]
                codes, bounds = with_ends(codes, bounds, len(distinct) - 1)
                ids = lexicon_ids(distinct, words, other)
                c = np.fromiter((frequent_n.get(w, -1) for w in distinct), np.int64, len(distinct))
                logs = np.log10(np.maximum(c, 0) + 1.0)
                owner = np.repeat(np.arange(n), np.diff(bounds))
                mine, common = ids[codes] != other, c[codes] >= 0
                sums = lambda weight: np.bincount(owner, weight, minlength=n)
                lp = log_probabilities(weights, shape, in_lanes(ids[codes], bounds, words[END]))
                keys = key + np.arange(n)
                key += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), b.column("doc_id").slice(at, n), b.column("held_out").slice(at, n), pa.array(np.diff(bounds)), pa.array(sums(c[codes] > 0).astype(np.int64)), pa.array(sums(np.where(mine, logs[codes], 0))), pa.array(sums(np.where(common & ~mine, logs[codes], 0))), pa.array(sums(lp) / np.log(10)), pa.array(sums(~mine).astype(np.int64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())],
                    names,
                )
                rare = np.flatnonzero(~common)
                if len(rare) and not empty:
                    pair, tf = np.unique(owner[rare] << 32 | codes[rare], return_counts=True)
                    k = len(pair)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[pair >> 32]), pa.nulls(k, b.schema.field("doc_id").type), pa.nulls(k, pa.bool_()), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())), pa.array(distinct, pa.string()).take(pa.array(pair & 0xFFFFFFFF)), pa.array(tf.astype(np.int32))],
                        names,
                    )

    parts = scratch.keep(docs.mapInArrow(score, schema), "scored")
    seldom = counts.where((F.col("n") < least) & (F.col("word") != END))
    rare = (
        parts.where("word is not null")
        .select("key", "word", "tf")
        .join(seldom, "word")  # a word never seen adds log10(1) = 0
        .groupBy("key")
        .agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("rare"), F.sum("tf").alias("rare_known"))
    )
    of_base, of_other = float(np.log10(n_all + n_words + 1)), float(np.log10(max(1, n_all - in_lexicon + n_words - len(known_words) + 1)))
    rare_sum = F.coalesce("rare", F.lit(0.0))
    return (
        parts.where("word is null")
        .join(rare, "key", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("in_lexicon") + F.col("beyond") + rare_sum - F.col("n_tokens") * of_base).alias("base_score"),
            (F.col("model") + F.col("beyond") + rare_sum - F.col("n_other") * of_other).alias("score"),
        )
    )
