"""Near-duplicate documents: improved consistent weighted sampling (Ioffe, 2010) of TF-IDF weighted five-word shingles.

A shingle's weight in a document is its count there times the mean IDF of its five words. Document frequencies are
counted over all documents in 2^16 slots of the words' hashes: 65,536 numbers whatever the input, so they can be
broadcast. The IDF is log(1 + N / (1 + df)). (An IDF of whole shingles would weigh what few copies share less than where
they differ, and so tear groups of copies apart.)

Signature: for each of bands * rows samples, the shingle and its quantum of weight with the least hash. Two documents
agree in a sample with the probability of their weighted Jaccard similarity. Documents with equal words in equal order
are one node from the start. Within a bucket of a band, however large, a node is a candidate with two leaders: the least
id and the most central node (that with the most neighbours in its buckets: an original, of a group whose copies are alike
only to it). So candidates grow with the rows.

Candidates whose signatures agree in less than `least` of all samples are left for later (3.5 standard deviations below the
limit). Then each node's best candidate is verified on whole texts, components are built, and candidates that still lie in
different components are verified; so long groups need few text comparisons.

A second round settles all other pairs of nodes that share a bucket and lie in different components, without leaders and
without signatures (see far_pairs): exact bounds leave out those that cannot reach the limit, the rest is verified. So two
documents that share a bucket and reach the limit are always in one class.
A class is a component; its id is its least doc_id.

Null text counts as empty. Documents without words are one class. A null doc_id gets the class of documents with the same
words, or null. Rows that repeat are in one class. Rows with one doc_id and different texts tie their classes together, and
one_of_each keeps the one with the least hash of its text. Ties go to the least id. Very long texts are taken whole. An
empty table gives an empty result. Other columns, whatever their names, are ignored, and kept by one_of_each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch, connected, mixed, slices
from rankcut.llm.words import content_hashes, shingles, sums, word_hashes

SLOTS = 1 << 16
TABLE = 1 << 16
GROUP = 256  # about how many nodes of a bucket lie in one block


def document_frequencies(docs: DataFrame, scratch: Scratch) -> tuple[np.ndarray, int]:
    """(number of documents for each slot of word hashes, number of documents)."""

    def count(batches):
        df, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            texts = b.column(0)
            for at, to in slices(texts):
                h, bounds = word_hashes(texts.slice(at, to - at))
                key = np.repeat(np.arange(to - at), np.diff(bounds)) << 16 | (h >> np.uint64(48)).astype(np.int64)
                df += np.bincount(np.unique(key) & (SLOTS - 1), minlength=SLOTS)
                n += to - at
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), -1)), pa.array(np.append(df[df > 0], n))], ["slot", "n"])

    rows = scratch.keep(docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "df")
    pdf = rows.toPandas()  # SLOTS + 1 rows at most
    scratch.drop(rows)
    df = np.zeros(SLOTS + 1, np.int64)
    df[pdf.slot.to_numpy(np.int64)] = pdf.n.to_numpy(np.int64)  # slot -1 is the last place
    return df[:-1], int(df[-1])


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(n / (1.0 + df)).astype(np.float32)


def sampling_tables(seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, log c + 64 and beta of consistent weighted sampling for each of TABLE hash values."""
    g = np.random.default_rng(seed)
    r = g.gamma(2.0, 1.0, TABLE).astype(np.float32)
    log_c = np.log(g.gamma(2.0, 1.0, TABLE)).astype(np.float32) + np.float32(64)
    return np.maximum(r, np.float32(1e-3)), log_c, g.random(TABLE).astype(np.float32)


def weighted_shingles(texts: pa.Array, idf: np.ndarray | None, n: int = 5):
    """(text of each distinct shingle, hash, weight, bounds by text, word hashes, their bounds), by text and hash.
    Without idf each distinct shingle has weight 1."""
    h, words = word_hashes(texts)
    s, first, bounds = shingles(h, words, n)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = owner.astype(np.uint64) << np.uint64(44) | s >> np.uint64(20)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key)))
    pick = order[at]
    if idf is None:
        owner = owner[pick]
        return owner, s[pick], np.ones(len(pick), np.float32), np.searchsorted(owner, np.arange(len(bounds))), h, words
    value = np.concatenate([[np.float64(0)], np.cumsum(idf[(h >> np.uint64(48)).astype(np.int64)], dtype=np.float64)])
    size = np.minimum(n, np.diff(words))[owner]
    # The mean is rounded, so that a shingle has the same weight wherever it stands.
    mean = np.round((value[first[pick] + size[pick]] - value[first[pick]]) / size[pick], 3).astype(np.float32)
    owner = owner[pick]
    return owner, s[pick], mean * tf.astype(np.float32), np.searchsorted(owner, np.arange(len(bounds))), h, words


def signatures(s: np.ndarray, w: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """(texts, k) samples as 64-bit numbers: the least hash (a float's bits) above 32 bits of its shingle."""
    r, log_c, beta = sampling_tables()
    out = np.full((len(bounds) - 1, k), np.uint64(0))
    full = np.flatnonzero(np.diff(bounds))
    log_w = np.log(w)
    low = s & np.uint64(0xFFFFFFFF)
    mult = mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x51ED270B)) | np.uint64(1)
    step = 1 << 16
    at = 0
    while at < len(full):  # runs of texts of about `step` shingles, so that arrays stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(bounds[full], bounds[full[at]] + step)))
        to = min(to, len(full))
        a, z = bounds[full[at]], bounds[full[to - 1] + 1]
        starts, own_s, own_w, own_low = bounds[full[at:to]] - a, s[a:z], log_w[a:z], low[a:z]
        for j in range(k):
            i = (own_s * mult[j] >> np.uint64(48)).astype(np.int32)
            rr, bb = r[i], beta[i]
            t = np.floor(own_w / rr + bb)
            t -= bb
            t += 1
            t *= rr
            x = log_c[i] - t
            out[full[at:to], j] = np.minimum.reduceat(x.view(np.uint32).astype(np.uint64) << np.uint64(32) | own_low, starts)
        at = to
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(sig), b + 1, np.uint64)
        for j in range(rows):
            x = mixed(x * np.uint64(31) + sig[:, b * rows + j])
        out[:, b] = x
    return out


def lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))


def candidate_pairs(buckets: DataFrame) -> DataFrame:
    """buckets(bucket, node) -> distinct (a, b), a > b: each node with the leaders of its buckets, the least and the most
    central. Pairs without a leader are left to far_pairs."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    central = buckets.join(sizes.hint("merge"), "bucket").groupBy("node").agg(F.sum("n").alias("met"))
    rows = buckets.join(central.hint("merge"), "node")
    leaders = [F.min("node"), F.max_by("node", F.struct("met", -F.col("node")))]
    led = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.array_distinct(F.array(*leaders)).alias("leads")).where("n > 1").select("bucket", "leads")
    stars = buckets.join(led.hint("merge"), "bucket").select("node", F.explode("leads").alias("lead")).where("node <> lead")
    return stars.select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct()


def several_components(heads: DataFrame, roots: DataFrame) -> DataFrame:
    """heads(node, bands), roots(node, root) -> (bucket, node, root) of the buckets that hold several components."""
    rows = heads.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    return rows.join(several.hint("merge"), "bucket").distinct()


def weights(texts: DataFrame, idf) -> DataFrame:
    """texts(node, text) -> (s, node, w): the weight of each shingle, and with s NULL that of the whole text."""

    def weigh(batches):
        for b in batches:
            column = b.column("text")
            for at, to in slices(column):
                owner, s, w, bounds, *_ = weighted_shingles(column.slice(at, to - at), idf.value)
                node = b.column("node").slice(at, to - at)
                yield pa.RecordBatch.from_arrays([pa.array((s >> np.uint64(20)).view(np.int64)), node.take(pa.array(owner)), pa.array(w.astype(np.float64))], ["s", "node", "w"])
                yield pa.RecordBatch.from_arrays([pa.nulls(to - at, pa.int64()), node, pa.array(sums(w.astype(np.float64), bounds))], ["s", "node", "w"])

    return texts.select("node", "text").mapInArrow(weigh, "s long, node long, w double")


def far_pairs(rows: DataFrame, weighed: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """rows(bucket, node, root), weighed: weights() of their texts -> distinct (a, b), a > b, of different components: of
    the pairs that share a bucket all those that can reach the threshold.

    A pair reaches it if its common weight is at least t / (1 + t) of both weights together. A shingle is rare if two of
    these nodes have it at most. Common weight is that of the rare shingles which both have, and at most the lesser of what
    their other shingles weigh. Pairs with a rare shingle in common are listed from these shingles, one for each; the others
    are held against the bound by blocks of their buckets, and only what passes becomes a row. A node of which more than
    1 - t of the weight is rare takes no part there, and nodes of a bucket's largest component don't meet one another.
    """
    t = threshold - 2e-6  # a little below what verify asks for
    share = t / (1 + t)
    rare = weighed.where("s is not null").groupBy("s").agg(F.count("*").alias("n"), F.max("node").alias("a"), F.min("node").alias("b"), F.min("w").alias("w")).where("n <= 2")
    rare = scratch.keep(rare.select("a", "b", "w"), "rare")
    own = rare.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("r"))
    # an id with several texts: the bound of neither text may be exceeded
    whole = weighed.where("s is null").groupBy("node").agg(F.count("*").alias("n"), F.min("w").alias("w"), F.max("w").alias("most"))
    rest = F.when(F.col("n") == 1, F.col("w") - F.coalesce("r", F.lit(0.0))).otherwise(F.col("most"))
    facts = whole.join(own.hint("merge"), "node", "left").select("node", "w", rest.alias("c"))
    facts = scratch.keep(facts.join(rows.select("node", "root").distinct().hint("merge"), "node"), "facts")

    of_a, of_b = (facts.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("root", "w", "c"))) for x in "ab")
    sharing = rare.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("common")).join(of_a.hint("merge"), "a").join(of_b.hint("merge"), "b")
    sharing = sharing.where("roota <> rootb").where(F.col("common") + F.least("ca", "cb") >= share * (F.col("wa") + F.col("wb")))

    met = scratch.keep(rows.join(facts.where(F.col("c") >= t * F.col("w")).drop("root").hint("merge"), "node"), "met")
    sizes = met.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main")).where("n > most")
    met = met.join(sizes.hint("merge"), "bucket").withColumn("hub", F.col("root") == F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.ceil(n / GROUP)).alias("block")
    listed = lambda name: F.collect_list(F.struct("node", "root", "w", "c", "hub")).alias(name)
    left = met.where("not hub").groupBy("bucket", block(F.col("n") - F.col("most"))).agg(listed("x")).select("bucket", "x")
    right = met.groupBy("bucket", block(F.col("n"))).agg(listed("y")).select("bucket", "y")

    def reach(batches):
        for b in batches:
            (x, xs), (y, ys) = (([b.column(c).flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5)], np.append(0, np.cumsum(b.column(c).value_lengths().to_numpy()))) for c in "xy")
            for i in range(b.num_rows):
                (n1, r1, w1, c1, _), (n2, r2, w2, c2, hub) = [v[xs[i] : xs[i + 1], None] for v in x], [v[ys[i] : ys[i + 1]] for v in y]
                p, q = np.nonzero((r1 != r2) & (hub | (n1 > n2)) & (np.minimum(c1, c2) >= share * (w1 + w2)))
                if len(p):
                    p, q = n1[p, 0], n2[q]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], ["a", "b"])

    blocks = left.join(right.hint("merge"), "bucket").select("x", "y").mapInArrow(reach, "a long, b long")
    return sharing.select("a", "b").union(blocks).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of pairs(a, b, ...) whose nodes lie in different components."""
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select(*pairs.columns)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, idf=None) -> DataFrame:
    """pairs(a, b) whose texts(node, text) have at least this Jaccard similarity, weighted where idf is given."""

    def compare(batches):
        for b in batches:
            keep = []
            size = np.maximum(*(np.array([len(x or "") for x in b.column(c).to_pylist()]) for c in ("ta", "tb")))
            at = 0
            while at < b.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), 3_000_000)))
                to = min(to, b.num_rows)
                oa, sa, wa, ba, *_ = weighted_shingles(b.column("ta").slice(at, to - at), idf and idf.value)
                ob, sb, wb, bb, *_ = weighted_shingles(b.column("tb").slice(at, to - at), idf and idf.value)
                ka = oa.astype(np.uint64) << np.uint64(44) | sa >> np.uint64(20)
                kb = ob.astype(np.uint64) << np.uint64(44) | sb >> np.uint64(20)
                _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                common = np.bincount(oa[ia], np.minimum(wa[ia], wb[ib]), minlength=to - at)
                union = sums(wa.astype(np.float64), ba) + sums(wb.astype(np.float64), bb) - common
                keep.append((common >= (threshold - 1e-6) * union) & (union > 0))
                at = to
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_()))

    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, bands: int = 12, rows: int = 4, least: float | None = None
) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, class_id), a row for each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    k = bands * rows
    least = threshold - 3.5 * (threshold * (1 - threshold) / k) ** 0.5 if least is None else least
    df, n = document_frequencies(docs, scratch)
    idf = spark.sparkContext.broadcast(idf_of(df, n))

    def sign(batches):
        for b in batches:
            texts = b.column("text")
            for at, to in slices(texts):
                _, s, w, bounds, h, words = weighted_shingles(texts.slice(at, to - at), idf.value)
                c1, c2 = content_hashes(h, words)
                sig = signatures(s, w, bounds, k)
                band = band_hashes(sig, bands, rows)
                short = mixed(sig).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, to - at), pa.array(c1), pa.array(c2), pa.array(np.diff(words)), lists(band.view(np.int64), pa.int64()), lists(short, pa.int32())],
                    ["doc_id", "c1", "c2", "n_words", "bands", "sig"],
                )

    signed = scratch.keep(
        docs.mapInArrow(sign, "doc_id long, c1 long, c2 long, n_words long, bands array<long>, sig array<int>"), "signatures"
    )
    # the least id stands for all documents with the same words
    firsts = scratch.keep(signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("node")), "firsts")
    heads = signed.where("n_words > 0").join(firsts.select("node"), F.col("doc_id") == F.col("node"), "left_semi").dropDuplicates(["doc_id", "c1", "c2"])
    heads = scratch.keep(heads.select(F.col("doc_id").alias("node"), "bands", "sig"), "heads")
    pairs = candidate_pairs(heads.select("node", F.explode("bands").alias("bucket")))
    sig_a, sig_b = (heads.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    agree = F.expr("aggregate(zip_with(sa, sb, (x, y) -> int(x = y)), 0, (n, x) -> n + x)")

    def agreeing(pairs: DataFrame) -> DataFrame:
        return pairs.join(sig_a.hint("merge"), "a").join(sig_b.hint("merge"), "b").select("a", "b", agree.alias("agree")).where(F.col("agree") >= least * k)

    pairs = scratch.keep(agreeing(pairs), "pairs")
    # of those documents that are in any pair, the texts
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = scratch.keep(docs.join(nodes.hint("merge"), F.col("doc_id") == F.col("node")).select("node", "text"), "texts")
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b"))
    near = scratch.keep(verify(best, texts, threshold, idf), "near")
    roots = scratch.keep(connected(near, scratch, "star"), "roots")
    rest = apart(pairs.join(best, ["a", "b"], "left_anti"), roots).select("a", "b")
    more = scratch.keep(verify(rest, texts, threshold, idf), "more")
    links = near.union(more)
    roots2 = scratch.keep(connected(links, scratch, "star"), "roots")
    scratch.drop(texts, roots)
    several = scratch.keep(several_components(heads, roots2), "several")
    texts = docs.join(several.select("node").distinct().hint("merge"), F.col("doc_id") == F.col("node")).select("node", "text").dropDuplicates()
    texts = scratch.keep(texts, "texts")
    weighed = scratch.keep(weights(texts, idf), "weights")
    far = scratch.keep(far_pairs(several, weighed, threshold, scratch), "far")
    scratch.drop(weighed)
    found = scratch.keep(verify(far, texts, threshold, idf), "found")
    if not found.isEmpty():
        roots2 = scratch.keep(connected(links.union(found), scratch, "star"), "roots")
    scratch.drop(heads, pairs, near, more, several, texts, far)
    ids = firsts.join(roots2, "node", "left").select("c1", "c2", F.coalesce("root", "node").alias("class_id"))
    return signed.select("doc_id", "c1", "c2").join(ids, ["c1", "c2"]).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents whose id is that of their class; of rows with the same id, one. Rows without class stay."""
    own = classes.where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(own, "doc_id", "left_semi")
    kept = kept.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64("text")).alias("_row")).select("_row.*")
    loose = docs.where("doc_id is null").dropDuplicates()
    return kept.unionByName(loose)
