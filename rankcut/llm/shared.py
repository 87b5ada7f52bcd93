"""What the operators of this subpackage have in common: shared storage, text columns, word hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only where that setting is absent (tests, one machine) a temporary folder takes its place.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder to cut lineage. drop() deletes what no result needs any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, tag: str, *folders: str) -> DataFrame:
        """folders: columns whose values are the names of folders."""
        path = new_path(self.spark, tag)
        df.write.parquet(path, partitionBy=list(folders) or None)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if (path := self.paths.pop(id(df), None)) is not None:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unused(name: str, df: DataFrame) -> str:
    """The name, with more underscores where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(texts: pa.Array, most: int = 4_000_000):
    """(from, to) of runs of rows holding about `most` bytes each, so that a batch of long texts stays small."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cum, at, n = np.cumsum(size), 0, len(size)
    while at < n:
        to = int(np.searchsorted(cum, (cum[at - 1] if at else 0) + most, side="right"))
        to = min(n, max(to, at + 1))
        yield at, to
        pa.default_memory_pool().release_unused()
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix64 (fixed constants of that published generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _stars(small: bool):
    """For mapInArrow over edges (a, b) that lie together by a, sorted by a and b: ties neighbours of a to the least of
    them. Large star: those above a, to the least of a and all. Small star (all lie below a): these and a itself."""

    def star(batches):
        of, least = None, 0
        last = (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(c).to_numpy() for c in (0, 1))
            first = np.ones(len(a), bool)
            first[1:] = a[1:] != a[:-1]
            first[0] = of is None or a[0] != of
            low = np.where(first, b if small else np.minimum(a, b), 0)
            starts = np.maximum.accumulate(np.where(first, np.arange(len(a)), -1))
            m = np.where(starts >= 0, low[starts], least)
            same = np.zeros(len(a), bool)  # an edge that repeats
            same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            same[0] = (a[0], b[0]) == last
            of, least, last = a[-1], m[-1], (a[-1], b[-1])
            if small:
                x = np.where(b == m, a, b)
                keep = ~same
            else:
                x, keep = b, ~same & (b > a)
            keep &= x != m
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(m[keep])], ["a", "b"])

    return star


def connected(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Connected components of edges(a, b), both long: (node, root), root the least node of the component.

    Leaves (nodes with one neighbour, which is smaller) are set aside, so that what is tied to a hub alone doesn't gather in
    one task. On the rest, rounds of large-star and small-star (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014), each two shuffles and written to the shared folder; ends when a round changes nothing. Then leaves take
    their neighbour's root. Nothing is collected but a count and a sum for each round.
    """
    every = scratch.keep(
        edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct(), tag
    )
    ends = every.select("a", F.lit(1).alias("up"), "b").union(every.select("b", F.lit(0), "a"))
    single = ends.groupBy("a").agg(F.count("*").alias("n"), F.max("up").alias("up"), F.max("b").alias("b")).where("n = 1 and up = 1").select("a", "b")
    leaves = scratch.keep(single, tag)
    cur, seen = every.join(leaves.hint("merge"), ["a", "b"], "left_anti"), None
    kind = "a long, b long"
    while True:
        both = cur.union(cur.select("b", "a"))
        large = both.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_stars(False), kind)
        small = large.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_stars(True), kind)
        told = Observation()
        small = small.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x"))
        nxt = scratch.keep(small, tag)
        scratch.drop(cur)
        cur, row = nxt, tuple(sorted(told.get.items()))
        if row == seen or not told.get["n"]:
            break
        seen = row
    cur = cur.distinct()
    core = cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select("b", "b").distinct())
    core = scratch.keep(core, tag)
    of_leaves = leaves.join(core.hint("merge"), F.col("b") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("root"))
    hubs = leaves.select("b").distinct().join(core.hint("merge"), F.col("b") == F.col("node"), "left_anti").select(F.col("b").alias("node"), F.col("b").alias("root"))
    return core.union(of_leaves).union(hubs)
