"""Token counts of whole documents; huge ones by overlapping chunks, spliced where both encodings agree.

A huge document is cut into chunks that run `overlap` characters into the next one. Chunks are rows of their own, so that
one document keeps many tasks busy. Each is encoded by the library with offsets. Two neighbours are spliced at a position
in their overlap where a token starts in both and the character before is ASCII white space: the tokenizer drops white
space and never joins across it, so the ids on either side of such a place don't depend on what stands on the other.
Where an overlap has no such place (one very long word), that document is done again with overlaps four times as wide,
at last as one piece.

Null text counts as empty; a document of white space has 0 tokens. Rows that repeat stay as they are, each with its own
count; rows with a null doc_id too. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch
from rankcut.llm.token_ids import TOKENIZER, encoded, encoder, tokenizer_path

AT_ONCE = 64  # chunks that leave a task together


def _marks(texts: list[str], starts: list[int], path: str) -> list[tuple[int, list[int], list[int]]]:
    """For each chunk: its number of tokens; the places (in the document) where a token follows white space; the number
    of tokens before each of them."""
    out = []
    for text, base, enc in zip(texts, starts, encoder(path).library.encode_batch(texts, add_special_tokens=False), strict=True):
        first = np.array([o[0] for o in enc.offsets], np.int64)
        ok = [i for i, p in enumerate(first) if p and text[p - 1] in " \t\n\x0b\f\r" and (not i or first[i - 1] != p)]
        out.append((len(enc.ids), [int(first[i]) + base for i in ok], ok))
    return out


def _chunk_counts(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """huge(key, text) -> (key, n_tokens, settled)."""
    schema = pa.schema([("key", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("part", pa.string())])

    def cut(batches):  # in one pass over each text, some MB of chunks at a time
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), (x.as_py() for x in b.column("text")), strict=True):
                ks = range(max(-(-len(text) // chunk), 1))
                for some in (ks[i : i + AT_ONCE] for i in ks[::AT_ONCE]):
                    parts = [text[k * chunk : (k + 1) * chunk + overlap] for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(([key] * len(parts), [len(text)] * len(parts), list(some), parts), schema, strict=True)], schema=schema)

    chunks = huge.select("key", "text").mapInArrow(cut, "key string, n int, k int, part string")

    def encode(batches):
        for b in batches:
            ks = b.column("k").to_pylist()
            for row in range(b.num_rows):
                [(total, places, before)] = _marks([b.column("part")[row].as_py()], [ks[row] * chunk], path)
                head = [(p, i) for p, i in zip(places, before) if p < ks[row] * chunk + overlap]
                tail = [(p, i) for p, i in zip(places, before) if p >= (ks[row] + 1) * chunk]
                yield pa.RecordBatch.from_pydict(
                    {"key": [b.column("key")[row].as_py()], "n": [b.column("n")[row].as_py()], "k": [ks[row]], "total": [total], "head": [dict(head)], "tail": [dict(tail)]},
                    schema=pa.schema([("key", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("total", pa.int64()), ("head", pa.map_(pa.int64(), pa.int64())), ("tail", pa.map_(pa.int64(), pa.int64()))]),
                )

    w = Window.partitionBy("key").orderBy("k")
    marked = (
        chunks.repartition("key", "k")
        .mapInArrow(encode, "key string, n int, k int, total long, head map<bigint,bigint>, tail map<bigint,bigint>")
        .withColumn("next", F.lead("head").over(w))
        .withColumn("last", F.col("k") == F.max("k").over(Window.partitionBy("key")))
        .withColumn("splice", F.expr("if(last, null, array_min(array_intersect(map_keys(tail), map_keys(next))))"))
        .withColumn("came", F.lag("splice").over(w))
    )
    return (
        marked.withColumn("n_here", F.expr("if(last, total, element_at(tail, splice)) - if(k = 0, 0, element_at(head, came))"))
        .groupBy("key")
        .agg(F.sum("n_here").alias("n_tokens"), F.min((F.col("last") | F.col("splice").isNotNull()).cast("int")).alias("settled"), F.max("n").alias("n"))
    )


def count_tokens(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = 2048,
    huge: int = 65_536,
    chunk: int = 16_384,
    overlap: int = 512,
) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit). Documents of over `huge` characters go by chunks,
    each distinct text once."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")

    def small(batches):
        for b in batches:
            counts = np.zeros(b.num_rows, np.int64)
            for at, to, _, n in encoded(b.column("text"), path, want_ids=False):
                counts[at:to] = n
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    plain = docs.where(F.length("text") <= huge).select("doc_id", "text", size)
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = plain.mapInArrow(small, f"doc_id {kind}, n_bytes long, n_tokens long")
    long = docs.where(F.length("text") > huge).select("doc_id", size, F.sha2("text", 256).alias("key"), "text")
    scratch, texts = Scratch(spark), long.select("key", "text").dropDuplicates(["key"])
    left, counted = texts, None
    while True:
        got = scratch.keep(_chunk_counts(left, path, chunk, overlap), "token-chunks")
        part = got.where("settled = 1").select("key", "n_tokens")
        counted = part if counted is None else counted.union(part)
        open_, most = got.where("settled = 0").agg(F.count("*"), F.max("n")).first()
        if not open_:
            break
        left = texts.join(got.where("settled = 0").select("key"), "key", "left_semi")
        overlap *= 4
        chunk = chunk if overlap < most else most
    pieces = long.drop("text").join(counted, "key").select("doc_id", "n_bytes", F.col("n_tokens").cast("long"))
    return done.union(pieces).withColumn("over_limit", F.col("n_tokens") > limit)
