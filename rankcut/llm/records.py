"""Files of token ids: length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A file holds records in a row. A record is
    8 bytes   length of the data, little-endian
    4 bytes   masked CRC-32C of those 8 bytes
    n bytes   data: doc_id (8 bytes, signed), then the ids (2 bytes each, or 4 where the vocabulary needs it)
    4 bytes   masked CRC-32C of the data
which is the TFRecord framing. The index is a table with the file, byte offset and length of each record, and how many
ids stand before it in its file, so a reader can take records in any order.

Documents are dealt to files by ranges of doc_id (rows with one doc_id by a hash of their text) and sorted within. A task
writes under a name of its own and then moves the file to its final name; a task that runs again writes the same bytes, so
a lost executor or a second attempt does no harm, and an attempt that fails deletes what it wrote. Very long texts are one
record each. Null text counts as empty, a null doc_id comes first (stored as the least 64-bit number and given back as null),
rows that repeat are records each. An empty table writes no file. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch, new_path
from rankcut.llm.token_ids import TOKENIZER, encoded, tokenizer_path

NO_ID = -(2**63)
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected (fixed value of the format)
MASK = 0xA282EAD8  # fixed value of the format
BLOCK = 64  # bytes that the vectorized checksum takes at a time


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_T = [_byte_table()]
for _k in range(3):
    _T.append(_T[0][_T[-1] & 0xFF] ^ (_T[-1] >> 8))


def _zeros_tables(n: int) -> list[np.ndarray]:
    """Tables, by byte of a CRC state, of the state after n zero bytes."""
    state = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(n):
        state = _T[0][state & 0xFF] ^ (state >> 8)
    tables = []
    for k in range(4):
        t = np.zeros(256, np.uint32)
        for bit in range(8):
            t ^= np.where(np.arange(256) >> bit & 1, state[8 * k + bit], 0).astype(np.uint32)
        tables.append(t)
    return tables


_Z = _zeros_tables(BLOCK)


def crc32c_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of each slice of a byte array. Whole blocks of all slices go side by side, and are joined by linearity."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    blocks = lengths // BLOCK
    total = int(blocks.sum())
    if total:
        owner = np.repeat(np.arange(len(starts)), blocks)
        nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = starts[owner] + nth * BLOCK
        part = np.zeros(total, np.uint32)
        for w in range(0, BLOCK, 4):
            x = data[at + w].astype(np.uint32) | data[at + w + 1].astype(np.uint32) << 8 | data[at + w + 2].astype(np.uint32) << 16 | data[at + w + 3].astype(np.uint32) << 24
            part ^= x
            part = _T[3][part & 0xFF] ^ _T[2][part >> 8 & 0xFF] ^ _T[1][part >> 16 & 0xFF] ^ _T[0][part >> 24]
        first, here = np.cumsum(blocks) - blocks, np.argsort(-blocks, kind="stable")
        for k in range(int(blocks.max())):
            here = here[: int(np.searchsorted(-blocks[here], -k, side="left"))]
            c = crc[here]
            crc[here] = _Z[0][c & 0xFF] ^ _Z[1][c >> 8 & 0xFF] ^ _Z[2][c >> 16 & 0xFF] ^ _Z[3][c >> 24] ^ part[first[here] + k]
    rest = lengths - blocks * BLOCK
    for k in range(int(rest.max(initial=0))):
        here = np.flatnonzero(rest > k)
        c = crc[here]
        crc[here] = _T[0][(c ^ data[starts[here] + blocks[here] * BLOCK + k]) & 0xFF] ^ (c >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return (crc >> 15 | crc << 17) + np.uint32(MASK)


def framed(docs: np.ndarray, ids: np.ndarray, counts: np.ndarray, end: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of a record for each document, their lengths); ids: those of all documents in a row, counts[i] of each."""
    n = counts + 1
    size = 24 + width * n
    starts = np.cumsum(size) - size
    buf = np.empty(int(size.sum()), np.uint8)
    unit, first = buf.view(f"<u{width}"), starts // width  # every field begins at a multiple of the width

    def put(at: int, values: np.ndarray) -> None:
        own = np.ascontiguousarray(values).view(f"<u{width}").reshape(len(n), -1)
        for k in range(own.shape[1]):
            unit[first + at // width + k] = own[:, k]

    put(0, (size - 16).astype("<u8"))
    put(12, docs.astype("<i8"))
    at = np.repeat(first + 20 // width - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
    unit[at] = ids
    unit[first + 20 // width + counts] = end
    put(8, masked(crc32c_of(buf, starts, np.full(len(n), 8))).astype("<u4"))
    crc = masked(crc32c_of(buf, starts + 12, size - 16)).astype("<u4").view(f"<u{width}").reshape(len(n), -1)
    for k in range(crc.shape[1]):
        unit[first + (size - 4) // width + k] = crc[:, k]
    return buf, size


def unframed(raw: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, all ids in a row, number of ids of each) of the records at the given places of a buffer; raises where a
    length or checksum is wrong."""
    take = lambda p, kind, n: np.stack([raw[p + i] for i in range(n)], 1).copy().view(kind)[:, 0]
    n = take(at, "<u8", 8).astype(np.int64)
    if (n != size - 16).any() or (take(at + 8, "<u4", 4) != masked(crc32c_of(raw, at, np.full(len(at), 8)))).any():
        raise ValueError("a record's length is damaged")
    if (take(at + 12 + n, "<u4", 4) != masked(crc32c_of(raw, at + 12, n))).any():
        raise ValueError("a record's data is damaged")
    counts = (n - 8) // width
    unit = raw[: len(raw) // width * width].view(f"<u{width}")
    where = np.repeat((at + 20) // width - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return take(at + 12, "<i8", 8), unit[where], counts


def width_for(tokenizer: str, end: int) -> int:
    """Bytes of an id: 2 where the tokenizer's vocabulary and the end id allow it, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end) < 1 << 16 else 4


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


INDEX = "file string, nth long, doc_id long, byte_offset long, byte_length long, n_tokens long, ids_before long"


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = 1, width: int | None = None) -> DataFrame:
    """Writes docs(doc_id, text) to files in `folder` in order of doc_id; returns the rows of the index.

    The files are written when the result is computed: store it once and read it from there.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    width = width or width_for(path, end)
    run = uuid.uuid4().hex

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{context.partitionId():07d}.rec"
        fs, root = _files(folder)
        out, nth, place, before = None, 0, 0, 0
        temp = f"{root}/_{run}-{context.taskAttemptId()}.part"
        try:
            for b in batches:
                for at, to, ids, counts in encoded(b.column("text"), path):
                    if width < 4 and len(ids) and int(ids.max()) >> 8 * width:
                        raise ValueError(f"an id does not fit into {width} bytes")
                    doc = b.column("doc_id").slice(at, to - at)
                    buf, size = framed(pc.fill_null(doc, NO_ID).to_numpy(), ids, counts, end, width)
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(temp)
                    out.write(buf)
                    ends, n_tokens = np.cumsum(size), counts + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (to - at)), pa.array(nth + np.arange(to - at)), doc, pa.array(place + ends - size), pa.array(size), pa.array(n_tokens), pa.array(before + np.cumsum(n_tokens) - n_tokens)],
                        ["file", "nth", "doc_id", "byte_offset", "byte_length", "n_tokens", "ids_before"],
                    )
                    nth, place, before = nth + to - at, place + int(ends[-1]), before + int(n_tokens.sum())
            if out is not None:
                out.close()
                fs.move(temp, f"{root}/{name}")
                out = None
        finally:
            if out is not None:  # this attempt failed
                out.close()
                fs.delete_file(temp)

    # the hash lets rows with the same doc_id go to several files
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.col("h")]
    return docs.repartitionByRange(*order).sortWithinPartitions(*order).drop("h").mapInArrow(write, INDEX)


def read_records(index: DataFrame, folder: str, width: int, most: int = 16_000_000) -> DataFrame:
    """Reads the records that the rows of a stored index name, in runs of one file, checks them, and returns
    (file, nth, doc_id, ids_before, n_tokens, ids_crc32)."""
    runs = index.withColumn("run", F.expr(f"byte_offset div {most}"))

    def read(batches):
        fs, root = _files(folder)
        for b in batches:
            pdf = b.to_pandas()
            for file, rows in pdf.groupby("file", sort=False):
                with fs.open_input_file(f"{root}/{file}") as f:
                    rows = rows.sort_values("nth")
                    for _, part in rows.groupby((rows.byte_offset - rows.byte_offset.min()) // most):
                        first = int(part.byte_offset.min())
                        raw = np.frombuffer(f.read_at(int((part.byte_offset + part.byte_length).max()) - first, first), np.uint8)
                        docs, ids, n = unframed(raw, part.byte_offset.to_numpy() - first, part.byte_length.to_numpy(), width)
                        view, ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(n)
                        crc = [zlib.crc32(view[x:y]) for x, y in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([file] * len(n)), pa.array(part.nth.to_numpy()), pa.array(docs, mask=docs == NO_ID), pa.array(part.ids_before.to_numpy()), pa.array(n), pa.array(crc, pa.int64())],
                            ["file", "nth", "doc_id", "ids_before", "n_tokens", "ids_crc32"],
                        )

    return (
        runs.repartition("file", "run")
        .sortWithinPartitions("file", "nth")
        .select("file", "nth", "byte_offset", "byte_length", "ids_before")
        .mapInArrow(read, "file string, nth long, doc_id long, ids_before long, n_tokens long, ids_crc32 long")
    )


def store_and_read(docs: DataFrame, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """Writes files and index to a new folder of the shared storage, reads them back: (doc_id, start, n_tokens,
    ids_crc32), start counting the ids of all documents before, in order of doc_id."""
    spark: SparkSession = docs.sparkSession
    scratch, folder = Scratch(spark), new_path(spark, "records")
    width = width_for(tokenizer or tokenizer_path(TOKENIZER), end)
    index = scratch.keep(write_records(docs, folder, tokenizer, end, width), "record-index")
    # a row for each file: files are in the order of their names
    sums = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    return read_records(index, folder, width).join(base, "file").select("doc_id", (F.col("base") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")
