"""Chunks of documents: fixed windows, sentences, recursive separators, sections and passages.

Chunkers that carry state through a text run as mapInPandas, one document at a time within an Arrow batch, and its chunks
leave with the batch. chunk_corpus() is for corpora whose texts differ much in length: it cuts long ones into pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankcut.sources.checkpoints import stored

CHUNK = "chunk_id string, parent_doc_id string, text string, chunk_index int, start_char int, end_char int"
SEPARATORS = ("\n\n", "\n", ". ", " ", "")  # from coarse to fine
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
HEADER = re.compile(r"^(={2,})\s*(.+?)\s*\1$", re.M)
CHARS = 4  # characters that count as a token


def fixed_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of size * 4 characters, (size - overlap) * 4 apart, up to the first that reaches the end or is blank."""
    width, stride = size * CHARS, (size - overlap) * CHARS
    rows = docs.where("trim(coalesce(text, '')) <> ''").select("doc_id", "text", F.length("text").alias("_n"))
    windows = rows.withColumn("_w", F.expr(f"sequence(0, greatest(int(ceil((_n - {width}) / {stride})), 0))"))
    first_blank = f"array_position(transform(_w, i -> trim(substring(text, i * {stride} + 1, {width})) = ''), true)"
    upto = F.expr(f"if({first_blank} = 0, size(_w), int({first_blank}) - 1)")
    cut = windows.withColumn("_k", upto).where("_k > 0").select("doc_id", "text", "_n", F.explode(F.expr("slice(_w, 1, _k)")).alias("chunk_index"))
    start = F.col("chunk_index") * stride
    return cut.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("doc_id").cast("string").alias("parent_doc_id"),
        F.substring("text", start + 1, F.lit(width)).alias("text"), "chunk_index", start.alias("start_char"), F.least(start + width, "_n").alias("end_char"),
    )


def _per_document(docs: DataFrame, split: Callable[[str], list[tuple[str, int, int]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f"{d}_chunk_{i}", str(d), t, i, a, z) for d, text in zip(pdf.doc_id, pdf.text, strict=True) if isinstance(text, str) and text.strip() for i, (t, a, z) in enumerate(split(text))]
            yield pd.DataFrame(rows, columns=["chunk_id", "parent_doc_id", "text", "chunk_index", "start_char", "end_char"])

    return docs.select("doc_id", "text").mapInPandas(run, CHUNK)


def sentence_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Runs of whole sentences of at most `size` tokens; a new chunk takes over the last sentences that fit in `overlap`."""
    return _per_document(docs, lambda text: pack_sentences(text, size, overlap))


def pack_sentences(text: str, size: int, overlap: int) -> list[tuple[str, int, int]]:
    spans, at = [], 0
    for m in SENTENCE_END.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    spans = [(a, z) for a, z in spans if text[a:z].strip()]
    out, held, used = [], [], 0
    weight = lambda s: (s[1] - s[0]) // CHARS
    close = lambda: out.append((" ".join(text[a:z] for a, z in held), held[0][0], held[-1][1]))
    for s in spans:
        if held and used + weight(s) > size:
            close()
            kept, room = [], overlap
            for prior in reversed(held):
                if weight(prior) > room:
                    break
                kept.insert(0, prior)
                room -= weight(prior)
            held, used = kept, sum(map(weight, kept))
        held.append(s)
        used += weight(s)
    if held:
        close()
    return out


def recursive_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Parts between separators, joined as long as the sum of their sizes is at most `size` tokens; a part that is too long
    is split by the next finer separator, and stays whole below the last. Empty parts go. A new chunk takes over the last
    part if that has at most `overlap` tokens. Places are within the chunk."""

    def split(text: str) -> list[tuple[str, int, int]]:
        return [(t, 0, len(t)) for t in split_by(text, size, overlap, 0)] if text.strip() else []

    return _per_document(docs, split)


def split_by(text: str, size: int, overlap: int, level: int) -> list[str]:
    sep = SEPARATORS[level]
    if not sep:  # single characters count as no token each, so all of them fit
        return [text]
    out, held, total = [], [], 0
    for part in filter(None, text.split(sep)):
        n = len(part) // CHARS
        if held and (n > size or total + n > size):
            out.append(sep.join(held))
            last = len(held[-1]) // CHARS
            held, total = ([held[-1]], last) if n <= size and last <= overlap else ([], 0)
        if n > size:
            out += split_by(part, size, overlap, level + 1)
        else:
            held, total = [*held, part], total + n
    return [*out, sep.join(held)] if held else out


def _next_start(j: int, sums: list[int], size: int, overlap: int) -> int:
    """Where the chunk ends whose first new part is j, of parts with these running sums of sizes, none above `size`. It has
    the part before j too if that is small: so where a chunk begins settles all that follow."""
    before = sums[j] - sums[j - 1] if j else overlap + 1
    limit = sums[j] + size - (before if before <= overlap else 0)
    return min(max(bisect_right(sums, limit) - 1, j + 1), len(sums) - 1)


def safe_place(at: int, parts: list[int], size: int, overlap: int) -> int:
    """The first place after `at` found at which split_by() begins a chunk that takes over nothing, whatever came before
    `at`; parts are sizes, and their number means that there is none. Beside a part that is too long is such a place.
    Elsewhere some chunk must begin at one of the places that a chunk begun before `at` can end at. All of these are
    followed until they meet in one: there every way of cutting passes."""
    end = next((i for i in range(at, len(parts)) if parts[i] > size), len(parts))
    begin = next((i + 1 for i in range(at - 1, -1, -1) if parts[i] > size), 0)
    if at in (begin, end):
        return at
    sums = [0, *accumulate(parts[begin:end])]
    at -= begin
    last = bisect_right(sums, sums[at - 1] + size) - 1
    open_ = list(range(at, min(max(last, at), len(sums) - 1) + 1))
    while open_[0] < len(sums) - 1:
        if len(open_) == 1 and parts[begin + open_[0] - 1] > overlap:
            return begin + open_[0]
        j = _next_start(open_.pop(0), sums, size, overlap)
        place = bisect_left(open_, j)
        if place == len(open_) or open_[place] != j:
            open_.insert(place, j)
    return end


def pieces_of(text: str, size: int, overlap: int, longest: int, level: int = 0) -> list[tuple[int, str]]:
    """(level, piece) in order: split_by() of the pieces, each from its level on, gives the chunks of the whole text. A piece
    is over `longest` characters only where there is no safe place."""
    sep = SEPARATORS[level]
    if len(text) <= longest or not sep:
        return [(level, text)]
    parts = list(filter(None, text.split(sep)))
    sizes, chars = [len(p) // CHARS for p in parts], [0, *accumulate(len(p) + len(sep) for p in parts)]
    huge = [i for i, p in enumerate(parts) if sizes[i] > size and len(p) > longest]  # cut by the next finer separator
    out, at = [], 0
    for stop in [*huge, len(parts)]:
        while at < stop:
            to = max(bisect_right(chars, chars[at] + longest // 2) - 1, at + 1)
            to = min(safe_place(to, sizes, size, overlap), stop) if to < stop else stop
            out.append((level, sep.join(parts[at:to])))
            at = to
        if at < len(parts):
            out += pieces_of(parts[at], size, overlap, longest, level + 1)
            at += 1
    return out


def chunk_corpus(docs: DataFrame, size: int, overlap: int, longest: int = 1 << 20, target: int = 1 << 25) -> DataFrame:
    """recursive_chunks() of a corpus whose texts differ much in length, spread evenly: texts of over `longest` characters are
    cut at safe places, pieces are dealt by hash to tasks of about `target` characters (each a small part of a task's),
    and the chunks of a document's pieces are numbered on. Rows of equal doc_id should be one row."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, text in zip(pdf.doc_id, pdf.text, strict=True):
                found = pieces_of(text, size, overlap, longest)
                yield pd.DataFrame({"doc_id": str(d), "piece": range(len(found)), "level": [v for v, _ in found], "text": [t for _, t in found]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, p, i, t) for d, p, v, text in zip(pdf.doc_id, pdf.piece, pdf.level, pdf.text, strict=True) for i, t in enumerate(split_by(text, size, overlap, v))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "i", "text"])

    rows = docs.where(r"text rlike '\\S'").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    long = F.length("text") > longest
    pieces = rows.where(~long).select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("level"), "text").union(rows.where(long).mapInPandas(cut, "doc_id string, piece int, level int, text string"))
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // target))
    chunks = stored(pieces.repartition(tasks, "doc_id", "piece").mapInPandas(run, "doc_id string, piece int, i int, text string"))
    counts = chunks.groupBy("doc_id", "piece").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("doc_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    later = counts.withColumn("_before", before).where("_before is not null").drop("_n")  # only texts of several pieces have such
    index = (F.col("i") + F.coalesce("_before", F.lit(0))).cast("int")
    return chunks.join(later, ["doc_id", "piece"], "left").select(
        F.concat("doc_id", F.lit("_chunk_"), index.cast("string")).alias("chunk_id"), F.col("doc_id").alias("parent_doc_id"), "text", index.alias("chunk_index"), F.lit(0).alias("start_char"), F.length("text").alias("end_char")
    )


def sections_of(text: str) -> list[tuple[str, int, str]]:
    """(title, level, body) of the parts of a text with == headers ==; what comes first is the Lead, of level 0."""
    marks = [*HEADER.finditer(text)]
    found = [("Lead", 0, text[: marks[0].start()] if marks else text)]
    for m, after in zip(marks, [*marks[1:], None], strict=False):
        found.append((m[2], len(m[1]) - 1, text[m.end() : after.start() if after else len(text)]))
    return [(title, level, body.strip()) for title, level, body in found if body.strip()]


def passages_of(text: str, size: int, overlap: int) -> list[tuple[str, int, int]]:
    """A short text whole, else windows of `size` characters cut back to a blank; each starts after the one before."""
    if len(text.split()) <= size // CHARS:
        return [(text, 0, len(text))]
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and (blank := text.rfind(" ", at + 1, end)) > at:
            end = blank
        if piece := text[at:end].strip():
            out.append((piece, at, end))
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


PASSAGE = "passage_id string, article_id string, text string, section string, section_level int, position int, char_start int, char_end int, word_count int, is_lead boolean"


def passages(articles: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """articles(doc_id, text) -> passages of their sections, numbered through the article."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                if isinstance(text, str):
                    all_ = [(title, level, *p) for title, level, body in sections_of(text) for p in passages_of(body, size, overlap)]
                    rows += [(f"{doc}_p{i}", str(doc), t, title, level, i, a, z, len(t.split()), level == 0) for i, (title, level, t, a, z) in enumerate(all_)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PASSAGE.split(", ")])

    return articles.select("doc_id", "text").mapInPandas(run, PASSAGE)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("parent_doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"), F.avg("n").alias("mean_chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"))
