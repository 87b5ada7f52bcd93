"""Benchmark passages in documents, also with other numbers, names and units.

Templates. Words of documents and items are made canonical: numbers (also number words) become <NUM>, units of measure
<UNIT>, names <NAME> (a capitalised word that doesn't begin a sentence, or that a name follows); all else stays as it is.
A run of one type is one placeholder, so that a name or number of more or fewer words fills the same slot. Windows of
`window` canonical words (with `literals` words that aren't placeholders) and windows of `window` plain words (items of
fewer words are one plain window) are hashed on both sides.

Look-up. A bitmap of the items' windows (64 bits for each window, at most MOST_BITS: 8 MB, whatever the benchmark's size)
goes to all tasks and leaves those windows of documents that may be an item's; these meet the items' windows in a hash
join. A fuller bitmap only leaves more rows to the join.

Verdict for each document and item. (1) Windows of a band of neighbouring diagonals (place in the document less place in
the item; a word more or less moves the diagonal by one) are one quotation. It counts if it has at least `share` of the
item's windows and the values in its slots are consistent: what is the same value in the item is the same value in the
document, for at least `agree` of the slots. If values differ, it is a re-parameterised one. (2) Plain windows likewise.
(3) A run of at least `run` equal plain words counts, so a part of a long item is found.

Null texts and ids match nothing. Rows with the same doc_id are one document, those with the same item_id one item, so
rows that repeat give one row. Ties between bands go to the least diagonal. Empty tables give an empty result. Texts of
any length are gone through whole, in blocks. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.shared import Scratch, mixed, slices
from rankcut.llm.words import CAPITAL, NUMBER, SENTENCE, words_of

#: Units that count as such (fixed list).
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs oz "
    "ml l liter liters litre litres ms s sec second seconds min minute minutes h hour hours day days week weeks month "
    "months year years percent usd eur gbp dollar dollars euro euros cent cents degree degrees celsius fahrenheit mph kmh "
    "watt watts volt volts"
).split()
#: Number words that count as such (fixed list).
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
NUM, UNIT, NAME = 1, 2, 3
MARKS = mixed(np.array([100, 101, 102, 103], np.uint64)) | np.uint64(1)  # of <NUM>, <UNIT>, <NAME>, from the second on
PLACES = mixed(np.arange(201, 265, dtype=np.uint64)) | np.uint64(1)
MOST_BITS = 1 << 26
PLAIN, TEMPLATE = 0, 1
HITS = "id long, kind int, hash long, place int, slots array<struct<at: int, value: long>>"


def _listed(words: list[str]) -> np.ndarray:
    return np.sort(words_of(pa.array(words))[0])


def canonical(texts: pa.Array):
    """Plain words: (hashes, bounds of each text). Canonical words: (hashes, hash of what stands there, whether it is a slot,
    bounds of each text)."""
    h, bounds, t = words_of(texts, traits=True)
    kind = np.zeros(len(h), np.int8)
    if len(h):
        fresh = np.zeros(len(h), bool)  # begins a sentence
        fresh[1:] = t[:-1] & SENTENCE != 0
        fresh[bounds[:-1][bounds[:-1] < len(h)]] = True
        capital = t & CAPITAL != 0
        name = capital & ~fresh
        name[:-1] |= capital[:-1] & fresh[:-1] & name[1:]
        kind[name] = NAME
        kind[np.isin(h, _listed(UNITS))] = UNIT
        kind[(t & NUMBER != 0) | np.isin(h, _listed(NUMBERS))] = NUM
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begins = np.ones(len(h), bool)
    begins[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(begins)
    value = h[at]
    if len(at):
        length = np.diff(np.append(at, len(h)))
        long = length > 1  # a run is told by its words in their order
        if long.any():
            nth = np.arange(len(h)) - np.repeat(at, length)
            value = np.where(long, mixed(np.add.reduceat(mixed(h + nth.astype(np.uint64) * PLACES[63]), at)), value)
    kind = kind[at]
    return h, bounds, np.where(kind > 0, MARKS[kind], h[at]), value, kind > 0, np.searchsorted(at, bounds)


def windows(c: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in c) of each window of n words."""
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(owner)) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    s = np.full(len(at), np.uint64(n))
    for k in range(n):
        s += c[at + k] * PLACES[k]
    return mixed(s), owner, at


def looked_up_windows(texts: pa.Array, window: int, literals: int, sizes: list[int], bits: np.ndarray | None = None, whole: bool = False):
    """Yields (kind, hash, text, place in the text, slots) of the windows; only those whose bits are set where bits are
    given; with `whole`, texts of fewer words are one plain window, else all windows of those sizes count."""
    h, bounds, c, value, slot, cb = canonical(texts)
    for n in sizes:
        s, owner, at = windows(h, bounds, n)
        if whole and n < window:
            ok = np.diff(bounds)[owner] == n
            s, owner, at = s[ok], owner[ok], at[ok]
        if bits is not None:
            ok = possible(s, bits)
            s, owner, at = s[ok], owner[ok], at[ok]
        yield PLAIN, s, owner, at - bounds[owner], None
    s, owner, at = windows(c, cb, window)
    fixed = np.concatenate([[0], np.cumsum(~slot)])
    ok = fixed[at + window] - fixed[at] >= literals
    ok &= fixed[at + window] - fixed[at] < window  # without slots it is a plain window
    s = s + np.uint64(1)
    if bits is not None:
        ok[ok] = possible(s[ok], bits)
    s, owner, at = s[ok], owner[ok], at[ok]
    k = at[:, None] + np.arange(window)
    row, col = np.nonzero(slot[k]) if len(k) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.searchsorted(row, np.arange(len(at) + 1))
    pairs = pa.StructArray.from_arrays([pa.array(col.astype(np.int32)), pa.array(value[k[row, col]].view(np.int64) if len(k) else np.zeros(0, np.int64))], ["at", "value"])
    yield TEMPLATE, s, owner, at - cb[owner], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def bit_places(s: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (s >> np.uint64(8)) & np.uint64(bits - 1), (s >> np.uint64(36)) & np.uint64(bits - 1)


def possible(s: np.ndarray, bits: np.ndarray) -> np.ndarray:
    x, y = bit_places(s, len(bits) * 8)
    got = np.ones(len(s), bool)
    for at in (x, y):
        got &= bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
    return got


def _rows(found, ids: pa.Array):
    kind, s, owner, place, slots = found
    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(s) + 1), pa.int32()), pa.StructArray.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int64())], ["at", "value"]))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(owner)), pa.array(np.full(len(s), kind, np.int32)), pa.array(s.view(np.int64)), pa.array(place.astype(np.int32)), none if slots is None else slots],
        ["id", "kind", "hash", "place", "slots"],
    )


def bitmap(windows: DataFrame) -> np.ndarray:
    """64 bits for each window, between 2^16 and MOST_BITS; two of them set for each."""
    n = windows.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (64 * n - 1).bit_length()))

    def places(batches):
        for b in batches:
            at = np.concatenate(bit_places(b.column(0).to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(1, at & 31))], ["word", "mask"])

    rows = windows.select("hash").mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    pdf = rows.toPandas()  # MOST_BITS / 32 rows at most
    out = np.zeros(bits // 32, "<u4")
    out[pdf.word.to_numpy(np.int64)] = pdf["mask"].to_numpy(np.int64)
    return out.view(np.uint8)


def best_band(doc: np.ndarray, item: np.ndarray, band: int) -> np.ndarray:
    """The matches (place in the document, place in the item) on the `band` neighbouring diagonals with the most places of
    the item; ties to the least diagonal."""
    diagonal = doc.astype(np.int64) - item
    pairs = np.unique(np.stack([diagonal, item]), axis=1)
    best, most = 0, -1
    starts = np.unique(pairs[0])
    lo, hi = np.searchsorted(pairs[0], starts), np.searchsorted(pairs[0], starts + band)
    for d, x, y in zip(starts.tolist(), lo.tolist(), hi.tolist(), strict=True):
        if y - x > most and (n := len(np.unique(pairs[1, x:y]))) > most:
            best, most = d, n
    return (diagonal >= best) & (diagonal < best + band)


def longest_run(doc: np.ndarray, item: np.ndarray) -> int:
    """The most matches in a row on one diagonal."""
    d = doc.astype(np.int64) - item
    pairs = np.unique(np.stack([d, item]), axis=1)
    new = np.ones(pairs.shape[1] + 1, bool)
    new[1:-1] = (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1] + 1)
    return int(np.diff(np.flatnonzero(new)).max(initial=0))


def consistent(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """(slots whose value in the document is the usual one for the item's value, slots with a changed value)."""
    pairs, n = np.unique(np.stack([item, doc]), axis=1, return_counts=True)
    usual: dict[int, int] = {}
    for x, k in zip(pairs[0].tolist(), n.tolist(), strict=True):
        usual[x] = max(usual.get(x, 0), k)
    return sum(usual.values()), int((item != doc).sum())


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    share: float = 0.5,
    agree: float = 0.75,
    literals: int = 3,
    run: int = 13,
    band: int = 8,
) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> a row for each document and item it quotes: (doc_id, item_id,
    n_windows, share, n_slots, n_changed, reparameterised)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def of_items(batches):
        for b in batches:
            for at, to in slices(b.column("text")):
                for found in looked_up_windows(b.column("text").slice(at, to - at), window, literals, list(range(1, window + 1)), whole=True):
                    yield _rows(found, b.column("item_id").slice(at, to - at))

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.mapInArrow(of_items, HITS).dropDuplicates(["id", "kind", "hash", "place"])
    items = scratch.keep(items, "item-windows").withColumnRenamed("id", "item_id")
    # only lengths that occur among short items are looked for in documents
    n_short = benchmark.where("text is not null").select(F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).alias("n")).where(f"n < {2 * window}").distinct()
    sizes = sorted({window, *(k for (n,) in n_short.collect() for k in range(1, min(n, window) + 1))})  # 2 * window rows at most
    bits = spark.sparkContext.broadcast(bitmap(items))

    def of_docs(batches):
        for b in batches:
            for at, to in slices(b.column("text")):
                for found in looked_up_windows(b.column("text").slice(at, to - at), window, literals, sizes, bits.value):
                    yield _rows(found, b.column("doc_id").slice(at, to - at))

    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = docs.mapInArrow(of_docs, HITS).selectExpr("id as doc_id", "kind", "hash", "place as doc_place", "slots as doc_slots")
    met = hits.join(items, ["kind", "hash"]).select("doc_id", "item_id", F.struct("kind", "doc_place", "place", "doc_slots", "slots").alias("m"))
    total = items.groupBy("item_id").agg(F.count_if(F.col("kind") == PLAIN).alias("n_plain"), F.count_if(F.col("kind") == TEMPLATE).alias("n_template"))
    met = met.groupBy("doc_id", "item_id").agg(F.collect_list("m").alias("m")).join(total, "item_id")

    def judge(batches):
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                m = b.column("m")[r].values
                kind, doc, item = (m.field(c).to_numpy() for c in ("kind", "doc_place", "place"))
                doc_id, item_id = b.column("doc_id")[r].as_py(), b.column("item_id")[r].as_py()
                n_plain, n_template = b.column("n_plain")[r].as_py(), b.column("n_template")[r].as_py()
                found = None
                own = np.flatnonzero(kind == PLAIN)
                if len(own):
                    n = len(np.unique(item[own[best_band(doc[own], item[own], band)]]))
                    if n >= share * n_plain or longest_run(doc[own], item[own]) + window - 1 >= run:
                        found = (n, n / n_plain, 0, 0)
                own = np.flatnonzero(kind == TEMPLATE)
                if len(own):
                    own = own[best_band(doc[own], item[own], band)]
                    n = len(np.unique(item[own]))
                    if n >= share * n_template:
                        slots: dict[int, tuple[int, int]] = {}
                        for i in own.tolist():
                            for x, y in zip(m.field("slots")[i].as_py(), m.field("doc_slots")[i].as_py(), strict=True):
                                slots[int(item[i]) + x["at"]] = (x["value"], y["value"])
                        a, z = np.array(list(slots.values()), np.int64).T
                        fit, changed = consistent(a, z)
                        if fit >= agree * len(a) and (found is None or changed == 0 or n / n_template > found[1]):
                            found = (n, n / n_template, len(a), changed)
                if found:
                    rows.append((doc_id, item_id, *found, found[3] > 0))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
                names = ["doc_id", "item_id", "n_windows", "share", "n_slots", "n_changed", "reparameterised"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return met.mapInArrow(judge, "doc_id long, item_id long, n_windows int, share double, n_slots int, n_changed int, reparameterised boolean")


def without_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents in which no item is quoted. Rows without doc_id stay."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
