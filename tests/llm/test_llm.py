"""The training-data operators against brute force on small tables with nulls, empty texts, copies and clashing columns."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankcut.llm import decontamination, knn, licenses, lm, near_dup, packing, paragraphs, quality, records, token_counts
from rankcut.llm.shared import Scratch, connected
from rankcut.llm.token_ids import WordEncoder, tokenizer_path

SCHEMA = "doc_id long, text string, source string, n_chars long, sequence_id string, rank int"
WORDS = [f"w{a}{b}" for a in "bcdfghklmn" for b in "aeiouxyz"] + ["Über", "l'été", "don't", "x-y,", "3.5%", "ﬁ", "数据", "é"]


def sentence(g, n):
    return " ".join(g.choice(WORDS, n)) + "."


@pytest.fixture(scope="module")
def texts():
    g = np.random.default_rng(5)
    base = [sentence(g, int(n)) for n in g.integers(60, 200, 12)]
    near = [" ".join(w if i % 90 else "changed" for i, w in enumerate(t.split())) for t in base[:4]]
    passage = sentence(g, 60)
    amid = [f"{sentence(g, 30)[:-1]} {passage} {sentence(g, 25)}" for _ in range(4)]
    odd = ["", None, "   \n\t ", "one", "<|endoftext|> is text", "a" * 3000, "\x1c\x00   x", "\n".join(sentence(g, 8) for _ in range(400))]
    return [*base, *near, *amid, *odd, base[0], base[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "s", len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[1], "s", 1, "clash", 1), (3, texts[3], "s", len(texts[3]), "clash", 1)]  # a null id, a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_by_words_are_those_of_whole_texts(library, texts):
    g = np.random.default_rng(0)
    signs = list("aÉß 'sS<|>.,;:!?_-~^`\t\n\x0b\x1c\x85 ́ Ⅷ½9٣中ﬁİ")
    odd = ["".join(g.choice(signs, int(n))) for n in g.integers(1, 60, 400)] + ["<|endoftext|>", "x<|startoftext|>y", "don't we'll I'd", "'S 's' a''s 're've"]
    all_ = [*texts, *odd]
    ids, n = WordEncoder(tokenizer_path(), limit=50).encode(pa.array(all_, pa.string()))
    want = [ids_of(library, t) for t in all_]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_counts(spark, docs, none, library):
    got = token_counts.count_tokens(docs, huge=400, chunk=150, overlap=8, limit=100).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(ids_of(library, r.text))) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    text = " ".join(f"w{i % 7}é{i}" for i in range(3000))  # many more chunks than leave a task together
    [row] = token_counts.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), huge=400, chunk=150, overlap=40).collect()
    assert row.n_tokens == len(library.encode(text, add_special_tokens=False).ids) and row.n_bytes == len(text.encode())
    assert token_counts.count_tokens(none).count() == 0


def test_packing(docs, none, library):
    got = packing.pack_documents(docs, capacity=64).collect()
    ids = {(r.doc_id): [*ids_of(library, r.text), 1] for r in docs.collect()}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and (r.length == 64 or r.start + r.length == len(ids[r.doc_id]))
    assert sum(r.length for r in got) == sum(len(ids[r.doc_id]) for r in docs.collect())
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in got) // 64) * 1.1 + 1
    assert packing.pack_documents(none).count() == 0


def test_plan_is_best_fit_decreasing():
    g = np.random.default_rng(3)
    sizes = np.sort(g.integers(1, 51, 400))[::-1]
    gaps = []
    for s in sizes:
        fit = [x for x in gaps if x >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(50 - s)
    plan = packing.plan_best_fit(dict(collections.Counter(sizes.tolist())), 50)
    assert 1 + max(int(first[-1] + (n - 1 - rank[-1]) // each[-1]) for (rank, first, each, _), n in ((plan[s], (sizes == s).sum()) for s in plan)) <= len(gaps)


def test_records(docs, none, library, spark):
    got = records.store_and_read(docs).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want, at = collections.Counter(), 0
    for r in rows:
        own = np.array([*ids_of(library, r.text), 1], "<u4")
        want[r.doc_id, at, len(own), zlib.crc32(own.tobytes())] += 1
        at += len(own)
    assert collections.Counter(map(tuple, got)) == want
    assert records.store_and_read(none).count() == 0


def test_checksums_and_damage():
    check = np.frombuffer(b"123456789", np.uint8)
    assert records.crc32c_of(check, np.array([0]), np.array([9]))[0] == 0xE3069283  # the check value of CRC-32C
    g = np.random.default_rng(1)
    datas = [g.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 700)]
    flat = np.frombuffer(b"".join(datas), np.uint8)
    n = np.array([len(d) for d in datas])
    table = records._T[0]
    for d, crc in zip(datas, records.crc32c_of(flat, np.cumsum(n) - n, n), strict=True):
        c = 0xFFFFFFFF
        for b in d:
            c = int(table[(c ^ b) & 0xFF]) ^ (c >> 8)
        assert c ^ 0xFFFFFFFF == crc
    for width in (2, 4):
        counts = np.array([0, 1, 31, 32, 40, 700])
        ids = g.integers(0, 1 << 16, int(counts.sum())).astype(np.uint32)
        docs = np.array([5, -1, records.NO_ID, 7, 2**62, 0])
        buf, size = records.framed(docs, ids, counts, 1, width)
        at = np.cumsum(size) - size
        got, flat, n = records.unframed(buf, at, size, width)
        assert got.tolist() == docs.tolist() and n.tolist() == (counts + 1).tolist()
        assert flat.tolist() == [x for k, c in enumerate(counts) for x in [*ids[counts[:k].sum() : counts[:k].sum() + c].tolist(), 1]]
        length, data = int(buf[at[4] : at[4] + 8].view("<u8")[0]), buf[at[4] + 12 : at[5] - 4]
        assert length == len(data) and buf[at[5] - 4 : at[5]].view("<u4")[0] == records.masked(records.crc32c_of(data, np.array([0]), np.array([length])))[0]
        hurt = buf.copy()
        hurt[at[5] + 30] ^= 1
        with pytest.raises(ValueError):
            records.unframed(hurt, at, size, width)


def shingled(text):
    w = [x for x in (re.sub(r"[\W_]+", "", y).lower() for y in re.split("[ \t\n\x0b\f\r]+", text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, none, texts):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    cls = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    for i, a in enumerate(texts):
        for j in range(i):
            x, y = shingled(a), shingled(texts[j])
            s = len(x & y) / len(x | y) if x | y else 1.0
            if s >= 0.86 or not (x | y):
                assert cls[i] == cls[j], (i, j, s)
            if s < 0.5:
                assert cls[i] != cls[j] or any(cls[k] == cls[i] for k in range(len(texts)) if k not in (i, j)), (i, j, s)
    assert [r.class_id for r in got if r.doc_id is None] == [1]
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.one_of_each(docs, near_dup.near_duplicates(docs))
    assert kept.where("doc_id = 0 or doc_id >= 24").count() >= 1 and kept.where("doc_id in (12, 13)").count() == 0


def test_parts_of_words_met_again_stay_known():
    e = WordEncoder(tokenizer_path(), limit=20)
    want = None
    for k in range(6):
        made = "".join(chr(97 + k) * 3 + chr(97 + j) + " " for j in range(20))
        ids, n = e.encode(pa.array(["often " + made]))
        assert want is None or (ids[: len(want)] == want).all()
        want = e.encode(pa.array(["often"]))[0]
        assert "often" in e.kept and len(e.kept) <= 42 and len(e.older) <= 42
    assert "often" in e.older


def test_large_groups_of_near_copies(spark):
    g = np.random.default_rng(9)
    base = sentence(g, 150).split()
    rows = [(i, " ".join(w if k != i % 150 else f"edit{i}" for k, w in enumerate(base)), "", 0, "", 0) for i in range(120)]
    assert near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("class_id").distinct().count() == 1


def test_copies_that_are_alike_only_to_one_of_high_id(spark):
    g = np.random.default_rng(11)
    base = [f"{w}{i}" for i, w in enumerate(g.choice(WORDS[:80], 600))]
    rows = []
    for i in range(300):  # seven words of its own each: about 0.83 like the base, and 0.7 like one another
        at = set((10 * g.choice(range(1, 59), 7, replace=False)).tolist())
        rows.append((i, " ".join(f"own{i}x{k}" if k in at else w for k, w in enumerate(base)), "", 0, "", 0))
    rows.append((1000, " ".join(base), "", 0, "", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = near_dup.near_duplicates(docs).collect()
    cls = collections.Counter(r.class_id for r in got)
    assert cls[0] >= 297


def test_pairs_without_a_leader_are_found(spark):
    g = np.random.default_rng(13)
    base = [f"{w}{i}" for i, w in enumerate(g.choice(WORDS[:80], 600))]
    rows = []
    for i in range(400):  # two of a pair have two changes in common and three each of their own: about 0.83 alike, others 0.75
        at = (10 * g.choice(range(1, 59), 8, replace=False)).tolist()
        for k, own in enumerate((at[2:5], at[5:])):
            words = list(base)
            for j in at[:2]:
                words[j] = f"both{i}x{j}"
            for j in own:
                words[j] = f"own{i}x{k}x{j}"
            rows.append((2 * i + k, " ".join(words), "", 0, "", 0))
    cls = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(cls[2 * i] == cls[2 * i + 1] for i in range(400)) >= 398 and len(set(cls.values())) >= 200


def test_far_pairs_lists_what_can_reach_the_limit(spark):
    """Nodes 1 and 2 have all in common, 3 has a fifth of it; 4 and 5 share a rare shingle only; 6 lies in 1's component."""
    weighed = [(s, n, 1.0) for n in (1, 2, 6) for s in range(10)] + [(s, 3, 1.0) for s in (0, 1)] + [(30 + s, 3, 1.0) for s in range(8)]
    weighed += [(s, n, 1.0) for n in (4, 5) for s in (50, 51, 52, 53)]
    weighed += [(None, n, 10.0) for n in (1, 2, 3, 6)] + [(None, 4, 4.0), (None, 5, 4.0)]
    rows = [(7, n, {6: 1}.get(n, n)) for n in range(1, 7)]
    got = near_dup.far_pairs(spark.createDataFrame(rows, "bucket long, node long, root long"), spark.createDataFrame(weighed, "s long, node long, w double"), 0.8, near_dup.Scratch(spark))
    assert {tuple(x) for x in got.collect()} == {(2, 1), (6, 2), (5, 4)}


def test_signatures_estimate_weighted_jaccard():
    g = np.random.default_rng(2)
    a, b = g.choice(WORDS, 400), g.choice(WORDS, 400)
    mix = np.where(np.arange(400) < 300, a, b)
    idf = (1 + g.random(near_dup.SLOTS)).astype(np.float32)
    t = pa.array([" ".join(a), " ".join(mix)])
    owner, s, w, bounds, *_ = near_dup.weighted_shingles(t, idf)
    sig = near_dup.signatures(s, w, bounds, 512)
    x, y = ({int(h): float(v) for h, v in zip(s[owner == k], w[owner == k], strict=True)} for k in (0, 1))
    true = sum(min(x[h], y[h]) for h in x.keys() & y.keys()) / sum(max(x.get(h, 0), y.get(h, 0)) for h in x.keys() | y.keys())
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 512)


def test_removal_of_repeats_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", 7), (2, None, "y", 0), (3, "a b", "z", 3)], "doc_id long, text string, _spans string, n_chars long")
    repeats = spark.createDataFrame([(1, 1, 3, True), (1, 0, 1, False), (3, 0, 9, True), (2, 0, 1, True)], "doc_id long, first_word long, end_word long, removed boolean")
    left = paragraphs.remove_repeats(docs, repeats)
    assert left.columns == docs.columns and left.where("doc_id = 1").collect() == [(1, "a  d", "x", 4)] and left.where("doc_id = 3").count() == 0


def test_repeated_passages(docs, none, texts):
    found = paragraphs.repeated_passages(docs)
    rows = found.collect()
    flagged = {r.doc_id for r in rows}
    assert set(range(16, 20)) <= flagged and not flagged & set(range(20, 27))
    left = {r.doc_id: r.text for r in paragraphs.remove_repeats(docs, found).where("doc_id is not null").collect()}
    runs = collections.defaultdict(set)
    for d, t in left.items():
        w = [x for x in (re.sub(r"[\W_]+", "", y).lower() for y in (t or "").split()) if x]
        for i in range(len(w) - 49):
            runs[tuple(w[i : i + 50])].add(d)
    assert not [v for v in runs.values() if len(v) > 1]
    assert left[5] == texts[5] and left[20] == "" and left[21] is None
    assert paragraphs.repeated_passages(none).count() == 0


def rows_of(texts, first=0):
    return [(first + i, t, "s", len(t), "clash", 1) for i, t in enumerate(texts)]


def test_passages_with_a_changed_word(spark):
    """Of 60-word passages of which a word is changed, put in or left out (Jaccard 0.83 to 1), nine tenths are found."""
    g = np.random.default_rng(21)
    voc = [f"{w}{i}" for i, w in enumerate(g.choice(WORDS[:80], 3000))]
    texts, pairs = [], []
    for k in range(60):
        p = list(g.choice(voc, 60))
        q, at = list(p), int(g.integers(5, 55))
        if k % 3 == 0:
            q[at] = "other"
        elif k % 3 == 1:
            q.insert(at, "other")
        else:
            del q[at]
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join([*g.choice(voc, 40), *x, *g.choice(voc, 40)]) for x in (p, q)]
    rows = paragraphs.repeated_passages(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    removed = {r.doc_id for r in rows if r.removed}
    assert removed <= {b for _, b in pairs} and len(removed) >= 54
    assert all(r.cluster_doc_id == r.doc_id - r.doc_id % 2 for r in rows)


def test_passages_whose_words_stand_in_earlier_documents(spark):
    """Every five words of a passage stand in an earlier, else different document; the passage is found all the same."""
    g = np.random.default_rng(22)
    voc = [f"{w}{i}" for i, w in enumerate(g.choice(WORDS[:80], 3000))]
    p = list(g.choice(voc, 60))
    early = [" ".join([*g.choice(voc, 50), *p[k : k + 12], *g.choice(voc, 50)]) for k in range(0, 50, 6)]
    late = [" ".join([*g.choice(voc, 30 + k), *p, *g.choice(voc, 30)]) for k in range(5)]
    junk = ["same " * 300, "same " * 200 + " ".join(g.choice(voc, 50))]
    rows = paragraphs.repeated_passages(spark.createDataFrame(rows_of(early + late + junk), SCHEMA)).collect()
    removed = collections.defaultdict(list)
    for r in rows:
        removed[r.doc_id] += range(r.first_word, r.end_word) if r.removed else []
    n = len(early)
    assert {d for d in removed if d < n + 5 and removed[d]} == set(range(n + 1, n + 5))
    assert all(set(removed[n + k]) == set(range(30 + k, 90 + k)) for k in range(1, 5)), sorted(rows)
    assert removed[n + 6]


def test_best_part_and_jaccard_by_brute_force():
    g = np.random.default_rng(23)
    for _ in range(50):
        size = g.integers(0, 12, 6)
        bounds = np.concatenate([[0], np.cumsum(size)])
        hit = g.random(bounds[-1]) < 0.6
        lo, hi = paragraphs.best_part(hit, np.repeat(np.arange(6), size), bounds, 1.0)
        for k in range(6):
            s = np.where(hit[bounds[k] : bounds[k + 1]], 1, -1)
            best = max([0, *(s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
            assert (s[lo[k] - bounds[k] : hi[k] - bounds[k]].sum() if hi[k] > lo[k] else 0) == best
    voc = g.integers(1, 1 << 32, 900, dtype=np.uint64).astype("<u4")
    p = g.choice(voc, 70)
    q = np.delete(p, 30)
    i, x0, x1, y0, y1, j = paragraphs.passages_of(*((w, np.array([0, len(w)])) for w in (p, q)), 45, 0.8)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (p[x0[0] : x1[0]], q[y0[0] : y1[0]])]
    assert j[0] == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(
        [(1, "If Anna Smith buys 12 apples for 3 dollars each and sells 5 of them how much did Anna Smith spend"), (2, "tiny item here"), (3, None), (None, "x y z"), (4, "")], "item_id long, text string"
    )
    planted = spark.createDataFrame(
        [
            (100, "Intro words. If Anna Smith buys 12 apples for 3 dollars each and sells 5 of them how much did Anna Smith spend. More."),
            (101, "Then, if Peter Jones buys 40 apples for 7 dollars each and sells 9 of them how much did Peter Jones spend, he asked."),
            (102, "If Peter Jones buys 40 apples for 7 dollars each and nothing else of this is like the item at all, whatever one says."),
            (103, "a tiny item here"),
            (104, None),
        ],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontamination.contaminated(planted, bench).collect()}
    assert got == {(100, 1): False, (101, 1): True, (103, 2): False}
    assert decontamination.contaminated(docs, bench).count() == 0 and decontamination.contaminated(none, bench).count() == 0
    kept = decontamination.without_contaminated(planted, decontamination.contaminated(planted, bench))
    assert {r.doc_id for r in kept.collect()} == {102, 104}


def test_reparameterised_questions(spark):
    """Slots of more or fewer words, number words, a word more or less, a part of a long item, items without literals."""
    g = np.random.default_rng(31)
    voc = [w for w in WORDS[:80]]
    long = [f"{w}{i}x" for i, w in enumerate(g.choice(voc, 250))]
    long = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], w) for w in long]
    bench = spark.createDataFrame(
        [
            (1, "A train that left with Anna Smith on board goes 12 km in the first hour and 5 km in the next so how far did Anna Smith go"),
            (2, " ".join(long)),
            (3, "1 2 3 4 5 6 7 8 9 10 11 12"),
            (1, "A train that left with Anna Smith on board goes 12 km in the first hour and 5 km in the next so how far did Anna Smith go"),
        ],
        "item_id long, text string",
    )
    rows = [
        (1, "Now. A train that left with Bob on board goes 40 miles in the first hour and 7 miles in the next so how far did Bob go"),
        (2, "Now. A train that left with Eve on board goes twenty five km in the first hour and six km in the next so how far did Eve go"),
        (3, "Now. A train that left with Eve Miller on board goes 3 km in the very first hour and 9 km in the next so how far did Eve Miller go"),
        (4, "Now. A train that left with Bob on board goes 40 km in the first hour and 7 km in the next so how far did Peter Jones go and Eve too"),
        (5, "other text " + " ".join(long[100:130]) + " and more"),
        (6, "take 1 2 3 4 5 6 7 8 9 10 11 12 now"),
        (7, " ".join(long[10:18]) + " nothing else"),
        (7, " ".join(long[10:18]) + " nothing else"),
        (8, " ".join(f"{w} " for w in g.choice(voc, 60_000)) + " ".join(long[:40])),
        (None, " ".join(long)),
    ]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, hash int, item_id string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) >= {(1, 1), (2, 1), (3, 1), (5, 2), (6, 3), (8, 2)} and not {d for d, _ in got} & {7, None}
    assert all(got[d, 1].reparameterised for d in (1, 2, 3)) and not got[5, 2].reparameterised


def test_traits_of_words():
    from rankcut.llm import words as w

    texts = ["Anna 12 12km 12 kilometres x9 Über über A. End? (Smith) 3.5% ÉÉ"]
    h, bounds, t = w.words_of(pa.array(texts), traits=True)
    assert bounds.tolist() == [0, 13]
    assert [int(x) for x in t] == [2, 1, 1, 1, 0, 0, 2, 0, 4, 6, 2, 1, 0]


def test_word_hashes_are_those_of_plain_words(monkeypatch):
    from rankcut.llm import words as w

    g = np.random.default_rng(32)
    signs = list("aÉß 'sS<|>.,;:!?_-~^`\t\n\x0b\x1c\x85 ́ Ⅷ½9٣中ﬁİ×÷ÿŸKéàÀ zZ  ")
    texts = ["".join(g.choice(signs, int(n))) for n in g.integers(0, 80, 300)] + [None, "", "a" * 500 + " b", "x y" * 200]
    seen = {}
    for block in (1 << 20, 64, 7):
        monkeypatch.setattr(w, "BLOCK", block)
        h, bounds = w.word_hashes(pa.array(texts))
        for i, t in enumerate(texts):
            want = [p for p in map(w.plain, re.split("[ \t\n\x0b\f\r]+", t or "")) if p]
            assert len(want) == bounds[i + 1] - bounds[i]
            assert all(seen.setdefault(x, y) == y for x, y in zip(want, h[bounds[i] : bounds[i + 1]].tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)


def test_quality(spark, none):
    g = np.random.default_rng(4)
    bad = ["vile", "rotten", "awful"]
    rows, labels = [], []
    for i in range(900):
        toxic, junk = i % 3 == 0, i % 5 == 0
        words = list(g.choice(WORDS, 60)) + (list(g.choice(bad, 3)) if toxic else [])
        rows.append((i, " | ".join(words) if junk else " ".join(words), "", 0, "", 0))
        flip = g.random() < 0.05
        labels.append((i, int(not junk), int(toxic != flip)))
    docs = spark.createDataFrame([*rows, (None, None, "", 0, "", 0)], SCHEMA)
    lab = spark.createDataFrame([*labels[:600], (5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, lab).collect()}
    assert len(got) == 901
    held = range(600, 900)
    right = [got[i].kept == (i % 3 != 0 and i % 5 != 0) for i in held]
    assert np.mean(right) > 0.95
    assert all(0 <= r.p_top <= 1 and r.p_top <= r.expected_grade <= 2 for r in got.values())
    clash = docs.selectExpr("*", "1 as kept", "'x' as p_top", "2.0 as expected_grade")
    assert quality.select_quality(clash, lab).columns == clash.columns and quality.classify(clash, lab).columns == ["doc_id", "expected_grade", "p_top", "kept"]
    own = docs.withColumns({"_grade": F.lit("own"), "_GRADE_": F.lit(1)})
    assert quality.select_quality(own, lab).select("_grade").distinct().collect() == [("own",)]
    kept = quality.select_quality(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.classify(none, lab).count() == 0
    assert quality.classify(docs, lab.where("doc_id < 0")).where("kept").count() == 901


def test_nearest(spark):
    g = np.random.default_rng(6)
    x = g.standard_normal((400, 12)).astype(np.float32)
    x[100:140] = x[0]
    x[200:230] *= 1e-6
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(900, None, 1), (1000, [0.0] * 12, 1), (1100, [float("nan")] * 12, 1), (1200, [1.0, None] * 6, 1), (1300, [1.0] * 5, 1), (None, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(5)
    got = knn.nearest(df.where("vec_id % 20 = 0"), df, k=10, block=7, rows=50, tile=33).orderBy("query_id", "rank").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == set(range(0, 400, 20))
    y = x.astype(np.float64)
    for q, found in by.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(400), d))[:10]
        assert [v for v, _ in found] == order.tolist() and np.allclose([s for _, s in found], d[order], rtol=1e-14, atol=0)
    assert knn.nearest(df.where("vec_id < 0"), df).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert knn.nearest(few, few).count() == 6
    twice = knn.nearest(few.where("vec_id = 0"), few.union(few), k=3).orderBy("rank").collect()  # rows that repeat
    d = {i: float(np.sqrt(((y[0] - y[i]) ** 2).sum())) for i in (1, 2)}
    near = min(d, key=d.get)
    assert [r.vec_id for r in twice] == [near, near, 3 - near]


def test_quantisation_bounds():
    g = np.random.default_rng(8)
    a, b = g.standard_normal((20, 1500)), g.standard_normal((30, 1500)) * 10
    b[:20] = a + np.where(np.arange(20)[:, None] % 2, 1e-9, 0)  # equal ones, and ones nearly so
    qa, qb = knn.quantised(a), knn.quantised(b)
    assert (knn.int8_products(qa[0], qb[0]) == qa[0].astype(np.int64) @ qb[0].astype(np.int64).T).all()
    low, high = knn.bounds(qa, qb)
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert (low <= true).all() and (true <= high).all() and (high - low <= 2.001 * (qa[2][:, None] + qb[2]) + 1e-4).all()


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_of_vectors_that_quantise_without_error(spark, seed):
    """Signs: many vectors are equal or equally far, so that ties decide, over several tiles and blocks."""
    g = np.random.default_rng(seed)
    x = np.where(g.random((9, 96)) < 0.5, -0.1, 0.1)[g.integers(0, 9, 3000) * (g.random(3000) < 0.5)]
    x[::7, :3] *= -1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = knn.nearest(df.where("vec_id % 300 = 0"), df, k=10, block=4, rows=20, tile=64).orderBy("query_id", "rank").collect()
    for q in range(0, 3000, 300):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(3000), d))[:10]
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(int(i), d[i]) for i in order]


def test_licenses(spark):
    files = spark.createDataFrame(
        [
            (1, "a/LICENSE", "Released under the MIT License.\n"),
            (2, "a/b/x.py", "print(1)"),
            (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode " * 1 + "more words here " * 30),
            (4, "z/x", "My driving license was issued in the town of nowhere by somebody else entirely"),
            (5, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            (6, "a/b/c/d/e.py", None),
            (7, None, ""),
        ],
        "key long, path string, text string",
    )
    got = {r.key: (r.license, r.origin, r.from_path) for r in licenses.scan_licenses(files).collect()}
    assert got[1] == ("MIT", "header", "a/LICENSE") and got[2] == ("MIT", "inherited", "a/LICENSE")
    assert got[3][:2] == ("Apache-2.0", "header") and got[4] == (None, "none", None)
    assert got[6] == ("GPL-3.0", "inherited", "a/b/c/COPYING") and got[7] == (None, "none", None)
    assert licenses.scan_licenses(files.where("key < 0")).count() == 0


def notice(name, start):
    return next(t for n, t in licenses.TEMPLATES if n == name and t.startswith(start) and len(t) > 200)


def test_license_texts_and_headers(spark):
    """Whole licence texts, headers over several lines and SPDX tags; code about other things has no licence."""
    import textwrap

    wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 70))
    code = "\nimport os\n" + "\n".join(f"value_{i} = compute(other_{i}, table, index)" for i in range(200))
    bsd3, bsd2, mit = notice("BSD-3-Clause", "Redis"), notice("BSD-2-Clause", "Redis"), notice("MIT", "Permission")
    rows = [
        (1, "b3/LICENSE", "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + wrap(bsd3)),
        (2, "b2/LICENSE", "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + wrap(bsd2)),
        (3, "b2/src/deep/x.c", "int main;"),
        (4, "ap/x.py", "# Copyright 2020 The Authors\n#\n" + wrap(notice("Apache-2.0", "Licensed under"), "# ") + code),
        (5, "tag/y.rs", "// SPDX-License-Identifier: WTFPL\n" + code),
        (6, "gpl/z.c", "/*\n" + wrap(notice("GPL-2.0", "This program"), " * ") + "\n */\n" + code),
        (7, "mit/m.js", "// Copyright Jane Doe\n//\n" + wrap(mit, "// ") + code),
        (8, "none/n.py", code),
        (9, "ap2/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE\n"),
        (10, "isc/ISC.txt", wrap(notice("ISC", "Permission"))),
        (None, "nul/LICENSE", wrap(mit)),
        (None, None, None),
        (12, "mit/m.js", code),
        (12, "mit/m.js", code),
        (13, "long/LICENSE.txt", wrap(mit) + "\n\n" + "sundry words of nobody " * 50_000),
    ]
    rows += [(100 + i, f"code/f{i}.py", f"common words {i} of the code in every file and for the use of it {i * 7}" + code) for i in range(60)]
    files = spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows], "key long, path string, text string, license string, score double, id int")
    found = licenses.scan_licenses(files)
    got = {r.key: (r.license, r.origin, r.from_path) for r in found.collect() if r.key is not None}
    assert got[1][:2] == ("BSD-3-Clause", "header") and got[2][:2] == ("BSD-2-Clause", "header")
    assert got[3] == ("BSD-2-Clause", "inherited", "b2/LICENSE")
    assert got[4][:2] == ("Apache-2.0", "header") and got[5][:2] == ("WTFPL", "header") and got[6][:2] == ("GPL-2.0", "header")
    assert got[7][:2] == ("MIT", "header") and got[8] == (None, "none", None) and got[9][:2] == ("Apache-2.0", "header")
    assert got[10][:2] == ("ISC", "header") and got[12] == (None, "none", None) and got[13][:2] == ("MIT", "header")
    assert all(got[100 + i] == (None, "none", None) for i in range(60))
    nulls = {r.path: r.license for r in found.where("key is null").collect()}
    assert nulls == {"nul/LICENSE": "MIT", "": None} and found.count() == len(rows)
    import duckdb

    db = duckdb.connect()
    db.register("files", files.select("key", "path", "text").toPandas().astype({"key": "Int64"}))
    want = sorted(map(repr, db.sql(licenses.license_sql("SELECT * FROM files")).fetchall()))
    assert sorted(repr(tuple(r)) for r in found.collect()) == want


def test_lm_counts_and_base(spark, docs, none):
    got = lm.score_documents(docs, lexicon=20, frequent=60, lanes=8).collect()
    tok = lambda t: [*re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    rows = docs.collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for r in rows if not out(r.doc_id) for w in tok(r.text))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r.doc_id, out(r.doc_id), len(tok(r.text)), sum(c[w] > 0 for w in tok(r.text)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(r.text)), 6)) for r in rows)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(none).count() == 0


def test_lm_probabilities_add_up_and_learn():
    shape = lm.Shape(classes=2, size=32, h=8, words=40)
    flat = shape.start()
    g = np.random.default_rng(0)
    flat += g.standard_normal(len(flat)).astype(np.float32) * 0.3
    p = shape.views(flat)
    hs = g.standard_normal((1, 8)).astype(np.float32)
    total = np.exp(lm.outputs(p, shape, np.repeat(hs, 40, 0), np.arange(40), False)).sum()
    assert total == pytest.approx(1, abs=1e-5)
    ids = np.tile(np.array([1, 2, 3, 4, 0], np.int32), 4000)
    bounds = np.arange(0, len(ids) + 1, 5)
    flat = shape.start()
    moments = (np.zeros_like(flat), np.zeros_like(flat), [0])
    for _ in range(12):
        lm.train(flat, shape, lm.even_lanes(ids, bounds, 0, 32), moments, 8, 0.02)
    assert lm.log_probabilities(flat, shape, lm.in_lanes(ids, bounds, 0)).mean() > -0.2


def test_lm_gradient():
    shape = lm.Shape(classes=2, size=32, h=4, words=50)
    g = np.random.default_rng(1)
    start = (g.standard_normal(len(shape.start())) * 0.3).astype(np.float32)
    ids, bounds = np.array([3, 40, 7, 0, 9, 0], np.int32), np.array([0, 4, 6])
    lanes = lm.in_lanes(ids, bounds, 0, 1)
    grad = np.zeros_like(start)

    class Spy(np.ndarray):
        pass

    flat, moments = start.copy(), (np.zeros_like(start), np.zeros_like(start), [0])
    lm.train(flat, shape, lanes, moments, 16, 0.0)
    grad = moments[0] * 10  # the first moment after one step
    loss = lambda w: -lm.log_probabilities(w, shape, lanes).astype(np.float64).mean()
    scale = None
    for i in np.argsort(-np.abs(grad))[:12]:
        up, down = start.copy(), start.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        scale = slope / grad[i] if scale is None else scale  # the gradient's length may have been cut to 1
        assert slope == pytest.approx(scale * grad[i], rel=0.05, abs=2e-3)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected(edges, Scratch(spark), "t").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}
    assert connected(edges.where("a < 0"), Scratch(spark), "t").count() == 0
    g = np.random.default_rng(41)
    pairs = [(int(a), int(b)) for a, b in g.integers(0, 900, (500, 2))] + [(5000, i) for i in range(1000, 1300)] + [(1000, i) for i in range(2000, 2300)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = connected(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark), "t").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.node, r.root) for r in got) == sorted((x, top(x)) for x in up if any(x in p and p[0] != p[1] for p in pairs))


def test_pipeline_stages(spark, tmp_path, texts):
    import corpus_pipeline

    g = np.random.default_rng(11)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(100 + i, sentence(g, 80), "en", "s", 400) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[-1][1].split()[10:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    left = {r.doc_id for r in docs.collect()}
    assert set(range(100, 119)) <= left and 119 not in left and not {12, 13, 14, 15} & left
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left
