"""Lexical search, periodic runs and exact duplicates against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from rankcut.llm import exact_dup, lexical, periodic

DOCS = "doc_id long, text string, row int, rank string, sha int, words string, segment int, n int"
EXTRA = (1, "clash", 2, "clash", 3, 4)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(parts)


# exact duplicates


def exact_wanted(rows):
    """Counter of (doc_id, keep_id, group_size, kept, sha)."""
    groups = collections.defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    want = collections.Counter()
    for text, members in groups.items():
        best = min(members)
        for m in members:
            want[None if m[1] else m[2], None if best[1] else best[2], len(members), m == best, hashlib.sha256(text.encode()).hexdigest()] += 1
    return want


def copies():
    g = np.random.default_rng(2)
    texts = [f"text {i} über 数据" for i in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, "a very  common\ntext" if i % 2 else "a very common text\t\x0b") for i in range(500)]  # over a third of all rows
    rows += [(2000 + i, texts[int(j)] + " " * int(g.integers(0, 3))) for i, j in enumerate(g.integers(0, 60, 200))]
    rows += [(None, texts[5]), (None, "only one without id"), (3, texts[3]), (3, texts[3]), (3000, ""), (3001, None), (3002, " \t\n\x0b\f\r")]
    rows += [(3003, "\x1c"), (3004, " "), (3005, "x" * 3_000_000), (3006, "x " * 3_000_000), (3007, "Text 1 über 数据")]
    return rows


@pytest.mark.parametrize("options", [{}, {"most": 1 << 10}, {"hot": 4}])
def test_exact_duplicates(spark, options):
    rows = copies()
    got = collections.Counter(map(tuple, exact_dup.exact_duplicates(frame(spark, rows), **options).collect()))
    assert got == exact_wanted(rows)


def test_filter_takes_few_others(spark):
    """Of rows without copies about one in seventy is taken for a possible copy, with copies none is missed."""
    g = np.random.default_rng(0)
    h = g.integers(0, 1 << 62, 20_000, dtype=np.int64)
    segments = len(h) * exact_dup.BITS // exact_dup.SEGMENT + 1
    rows = [(int(x >> 32) % segments, int(x) & 65535, int(x >> 16) & 65535) for x in [*h, *h[:100]]]
    df = spark.createDataFrame(rows, "segment long, one int, two int").repartition(5)
    again = df.mapInArrow(exact_dup._segments, "segment long, once binary, again binary").groupBy("segment").applyInArrow(exact_dup._merge, "segment long, again binary")
    bits = {r.segment: np.unpackbits(np.frombuffer(r.again, np.uint8), bitorder="little") for r in again.collect()}
    may = [bool(bits[s][a] and bits[s][b]) for s, a, b in rows]
    assert all(may[:100]) and all(may[-100:]) and sum(may[100:-100]) < 0.03 * len(h)


def test_without_copies(spark):
    docs = frame(spark, [(1, "a b"), (2, "a  b"), (3, "c"), (None, "d")])
    out = exact_dup.without_copies(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


# lexical search


def lexical_wanted(items, docs, k):
    def terms(text):
        return re.findall(lexical.TERM_SIGNS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    counted = [(doc, collections.Counter(terms(t))) for doc, t in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(terms(text))
    out = set()
    for item, times in asked.items():
        scores = []
        for doc, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in times.items() if t in c)
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out |= {(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("options", [{}, {"block": 100, "cells": 40}])
def test_lexical_search(spark, options):
    g = np.random.default_rng(4)
    words = ["alpha", "Beta", "gamma's", "über", "Über", "数据", "x1", "1", "a", "É", " ", "ﬁ", "naïve", "q-w", "zz", "İ", "ß"]
    text = lambda n: "".join(str(g.choice(words)) + str(g.choice(list(" \n.,-_'\x00\x7f/"))) for _ in range(n))
    docs = [(i, text(int(g.integers(1, 40)))) for i in range(120)]
    docs += [(200, docs[0][1]), (201, docs[0][1]), (5, docs[5][1]), (202, ""), (203, None), (204, " .-"), (None, docs[3][1]), (205, text(60_000))]
    items = [(i, text(int(g.integers(1, 12)))) for i in range(15)] + [(20, ""), (21, None), (None, "alpha"), (3, "alpha alpha zz"), (22, "nowhere to be found"), (23, "alphabet")]
    asked = spark.createDataFrame([(*r, *EXTRA) for r in items], DOCS.replace("doc_id", "item_id"))
    got = lexical.ranked_documents(asked, frame(spark, docs), k=10, **options).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == lexical_wanted(items, docs, 10)


def test_best_documents_by_batches():
    g = np.random.default_rng(1)
    scores = g.integers(0, 6, (300, 7))
    scores[:, 6] = 0
    best = lexical.Best(7, 10)
    for at in range(0, 300, 37):
        best.add(np.arange(at, min(at + 37, 300)), scores[at : at + 37])
    want = [(i, d, scores[d, i]) for i in range(6) for d in sorted(range(300), key=lambda d: (-scores[d, i], d))[:10]]
    assert list(zip(best.item, best.doc, best.score, strict=True)) == want


# periodic runs


def runs_wanted(words):
    """All runs (start, length, period) by comparing words of all distances."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)  # the smallest period comes first
    return sorted((s, n, q) for (s, n), q in found.items())


def row_wanted(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    runs = sorted(runs_wanted(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_texts():
    g = np.random.default_rng(7)
    out = ["", None, " \n ", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a b a a a a a a", "           "]
    for _ in range(80):  # few words, so many chance runs
        out.append(" ".join(g.choice(list("ab"), int(g.integers(10, 300)))))
    for _ in range(60):  # repeated blocks amid others, nested ones too
        block = list(g.choice(list("abcdefgh"), int(g.integers(1, 40))))
        if g.random() < 0.5:
            block = block[: len(block) // 2] * 4 + block[len(block) // 2 :]
        n = int(len(block) * g.uniform(3.5, 9))
        run = (block * 10)[:n]
        if g.random() < 0.3 and n > 9:
            run[int(g.integers(0, n))] = "odd"
        out.append("\t".join([*g.choice(list("ijklm"), int(g.integers(0, 50))), *run, *g.choice(list("nopq"), int(g.integers(0, 50)))]))
    out += ["x " * 700, "x y " * 400, ("x " * 9 + "y ") * 70]
    return out


def test_periodic_runs(spark):
    texts = periodic_texts()
    rows = list(enumerate(texts)) + [(None, texts[4]), (7, texts[7]), (7, texts[7])]
    got = collections.Counter(map(tuple, periodic.periodic_runs(frame(spark, rows)).collect()))
    assert got == collections.Counter((doc, *row_wanted(t)) for doc, t in rows)


def test_runs_over_many_tiles(spark, monkeypatch):
    """Long runs of small and large periods, also with narrow tiles."""
    g = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    block, wide = list(g.choice(words, 37)), list(g.choice(words, 2600))
    texts = [" ".join([*g.choice(words, 500), *(block * 600), *g.choice(words, 700)]), " ".join([*g.choice(words, 900), *(wide * 5)[:-11]]), " ".join(["z"] * 30_000)]
    want = []
    for t, (start, q) in zip(texts, ((500, 37), (900, 2600), (0, 1)), strict=True):
        w = t.split()
        while start and w[start - 1] == w[start - 1 + q]:
            start -= 1
        end = start + q
        while end < len(w) and w[end] == w[end - q]:
            end += 1
        want.append((start, end - start, q))
    got = {r.doc_id: (r.start, r.length, r.period) for r in periodic.periodic_runs(frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(want))
    monkeypatch.setattr(periodic, "TILE", 8)
    for t in periodic_texts()[9:]:
        ids = periodic.numbered(t.encode().split())
        parts = sorted({x for p, at, w in periodic.tiles(ids) for x in periodic.solve(p, w, at)})
        runs, last = [], None
        for q, lo, hi in parts:
            if last and last[0] == q and lo <= last[2]:
                last[2] = max(last[2], hi)
            else:
                last = [q, lo, hi]
                runs.append(last)
        assert sorted((lo, hi - lo + q, q) for q, lo, hi in runs if hi - lo + q >= max(6, 4 * q)) == runs_wanted(t.split())


def test_planted_repeats(spark):
    g = np.random.default_rng(5)
    rows = [(i, " ".join(g.choice(list("abcdefghijk"), int(g.integers(0, 60))))) for i in range(300)] + [(None, "a b"), (311, None)]
    for doc, text, was in [(r.doc_id, r.text, dict(rows).get(r.doc_id)) for r in periodic.with_planted_repeats(frame(spark, rows[:300])).collect()]:
        h, words = zlib.crc32(str(doc).encode()), was.split()
        if h % 10 == 0 and words:
            k, n = h // 10, len(words)
            a = k % n
            p = 1 + (n - a) // (3 + k % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert text.split() == words
    assert periodic.with_planted_repeats(frame(spark, rows[300:])).count() == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert exact_dup.exact_duplicates(none).count() == periodic.periodic_runs(none).count() == lexical.ranked_documents(items, none).count() == 0
    assert lexical.ranked_documents(items.where("item_id > 1"), frame(spark, [(1, "a")])).count() == 0
