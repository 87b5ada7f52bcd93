"""Words of whole texts as hashes, and five-word shingles of them.

A word is what stands between ASCII white space, without what isn't a letter or digit, in lower case; what has none is no
word. word_hashes works on bytes: ASCII and the letters of the Latin-1 block by tables, and only words with other signs go
through Python one by one. Texts of any length go through in blocks.

Caches of a worker process belong to the kind of work in hand: when another begins, they are let go, so that a worker
which serves several stages in turn doesn't keep the caches of all.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rankcut.llm.shared import mixed

LIMIT = 150_000
BLOCK = 1 << 20  # bytes hashed at a time
NOT_WORD = re.compile(r"[\W_]+")
#: Odd multipliers for the places in a shingle, from the generator itself.
PLACES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)

_KNOWN: dict[str, dict] = {}
_KINDS: list[str] = []


def known(kind: str, name: str) -> dict:
    """This process's cache `name` of a kind of work; those of other kinds are let go."""
    if _KINDS != [kind]:
        _KNOWN.clear()
        _KINDS[:] = [kind]
    return _KNOWN.setdefault(name, {})


def plain(word: str) -> str:
    return NOT_WORD.sub("", word).lower()


def _tables() -> tuple[np.ndarray, ...]:
    every = np.arange(256)
    space = np.isin(every, list(b" \t\n\x0b\f\r"))
    kept = np.isin(every, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    lower = np.where((every >= 65) & (every <= 90), every + 32, every).astype(np.uint8)
    return space, kept, lower, mixed(every.astype(np.uint64) + np.uint64(1001))


SPACE, KEPT, LOWER, VALUES = _tables()
LEAD = 0xC3  # of the two bytes of a Latin-1 letter
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = int(PLACES[60])
        made = [np.full(max(n, BLOCK + 1), np.uint64(x)) for x in (base, pow(base, -1, 1 << 64))]
        for m in made:
            m[0] = 1
        made = [np.cumprod(m, dtype=np.uint64) for m in made]
        if n > BLOCK + 1:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def hashed_bytes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A hash of the kept bytes of each slice; 0 if there is none."""
    rank = np.concatenate([np.zeros(1, np.int32), np.cumsum(kept, dtype=np.int32)])
    up, down = powers(int(rank[-1]) + 1)
    at = np.flatnonzero(kept)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[low[at]] * up[: len(at)], dtype=np.uint64)])
    x, y = rank[starts], rank[ends]
    return np.where(y > x, mixed((run[y] - run[x]) * down[x] + (y - x).astype(np.uint64)) | np.uint64(1), np.uint64(0))


def _odd_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words with signs that the tables don't know."""
    own = known("hash", "odd")
    got = {w: own.get(w) for w in words}
    if new := [w for w, h in got.items() if h is None]:
        forms = [plain(w).encode() for w in new]
        flat = np.frombuffer(b"".join(forms), np.uint8)
        ends = np.cumsum([len(f) for f in forms])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        made = dict(zip(new, hashed_bytes(flat, starts, ends, np.ones(len(flat), bool), flat).tolist(), strict=True))
        got |= made
        if len(own) > LIMIT:
            own.clear()
        own.update((w, h) for w, h in made.items() if len(w) <= 64)
    return np.array([got[w] for w in words], np.uint64)


#: Traits of a word: it begins with a digit and has three letters at most; capitalised; a sentence ends after it.
NUMBER, CAPITAL, SENTENCE = 1, 2, 4


def _traits(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> np.ndarray:
    digit = (b >= 48) & (b <= 57)
    at = np.append(np.flatnonzero(kept), 0)
    rank, digits, stops = (np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)]) for x in (kept, digit, np.isin(b, list(b".!?:"))))
    x, y = rank[starts], rank[ends]
    some = y > x
    head, last = at[np.where(some, x, 0)], at[np.where(some, y - 1, 0)]
    wide = b[head] == LEAD
    follow = at[np.minimum(np.where(some, x, 0) + 1 + wide, len(at) - 1)]
    after = lambda i: b[np.minimum(i + 1, len(b) - 1)]
    lower = (y > x + 1 + wide) & ((b[follow] >= 97) & (b[follow] <= 122) | (b[follow] >= 128) & ((b[follow] != LEAD) | (after(follow) > 0x9E)))
    upper = (b[head] >= 65) & (b[head] <= 90) | wide & (after(head) <= 0x9E)
    number = digit[head] & (y - x - (digits[ends] - digits[starts]) <= 3)
    return np.where(some, NUMBER * number + CAPITAL * (upper & lower) + SENTENCE * (stops[ends] > stops[last + 1]), 0).astype(np.uint8)


def _block_hashes(b: np.ndarray, begins: np.ndarray, traits: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hash of each word, or 0; place where it begins; its traits) of a block of bytes; begins: where texts begin in it."""
    space = SPACE[b]
    first = ~space
    first[1:] &= space[:-1]
    first[begins] = ~space[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(0, np.uint8)
    ends = np.append(starts[1:], len(b))
    kept, low, high = KEPT[b], LOWER[b], np.flatnonzero(b >= 128)
    odd = None
    if len(high):
        v = b[high]
        after = np.zeros(len(high), bool)  # the second byte of a Latin-1 letter
        after[1:] = (v[:-1] == LEAD) & (high[1:] == high[:-1] + 1)
        fine = (v == LEAD) | after & (v != 0x97) & (v != 0xB7)
        kept[high] = fine
        low[high] = np.where(after & (v <= 0x9E), v + 0x20, v)
        lead_of = high[after & ~fine] - 1
        bad = np.zeros(len(b), bool)
        bad[high[~fine]] = True
        bad[lead_of] = True
        odd = np.flatnonzero(np.logical_or.reduceat(bad, starts))
    out = hashed_bytes(b, starts, ends, kept, low)
    if odd is not None and len(odd):
        raw = b.tobytes()
        out[odd] = _odd_hashes([raw[starts[i] : ends[i]].decode(errors="replace").rstrip(" \t\n\x0b\f\r") for i in odd.tolist()])
    return out, starts, _traits(b, starts, ends, kept) if traits else None


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in a row, bounds of each text)."""
    h, bounds, _ = words_of(texts)
    return h, bounds


def words_of(texts: pa.Array, traits: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes of all words in a row, bounds of each text, traits of each word)."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, places, kinds, at = [], [], [], 0
    while at < len(flat):
        to, reach = min(at + BLOCK, len(flat)), BLOCK
        while to < len(flat):  # a block ends where a text or a word does; one very long word is a block of its own
            i = int(np.searchsorted(offsets, to, side="right")) - 1
            cut = int(offsets[i]) if offsets[i] > at else at
            gaps = np.flatnonzero(SPACE[flat[max(cut, to - 4096) : to]])
            if len(gaps):
                cut = max(cut, to - 4096) + int(gaps[-1]) + 1
            if cut > at:
                to = cut
                break
            reach *= 2
            to = min(at + reach, len(flat))
        begins = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        h, p, t = _block_hashes(flat[at:to], begins, traits)
        hashes.append(h), places.append(p + at), kinds.append(t)
        at = to
    h, p = (np.concatenate([*x, np.zeros(0, k)]) for x, k in ((hashes, np.uint64), (places, np.int64)))
    real = h != 0
    t = np.concatenate([*kinds, np.zeros(0, np.uint8)])[real] if traits else None
    return h[real], np.searchsorted(p[real].astype(np.int64), offsets), t


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of each word, the distinct words as they stand, bounds of each text)."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), bounds - bounds[0]


def looked_up(words: list[str], kind: str, name: str, f: Callable[[str], int]) -> np.ndarray:
    """f of each word, kept by this process."""
    own = known(kind, name)
    if len(own) > LIMIT:
        own.clear()
    out = list(map(own.get, words))
    for i, got in enumerate(out):
        if got is None:
            out[i] = f(words[i])
            if len(words[i]) <= 64:
                own[words[i]] = out[i]
    return np.array(out, np.uint64)


def content_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two signed numbers, of each text's words in order."""
    n = np.diff(bounds)
    place = (np.arange(len(h)) - np.repeat(bounds[:-1], n)).astype(np.uint64)
    out = []
    for k in (1, 2):
        x = mixed(h + place * PLACES[k] + np.uint64(k))
        out.append(mixed(sums(x, bounds) + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each slice, 0 for empty ones (whole numbers wrap around)."""
    c = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return c[bounds[1:]] - c[bounds[:-1]]


def shingles(h: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, index of its first word, bounds of each text). A text of fewer than n words, but one at
    least, is a shingle of its own."""
    size = np.diff(bounds)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], count)
    s = np.zeros(len(first), np.uint64)
    ends = np.repeat(bounds[1:], count)
    short = bool((size < n).any())
    for k in range(n):
        at = first + k
        if short:
            ok = at < ends
            s += np.where(ok, h[np.minimum(at, len(h) - 1)], 0) * PLACES[k]
        else:
            s += h[at] * PLACES[k]
    return mixed(s), first, out
