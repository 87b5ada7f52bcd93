"""Token ids of whole texts by a `tokenizers` file, over the distinct words of a run of texts.

The tokenizer file word_bpe_49k.json drops white space and never joins across it, so a text's ids are the ids of its
words in turn. A plain word (ASCII and Latin-1 letters, digits, punctuation but the apostrophe) falls into runs of letters,
single digits and runs of signs, as the tokenizer's own pattern has it; each distinct one goes through the library's BPE
model once and is kept for the texts to come, up to a limit. Other words go through the library's full pipeline.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rankcut.llm.shared import slices
from rankcut.llm.words import LIMIT, known

TOKENIZER = "word_bpe_49k.json"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"!-&(-/:-@\[-`{-~"
PLAIN = f"^[{LETTERS}0-9{SIGNS}]+$"
PART = f"([{LETTERS}]+|[0-9]|[{SIGNS}]+)"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level BPE: printable Latin-1 stands for itself, the n-th other byte for chr(256 + n)."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordEncoder:
    """Ids of texts. `limit` bounds the parts of words in each of two generations, of at most 64 characters each: when
    the younger one is full it takes the place of the older, of which what is met again has moved to the younger before."""

    def __init__(self, path: str, limit: int = LIMIT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the processors
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit = limit
        self.kept: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.letters = byte_letters() | {10: "\n"}

    def _parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of lower-case parts."""
        if len(self.kept) >= self.limit:
            self.older, self.kept = self.kept, {}
        out = list(map(self.kept.get, parts))
        new = []
        for i in [i for i, got in enumerate(out) if got is None]:
            if (got := self.older.get(parts[i])) is None:
                new.append(i)
            else:
                out[i] = self.kept[parts[i]] = got
        if new:
            # an empty part stands before the first one of each word, and has no ids
            shown = "\n".join([parts[i] for i in new]).encode().decode("latin-1").translate(self.letters).split("\n")
            tokenize = self.library.model.tokenize
            for i, letters in zip(new, shown, strict=True):
                out[i] = [t.id for t in tokenize(letters)]
                if len(letters) <= 64:
                    self.kept[parts[i]] = out[i]
        return out

    def _ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, number of ids of each word)."""
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        easy, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.take(pa.array(easy))), PART, r" \1"))
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        codes, known_parts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        lists = self._parts(known_parts)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        pool = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(n.sum()))
        each = n[codes] if len(codes) else np.zeros(0, np.int64)
        cum = np.concatenate([[0], np.cumsum(each)])
        begin = np.cumsum(n) - n
        at = np.repeat(begin[codes] - cum[:-1], each) if len(codes) else np.zeros(0, np.int64)
        ids = [pool[at + np.arange(len(at))]]
        counts, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        counts[easy], first[easy] = cum[bounds[1:]] - cum[bounds[:-1]], cum[bounds[:-1]]
        if len(odd):
            found = [e.ids for e in self.library.encode_batch(words.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            counts[odd] = [len(x) for x in found]
            first[odd] = cum[-1] + np.cumsum(counts[odd]) - counts[odd]
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts[odd].sum())))
        return np.concatenate(ids), first, counts

    def encode(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """(all ids in a row, number of ids of each text); null counts as empty."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), bounds - bounds[0]
        pool, first, n = self._ids_of_words(coded.dictionary)
        each = n[codes] if len(codes) else np.zeros(0, np.int64)
        cum = np.concatenate([[0], np.cumsum(each)])
        counts = cum[bounds[1:]] - cum[bounds[:-1]]
        if not want_ids:
            return None, counts
        at = np.repeat(first[codes] - cum[:-1], each) if len(codes) else np.zeros(0, np.int64)
        return pool[at + np.arange(len(at))], counts


def encoder(path: str) -> WordEncoder:
    """This worker process's encoder."""
    own = known("tokens", "encoders")
    if path not in own:
        own[path] = WordEncoder(path)
    return own[path]


def encoded(texts: pa.Array, path: str, want_ids: bool = True):
    """Yields (from, to, ids, counts) for runs of rows."""
    own = encoder(path)
    for at, to in slices(texts):
        yield at, to, *own.encode(texts.slice(at, to - at), want_ids)
