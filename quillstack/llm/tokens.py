"""Token ids of whole texts by a public tokenizer, each different piece tokenised once per worker.

A tokenizer of this kind cuts a text into pieces and maps each piece to ids on its own.  The
pieces of a batch are found with numpy over its code points, and a table in the worker holds
the ids of the pieces met so far; only new pieces go to the ``tokenizers`` library.  A hash finds a
piece's entry, and its letters are compared with the entry's: a different piece of the same hash
goes to the library.  Texts for which the cutting rule here might differ from the library's (characters past Latin
Extended-B, strings of special tokens, characters whose lower case is longer, very long
texts) go to the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from quillstack.llm.batches import bounded, kept, texts

LATIN = 0x250
#: Pieces held by one worker; beyond it the table starts anew.
HELD = 1 << 19


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of ranges one after another, and how many there are up to the end of each."""
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0), upto


def _strings(letters: np.ndarray, upto: np.ndarray) -> list[str]:
    """Pieces that stand one after another and end at ``upto``."""
    text, ends = letters.astype("<u4").tobytes().decode("utf-32-le"), upto.tolist()
    return [text[i:j] for i, j in zip([0, *ends], ends)]


def _with_room(table: np.ndarray, used: int, more: int) -> np.ndarray:
    """The table, or a longer copy of its used part."""
    return table if used + more <= len(table) else np.r_[table[:used], np.zeros(max(len(table), more), dtype=table.dtype)]


class PieceTokenizer:
    """``encode(texts)`` gives all ids and the number of ids of each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.size = self.library.get_vocab_size()
        self.special = [x["content"] for x in spec["added_tokens"]]
        #: Two public cutting rules: pieces keep the blank before them, or blanks are dropped and digits stand alone.
        self.keeps_space = spec["normalizer"] is None
        chars = [chr(c) for c in range(LATIN)]
        lowered = chars if self.keeps_space else [c.lower() for c in chars]
        self.plain = np.array([len(x) == 1 for x in lowered])
        self.lower = np.array([ord(x[0]) for x in lowered], dtype=np.uint32)
        kind = [3 if unicodedata.category(c)[0] == "L" else 2 if unicodedata.category(c)[0] == "N" else 0 if c in "\t\n\x0b\x0c\r \x85\xa0" else 1 for c in chars]
        self.kind = np.array(kind, dtype=np.uint8)
        random = np.random.default_rng(7)
        self.code = random.integers(1, 1 << 63, 0x2C80, dtype=np.uint64)
        self.base, self.inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(4 * HELD, -1, dtype=np.int32)
        self.keys = np.zeros(HELD, dtype=np.uint64)
        self.first = np.zeros(HELD + 1, dtype=np.int64)
        self.count = np.zeros(HELD, dtype=np.int32)
        self.pool = np.zeros(1 << 20, dtype=np.uint32)
        self.begin = np.zeros(HELD + 1, dtype=np.int64)
        self.letters = np.zeros(1 << 20, dtype=np.uint16)
        self.n = 0

    def _powers(self, n: int) -> None:
        if len(self.powers) <= n:
            m = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(m, self.base, dtype=np.uint64)], dtype=np.uint64)
                self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(m, self.inverse, dtype=np.uint64)], dtype=np.uint64)

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _simple(self, text: str) -> bool:
        return len(text) <= HELD // 2 and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        fast, out, n = [], [None] * len(texts), np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, dtype=np.uint32)
                continue
            if self._simple(t):
                points = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
                if points.max() < LATIN and self.plain[points].all():
                    fast.append((i, points))
                    continue
            out[i] = self._direct(t)
        if fast:
            ids, counts = self._pieces([p for _, p in fast])
            if len(fast) == len(texts):
                return ids, counts
            ends = np.cumsum(counts)
            for (i, _), a, b in zip(fast, (ends - counts).tolist(), ends.tolist()):
                out[i] = ids[a:b]
        n[:] = [len(x) for x in out]
        return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)), n

    def _cut(self, points: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last code point of each piece."""
        kind = self.kind[np.minimum(points, LATIN - 1)]  # past the table: the lower case of a letter
        if not self.keeps_space:
            begin = np.r_[True, kind[1:] != kind[:-1]] | (kind == 2)
            begin[text_start] = True
            self._contractions(points, kind, begin, text_start)
            at = np.flatnonzero(begin)
            end = np.r_[at[1:], len(points)]
            keep = kind[at] != 0
            return at[keep], end[keep]
        begin = np.r_[True, kind[1:] != kind[:-1]]
        begin[text_start] = True
        # The last blank of a run before other text goes with that text if it is a space, and is a piece alone if it is not.
        follows = np.flatnonzero(begin & (kind != 0))
        first = np.zeros(len(points), dtype=bool)
        first[text_start] = True
        follows = follows[~first[follows]]
        follows = follows[kind[follows - 1] == 0]
        begin[follows[points[follows - 1] == 32]] = False
        begin[follows - 1] = True
        self._contractions(points, kind, begin, text_start)
        at = np.flatnonzero(begin)
        return at, np.r_[at[1:], len(points)]

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, begin: np.ndarray, text_start: np.ndarray) -> None:
        """A piece that is one apostrophe takes s, t, m, d, re, ve or ll from the letters after it."""
        first = np.zeros(len(points) + 3, dtype=bool)
        first[text_start] = first[len(points) :] = True
        at = np.flatnonzero((points[:-1] == 39) & begin[:-1] & (kind[1:] == 3))
        at = at[~first[at + 1]]
        one = points[at + 1]
        two = np.where(first[at + 2], 0, points[np.minimum(at + 2, len(points) - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((at[short], 2), (at[long], 3)):
            begin[hit + 1] = False
            after = hit + size
            begin[after[after < len(points)]] = True

    def _pieces(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        points = np.concatenate(parts)
        if not self.keeps_space:
            points = self.lower[points]
        sizes = np.array([len(p) for p in parts])
        text_start = np.cumsum(sizes) - sizes
        at, end = self._cut(points, text_start)
        self._powers(len(points) + 1)
        with np.errstate(over="ignore"):
            prefix = np.r_[np.uint64(0), np.cumsum(self.code[points] * self.powers[: len(points)], dtype=np.uint64)]
            key = (prefix[end] - prefix[at]) * self.inverses[at]
            key ^= (key >> np.uint64(29)) ^ (end - at).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        entry = self._find(key)
        while len(missing := np.flatnonzero(entry < 0)):
            fresh, where = np.unique(key[missing], return_index=True)
            where = missing[where]
            self._add(fresh, points, at[where], end[where])
            entry = self._find(key)  # all of them: the table may have begun anew
        first, count, pool = self.first[entry], self.count[entry], self.pool
        other = np.flatnonzero(~self._equal(entry, points, at, end))
        if len(other):
            own, letters_upto = _ranges(at[other], (end - at)[other])
            sizes, ids = self._library(_strings(points[own], letters_upto))
            used = int(self.first[self.n])
            first[other], count[other], pool = used + np.cumsum(sizes) - sizes, sizes, np.r_[pool[:used], ids]
        total = np.cumsum(count, dtype=np.int64)
        ids = pool[np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        upto = np.r_[0, total]
        inside = np.searchsorted(at, np.r_[text_start, len(points)])
        return ids, np.diff(upto[inside])

    def _equal(self, entry: np.ndarray, points: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each entry was made of these very letters."""
        size = end - at
        same = size == self.begin[entry + 1] - self.begin[entry]
        which = np.flatnonzero(same)
        at, size = at[which], size[which]
        own, upto = _ranges(at, size)
        held = own + np.repeat(self.begin[entry[which]] - at, size)
        wrong = np.flatnonzero(points[own] != self.letters[held])
        same[which[np.searchsorted(upto, wrong, side="right")]] = False
        return same

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        found = np.full(len(key), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        todo, slot = np.arange(len(key)), (key >> np.uint64(13)).astype(np.int64) & mask
        while len(todo):
            entry = self.slots[slot]
            hit = (entry >= 0) & (self.keys[entry] == key[todo])
            found[todo[hit]] = entry[hit]
            more = (entry >= 0) & ~hit
            todo, slot = todo[more], (slot[more] + 1) & mask
        return found

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids."""
        ids = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum()))

    def _add(self, keys: np.ndarray, points: np.ndarray, at: np.ndarray, end: np.ndarray) -> None:
        if self.n + len(keys) > HELD:
            self.clear()
        if len(keys) > HELD:
            raise ValueError("a batch has more different pieces than the table holds")
        own, letters_upto = _ranges(at, end - at)
        letters = points[own].astype(np.uint16)
        counts, flat = self._library(_strings(letters, letters_upto))
        a, b, used, lettered = self.n, self.n + len(keys), int(self.first[self.n]), int(self.begin[self.n])
        self.pool, self.letters = _with_room(self.pool, used, len(flat)), _with_room(self.letters, lettered, len(letters))
        self.pool[used : used + len(flat)] = flat
        self.letters[lettered : lettered + len(letters)] = letters
        self.keys[a:b], self.count[a:b] = keys, counts
        self.first[a : b + 1] = used + np.r_[0, np.cumsum(counts)]
        self.begin[a : b + 1] = lettered + np.r_[0, letters_upto]
        mask = len(self.slots) - 1
        todo, slot = np.arange(a, b), (keys >> np.uint64(13)).astype(np.int64) & mask
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & mask
        self.n = b


def tokenizer(path: str) -> PieceTokenizer:
    """One per worker and file; its table serves the worker's next tasks, until one of another kind comes."""
    if path not in kept:
        kept.clear()
        kept[path] = PieceTokenizer(path)
    return kept[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, all ids, ids per text) of bounded slices."""
    made = tokenizer(path)
    for batch in bounded(batches, limit=1 << 18, keep=path):
        yield batch, *made.encode(texts(batch.column("text")))
