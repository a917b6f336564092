"""License scan: exact license phrases, and short notices with a bounded number of edits.

A text is taken as its words (lower-cased A-Z, separators are one space).  A phrase of the base list counts where its words stand
consecutively.  A notice of the fuzzy list may differ by up to ``edits(notice)`` insertions, deletions and substitutions of characters:

1. A notice with ``k`` edits allowed is cut into ``k + 1`` seeds; whatever is within ``k`` edits of it holds one of them unchanged.
2. One Aho-Corasick automaton of all seeds finds the candidates of a whole text; a candidate is the stretch in which the notice can lie.
3. The ``regex`` library matches the notice with bounded errors in each stretch and reports the span and its edits.  Stretches that overlap are
   searched together, but none longer than ``STRETCH`` and one candidate, so work is in proportion to the candidates.

Of places of one notice that overlap, the one with the fewest edits is reported, then the first.

Defined cases: null and empty texts have no words, places or labels and the score 0.  Very long texts are taken whole.  Repeated rows are
judged each; rows without an id too.  Empty tables give no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.batches import bounded, small_batches
from quillstack.llm.terms import spaced

#: Phrases counted exactly, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices searched with errors, with their labels.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
}
#: Characters of a notice for each edit allowed, and characters of stretches that are searched together.
PER_EDIT, STRETCH = 15, 4096


def edits(notice: str) -> int:
    """Edits allowed: one for every fifteen characters, at least one."""
    return max(1, len(notice) // PER_EDIT)


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """(place, letters) of ``k + 1`` parts of nearly one length."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds phrases and notices in normalised texts."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.phrases = [(f" {phrase} ", label) for phrase, label in phrases.items()]
        self.notices = [(text, label, edits(text)) for text, label in notices.items()]
        if any(len(text) <= k for text, _, k in self.notices):
            raise ValueError("a notice must be longer than the edits allowed")
        self.match = [regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}") for text, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        for n, (text, _, k) in enumerate(self.notices):
            for place, seed in seeds(text, k):
                self.seeds.add_word(seed, [*self.seeds.get(seed, []), (n, place + len(seed))])
        if self.notices:
            self.seeds.make_automaton()

    def exact(self, text: str) -> list[tuple[str, int]]:
        """(label, place) of all phrases of a text that begins and ends with a space."""
        found = []
        for phrase, label in self.phrases:
            at = text.find(phrase)
            while at >= 0:
                found.append((label, at + 1))
                at = text.find(phrase, at + 1)
        return sorted(found, key=lambda x: (x[1], x[0]))

    def stretches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(notice, first, past the last character) of all stretches that can hold a notice; each candidate lies in one of them whole."""
        if not self.notices:
            return
        open_: dict[int, tuple[int, int]] = {}
        for last, owners in self.seeds.iter(text):
            for n, upto in owners:
                notice, _, k = self.notices[n]
                begin = max(0, last + 1 - upto - k)
                end = min(len(text), last + 1 - upto + len(notice) + k)
                if n in open_:
                    a, b = open_[n]
                    if begin <= b and end - a <= STRETCH:
                        open_[n] = (min(a, begin), max(b, end))
                        continue
                    yield n, a, b
                open_[n] = (begin, end)
        yield from ((n, a, b) for n, (a, b) in open_.items())

    def matches(self, n: int, text: str, first: int, last: int) -> Iterator[tuple[int, int, int]]:
        """(edits, first, past the last character): the best match of a stretch, then those left and right of it."""
        todo = [(first, last)]
        while todo:
            a, b = todo.pop()
            m = self.match[n].search(text, a, b)
            if m:
                yield sum(m.fuzzy_counts), m.start(), m.end()
                todo += [(a, m.start()), (m.end(), b)]

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, notice, first, past the last character, edits), places of one notice apart, in order of place."""
        met: dict[int, set[tuple[int, int, int]]] = {}
        for n, a, b in self.stretches(text):
            met.setdefault(n, set()).update(self.matches(n, text, a, b))
        found = []
        for n, places in met.items():
            starts, ends = [-1], [-1]
            for errors, a, b in sorted(places):
                i = bisect_right(starts, a)
                if ends[i - 1] <= a and (i == len(starts) or b <= starts[i]):
                    starts.insert(i, a)
                    ends.insert(i, b)
                    found.append((self.notices[n][1], n, a, b, errors))
        return sorted(found, key=lambda x: (x[2], x[1]))


def normal(text: str | None) -> tuple[str, int]:
    """Words with one space between, before and after them, and their number."""
    words = spaced(text).split()
    return (f" {b' '.join(words).decode()} " if words else ""), len(words)


class Places:
    """Numbers of the words at rising places of one text."""

    def __init__(self, text: str):
        self.text, self.at, self.word = text, 0, -1

    def __call__(self, place: int) -> int:
        """The word that holds the character; for a space the one behind it."""
        self.word += self.text.count(" ", self.at, place + 1)
        self.at = place + 1
        return self.word


@lru_cache(maxsize=4)
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    """One per worker and list."""
    return Scanner(dict(phrases), dict(notices))


SPANS = "array<struct<label: string, notice: string, first_word: bigint, last_word: bigint, edits: int, matched: string>>"


def scan(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, n_words, phrases, notices), one row per document; both lists hold the spans found, in order of place."""
    small_batches(spark)
    lists = tuple(phrases.items()), tuple(notices.items())
    span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(*lists)
        for batch in bounded(batches):
            counts, exact, fuzzy = [], [], []
            for raw in batch.column("text").to_pylist():
                text, n = normal(raw)
                counts.append(n)
                word, spans = Places(text), []
                for label, at in find.exact(text):
                    phrase = next(p for p, own in find.phrases if own == label and text.startswith(p, at - 1)).strip()
                    first = word(at)
                    spans.append((label, phrase, first, first + phrase.count(" "), 0, phrase))
                exact.append(spans)
                word, spans = Places(text), []
                for label, notice, a, b, errors in find.fuzzy(text):
                    first = word(a)
                    end = a + len(text[a:b].rstrip(" "))  # a space at the end belongs to no word
                    spans.append((label, find.notices[notice][0], first, first + text.count(" ", a + 1, end), errors, text[a:b]))
                fuzzy.append(spans)
            columns = [[[dict(zip(span.names, s)) for s in spans] for spans in rows] for rows in (exact, fuzzy)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(c, pa.list_(span)) for c in columns)], names=["doc_id", "n_words", "phrases", "notices"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, n_words long, phrases {SPANS}, notices {SPANS}")


def labelled(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices) from what ``scan`` returns.

    The score is 1 for an exact phrase, else the largest share of a notice's characters that needed no edit.
    """
    labels = lambda c: F.transform(c, lambda s: s.label)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform("phrases", lambda s: s.first_word)
    share = F.array_max(F.transform("notices", lambda s: 1 - s.edits / F.length(s.notice)))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels("phrases")).alias("base_labels"),
        joined(F.concat(labels("phrases"), labels("notices"))).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
        "notices",
    )


def find_licenses(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``labelled`` rows of all documents; options are those of ``scan``."""
    return labelled(scan(spark, docs, **options))
