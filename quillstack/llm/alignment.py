"""Alignment of the tokens of two tokenizers, at whole-corpus scale.

A text is tokenised in full by both: A, a byte-level vocabulary of the ``tokenizers`` library, gets a space and the text; B, a piece vocabulary
of ``sentencepiece``, gets the text and puts the space before it itself.  Tokens have byte lengths, and both token rows must spell the space and the text.

1. Anchors: where a token of A and one of B both begin with a space at the same byte, both have ended just before; such verified shared ends split a
   document into windows of token ids, about one for each word.
2. A window is aligned once: byte places where tokens of both end cut it into groups, and every token of A is linked to every token of B of its group.
   Alignments are kept by the window's two id rows; a hash finds one, and the ids are then compared.  Long windows are aligned but not kept.
3. A document is the sum of its windows: its different id pairs with the times they are linked are staged, and a sum over that table gives in how many
   documents each pair is linked.
4. Pairs of many documents, as many as a bound allows, are sent to every task; a document's other pairs, if any, are joined with the counts.

Defined cases: texts that are null or empty, or that either tokenizer does not give back byte for byte, have no tokens (all numbers 0, an empty hash).  Strings of special tokens are
plain text.  Very long texts are taken whole.  Repeated rows, and rows without an id, are documents each and are returned each.
Empty tables give no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.batches import bounded, kept, release, small_batches
from quillstack.llm.suffix_dedup import mixed
from quillstack.llm.tokens import PieceTokenizer, _ranges
from quillstack.staging import Stage

#: Bytes of text aligned at a time, windows kept by a worker, tokens of a window that is kept, pairs sent to every task.
SLICE, KEPT, SHORT, HOT = 1 << 18, 1 << 17, 48, 1 << 20


class ByteTokens(PieceTokenizer):
    """A: strings of special tokens are plain text; ``spelled`` holds the bytes of every id."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.special = []
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {c: chr(c) for c in printable} | {c: chr(0x100 + i) for i, c in enumerate(c for c in range(256) if c not in printable)}
        byte = {s: c for c, s in shown.items()}
        spelled = [b""] * self.size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            spelled[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.spelled = spelled


class SentencePieces(PieceTokenizer):
    """B, cut where a space follows something else: no piece of the vocabulary holds a space behind another letter, so no merge crosses a cut."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(self.size)]
        self.cuts = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        self.special, self.keeps_space = [], True
        self.plain = np.ones(0x250, dtype=bool)
        self.code = np.random.default_rng(9).integers(1, 1 << 63, 0x2C80, dtype=np.uint64)
        self.base, self.inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)
        self.spelled = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.clear()

    def _simple(self, text: str) -> bool:
        return self.cuts and super()._simple(text)

    def _direct(self, text: str) -> np.ndarray:
        """Ids of a space and more; the library puts the space itself."""
        return np.array(self.library.encode(text[1:]), dtype=np.uint32)

    def _cut(self, points: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = points == 32
        begin = space & np.r_[True, ~space[:-1]]
        begin[text_start] = True
        at = np.flatnonzero(begin)
        return at, np.r_[at[1:], len(points)]

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.library.encode([p[1:] if p.strip(" ") else "x" + p for p in pieces], num_threads=1)
        before = len(self.library.encode("x"))  # a cut also lies between a letter and the spaces at a text's end
        ids = [x if p.strip(" ") else x[before:] for p, x in zip(pieces, ids)]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        return sizes, np.array([i for x in ids for i in x], dtype=np.uint32)


class Side:
    """Tables of one vocabulary: byte lengths, bytes, a mark for tokens that begin with a space, a code for hashing."""

    def __init__(self, made: PieceTokenizer, salt: int):
        self.encode = made.encode
        self.size = np.array([len(s) for s in made.spelled], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(made.spelled), dtype=np.uint8)
        self.spaced = np.array([s[:1] == b" " for s in made.spelled])
        self.code = np.random.default_rng(salt).integers(1, 1 << 63, len(made.spelled), dtype=np.uint64)


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different rows of equally long arrays in order, and the number of each."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)][: len(order)])
    return (*[k[first] for k in keys], np.diff(np.r_[first, len(order)]))


class Aligner:
    """Both tokenizers and the window alignments of one worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Side(ByteTokens(path_a), 3), Side(SentencePieces(path_b), 5)
        self.width = len(self.b.size)
        # Ids with what follows them inside a group row: more of this side, the other side, the next group.
        n_a = len(self.a.size)
        self.words = [f"{i},".encode() for i in range(n_a)] + [f"{i}|".encode() for i in range(n_a)] + [f"{i},".encode() for i in range(self.width)] + [f"{i};".encode() for i in range(self.width)]
        self.word_size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        """Forgets all alignments."""
        self.entry: dict[int, int] = {}
        self.said: list[bytes] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)  # tokens of A and B, groups, links
        self.ids, self.ids_begin = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.pairs, self.times, self.pairs_begin = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def spelled(self, side: Side, ids: np.ndarray, n: np.ndarray, data: list[bytes]) -> np.ndarray:
        """Which texts the tokens give back."""
        size = side.size[ids]
        upto = np.r_[0, np.cumsum(size)]
        edge = np.r_[0, np.cumsum(n)]
        same = np.diff(upto[edge]) == [len(d) for d in data]
        where, _ = _ranges(side.begin[ids], size)
        letters = side.letters[where]
        if same.all():
            wrong = np.flatnonzero(letters != np.frombuffer(b"".join(data), dtype=np.uint8))
            same[np.searchsorted(upto[edge], wrong, side="right") - 1] = False
            return same
        for i in np.flatnonzero(same).tolist():
            same[i] = letters[upto[edge[i]] : upto[edge[i + 1]]].tobytes() == data[i]
        return same

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B, and their numbers for each text; none for texts that are not given back."""
        said = [" " + t if t else "" for t in texts]
        data = [s.encode() for s in said]
        made = [side.encode(said) for side in (self.a, self.b)]
        good = np.array([bool(s) for s in said], dtype=bool)
        for side, (ids, n) in zip((self.a, self.b), made):
            good &= self.spelled(side, ids, n, data)
        out = []
        for ids, n in made:
            out += [ids if good.all() else ids[np.repeat(good, n)], np.where(good, n, 0)]
        return out[0], out[2], out[1], out[3]

    def windows(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First token of A and of B of each window; a text with tokens begins one."""
        size_a, size_b = self.a.size[a], self.b.size[b]
        at_a, at_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        first_a = self.a.spaced[a]
        first_a[(np.cumsum(n_a) - n_a)[n_a > 0]] = True
        first_b = self.b.spaced[b]
        first_b[(np.cumsum(n_b) - n_b)[n_b > 0]] = True
        mark = np.zeros(int(size_a.sum()) + 1, dtype=bool)
        mark[at_b[first_b]] = True
        start_a = np.flatnonzero(first_a)
        start_a = start_a[mark[at_a[start_a]]]
        mark[:] = False
        mark[at_a[start_a]] = True
        start_b = np.flatnonzero(first_b)
        return start_a, start_b[mark[at_b[start_b]]]

    def hashes(self, side: Side, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each range of ids, by their places in it."""
        size = end - begin
        place = np.arange(len(ids)) - np.repeat(begin, size)
        return np.add.reduceat(mixed(side.code[ids] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin) if len(begin) else np.zeros(0, dtype=np.uint64)

    def align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(groups and links of each window, its group row, ends of its pairs, pairs, times) of windows given by their ids one after another."""
        owner_a, owner_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        mark = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, dtype=bool)
        mark[end_b] = True
        last_a = mark[end_a]
        mark[:] = False
        mark[end_a[last_a]] = True
        last_b = mark[end_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_groups = int(last_a.sum())
        of_group = owner_a[last_a]
        many_a, many_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        links = many_a * many_b
        counts = np.stack([np.bincount(of_group, minlength=len(n_a)), np.bincount(of_group, links, minlength=len(n_a)).astype(np.int64)], axis=1)
        # Rows of groups: in each group the ids of A, then those of B.
        size = len(self.a.size)
        word = np.r_[a + size * last_a, b.astype(np.int64) + 2 * size + self.width * last_b]
        order = np.lexsort((np.r_[np.zeros(len(a), dtype=np.int8), np.ones(len(b), dtype=np.int8)], np.r_[group_a, group_b]))
        word = word[order]
        line = b"".join(map(self.words.__getitem__, word.tolist()))
        cuts = np.r_[0, np.cumsum(np.bincount(np.r_[owner_a, owner_b][order], self.word_size[word], minlength=len(n_a)).astype(np.int64))].tolist()
        rows = [line[i : j - 1] for i, j in zip(cuts, cuts[1:])]
        # A group's different ids and their numbers: all links of two ids at once.
        g_a, i_a, t_a = _distinct(group_a, a.astype(np.int64))
        g_b, i_b, t_b = _distinct(group_b, b.astype(np.int64))
        kinds_b = np.bincount(g_b, minlength=n_groups)
        first_b = np.cumsum(kinds_b) - kinds_b
        left = np.repeat(np.arange(len(g_a)), kinds_b[g_a])
        right, _ = _ranges(first_b[g_a], kinds_b[g_a])
        window, pair, times = of_group[g_a[left]], i_a[left] * self.width + i_b[right], t_a[left] * t_b[right]
        order = np.lexsort((pair, window))
        window, pair, times = window[order], pair[order], times[order]
        first = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]) | (pair[1:] != pair[:-1])][: len(pair)])
        times = np.add.reduceat(times, first) if len(first) else times
        return counts, rows, np.cumsum(np.bincount(window[first], minlength=len(n_a))), pair[first], times

    def _keep(self, key: np.ndarray, ids: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, made: tuple) -> None:
        counts, rows, pairs_upto, pairs, times = made
        n = len(self.said)
        self.entry.update(zip(key.tolist(), range(n, n + len(key))))
        self.said += rows
        self.counts = np.concatenate([self.counts, np.c_[n_a, n_b, counts]])
        self.ids_begin = np.r_[self.ids_begin, self.ids_begin[-1] + np.cumsum(n_a + n_b)]
        self.ids = np.r_[self.ids, ids]
        self.pairs_begin = np.r_[self.pairs_begin, self.pairs_begin[-1] + pairs_upto]
        self.pairs, self.times = np.r_[self.pairs, pairs], np.r_[self.times, times]

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, groups and links of each text, the hash of its group row, ends of its pairs, pairs, times)."""
        if len(self.said) > KEPT:
            self.clear()
        a, b, n_a, n_b = self.tokens(texts)
        start_a, start_b = self.windows(a, b, n_a, n_b)
        end_a, end_b = np.r_[start_a[1:], len(a)][: len(start_a)], np.r_[start_b[1:], len(b)][: len(start_b)]
        size_a, size_b = end_a - start_a, end_b - start_b
        doc = np.searchsorted(np.cumsum(n_a), start_a, side="right")
        key = mixed(self.hashes(self.a, a, start_a, end_a) * np.uint64(3) + self.hashes(self.b, b, start_b, end_b))
        value, first, inverse = np.unique(key, return_index=True, return_inverse=True)

        def ids_of(which: np.ndarray) -> np.ndarray:
            """Ids of A and then of B of the windows, one after another."""
            both = np.stack([start_a[which], start_b[which] + len(a)], axis=1).ravel()
            where, _ = _ranges(both, np.stack([size_a[which], size_b[which]], axis=1).ravel())
            return np.r_[a, b][where]

        def differ(which: np.ndarray, ids: np.ndarray, begin: np.ndarray, n: np.ndarray, n_first: np.ndarray) -> np.ndarray:
            """Those windows whose ids are not the given ones."""
            size = size_a[which] + size_b[which]
            same = (size == n) & (size_a[which] == n_first)
            sure = np.flatnonzero(same)
            own = ids_of(which[sure])
            theirs, upto = _ranges(begin[sure], n[sure])
            same[sure[np.searchsorted(upto, np.flatnonzero(own != ids[theirs]), side="right")]] = False
            return which[~same]

        # Windows of one hash in this slice are compared with the first of them, and that one with what is kept.
        total = size_a + size_b
        every = ids_of(np.arange(len(total)))
        begin = np.cumsum(total) - total
        odd = differ(np.arange(len(total)), every, begin[first[inverse]], total[first[inverse]], size_a[first[inverse]]) if len(total) else np.zeros(0, dtype=np.int64)
        entry = np.array([self.entry.get(k, -1) for k in value.tolist()], dtype=np.int64)
        known = np.flatnonzero(entry >= 0)
        if len(known):
            wrong = differ(first[known], self.ids, self.ids_begin[entry[known]], np.diff(self.ids_begin)[entry[known]], self.counts[entry[known], 0])
            entry[inverse[wrong]] = -2  # another window of this hash is kept
        short = (size_a[first] <= SHORT) & (size_b[first] <= SHORT)
        new = np.flatnonzero((entry == -1) & short)
        if len(new):
            w = first[new]
            ids = ids_of(w)
            entry[new] = len(self.said) + np.arange(len(new))
            self._keep(value[new], ids, size_a[w], size_b[w], self.align(a[_ranges(start_a[w], size_a[w])[0]], b[_ranges(start_b[w], size_b[w])[0]], size_a[w], size_b[w]))
        own = entry[inverse]
        own[odd] = -2
        # Long windows and those that share a hash with another one: aligned for this slice only.
        alone = np.flatnonzero(own < 0)
        extra = self.align(a[_ranges(start_a[alone], size_a[alone])[0]], b[_ranges(start_b[alone], size_b[alone])[0]], size_a[alone], size_b[alone]) if len(alone) else None
        own[alone] = len(self.said) + np.arange(len(alone))
        counts, said, pairs, times, pairs_begin = self.counts[:, 2:], self.said, self.pairs, self.times, self.pairs_begin
        if extra:
            counts, said = np.concatenate([counts, extra[0]]), said + extra[1]
            pairs_begin = np.r_[pairs_begin, pairs_begin[-1] + extra[2]]
            pairs, times = np.r_[pairs, extra[3]], np.r_[times, extra[4]]
        n_docs = len(texts)
        sums = [np.bincount(doc, counts[own, k], minlength=n_docs).astype(np.int64) for k in (0, 1)]
        lines, edge = [said[i] for i in own.tolist()], np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
        hashes = [hashlib.sha256(b";".join(lines[i:j])).hexdigest() if i < j else "" for i, j in zip(edge, edge[1:])]
        d, w, n = _distinct(doc, own)
        many = np.diff(pairs_begin)[w]
        where, _ = _ranges(pairs_begin[w], many)
        d, pair, n = np.repeat(d, many), pairs[where], np.repeat(n, many) * times[where]
        order = np.lexsort((pair, d))
        d, pair, n = d[order], pair[order], n[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (pair[1:] != pair[:-1])][: len(d)])
        n = np.add.reduceat(n, first) if len(first) else n
        return np.stack([n_a, n_b, *sums], axis=1), hashes, np.searchsorted(d[first], np.arange(n_docs + 1)), pair[first], n


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker and pair of files; it serves the worker's next tasks, until one of another kind comes."""
    key = f"{path_a} {path_b}"
    if key not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept.clear()
        kept[key] = Aligner(path_a, path_b)
    return kept[key]


def aligned(docs: DataFrame, path_a: str, path_b: str, pair_type: str = "long") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a document's different pairs (A id times B's vocabulary, plus B id) and the times each is linked; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(path_a, path_b)
        kind = pa.int32() if pair_type == "int" else pa.int64()
        for batch in bounded(batches, limit=SLICE, keep=f"{path_a} {path_b}"):
            numbers, hashes, upto, pairs, times = made.documents(batch.column("text").to_pylist())
            offsets = pa.array(upto.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(pairs).cast(kind)), pa.ListArray.from_arrays(offsets, pa.array(times))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in numbers.T), pa.array(hashes, pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{pair_type}>, times array<long>")


def pair_counts(stage: Stage, rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair linked, and whether no pair of its A id is in more."""
    counts = stage.put("counts", rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.floor(F.col("pair") / width)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return stage.put("judged", counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def align_tokenizers(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document.

    ``hot`` bounds the pairs that are sent to every task.
    """
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    small_batches(spark)
    stage = Stage(spark, "alignment")
    width = SentencePieceProcessor(model_file=path_b).get_piece_size()
    pair_type = "int" if Tokenizer.from_file(path_a).get_vocab_size() * width < 1 << 31 else "long"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage.put("aligned", aligned(docs, path_a, path_b, pair_type))
    counts = pair_counts(stage, rows, width)
    # Classes of frequency from the most frequent one down, as many as the bound allows.
    least, total, there = 64, 0, sorted(((x["class"], x["count"]) for x in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("class")).count().collect()), reverse=True)
    for k, n in there:
        if total + n > hot:
            break
        least, total = k, total + n
    sent = counts.filter(F.floor(F.log2("n")) >= least).toArrow()
    pair, n, best = (sent.column(i).to_numpy() for i in range(3))
    order = np.argsort(pair)
    held = spark.sparkContext.broadcast((pair[order], n[order], best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            own, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            many = np.diff(own.offsets.to_numpy())
            doc, value = np.repeat(np.arange(batch.num_rows), many), own.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, value), max(0, len(pair) - 1))
            hit = pair[at] == value if len(pair) else np.zeros(len(value), dtype=bool)
            at, who, weight = at[hit], doc[hit], times[hit]
            sums = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], who, weight * best[at] if len(pair) else weight)
            np.add.at(sums[1], who, weight * n[at] if len(pair) else weight)
            offsets = pa.array(np.searchsorted(doc[~hit], np.arange(batch.num_rows + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (value, times)]
            same = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*same, *map(pa.array, sums), *rest], names=[*head, "n_best", "count_sum", "pairs", "times"])
        release()

    head = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<{pair_type}>, times array<long>"
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    looked = rows.withColumn("row", F.monotonically_increasing_id()).select("row", *rows.columns).mapInArrow(run, schema)
    if total == sum(n for _, n in there):
        return looked.select(out)
    looked = stage.put("looked", looked)
    cold = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("t"))
    more = cold.join(counts.filter(F.floor(F.log2("n")) < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more_sum"))
    joined = looked.drop("pairs", "times").join(more, "row", "left")
    return joined.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(out)
