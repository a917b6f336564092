import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quillstack.llm import packing, token_files, tokens
from quillstack.staging import Stage, read_table

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ROWS = [(5, "the cat's hat", "x"), (1, None, "x"), (9, "", "x"), (None, "no id", "x"), (3, "wörd " * 5000, "x"), (3, "again", "x"), (3, "again", "x"), (7, "日本語 <|endoftext|> it'll", "x")]


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_ids_equal_the_librarys(file, spark):
    path, r = public_tokenizers.path(file), random.Random(3)
    made = tokens.PieceTokenizer(path)
    odd = ["".join(r.choice("aZé ß09²½ \n\n\t \x85\xa0\x1c\x1f!?-_«ªµ§ǅİȺɐ''stmdrevlABSL  ") for _ in range(r.randrange(25))) for _ in range(6000)]
    odd += ["it's we'll 'tis I'd", "rock 'n' roll", "' s", "''s", "a'S", "x'l", "x're", "<|endoftext|> a", "日本語", "", " \n a", "a\n\n b"]
    odd += [x.text for x in read_table(spark, "/root/testdata/sf0.001", "documents").collect()]
    for _ in range(2):
        ids, n = made.encode(odd)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [made.library.encode(x, add_special_tokens=False).ids for x in odd]


def periodic(n, letters="ab"):
    """A Thue-Morse word and its complement: sums of powers modulo 2**64 cannot tell them apart."""
    word = "".join(letters[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_of_equal_hash_keep_their_own_ids(file, n):
    made = tokens.PieceTokenizer(public_tokenizers.path(file))
    a, b = periodic(n)
    for texts in ([a, b], [b, a, f"x {a} {b} y"], [a]):
        ids, sizes = made.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [made.library.encode(x, add_special_tokens=False).ids for x in texts]


def test_entries_are_compared_by_letters(monkeypatch):
    """With a hash of few values nearly all pieces collide, of equal and of other lengths."""
    made = tokens.PieceTokenizer(public_tokenizers.path(FILES[0]))
    find, add = made._find, made._add
    monkeypatch.setattr(made, "_find", lambda key: find(key & np.uint64(3 << 13)))
    monkeypatch.setattr(made, "_add", lambda key, points, at, end: [add(*x) for k in np.unique(key & np.uint64(3 << 13)) for i in [np.flatnonzero(key & np.uint64(3 << 13) == k)[:1]] for x in [(k[None], points, at[i], end[i])]])
    texts = ["the cat sat on the mat", "on the cat", "", "a matter of cats and rats"]
    ids, sizes = made.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [made.library.encode(x, add_special_tokens=False).ids for x in texts]


def test_table_that_begins_anew(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 64)
    made = tokens.PieceTokenizer(public_tokenizers.path(FILES[0]))
    for k in range(30):
        texts = [f"word{chr(97 + k % 26)}{chr(97 + j)} common" for j in range(20)]
        ids, n = made.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [made.library.encode(x, add_special_tokens=False).ids for x in texts]


def best_fit(sizes, capacity):
    """Free tokens of all sequences after best-fit decreasing, one document at a time."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return gaps


def filled(counts, runs, capacity):
    """Sequences that the runs fill, all of them whole and without holes."""
    placed, runs = {}, sorted(runs)
    for s, n in counts.items():
        for rank in range(n):
            _, lo, each, first, offset = max(x for x in runs if x[0] == s and x[1] <= rank)
            placed.setdefault(first + (rank - lo) // each, []).append((offset + (rank - lo) % each * s, s))
    for rows in placed.values():
        at = 0
        for offset, s in sorted(rows):
            assert offset == at
            at += s
        assert at <= capacity
    return placed


def test_sweep_is_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice([7, 20, 64])
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
        counts = {s: sizes.count(s) for s in sizes}
        runs, left, _, fresh = packing.sweep([(s, 0, n) for s, n in counts.items()], [], capacity, 0)
        assert not left and len(filled(counts, runs, capacity)) == len(best_fit(sizes, capacity)) == fresh


@pytest.mark.parametrize("kind", ["any", "short", "middle", "tiny", "one length", "none"])
def test_rounds_need_as_few_sequences_as_best_fit(spark, kind):
    r = random.Random(6)
    make = {"any": lambda: r.randint(1, 256), "short": lambda: r.randint(1, 60), "middle": lambda: r.randint(60, 100), "tiny": lambda: r.randint(1, 9), "one length": lambda: 100, "none": lambda: 1}[kind]
    sizes = [make() for _ in range(0 if kind == "none" else 2500)]
    counts = {s: sizes.count(s) for s in sizes}
    table = spark.createDataFrame([(s, n) for s, n in counts.items()], "size int, n long")
    runs = [tuple(x) for x in packing.rounds(Stage(spark, "t"), table, 256).collect()]
    placed = filled(counts, runs, 256)
    assert sum(map(len, placed.values())) == len(sizes)
    assert len(placed) <= len(best_fit(sizes, 256)) * 1.005 + 1 and sorted(placed) == list(range(len(placed)))


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack(spark, capacity):
    path = public_tokenizers.path(FILES[0])
    df = spark.createDataFrame(ROWS, "doc_id long, text string, length string").repartition(3)
    got = packing.pack(spark, df, path, capacity=capacity).collect()
    want = []
    for d, t, _ in ROWS:
        ids = np.array([*ids_of(path, t), 0], dtype="<u4")
        want += [(d, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted((tuple(x[:5]) for x in got), key=key) == sorted(want, key=key)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for rows in by.values():
        rows.sort()
        assert [o for o, _ in rows] == np.cumsum([0] + [n for _, n in rows[:-1]]).tolist() and sum(n for _, n in rows) <= capacity
    assert packing.pack(spark, df.limit(0), path).collect() == []


def test_lookup_reads_few_blocks(spark):
    path = public_tokenizers.path(FILES[1])
    df = spark.createDataFrame([(i * 3, f"document number {i} " * (i % 5), "x") for i in range(200)] + [(None, "no id", "x")], "doc_id long, text string, ids string")
    stage = Stage(spark, "t")
    rows = stage.put("ids", token_files.tokenised(df, path, 2))
    written = stage.put("blocks", token_files.blocks(rows, path, 2, block_ids=64))
    assert written.count() > 20
    got = {x.doc_id: x.ids for x in token_files.lookup(written, [0, 300, 301, 597, 9999]).collect()}
    assert got == {d: [*ids_of(path, f"document number {d // 3} " * (d // 3 % 5)), 2] for d in (0, 300, 597)}
    assert token_files.lookup(written, []).collect() == []


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 64)
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 999, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-999 * bits // 8)
    for a, b in ((0, 999), (0, 0), (7, 8), (500, 777)):
        assert (token_files.unpack_bits(data, bits, a, b) == ids[a:b]).all()


def test_blocks_give_random_access():
    counts = np.array([3, 0, 5])
    block = token_files.Block(token_files.make_block([4, None, 6], counts, np.arange(8, dtype=np.uint32), 5))
    assert block.document(0).tolist() == [0, 1, 2] and block.document(1).tolist() == [] and block.document(2).tolist() == [3, 4, 5, 6, 7]


def test_write_and_read(spark):
    path = public_tokenizers.path(FILES[1])
    df = spark.createDataFrame(ROWS, "doc_id long, text string, start string").repartition(3)
    got = sorted(map(tuple, token_files.write_and_read(spark, df, path).collect()), key=lambda x: x[1])
    want, at = [], 0
    tie = lambda t: np.uint64(xxhash.xxh64_intdigest(np.array([*ids_of(path, t), 2], dtype="<u2").tobytes())).astype(np.int64)
    for d, t, _ in sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1]))):
        ids = np.array([*ids_of(path, t), 2], dtype="<u4")
        want.append((d, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert got == want
    assert token_files.write_and_read(spark, df.limit(0), path).collect() == []
