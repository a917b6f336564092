import random

import numpy as np

from quillstack.llm import suffix_dedup as S


def brute(rows, k):
    """Words of each document inside k-word windows that another document holds, and those held earlier."""
    seen = {}
    split = {d: (t or "").encode().split() for d, t in rows if d is not None}
    for d, w in split.items():
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i : i + k]), set()).add(d)
    out = {}
    for d, w in split.items():
        for i in range(len(w) - k + 1):
            who = seen[tuple(w[i : i + k])]
            if len(who) > 1:
                out.setdefault((d, min(who) < d), set()).update(range(i, i + k))
    return out


def covered(spans):
    out = {}
    for x in spans:
        out.setdefault((x.doc_id, x.earlier), set()).update(range(x.start_word, x.start_word + x.n_words))
    return out


def corpus(r, n):
    words = [f"w{i}" for i in range(400)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    shared = [make(r.choice([9, 10, 11, 15, 24, 40, 90])) for _ in range(12)]
    rows = []
    for d in range(n):
        w = make(r.randint(0, 60))
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.choice([0, 0, r.randrange(len(s))])
            w += s[a : r.choice([len(s), r.randint(a, len(s))])] + make(r.choice([0, 1, 3, 30]))
        rows.append((d * 3 % (3 * n + 1), "  ".join(w)))
    for d in range(6):
        w = rows[r.randrange(n)][1].split()
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = "edit"
        rows.append((1000 + d, "\n".join(w)))
    return rows + [(2000, "same " * 70), (2001, "x " + "same " * 50), (2002, None), (2003, ""), (None, rows[0][1])]


def test_words_of_repeated_passages_equal_all_windows(spark):
    r = random.Random(4)
    for seed in range(3):
        rows = corpus(r, 60)
        df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, pos string").repartition(3)
        spans = S.repeated_passages(spark, df, min_words=10).collect()
        assert covered(spans) == brute(rows, 10)
        first = {(x.doc_id, x.earlier): x for x in spans}
        assert all(x.first_doc_id < x.last_doc_id and (x.first_doc_id < x.doc_id) == x.earlier for x in first.values())


def test_default_length(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(6))
    passage = [word() for _ in range(51)]
    rows = [(i, " ".join([word() for _ in range(80)] + passage[: 51 - (i == 3) * 2] + [word() for _ in range(80)])) for i in range(5)]
    spans = S.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.start_word, x.n_words, x.first_doc_id, x.last_doc_id, x.earlier) for x in spans) == [(i, 80, 51, 0, 4, i > 0) for i in (0, 1, 2, 4)]


def test_every_window_keeps_a_suffix():
    r = np.random.default_rng(1)
    for n in (0, 3, 24, 25, 50, 51, 400):
        words = r.integers(0, 50, n, dtype=np.uint64)
        pos = S.kept_positions(words, np.array([0, n]), 25)
        for s in range(n - 49):
            assert ((pos >= s) & (pos + 25 <= s + 50)).any()
    long = ("word " * 300000).encode()
    assert len(S.word_hashes(long)[0]) == 300000 and len(set(S.word_hashes(long)[0].tolist())) == 1


def test_long_periodic_words_differ():
    word = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes, _ = S.word_hashes(f"{word} {other} {word} short".encode())
    assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == 3


def test_removal_keeps_first_occurrences(spark):
    base = " ".join(f"a{i}" for i in range(60))
    rows = [(1, f"{base} own1", 0, "k"), (2, f"é own2  {base}\nend", 7, "k"), (3, base, 5, "k"), (None, base, 1, "k"), (4, None, 0, "k"), (5, "clean text", 10, "k")]
    got = S.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string")).collect()
    assert sorted(((x.doc_id or -1, x.text, x.n_chars) for x in got), key=str) == sorted([(1, f"{base} own1", 0), (2, "é own2  end", 11), (-1, base, 1), (4, None, 0), (5, "clean text", 10)], key=str)
    assert S.repeated_passages(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
