import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillstack.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    docs = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    lengths = [sum(c.values()) for _, c in docs]
    total, n_docs = sum(lengths), sum(n > 0 for n in lengths)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, c in asked.items():
        found = []
        for (d, tf), n in zip(docs, lengths):
            m = 75 + 25 * n * n_docs // total if total else 0
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, times in c.items() if t in tf)
            if score > 0:
                found.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def shown(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, frame.collect()))


def corpus(n=700):
    r = random.Random(2)
    words = ["cat", "Dog", "mat", "été", "ÉTÉ", "x1", "日本", "cat-dog", "a_b", "don't", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(0, 60)))) for i in range(n)]
    docs += [(1000 + i, "same words of a large group of copies cat") for i in range(300)]
    docs += [(None, "cat cat"), (7, "cat"), (7, "cat"), (5000, None), (5001, ""), (5002, "!?"), (5003, "cat mat " * 30000)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(0, 12)))) for i in range(40)] + [(1, "cat cat CAT"), (50, None), (51, "nothing-of-that-kind zzz"), (None, "cat"), (52, "copies of words"), (52, "copies of words"), (53, "w1 " * 500)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"entries": 40, "width": 3}, {"k": 3}])
def test_equals_brute_force(options, spark):
    docs, items = corpus()
    d = spark.createDataFrame([(t, i, 0, "x") for i, t in docs], "text string, doc_id long, n int, term string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, score int")
    assert shown(lexical.search(spark, d, q, **options)) == brute(docs, items, options.get("k", 20))


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    docs, items = corpus(200)
    docs = [x for x in dict(docs).items() if x[0] is not None]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in docs])
    con.execute("CREATE TABLE benchmark (item_id INT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [list(x) for x in items])
    assert sorted(con.sql(lexical.oracle_sql()).fetchall()) == brute(docs, items)


@pytest.mark.parametrize("missing", ["docs", "items", "both", "words"])
def test_empty_tables(missing, spark):
    docs = [] if missing in ("docs", "both") else [(1, None if missing == "words" else "a b")]
    items = [] if missing in ("items", "both") else [(1, "a")]
    got = lexical.search(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert shown(got) == brute(docs, items)


def test_partial_sums_stay_exact():
    """Weights near and beyond the bound of one product: tiles end in time, and a weight is cut into parts."""
    r = np.random.default_rng(4)
    most = (lexical.EXACT - 1) // lexical.IMPACT
    item, term = np.repeat(np.arange(3), 40), np.tile(np.arange(40), 3)
    weight = r.integers(1, most // 3, 120)
    weight[5], weight[60] = 3 * most + 7, most
    tiles = lexical.vocabulary_tiles(item, term, weight, 16)
    assert all(t.end - t.first <= 16 and (np.bincount(t.item, t.weight) * lexical.IMPACT < lexical.EXACT).all() for t in tiles)
    row, own = np.nonzero(r.random((9, 40)) < 0.7)
    impact = r.integers(1, lexical.IMPACT, len(row))
    order = np.argsort(own, kind="stable")
    score = lexical.tile_scores(tiles, 3, row[order], own[order], impact[order], 9)
    for i in range(3):
        for d in range(9):
            assert int(score[i, d]) == sum(int(weight[40 * i + t]) * int(x) for t, x in zip(own[row == d].tolist(), impact[row == d].tolist()))


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    hashes = lexical.word_hashes
    monkeypatch.setattr(lexical, "word_hashes", lambda data: (hashes(data)[0] & np.uint64(1), hashes(data)[1]))
    known, place = lexical.Vocabulary.of(["cat", "cats", "dog", "mat", "do"])
    starts, which, found = known.find(b"dog cat  cats ma mat dogs do")
    back = np.argsort(place)
    assert sorted((int(w), ["cat", "cats", "dog", "mat", "do"][back[f]]) for w, f in zip(which, found)) == [(0, "dog"), (1, "cat"), (2, "cats"), (4, "mat"), (6, "do")]
