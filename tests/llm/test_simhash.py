import random

import numpy as np

from quillstack.llm import simhash as S

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("print", T.StringType())])


def brute(rows):
    """Components of fingerprints by comparing all pairs."""
    prints = [S.fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted((d, f"{prints[i]:016x}", min(groups[root(i)])) for i, (d, _) in enumerate(rows))


def slow_print(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprint_follows_its_definition():
    for text in ["", "  \n", "One", "one TWO", "a b c", "É x\x0by\x1fz q w e r", "the cat sat on the mat " * 40]:
        assert S.fingerprint(text) == slow_print(text)


def test_components_match_all_pairs(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        base = [r.choice(words) for _ in range(r.choice([4, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "x")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, S.near_duplicates(spark, df).collect()))
    assert got == brute(rows)
    kept = {x.doc_id for x in S.keep_one(spark, df).collect()}
    assert kept <= {c for _, _, c in got}


def test_links_meet_at_an_anchor_and_hot_anchors_are_split(spark, monkeypatch):
    r = random.Random(2)
    values = set()
    for _ in range(60):
        v = r.getrandbits(64)
        values.add(v)
        for _ in range(8):
            u = v
            for b in r.sample(range(64), r.randint(1, 4)):
                u ^= 1 << b
            values.add(u)
    values |= {0, *(1 << i for i in range(64))}
    values = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), i) for i, v in enumerate(values)], "print long, node long")
    expected = {(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3}

    def joined(pairs):
        a, b = S.forest(*map(np.array, zip(*pairs)))
        return dict(zip(a.tolist(), b.tolist()))

    from quillstack.staging import Stage

    for homes, visitors in ((4096, 16384), (2, 5)):
        monkeypatch.setattr(S, "HOMES", homes)
        monkeypatch.setattr(S, "VISITORS", visitors)
        got = S.links(Stage(spark, "test"), nodes).collect()
        assert joined([(x.a, x.b) for x in got]) == joined(list(expected))


def test_empty_table_and_null_ids(spark):
    assert S.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    rows = S.near_duplicates(spark, spark.createDataFrame([(None, "a b c d", ""), (4, "a b c d", ""), (None, "other words here now", "")], SCHEMA)).collect()
    assert sorted((x.doc_id is None, x.component_id or -1) for x in rows) == [(False, 4), (True, -1), (True, 4)]


def test_shingles_of_a_long_text_are_hashed_in_parts(monkeypatch):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(900)}" for _ in range(n)) for n in (0, 1, 2, 3, 4, 6, 7, 8, 9, 400)]
    whole = [S.fingerprint(t) for t in texts]
    assert whole == [slow_print(t) for t in texts]
    for chunk in (1, 2, 3, 7):
        monkeypatch.setattr(S, "CHUNK", chunk)
        assert [S.fingerprint(t) for t in texts] == whole


def test_memory_of_a_very_long_text_follows_its_words():
    import tracemalloc

    text = "word and more " * 300_000
    tracemalloc.start()
    S.fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * len(text) / 5 + 30e6  # a word object and its place for every word, and one chunk
