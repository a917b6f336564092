import random

from quillstack.llm import simhash, similar
from quillstack.staging import Stage


def sets(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similarity(a, b):
    x, y = sets(a), sets(b)
    return len(x & y) / max(1, len(x | y))


def corpus(r):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for size in [6, 9, 15, 30, 60, 78, 85, 150, 400, 900] * 3:
        base = [word() for _ in range(size)] + (passage if size > 100 else [])
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = word()
            text = r.choice([" ", "\n", "  "]).join(w)
            rows.append((len(rows), text.upper() if r.random() < 0.2 else text))
    return rows


def test_links_are_exact_and_copies_are_found(spark):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(None, rows[0][1], "x"), (9000, None, "x"), (9001, "", "x")], "doc_id long, text string, b string").repartition(3)
    got = {(x.a, x.b) for x in similar.similar_pairs(Stage(spark, "t"), df).collect()}
    text = dict(rows)
    assert got and all(similarity(text[a], text[b]) >= 0.8 and b < a for a, b in got)
    real = [(a, b) for a in text for b in text if b < a and similarity(text[a], text[b]) >= 0.8]

    def roots(pairs):
        label = {d: d for d in text}

        def root(d):
            while label[d] != d:
                d = label[d]
            return d

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            label[y] = x
        return {d: root(d) for d in text}

    want, have = roots(real), roots(got)
    assert sum(want[d] == have[d] for d in text) >= 0.98 * len(text)
    kept = {x.doc_id for x in simhash.keep_one(spark, df).collect()}
    close = [(a, b) for a in text for b in text if b < a and (simhash.fingerprint(text[a]) ^ simhash.fingerprint(text[b])).bit_count() <= 3]
    full = roots(list(got) + close)
    assert kept - {None, 9000, 9001} == set(full.values()) and {None, 9000} <= kept and 9001 not in kept


def test_candidates_are_complete(spark):
    """Containers, truncated copies and passages of many documents: the groups of all pairs, against brute force."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts, passage = [], [word() for _ in range(60)]
    for size in (78, 300, 900):
        base = [word() for _ in range(size)]
        half = base[: size // 2 + 1]
        texts += [base, half, [*half[:-1], word()], base[: size * 9 // 10], base[: size * 3 // 4]]
    for _ in range(300):
        texts.append(passage + [word() for _ in range(r.randint(14, 40))])
    for k in range(40):  # all near 0.8 of one another, on both sides
        w = passage * 1 + [word() for _ in range(4 + k % 6)]
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(len(rows), rows[1][1]), (3, rows[320][1])]  # a copy, and an id of two texts
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x.a, x.b) for x in similar.similar_pairs(Stage(spark, "t"), df).collect()}
    own = [(d, sets(t)) for d, t in rows]
    real = {(max(a, b), min(a, b)) for a, x in own for b, y in own if a != b and len(x & y) >= 0.8 * len(x | y)}

    def groups(pairs):
        label = {d: d for d, _ in rows}
        for _ in label:
            before = dict(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    assert got <= real and (2, 1) in got and groups(got) == groups(real)


def test_a_long_document_that_quotes_many_is_compared_with_none(spark, monkeypatch):
    """The smallest id holds 200 passages that are documents of their own; two of those have a near copy."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passages = [[word() for _ in range(60)] for _ in range(200)]
    rows = [(0, " ".join(w for p in passages for w in p))] + [(i + 1, " ".join(p)) for i, p in enumerate(passages)]
    rows += [(500, rows[7][1] + " end"), (501, rows[9][1].upper())]
    tried, compared = [], similar.compared
    monkeypatch.setattr(similar, "compared", lambda stage, pairs, *rest: tried.extend((x.a, x.b) for x in pairs.collect()) or compared(stage, pairs, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(x.a, x.b) for x in similar.similar_pairs(Stage(spark, "t"), df).collect()} == {(500, 7), (501, 9)}
    assert set(tried) == {(500, 7)}


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 50021}" for i in range(400_000))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short")], "doc_id long, text string")
    assert {(x.a, x.b) for x in similar.similar_pairs(Stage(spark, "t"), df).collect()} == {(2, 1)}


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar.similar_pairs(Stage(spark, "t"), empty).collect() == [] and simhash.keep_one(spark, empty).collect() == []
