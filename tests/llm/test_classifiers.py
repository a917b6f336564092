import zlib

import numpy as np
import pytest

from quillstack.llm import langid, ngrams, toxicity
from quillstack.staging import read_table

SF = "/root/testdata/sf0.01"
CASES = "doc_id long, text string, lang string, held_out string, score string"


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 3 == 1


def test_ngrams_of_a_batch_equal_those_of_single_texts():
    said = ["Ab c", "", "é", "the cat " * 9]
    points, at = ngrams.points_of(said)
    got = [[] for _ in said]
    for h, first, last in ngrams.hashed(points, at, (1, 2, 3), 16):
        for i in range(len(said)):
            got[i] += h[first[i] : last[i]].tolist()
    assert [sorted(x) for x in got] == [sorted(ngrams.buckets(t, (1, 2, 3), 16).tolist()) for t in said]


def test_languages_of_held_out_documents(spark):
    docs = read_table(spark, SF, "documents")
    rows = langid.identify(spark, docs, per_class=150).collect()
    truth = {x.doc_id: x.lang for x in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(x.held_out == held(x.doc_id) and 0 <= x.score <= 1 for x in rows)
    out = [x for x in rows if x.held_out]
    right = np.array([x.lang_pred == truth[x.doc_id] for x in out])
    assert right.mean() > 0.96
    assert abs(np.mean([x.score for x in out]) - right.mean()) < 0.06


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs = read_table(spark, SF, "documents").limit(300)
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'zz' ELSE lang END AS lang")
    same = [sorted(map(tuple, langid.identify(spark, x, per_class=40).collect())) for x in (docs, other)]
    assert same[0] == same[1]


def test_language_cases(spark):
    rows = [(1, None, "en", "", ""), (2, "", "en", "", ""), (3, "123 ²½ _!?", None, "", ""), (None, "the cat", "en", "", ""), (5, "le chat est la", "fr", "", ""), (5, "le chat est la", "fr", "", ""), (6, "the dog", "en", "", ""), (7, "x" * 300000, None, "", "")]
    df = spark.createDataFrame(rows, CASES).repartition(2)
    got = langid.identify(spark, df).collect()
    assert len(got) == len(rows)
    assert sorted(x.lang_pred for x in got if x.doc_id in (1, 2, 3)) == ["und"] * 3
    assert langid.identify(spark, df.limit(0)).collect() == []
    assert {x.lang_pred for x in langid.identify(spark, df.withColumn("lang", df.lang.substr(9, 1)).filter("lang is null")).collect()} == {"und"}


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.1", "documents"), read_table(spark, "/root/testdata/sf0.1", "labels")
    return toxicity.score(spark, docs, labels).collect(), {x.doc_id: x.toxic for x in labels.collect()}


def test_toxicity_of_held_out_documents(toxic):
    rows, truth = toxic
    assert len(rows) == 10000 and all(x.held_out == held(x.doc_id) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in rows)
    out = [x for x in rows if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted for x in out if truth[x.doc_id] == 1]) > 0.9
    assert np.mean([x.predicted for x in out if truth[x.doc_id] == 0]) < 0.01


def test_filter_and_scores_agree(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0)], docs.schema))
    scored = {(x.doc_id, x.predicted) for x in toxicity.score(spark, odd, labels).collect()}
    kept = toxicity.keep_clean(spark, odd, labels)
    assert kept.columns == docs.columns
    assert {(x.doc_id, 0) for x in kept.collect()} == {x for x in scored if not x[1]}


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, None, "x", "", ""), (2, "you idiot " * 5, "x", "", ""), (2, "you idiot " * 5, "x", "", ""), (None, "nice day", "x", "", "")], CASES)
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(spark, docs, labels).collect()
    assert len(got) == 4 and {x.score for x in got} == {0.0}
    assert toxicity.score(spark, docs.limit(0), labels).collect() == []
    assert sorted(x.text or "" for x in toxicity.keep_clean(spark, docs, labels).collect()) == ["", "nice day", "you idiot " * 5, "you idiot " * 5]


def slow_buckets(text, sizes, bits):
    """Each n-gram hashed on its own with Python's integers."""
    said, out = [ord(c) for c in f" {text.lower()} "], []
    for n in sizes:
        for i in range(len(said) - n + 1):
            value = said[i]
            for c in said[i + 1 : i + n]:
                value = (value * 0x01000193 + c) % 2**32
            out.append((((value ^ value >> 15 ^ n * 0x51ED27) * 0x9E3779B1) % 2**32) >> (32 - bits))
    return out


@pytest.mark.parametrize("text", ["", "a", "The café ÄÖ 日本 x", "ab " * 50])
def test_ngrams_follow_their_definition(text):
    for sizes, bits in ((langid.SIZES, langid.BITS), (toxicity.SIZES, toxicity.BITS)):
        assert sorted(ngrams.buckets(text, sizes, bits).tolist()) == sorted(slow_buckets(text, sizes, bits))


def test_ftrl_and_scores_follow_their_definition():
    rows = [("the cat sat", "en"), ("le chat est", "fr"), ("a dog and a cat", "en"), ("un chien et", "fr"), ("the dog", "en"), ("la la le", "fr")]
    idf = np.linspace(1, 2, 1 << langid.BITS)
    made = langid.fit(rows, idf, epochs=2)
    alpha, beta, l1, l2, names = 0.3, 1.0, 0.02, 0.05, ["en", "fr"]
    z, n = ({c: {} for c in names} for _ in range(2))

    def weight(c, k):
        zz, nn = z[c].get(k, 0.0), n[c].get(k, 0.0)
        return 0.0 if abs(zz) <= l1 else -(zz - np.sign(zz) * l1) / ((beta + nn**0.5) / alpha + l2)

    def share(logit):
        e = {c: np.exp(v - max(logit.values())) for c, v in logit.items()}
        return {c: v / sum(e.values()) for c, v in e.items()}

    def values(text):
        own = slow_buckets(text, langid.SIZES, langid.BITS)
        return {k: langid.SCALE * own.count(k) / len(own) * idf[k] for k in set(own)}

    learned = [r for i, r in enumerate(rows) if i % 5 != 4]
    order = np.random.default_rng(0)
    for _ in range(2):
        for i in order.permutation(len(learned)):
            x, lang = {**values(learned[i][0]), "bias": 1.0}, learned[i][1]
            w = {c: {k: weight(c, k) for k in x} for c in names}
            p = share({c: sum(w[c][k] * v for k, v in x.items()) for c in names})
            for c in names:
                for k, v in x.items():
                    g = (p[c] - (c == lang)) * v
                    old = n[c].get(k, 0.0)
                    z[c][k] = z[c].get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[c][k]
                    n[c][k] = old + g * g
    for text in ("the cat", "le chien", "zz"):
        want = share({c: (sum(weight(c, k) * v for k, v in values(text).items()) + weight(c, "bias")) / made.temperature for c in names})
        assert made.scores([text])[0] == pytest.approx([want[c] for c in names], rel=1e-4)


def test_log_count_ratios_and_scores_follow_their_definition():
    rows = [(f"you are bad bad {i} idiot", 1) for i in range(30)] + [(f"what a nice day {i} friend", 0) for i in range(40)]
    made = toxicity.fit(rows, features=500, deviations=3.0, steps=0)
    held = [({(k, b) for b in set(own) for k, level in enumerate(toxicity.LEVELS) if own.count(b) >= level}, y) for t, y in rows for own in [slow_buckets(t, toxicity.SIZES, toxicity.BITS)]]
    share = lambda f, y: (sum(f in own for own, z in held if z == y) + 1) / (sum(z == y for _, z in held) + 2)
    every = {f for own, _ in held for f in own}
    spread = {f: sum(share(f, y) * (1 - share(f, y)) / (30 if y else 40) for y in (0, 1)) ** 0.5 for f in every}
    strong = {f for f in every if abs(share(f, 1) - share(f, 0)) > 3 * spread[f]}
    chosen = {(int(c) >> toxicity.BITS, int(c) & ((1 << toxicity.BITS) - 1)) for c in made.chosen}
    assert len(chosen) == min(500, len(strong)) and chosen <= strong
    made = toxicity.fit(rows, steps=20)
    w = {(int(c) >> toxicity.BITS, int(c) & ((1 << toxicity.BITS) - 1)): float(x) for c, x in zip(made.chosen, made.weight)}
    for text in ("bad idiot you are bad bad bad", "nice friend", ""):
        own = slow_buckets(text, toxicity.SIZES, toxicity.BITS)
        logit = made.bias + sum(w.get((k, b), 0.0) for b in set(own) for k, level in enumerate(toxicity.LEVELS) if own.count(b) >= level)
        assert made.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-4)


def test_one_step_of_the_toxicity_fit():
    """A step of the balanced regression on features scaled by their ratios, from zero weights."""
    rows = [(f"bad word {i} bad", 1) for i in range(12)] + [(f"good text {i} fine", 0) for i in range(24)]
    made = toxicity.fit(rows, steps=1)
    label = np.array([y for _, y in rows])
    n = label.sum(), len(label) - label.sum()
    held = [slow_buckets(t, toxicity.SIZES, toxicity.BITS) for t, _ in rows]
    for c, w in list(zip(made.chosen.tolist(), made.weight.tolist()))[:40]:
        k, b = c >> toxicity.BITS, c & ((1 << toxicity.BITS) - 1)
        x = np.array([own.count(b) >= toxicity.LEVELS[k] for own in held], dtype=float)
        ratio = np.log(((x[label == 1].sum() + 1) / (n[0] + 2)) / ((x[label == 0].sum() + 1) / (n[1] + 2)))
        error = (0.5 - label) * np.where(label == 1, len(label) / (2 * n[0]), len(label) / (2 * n[1])) / len(label)
        g = (x * ratio * error).sum()
        assert w == pytest.approx(-0.1 * g / np.sqrt(1e-8 + g * g) * ratio, rel=1e-3)


def test_fit_samples_are_bounded_in_bytes(spark):
    from quillstack.llm.batches import within_bytes
    from quillstack.staging import Stage

    rows = spark.createDataFrame([(i, "x" * (500 if i == 3 else 10), i % 2) for i in range(200)] + [(None, None, 1)], "doc_id long, text string, label int").repartition(4)
    kept = within_bytes(Stage(spark, "t"), rows, 1000).collect()
    assert 95 <= len(kept) <= 101 and sum(len(x.text or "") for x in kept) <= 1000 and 3 not in {x.doc_id for x in kept}
    assert sorted(map(str, kept)) == sorted(map(str, within_bytes(Stage(spark, "t"), rows.repartition(2), 1000).collect()))
    assert within_bytes(Stage(spark, "t"), rows.limit(0), 1000).collect() == []


def test_very_long_texts_are_scored(spark):
    docs = spark.createDataFrame([(1, "kind words and " * 100_000, "en"), (2, "kind words and more", "en"), (3, "other mots et choses", "fr")] + [(i, f"ok {i}", "en") for i in range(4, 30)], "doc_id long, text string, lang string")
    assert len(langid.identify(spark, docs).collect()) == 29
    labels = spark.createDataFrame([(i, int(i == 2)) for i in range(1, 30)], "doc_id long, toxic int")
    assert len(toxicity.score(spark, docs, labels).collect()) == 29


def test_languages_of_texts_in_blocks(monkeypatch):
    """Blocks of any size give the same sums, also where they end within texts or n-grams."""
    r = np.random.default_rng(2)
    model = langid.Model(["a", "b"], r.normal(size=(2, 1 << langid.BITS)).astype(np.float32), np.array([0.1, -0.2]), 1.3)
    batch = ["", "x", "ab", "the quick brown fox", "Été à la plage " * 7, "日本語のテキスト", "z" * 100]
    whole = model.logits(batch)
    for block in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert np.allclose(model.logits(batch), whole, rtol=1e-9, atol=1e-9)


def test_memory_of_a_very_long_text_is_bounded():
    import tracemalloc

    model = langid.Model(["a", "b"], np.zeros((2, 1 << langid.BITS), dtype=np.float32), np.zeros(2), 1.0)
    text = "some words of a text " * 200_000
    tracemalloc.start()
    model.logits([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text) + 40e6  # the text as code points, twice for a moment, and one block


def test_an_id_of_many_texts_is_learned_from_once(spark, monkeypatch):
    """Nine ids, one of which has two thousand texts: the fit sees nine rows."""
    seen, real = [], toxicity.within_bytes
    monkeypatch.setattr(toxicity, "within_bytes", lambda stage, rows, limit: seen.append(rows.count()) or real(stage, rows, limit))
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:9]
    rows = [(i, f"text {i} " + ("awful " * 9 if k % 2 else "fine " * 9)) for k, i in enumerate(ids)] + [(ids[0], f"another {k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    assert toxicity.score(spark, docs, labels).count() == len(rows) and seen == [9]
