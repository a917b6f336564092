import hashlib

import numpy as np
import pytest

from quillstack.llm import mixing as M
from quillstack.staging import read_table


def filled(share, bound, total):
    """Targets in proportion to shares, none above its bound, by bisection."""
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.minimum(share * mid, bound).sum() < total else (lo, mid)
    return np.minimum(share * lo, bound)


def numpy_rake(tokens, targets, rounds, keep, tolerance=1e-3):
    w, bound = tokens.copy(), tokens / keep
    for _ in range(rounds):
        before = w
        for axis, t in enumerate(targets):
            for v in range(len(t)):
                at = tuple(v if a == axis else slice(None) for a in range(3))
                own, held = w[at], w[at] >= bound[at] * M.NEAR
                now, free = own.sum(), own[~held].sum()
                if now > 0 and t[v] < now:
                    new = own * t[v] / now
                elif free > 0:
                    new = np.where(held, own, np.minimum(bound[at], own * (t[v] - own[held].sum()) / free))
                else:
                    new = own
                w = w.copy()
                w[at] = new
        if np.abs(w - before).sum() <= tolerance * tokens.sum():
            break
    return w


def test_probabilities_match_a_dense_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = M.calibrate(spark, docs).collect()
    assert len(rows) == docs.count()
    axes = [sorted({x[d] for x in rows}) for d in M.DIMENSIONS]
    tokens = np.zeros([len(a) for a in axes])
    at = lambda x: tuple(a.index(x[d]) for a, d in zip(axes, M.DIMENSIONS))
    for x in rows:
        tokens[at(x)] += x.tokens
    targets = []
    for a in range(3):
        m = tokens.sum(axis=tuple(b for b in range(3) if b != a))
        targets.append(filled(m**0.7, m / 0.5, tokens.sum()))
    w = numpy_rake(tokens, targets, 15, 0.5)
    for x in rows:
        assert x.probability == pytest.approx(0.5 * w[at(x)] / tokens[at(x)] if tokens[at(x)] else 0.5, abs=2e-6) and x.probability <= 1
        assert x.sampled == (int(hashlib.md5(str(x.doc_id).encode()).hexdigest()[:8], 16) / 2**32 < x.probability)
    for x in M.marginals(spark, docs).collect():
        a = M.DIMENSIONS.index(x.dimension)
        v = axes[a].index(x.value)
        assert x.target == pytest.approx(targets[a][v], rel=1e-6) and x.target <= x.tokens / 0.5 * (1 + 1e-9)
        assert x.reached == pytest.approx(w.sum(axis=tuple(b for b in range(3) if b != a))[v], rel=1e-6)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_tempered_targets_are_met(spark, table):
    rows = M.marginals(spark, read_table(spark, f"/root/testdata/{table}", "documents"), rounds=60, tolerance=1e-5).collect()
    assert sum(x.target for x in rows) == pytest.approx(3 * sum(x.tokens for x in rows) / 3, rel=1e-6)
    off = {(x.dimension, x.value): abs(x.reached - x.target) / x.target for x in rows if x.target}
    assert max(off.values()) < 0.01, sorted(off.items(), key=lambda x: -x[1])[:5]


def test_one_cell_bounds_do_not_spoil_the_rest(spark):
    """A rare language cannot reach its target; it is kept whole and the other targets are met."""
    rows = [(i, "w " * 50, "rare" if i < 5 else ("en", "fr")[i % 2], f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("lang", "rare", 1.0), ("lang", "en", 1.0), ("lang", "fr", 1.0), ("source", "s0", 1.0), ("source", "s1", 1.0), ("source", "s2", 2.0), ("topic", "short", 1.0)], "dimension string, value string, share double")
    got = {(x.dimension, x.value): x for x in M.marginals(spark, docs, targets=targets, rounds=50, tolerance=1e-6).collect()}
    assert got["lang", "rare"].reached == pytest.approx(5 * 50 / 0.5) and all(x.reached == pytest.approx(x.target, rel=1e-3) for x in got.values())
    assert {x.probability for x in M.calibrate(spark, docs, targets=targets, rounds=50, tolerance=1e-6).collect() if x.lang == "rare"} == {1.0}


def test_given_targets_are_met(spark):
    rows = [(i, "w " * (i % 7 + 1), "en" if i % 3 else "fr", f"s{i % 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("source", "s0", 0.7), ("source", "s1", 0.3), ("lang", "en", 1.0), ("lang", "fr", 1.0), ("topic", "short", 1.0)], "dimension string, value string, share double")
    got = M.calibrate(spark, docs, targets=targets, keep=0.2).collect()
    kept = {}
    for x in got:
        for d in ("source", "lang"):
            kept[x[d]] = kept.get(x[d], 0) + x.probability * x.tokens
    assert kept["s0"] / kept["s1"] == pytest.approx(7 / 3, rel=1e-3) and kept["en"] / kept["fr"] == pytest.approx(1, rel=1e-3)


def test_cases(spark):
    schema = "doc_id long, text string, lang string, source string, tokens string, probability string"
    rows = [(1, None, None, None, "t", "p"), (2, "", "en", "s", "t", "p"), (None, "a b", "en", "s", "t", "p"), (3, "x " * 200000, "en", "s", "t", "p"), (3, "x", "en", "s", "t", "p"), (3, "x", "en", "s", "t", "p")]
    docs = spark.createDataFrame(rows, schema)
    got = M.calibrate(spark, docs).collect()
    assert len(got) == len(rows) and all(0 <= x.probability <= 1 for x in got)
    chosen = [x.doc_id for x in got if x.sampled]
    assert sorted(x.doc_id or 0 for x in M.sample(spark, docs).collect()) == sorted(x or 0 for x in chosen)
    assert M.sample(spark, docs).columns == docs.columns
    assert M.calibrate(spark, docs.limit(0)).collect() == []


def test_rounds_that_end_early_say_so(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert {x.settled for x in M.calibrate(spark, docs, rounds=1, tolerance=1e-9).select("settled").distinct().collect()} == {False}
    assert {x.settled for x in M.calibrate(spark, docs, tolerance=0.5).select("settled").distinct().collect()} == {True}


def test_fills_go_on_until_nothing_changes(spark):
    """A chain of values of which each step brings one more to its bound: twenty steps, more than any fixed number would allow."""
    n = 20
    tokens = np.array([100.0 * 1.9**i for i in range(n)] + [1e12])
    share = np.array([tokens[i] * 3.0 * 1.05 ** (n - i) for i in range(n)] + [1e12])
    margins = spark.createDataFrame([("source", str(i), float(t), float(s)) for i, (t, s) in enumerate(zip(tokens, share))], "dimension string, value string, tokens double, share double")
    got = {int(x.value): x.target for x in M.with_targets(margins, float(tokens.sum()), 0.5).collect()}
    want = filled(share, tokens / 0.5, tokens.sum())
    assert [got[i] for i in range(n + 1)] == pytest.approx(want.tolist(), rel=1e-6)
