import math

import numpy as np
import pytest

from quillstack.llm import graph_ann as G
from quillstack.staging import read_table


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = G.exact(x[i], x)
        keep = ids != ids[i]
        top = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(ids[i])] = list(zip(ids[keep][top].tolist(), s[keep][top].tolist()))
    return out


def test_recall_and_exact_scores(spark):
    table = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in G.nearest(spark, table, shard_rows=700).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, x, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    score = {(int(a), int(b)): float(s) for a in want for b, s in zip(ids, G.exact(x[ids == a][0], x))}
    assert all(s == score[q, v] for q, rows in got.items() for v, s in rows)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_lengths_matter_and_ties_go_to_smaller_ids(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 6)) * r.uniform(0.1, 9, size=(200, 1))
    x[60:140] = x[5]
    ids = np.arange(200)
    table = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rank int")
    got = {}
    for row in G.nearest(spark, table, shard_rows=70).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    want = brute(ids, x, 20, 20)
    assert got == want


def test_a_few_long_vectors_hide_no_others(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i, size in ((3, 1e3), (41, 1e4), (77, 1e6), (801, 1e160), (903, 1e-170)):
        x[i] *= size
    ids = np.arange(2000)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for row in G.nearest(spark, table).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    want = brute(ids, x, 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.95


LENGTHS = {
    "unit": lambda r, g: g / np.linalg.norm(g, axis=1, keepdims=True),
    "gaussian": lambda r, g: g,
    "one to four": lambda r, g: g / np.linalg.norm(g, axis=1, keepdims=True) * r.uniform(1, 4, (len(g), 1)),
    "log-normal": lambda r, g: g / np.linalg.norm(g, axis=1, keepdims=True) * np.exp(0.5 * r.normal(size=(len(g), 1))),
}


@pytest.mark.parametrize("lengths", LENGTHS)
def test_recall_by_spread_of_lengths(lengths, spark):
    """Registered settings: nearly all rows are in one shard where lengths are alike."""
    r = np.random.default_rng(6)
    x = LENGTHS[lengths](r, r.normal(size=(6000, 64)))
    ids = np.arange(6000)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for row in G.nearest(spark, table).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    want = brute(ids, x, 20, 20)
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_a_shard_whose_graph_finds_too_little_is_scanned():
    """A graph without links finds its start only; all beams fall short, and the scan is exact."""
    r = np.random.default_rng(7)
    x = r.normal(size=(1500, 8))
    assert G.enough(G.unit_rows(x[:40]), G.scaled(x), np.full((1500, 4), -1, dtype=np.int32), 20, G.BEAMS) == 0
    shard = G.unpack_shard(G.pack_shard(np.arange(1500), x, 20, x[:40], beams=()))
    assert shard[-1] == 0
    ids, who, score = G.search_shard(np.arange(0, 1500, 20), x[::20], shard, 20)
    want = brute(np.arange(1500), x, 20, 20)
    assert {q: list(zip(who[ids == q].tolist(), score[ids == q].tolist())) for q in want} == want


def test_cases(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (None, [1.0, 1.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (8, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in G.nearest(spark, table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 2.0), (0, 2, 20, 0.0), (20, 1, 7, 2.0), (20, 2, 0, 0.0)]
    assert G.nearest(spark, table.limit(0)).collect() == []
