import random

import corpus_pipeline
import pytest

from quillstack.llm import simhash, toxicity
from quillstack.staging import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs, out = read_table(spark, SF, "documents"), [read_table(spark, SF, "documents")]
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs)
    return out


def test_stages_in_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns and docs.schema == stages[0].schema


def test_decisions_take_effect(spark, stages):
    ids = [{x.doc_id for x in d.select("doc_id").collect()} for d in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[0]) > len(ids[1]) > len(ids[2])
    scores = toxicity.score(spark, stages[0], read_table(spark, SF, "labels")).collect()
    assert ids[0] - ids[1] == {x.doc_id for x in scores if x.predicted}
    assert ids[2] == {x.doc_id for x in simhash.keep_one(spark, stages[1]).collect()}
    left = {x.doc_id: x.text for x in stages[2].collect()}
    prints = {d: simhash.fingerprint(t) for d, t in left.items()}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in left.items() for w in [t.encode().lower().split()]}
    for a in left:
        for b in left:
            if b < a:
                assert (prints[a] ^ prints[b]).bit_count() > 3
                if 0.8 <= len(shingles[a]) / len(shingles[b]) <= 1.25:
                    assert len(shingles[a] & shingles[b]) < 0.8 * len(shingles[a] | shingles[b])


def test_repeats_are_cut_once(stages):
    before, after = ({x.doc_id: x.text.split() for x in d.collect()} for d in stages[2:4])
    seen = {}
    for d in sorted(before):
        for i in range(len(before[d]) - 49):
            seen.setdefault(tuple(before[d][i : i + 50]), set()).add(d)
    for d, w in before.items():
        gone = set()
        for i in range(len(w) - 49):
            if min(seen[tuple(w[i : i + 50])]) < d:
                gone.update(range(i, i + 50))
        assert after.get(d, []) == [x for i, x in enumerate(w) if i not in gone]


def test_last_stage_packs_everything(stages):
    rows = stages[-1].collect()
    assert {x.doc_id for x in rows} == {x.doc_id for x in stages[4].collect()}
    by = {}
    for x in rows:
        by[x.sequence_id] = by.get(x.sequence_id, 0) + x.length
    assert max(by.values()) <= 2048 and len(by) <= 1.02 * sum(by.values()) / 2048 + 1
