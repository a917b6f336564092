import random
import re

import pytest

from quillstack.llm import licenses
from quillstack.llm import queries as Q
from quillstack.staging import read_table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    """(n_words, n_base, first_word, last_word, base_labels) by comparing words at every place."""
    w, found = words(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def least_edits(notice, text):
    """Fewest edits of a notice against any part of the text: the textbook table, one row of the text at a time."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, n in enumerate(notice):
            new.append(min(row[j] + (n != c), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(notice, n, r):
    s = list(notice)
    for _ in range(n):
        i = r.randrange(len(s))
        kind = r.randrange(3)
        s[i : i + (kind != 1)] = [] if kind == 0 else [r.choice("abcdefgh ")]
    return "".join(s)


def some_texts():
    r = random.Random(8)
    filler = ["licensed", "under", "the", "license", "software", "of", "gnu", "general", "public", "granted", "free", "mit", "bsd", "wörd", "cc", "by", "apache"]
    out = [None, "", "!!!", "CC BY-NC", "cc-by cc\nby ccby", "The MIT\tLicense. mit license", "GNU General Public License gnu general public license", "released under the bsd license", "licensed under the eclipse public license", "É MIT LICENSE é"]
    for notice in licenses.NOTICES:
        k = licenses.edits(notice)
        for n in (0, 1, k, k + 1, k + 3):
            out.append(" ".join(r.choices(filler, k=r.randrange(8))) + " " + edited(notice, n, r).upper() + ". " + " ".join(r.choices(filler, k=r.randrange(8))))
    out += [" ".join(r.choices(filler, k=r.randrange(30))) for _ in range(60)]
    return out


def test_equals_brute_force(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(t, i, 0) for i, t in enumerate(texts)], "text string, doc_id long, notices int").repartition(3)
    got = {x.doc_id: x for x in licenses.find_licenses(spark, docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        x, normal = got[i], licenses.normal(text)[0]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base(text)
        near = {n: least_edits(n, normal) for n in licenses.NOTICES}
        want = {n: e for n, e in near.items() if e <= licenses.edits(n)}
        assert {s.notice: min(y.edits for y in x.notices if y.notice == s.notice) for s in x.notices} == want
        assert x.labels == ",".join(sorted(set(x.base_labels.split(",") if x.base_labels else []) | {licenses.NOTICES[n] for n in want}))
        assert x.score == pytest.approx(1.0 if x.n_base else max((1 - e / len(n) for n, e in want.items()), default=0.0))
        for s in x.notices:
            w = words(text)
            assert s.matched in normal and s.matched.strip() in " ".join(w[s.first_word : s.last_word + 1])
            assert len(s.matched.split()) == s.last_word - s.first_word + 1


def test_places_of_one_notice_stay_apart_and_none_is_lost():
    """Many places, a stretch longer than what is searched at once, a better place behind a worse one."""
    find = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    notice = "released under the mit license"
    worse = notice.replace("mit", "mti")
    text = " " + " ".join([worse, notice, "word", notice[:-1] + "ce"] * 300) + " "
    mine = [x for x in find.fuzzy(text) if find.notices[x[1]][0] == notice]
    assert len(mine) == 900 and all(a[3] <= b[2] for a, b in zip(mine, mine[1:]))
    assert len(find.exact(text)) == sum(text.count(f" {p} ") for p in licenses.PHRASES)


def test_long_text_and_repeated_rows(spark):
    text = "license " * 40000 + "Licensed under the Apache Licence Version 2.0 " + "x" * 100000
    docs = spark.createDataFrame([(1, text), (1, text), (None, "MIT License")], "doc_id long, text string")
    got = sorted(((x.doc_id or 0, x.labels, x.n_base, x.n_words) for x in licenses.find_licenses(spark, docs).collect()))
    assert got == [(0, "mit", 1, 2), (1, "apache", 0, 40009), (1, "apache", 0, 40009)]


def test_query_and_empty_table(spark):
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in Q.op13_license_scan(spark, "/root/testdata/sf0.001").collect()}
    assert got == {x.doc_id: base(x.text) for x in read_table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert licenses.find_licenses(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_seeds_cover_a_notice():
    for notice in licenses.NOTICES:
        parts = licenses.seeds(notice, licenses.edits(notice))
        assert "".join(s for _, s in parts) == notice and len(parts) == licenses.edits(notice) + 1
