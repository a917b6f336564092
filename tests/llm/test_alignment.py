import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quillstack.llm import alignment
from quillstack.llm import queries as Q
from quillstack.staging import read_table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [c for c in range(256) if c not in printable]
    byte = {chr(c): c for c in printable} | {chr(0x100 + i): c for i, c in enumerate(rest)}
    return a, byte, SentencePieceProcessor(model_file=B)


def groups_of(libraries, text):
    """Groups of a text by the two libraries alone, one text at a time."""
    a, byte, b = libraries
    if not text:
        return []
    data, left, right = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False), b.encode(text)
    spelled_a = [bytes(byte[c] for c in t) for t in left.tokens]
    spelled_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in right for p in [b.id_to_piece(i)]]
    if b"".join(spelled_a) != data or b"".join(spelled_b) != data:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((left.ids[i:x], right[j:y]))
        i, j = x, y
    return out


def brute(libraries, rows):
    made = [(d, groups_of(libraries, t)) for d, t in rows]
    count = Counter(p for _, gs in made for p in {(x, y) for a, b in gs for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for d, gs in made:
        links = [(x, y) for a, b in gs for x in a for y in b]
        line = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        out.append((d, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


ODD = ["", None, " ", "   ", "a", "a ", " a", "a  b", "two  spaces   and \n\n lines \t tab", "<|endoftext|> <s> </s> <unk> x", "▁ mark", "a▁b", "日本語のテキスト and more", "naïve café ½ ² œ", "\x00 nul \x01", "emoji 😀😀 ok", "é ﬁ", "=" * 300, "12345678901234567890", "it's we'll they'd", "ab" * 3000, "x" * 5000 + " " + "y" * 70, " " * 200 + "z", "\r\n\r\n", "\xa0\xa0 nb", "word " * 4000]


def shown(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", *COLUMNS).collect()), key=str)


@pytest.mark.parametrize("hot", [1 << 20, 60, 0])
def test_equals_the_libraries_one_text_at_a_time(hot, spark, libraries):
    r = random.Random(5)
    rows = list(enumerate(ODD)) + [(100 + i, "".join(r.choice("aZé ß09²½ \n\t\x85\xa0!?-_«µ'stmdre日😀▁  ") for _ in range(r.randrange(40)))) for i in range(300)] + [(None, "no id here"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, pairs int").repartition(3)
    assert shown(alignment.align_tokenizers(spark, docs, A, B, hot=hot)) == brute(libraries, rows)


def test_documents_of_the_smallest_table(spark, libraries):
    rows = [(x.doc_id, x.text) for x in read_table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert shown(Q.op11_token_alignment(spark, "/root/testdata/sf0.001")) == brute(libraries, rows)


def test_pieces_equal_the_librarys():
    made, r = alignment.SentencePieces(B), random.Random(1)
    assert made.cuts
    texts = [t for t in ODD if t] + ["".join(r.choice("aZé  \n.s") for _ in range(r.randrange(1, 30))) for _ in range(4000)]
    for _ in range(2):
        ids, n = made.encode([" " + t for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == made.library.encode(texts)


@pytest.mark.parametrize("held", [3, 1 << 17])
@pytest.mark.parametrize("mask", [(1 << 64) - 1, 7])
def test_windows_of_one_hash_and_tables_that_begin_anew(held, mask, monkeypatch, libraries):
    """With eight hashes nearly all windows collide: ids are compared, so results stay."""
    mixed = alignment.mixed
    monkeypatch.setattr(alignment, "mixed", lambda x: mixed(x) & np.uint64(mask))
    monkeypatch.setattr(alignment, "KEPT", held)
    made = alignment.Aligner(A, B)
    texts = ["the cat sat on the mat", "on a mat, the cat", None, "unusualwordhere the the", "zzyzx " * 30]
    for _ in range(3):
        numbers, hashes, upto, pairs, times = made.documents(texts)
        for i, t in enumerate(texts):
            gs = groups_of(libraries, t)
            want = Counter(x * made.width + y for a, b in gs for x in a for y in b)
            assert dict(zip(pairs[upto[i] : upto[i + 1]].tolist(), times[upto[i] : upto[i + 1]].tolist())) == want
            assert numbers[i].tolist() == [sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(want.values())]


def test_empty_table(spark):
    got = alignment.align_tokenizers(spark, spark.createDataFrame([], "doc_id int, text string"), A, B)
    assert got.collect() == [] and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
