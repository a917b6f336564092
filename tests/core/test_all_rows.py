"""Queries over every row, hard ones included, against plain Python."""

import html

from quillstack import queries as Q


def test_normalize_space_takes_entities_and_blank_lines(spark, tmp_path):
    rows = [(1, "a &amp; b"), (2, " x\n\n \ty  z\n"), (3, "&lt;p&gt; &#39;q&#39;"), (4, "R&D  Q&A"), (5, ""), (6, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.out for x in Q.QUERIES["normalize_space_all_rows"](spark, str(tmp_path)).collect()}
    assert got == {d: " ".join(html.unescape(t).split()) for d, t in rows}


def test_parse_ranges_takes_every_turn(spark, tmp_path):
    rows = [(c, t) for c in (1, 2) for t in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((x.conv_id, x.value) for x in Q.QUERIES["parse_ranges_all_rows"](spark, str(tmp_path)).collect())
    assert got == sorted((c, v) for c, t in rows for v in {t + 1, t + 2, t + 3, 9} | ({t} if t else set()))
