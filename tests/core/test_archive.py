import pytest
from pyspark.sql import functions as F

from quillstack.operators import dom, merge, parse, render, rename, validate
from quillstack.plans import archive

POST = "thread_id string, post_id string, post_number string, post_url string, page int, author string, timestamp string, text string, image_urls array<string>"


def posts(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], POST)


def test_reasons(spark):
    rows = [
        ("1", "2", "", 1, "a", "Unknown date", "x", []),
        ("", "2", "", 1, "a", "Unknown date", "x", []),
        ("1", "2", "", 1, "Unknown", "Jan", "", ["i"]),
        ("1", "2", "", 1, "Quoting b", "Jan", " ", []),
        ("1", "", "", 1, "Quote", "Unknown date", "x", None),
        (None, None, None, 1, None, None, None, None),
    ]
    got = [(x.accepted, x.validation_reasons) for x in validate.judged_posts(posts(spark, *rows)).collect()]
    assert got == [
        (True, []),
        (False, ["weak_post_signals"]),
        (True, ["weak_author"]),
        (False, ["author_is_quote_header", "empty_post"]),
        (False, ["weak_post_signals", "weak_author", "missing_label_and_timestamp"]),
        (False, ["weak_post_signals", "empty_post"]),
    ]


def test_page_rules(spark):
    p = validate.judged_posts(posts(spark, ("1", "2", "", 1, "a", "Jan", "x", []), ("2", "3", "", 1, "a", "Jan", "x", [])))
    pages = spark.createDataFrame([("t", 1, ["2", "3"]), ("t", 5, []), ("t", 6, None)], "thread_id string, page int, expected array<string>")
    got = {x.page: x.validation for x in validate.validate_pages(pages, p).collect()}
    assert got[1].warnings == ["expected 3 labelled posts but accepted 2", "page 1 opener missing", "missing post numbers: 1"] and not got[1].passed
    assert got[5].passed and got[6].passed and got[5].accepted_post_count == 0


def test_merge(spark):
    a = posts(spark, ("1", "1", "", 1, "old", "", "", []), ("1", "1", "", 2, "old", "", "", []), (None, "", None, None, "old", "", "", []))
    b = posts(spark, ("1", "1", "", 1, "new", "", "", []), ("2", "2", "", 1, "new", "", "", []), ("", None, "", 0, "new", "", "", []))
    got = sorted((x.post_id or "", x.page or 0, x.author) for x in merge.merge_posts(a, b).collect())
    assert got == [("", 0, "old"), ("1", 1, "old"), ("1", 2, "old"), ("2", 1, "new")]
    again = merge.merge_posts(merge.merge_posts(a, b), b)
    assert sorted(map(str, again.collect())) == sorted(map(str, merge.merge_posts(a, b).collect()))
    assert sorted(x.post_id or "" for x in merge.new_posts_only(b, a).collect()) == ["", "2"]
    assert merge.replace_pages(a, b.limit(0), a.limit(0)).count() == merge.merge_posts(a, a.limit(0)).count()
    failed = spark.createDataFrame([("t", 1, False)], "thread_id string, page int, passed boolean")
    assert sorted(x.author for x in merge.replace_pages(a, b, failed.select("thread_id", "page"), only_if_passed=failed).collect()) == ["old"] * 3


def above(df, table):
    """Of each scan of a table: the joins and exchanges that stand over it, the nearest first."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for at in (i for i, line in enumerate(lines) if "FileScan" in line and table in line):
        found, now = [], depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < now:
                now = depth(line)
                found.append(line.strip(" :+-*()0123456789"))
        yield [x for x in found if "Exchange" in x or "Join" in x]


def exchanges_over(df, table):
    return [x for x in next(above(df, table)) if "Exchange" in x]


def test_a_bucketed_archive_is_not_shuffled(spark):
    from quillstack.sources import writers

    rows = [(str(i), str(i), "", i % 7, "a", "Jan", "", []) for i in range(60)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        writers.save_bucketed_archive(posts(spark, *rows[:40]), "by_post", 4)
        fresh = merge.new_posts_only(posts(spark, *rows), spark.table("by_post"))
        assert exchanges_over(fresh, "by_post") == [] and sorted(int(x.post_id) for x in fresh.collect()) == list(range(40, 60))
        writers.save_bucketed_archive(posts(spark, *rows), "by_page", 4, keys=("thread_id", "page"))
        pages = posts(spark, *rows[:3]).select("thread_id", "page")
        rest = merge.except_pages(spark.table("by_page"), pages)
        assert exchanges_over(rest, "by_page") == [] and {x.page for x in rest.collect()} == {3, 4, 5, 6}
        fixed = posts(spark, *rows[:2], ("9", "9", "", 2, "z", "Jan", "", [])).withColumn("author", F.lit("new"))
        paged = merge.replace_pages(spark.table("by_page"), fixed, posts(spark, *rows[:2]).select("thread_id", "page"), merged=True)
        kept, *asked = above(paged, "by_page")
        assert kept and not any("Exchange" in x for x in kept)
        # Only keys of rows that met the replacement's pages, or of rows without a page, are dealt out.
        assert len(asked) == 2 and all("Join" in x[0] for x in asked)
        assert sorted((int(x.post_id), x.author) for x in paged.collect()) == sorted([(i, "a") for i in range(60) if i % 7 > 1] + [(0, "new"), (1, "new")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for table in ("by_post", "by_page"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_replaced_pages_of_a_merged_archive(spark):
    """Passing the archive's rows on gives what merging them again gives."""
    import itertools
    import random

    draw = random.Random(5)
    choice = list(itertools.product(["t", "u", None], ["1", "2", "", None], ["1", "", None], ["", "x", None], [1, 2, 0, None]))
    rows = lambda n, side: spark.createDataFrame([(t, i, k, u, p, f"{side}{draw.randrange(9)}", "", "", []) for t, i, k, u, p in draw.choices(choice, k=n)], POST)
    for n in (0, 40, 250):
        for m in (0, 30):
            held = spark.createDataFrame(merge.merge_posts(rows(n, "old"), rows(0, "")).collect(), POST)
            new = rows(m, "new")
            pages = spark.createDataFrame([("t", 1), ("u", 0), ("t", 1), (None, 1)], "thread_id string, page int")
            show = lambda df: sorted(map(str, df.collect()))
            assert show(merge.replace_pages(held, new, pages, merged=True)) == show(merge.replace_pages(held, new, pages))


def test_repair_counts(spark):
    old = posts(spark, ("1", "1", "", 1, "a", "Jan", "", []), ("", "9", "", 1, "b", "Jan", "", []))
    new = posts(spark, ("1", "1", "", 1, "other", "Jan", "", []), ("1", "1", "", 1, "a", "Jan", "", []), ("", "9", "", 1, "b", "Jan", "", []), ("7", "1", "", 1, "a", "Jan", "", []))
    assert [tuple(x) for x in merge.repair_added_vs_replaced(old, new).collect()] == [("t", 1, 2, 2)]


@pytest.mark.parametrize(
    "given, expected",
    [
        ({"cached": [7]}, (7, "raw_html")),
        ({"posts": [3, 7]}, (8, "thread_json")),
        ({"markers": [2], "posts": [9]}, (3, "page_markers")),
        ({"state": 4, "markers": [9]}, (4, "state")),
        ({}, (1, "requested")),
    ],
)
def test_resume(spark, given, expected):
    pages = lambda k: spark.createDataFrame([("t", p) for p in given.get(k, [])], "thread_id string, page int")
    state = spark.createDataFrame([("t", given["state"])] if "state" in given else [], "thread_id string, next_page int")
    row = archive.resume_plan(spark.createDataFrame([("t",)], "thread_id string"), state=state, markers=pages("markers"), posts=pages("posts"), cached=pages("cached")).first()
    assert (row.start_page, row.source) == expected


def test_stop_rules(spark):
    rows = [("a", 1, 3, 3, "x", 9), ("a", 2, 3, 3, "y", 9), ("a", 3, 3, 3, "y", 9), ("b", 1, 3, 0, "x", 9), ("b", 2, 0, 0, "", 9), ("c", 1, 3, 3, "p", 2), ("c", 2, 3, 0, "q", 2), ("c", 3, 3, 3, "r", 2)]
    pages = spark.createDataFrame(rows, "thread_id string, page int, n_blocks int, n_new int, first_post string, last_page int")
    got = {x.thread_id: (x.stop_page, x.reason) for x in archive.crawl_stop_page(pages).collect()}
    assert got == {"a": (3, "first post repeated"), "b": (2, "no posts on page"), "c": (2, "last page")}
    kept = sorted((x.thread_id, x.page) for x in archive.pages_before_stop(pages).collect())
    assert kept == [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2)]
    assert {x.stop_page for x in archive.crawl_stop_page(pages, limit=1).collect()} == {2}


def test_estimate(spark):
    pages = spark.createDataFrame([("t", i, float(s)) for i, s in enumerate([1, 2, 3, 4, 5, 60], 1)] + [("n", 1, None)], "thread_id string, page int, seconds double")
    got = {(x.thread_id, x.page): x.estimate for x in archive.page_time_estimate(pages).collect()}
    assert got["t", 6] == pytest.approx(0.7 * (2 + 6 + 12 + 20 + 300) / 15 + 0.2 * 4) and got["t", 1] == 1.0 and got["n", 1] == 15.0


def test_rename(spark):
    paths = spark.createDataFrame([("d-x/a-b.py",), ("a-b-c.py",), ("a_b-c.py",), ("k-l.py",), ("k_l.py",), ("m-n.txt",), (None,)], "path string")
    got = {x.old_path: (x.new_path, x.status) for x in rename.rename_conflicts(paths).collect()}
    taken = "Target already exists"
    assert got == {"d-x/a-b.py": ("d-x/a_b.py", "planned"), "a-b-c.py": ("a_b_c.py", "planned"), "a_b-c.py": ("a_b_c.py", taken), "k-l.py": ("k_l.py", taken)}
    assert {x.status: x.files for x in rename.rename_summary(paths).collect()} == {"planned": 2, taken: 2, "found": 4}


PAGE = """<html><head><title>T</title></head><body><h1>A &amp;amp; B</h1>
<div class="open"><a class="username">Starter</a> <span class="date">Jan 1, 2024 9:00am</span><div class="message">The opening text of this thread is long enough to be found, it has many words in it.</div></div>
<div class="post"><a class="username">ann</a><span class="date">Jan 5, 2024 1:05pm</span> <a href="/thread/post/11"># 2</a>
 <div class="message">Quoting bob<br>quoted line<br><br>own line<br>own line<br>Disliked<br>99<br>{quote}kept<br><p>Attached Image (click to enlarge)</p>
 <img src="/i/full.png"><img src="/avatar/x.png"><img data-src="/attachment/image/5/thumbnail?d=1" src="/spacer.gif">
 <div>Attached File(s)</div><div><a href="/attachment/file/8">plan.zip</a> 12 KB | 1,204 downloads</div><a href="/attachment/image/6">a label</a>
 <hr>my sig<br>my sig<br><br>bye</div></div>
<div class="post"><span class="date">no date</span><a href="/thread/post/12"># 1,003</a><div class="message">short copy of a post that is here</div></div>
<div class="post"><b>x</b><a href="/thread/post/12"># 1,003</a><div class="message">a much longer copy of the same post that is here as well, with more words</div></div>
<blockquote class="quote"><a href="/thread/post/13"># 7</a> quoted post with its number anchor, not a post</blockquote>
<nav><a href="?page=4">4</a><a href="?page=x">12</a><a href="/other?page=99">99</a></nav></body></html>"""


def test_parser(spark):
    raw = spark.createDataFrame([("t", 1, "https://f.org/thread/5-x", PAGE), ("t", 2, None, None)], "thread_id string, page int, page_url string, html string")
    parsed = parse.parse_pages(raw).withColumn("last", parse.last_page()).collect()
    one, two = sorted(parsed, key=lambda x: x.page)
    assert one.title == "A & B" and one.expected == ["2", "1003", "7"] and one.last == 12
    assert two.blocks == [] and two.title == parse.DEFAULT_TITLE and two["last"] is None
    opener, post, copy = one.blocks
    assert (opener.post_number, opener.author, opener.timestamp) == ("1", "Starter", "Jan 1, 2024 9:00am")
    assert (post.post_id, post.post_number, post.author, post.post_url) == ("11", "2", "ann", "https://f.org/thread/post/11")
    assert post.body_text == "> Quoting bob\n> quoted line\n\nown line\nkept\n[[POST_IMAGE]]"
    assert post.signature_text == "my sig\n\nbye"
    assert post.attachment_labels == ["a label", "plan.zip | 12 KB | 1,204 downloads"]
    assert post.image_urls == ["https://f.org/i/full.png", "https://f.org/attachment/image/5?d=1", "https://f.org/attachment/image/6"]
    assert copy.post_number == "1003" and "longer" in copy.body_text and copy.timestamp == "Unknown date"
    v = {x.page: x.validation for x in parse.validated_pages(parse.parse_pages(raw)).collect()}
    assert not v[1].passed and v[1].missing_post_numbers == ["7"] and v[2].passed
    accepted = parse.posts_of(parse.parse_pages(raw)).filter("accepted").collect()
    assert [x.post_number for x in accepted] == ["1", "2", "1003"] and accepted[1].text.endswith("Sig: my sig\nSig: bye")


def test_pages_are_parsed_in_slices():
    import pandas as pd

    batch = pd.DataFrame({"html": ["a" * 10, None, "b" * 25, "", "c" * 8, "d" * 8, "e" * 8], "page": range(7)})
    got = [list(x.page) for x in parse.slices(batch, 20)]
    assert got == [[0, 1], [2], [3, 4, 5], [6]]
    assert [len(x) for x in parse.slices(batch.iloc[:0], 20)] == [0]


def test_hostile_pages():
    for html in ("", "<", "<p", "</div></div>", "<div>" * 300, "<a href='/thread/post/1'># 1</a>", "<table><tr><td>a<tr><td>b", "\0퟿"):
        assert isinstance(parse.parse_html(html, 1, "")["blocks"], list)
    assert [n.tag for n in dom.tree("<ul><li>a<li>b</ul><p>c<p>d").nodes()] == ["ul", "li", "li", "p", "p"]


LONG = "many words of a post that is long enough to be taken as one "


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 100_000 + f'<a href="/thread/post/5"># 2</a> {LONG} Jan 5, 2024 1:05pm' + "</div>" * 100_000,
        "<b><i>" * 50_000 + LONG * 3,
        f'<div>{"<span class=content>" * 50_000}{LONG}<a href="/thread/post/5"># 2</a></div>',
        "<p><b>" * 50_000 + LONG,
        f'<div class="message">{LONG}{"<q>" * 100_000}<hr>sig<a href="/attachment/file/8">x.zip</a> 3 KB</div><a href="/thread/post/5"># 2</a>',
        "<![foo[ x ]]>" + LONG,
        "<!" + "<" * 5000,
    ],
)
def test_deep_and_odd_pages_end(html):
    assert isinstance(parse.parse_html(html, 1, "https://f.org/t")["blocks"], list)


def test_bad_links_are_no_urls(spark):
    body = f'<a href="http://[broken">x</a><img src="http://[also">{LONG}<a href="http://[/attachment/1">f</a>'
    page = f'<div class="post"><span class="date">Jan 5, 2024 1:05pm</span><a href="/thread/post/5"># 2</a><div class="message">{body}</div></div><a href="http://[thread/post/9"># 3</a>'
    raw = spark.createDataFrame([("t", 1, "https://f.org/t", page), ("t", 2, "http://[bad", page)], "thread_id string, page int, page_url string, html string")
    one, two = parse.parse_pages(raw).orderBy("page").collect()
    assert [(b.post_id, b.post_number, b.image_urls, b.body_text[:10]) for b in one.blocks] == [("5", "2", [], "x " + LONG[:8])]
    assert [(b.post_id, b.post_number, b.post_url) for b in two.blocks] == [("", "2", "")]


def test_text_dates_help_an_opener():
    """Before forty other strings nothing dates the opener but its whole text."""
    words = "".join(f"<i>{w}</i>" for w in ["w w"] * 41)
    opener = f'<td>{words} said on Jan <u>1, 2024 9:00am</u> and more words after it</td>'
    post = f'<td><a href="/thread/post/5"># 2</a> {LONG} Jan 5, 2024 1:05pm</td>'
    blocks = parse.parse_html(f"<table><tr>{opener}{post}</tr></table>", 1, "")["blocks"]
    assert [b["post_number"] for b in blocks][-1] == "2"


def test_post_links_without_numbers_count_if_no_number_does():
    """A number anchor whose own walk ends early is found from another link of its post."""
    far = f'<div><div><p>{LONG * 80}<a href="/thread/post/5"># 2</a></p></div></div>'
    page = dom.tree(f'<div>{far}<a href="/thread/post/6">link</a> Jan 5, 2024 1:05pm</div>')
    marks = parse.Marks(page)
    assert [len(x) for x in (marks.numbers, marks.permalinks)] == [1, 2]
    assert len(parse.blocks_of(page, 2, "", marks)) == 1


def test_bodies():
    body = "> a\n> b\nline <x>\n\n[[POST_IMAGE]]\nend"
    assert render.html_body(body, ["1.png", "2.png"]).split("\n") == [
        "<blockquote>", "<p>a</p>", "<p>b</p>", "</blockquote>", "<p>line &lt;x&gt;</p>", '<img src="1.png" alt="post image" loading="lazy">', "<p>end</p>", '<img src="2.png" alt="post image" loading="lazy">',
    ]
    assert render.html_body("", ["1.png"]) == "" and render.markdown_body(None, ["1.png"]) == ""
    assert "![post image](1.png)" in render.markdown_body(body, ["1.png"]) and "[[POST_IMAGE]]" not in render.markdown_body(body, [])


def test_numbers_beyond_a_long(spark, tmp_path):
    from quillstack.operators import select
    from quillstack.sources import readers

    huge = "9" * 20
    p = posts(spark, ("1", "5", "", 5, "a", "", "", []), ("2", huge, "", None, "a", "", "", []))
    assert [x.post_id for x in select.filter_by_pages(p, f"3-{huge}").collect()] == ["1"]
    assert [x.post_id for x in select.filter_by_post_numbers(p, f"#{'8' * 5000}", "5").collect()] == ["1"]
    many = ",".join(str(i) for i in range(1, 400, 2))
    assert [x.post_id for x in select.filter_by_post_numbers(p, many).collect()] == ["1"]
    (tmp_path / "sel").write_text(f"{huge} 3-{huge}")
    assert sorted(map(tuple, readers.read_selection_file(spark, f"{tmp_path}/sel").collect())) == [(3, select.LARGEST), (select.LARGEST, select.LARGEST)]
    specs = spark.createDataFrame([(1, "7-20000, 5"), (2, f"{huge}"), (3, None)], "id int, spec string")
    got = select.expand_ranges(specs, "id", "spec").collect()
    assert sorted(x.value for x in got if x.id == 1) == [5, *range(7, 20001)] and [x.value for x in got if x.id != 1] == [select.LARGEST]


def test_names_are_compared_as_shown(spark):
    from quillstack.operators import report, select

    names = ["A  B", "A B", "\u00a0A B", "a&amp;b", "a&b", None, "&nbsp;"]
    p = posts(spark, *[(str(i), str(i), "", 1, n, "", "", []) for i, n in enumerate(names)])
    assert sorted((x.author, x.post_count, x.rank) for x in report.top_authors(p).collect()) == [("A B", 3, 1), ("Unknown", 2, 2 + 1), ("a&b", 2, 2)]
    assert report.author_totals(p).first().distinct_users == 3
    assert sorted(x.post_id for x in select.filter_by_users(p, "a&amp;b").collect()) == ["3", "4"]
    assert merge.repair_added_vs_replaced(p.filter("post_id = 3").withColumn("post_number", F.lit("4")), p.filter("post_id = 4")).first().added == 1


def test_range_join_beyond_the_broadcast_bound(spark, monkeypatch):
    from quillstack.operators import select

    p = posts(spark, *[(str(i), str(i), "", 1, "a", "", "", []) for i in range(40)])
    ranges = spark.createDataFrame([("t", 3, 5), ("t", 4, 9), ("t", 30, 30), ("u", 1, 99)], "thread_id string, lo int, hi int")
    number = select.number_of(F.col("post_number"))
    expected = sorted([*range(3, 10), 30])
    assert sorted(int(x.post_id) for x in select.range_selection_join(p, ranges, number).collect()) == expected
    odd = p.select("*").withColumn("thread_id", F.when(F.col("post_id") < "5", F.col("thread_id"))).withColumn("half", F.col("post_id").cast("double") + 0.5)
    loose = ranges.unionByName(spark.createDataFrame([(None, 1, 99), ("t", 9, 3)], ranges.schema))
    few = sorted(x.post_id for x in select.range_selection_join(odd, loose, F.col("half")).collect())
    monkeypatch.setattr(select, "BROADCAST_RANGES", 1)
    assert sorted(x.post_id for x in select.range_selection_join(odd, loose, F.col("half")).collect()) == few and few
    assert sorted(int(x.post_id) for x in select.range_selection_join(p, ranges, number).collect()) == expected
