"""Rendering posts and threads as Markdown and HTML, in our own markup."""

from __future__ import annotations

import uuid
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstack.functions import lines as L
from quillstack.functions.text import export_sections, html_escape, squeeze
from quillstack.functions.urls import is_outside, mime_type
from quillstack.operators.images import resolve_images
from quillstack.operators.ordering import scanned
from quillstack.operators.select import display_label, sort_key
from quillstack.staging import Stage

STYLE = "body{max-width:100ch;margin:2em auto;font-family:sans-serif}article{border-top:1px solid}blockquote{border-left:3px solid;padding-left:1em}img{max-width:100%}"
HTML_FOOT = "</body></html>\n"
#: Bytes of a part of a long document.
PART_BYTES = 8 << 20


def _parts(body: str, images) -> list[tuple[str, str]]:
    """(kind, value) of a body in order: quote, line, gap or image; surplus images come last."""
    images, out, used = list(images if images is not None else ()), [], 0
    for line in body.splitlines():
        plain = L.squeeze(line)
        if plain == L.PLACEHOLDER:
            if used < len(images):
                out.append(("image", images[used]))
                used += 1
        elif not plain:
            out.append(("gap", ""))
        elif line.startswith("> "):
            out.append(("quote", line[2:].rstrip()))
        else:
            out.append(("line", line.rstrip()))
    return out + [("image", x) for x in images[used:]]


def markdown_body(body: str | None, images) -> str:
    """Lines of a body with images at their places; an empty body shows none."""
    if not body:
        return ""
    shown = {"image": "![post image]({})\n".format, "quote": "> {}".format, "line": "{}".format, "gap": "{}".format}
    return "\n".join(shown[kind](value) for kind, value in _parts(body, images))


def html_body(body: str | None, images) -> str:
    """Paragraphs; neighbouring quoted lines share one block quote.  An empty body shows no images."""
    out, quoting = [], False
    for kind, value in _parts(body, images) if body else ():
        if quoting and kind != "quote":
            out.append("</blockquote>")
            quoting = False
        if kind == "quote" and not quoting:
            out.append("<blockquote>")
            quoting = True
        if kind == "image":
            out.append(f'<img src="{escape(value)}" alt="post image" loading="lazy">')
        elif kind != "gap":
            out.append(f"<p>{escape(value)}</p>")
    return "\n".join(out + ["</blockquote>"] * quoting)


@F.pandas_udf(StringType())
def _markdown(body: pd.Series, images: pd.Series) -> pd.Series:
    return pd.Series([markdown_body(*x) for x in zip(body, images)])


@F.pandas_udf(StringType())
def _html(body: pd.Series, images: pd.Series) -> pd.Series:
    return pd.Series([html_body(*x) for x in zip(body, images)])


def _labelled(posts: DataFrame) -> DataFrame:
    return display_label(posts).withColumn("s", export_sections("body_text", "text", "attachment_labels", "signature_text"))


def render_markdown(posts: DataFrame) -> DataFrame:
    """(thread_id, key, markdown) of every post."""
    lines = lambda name, c: F.array_join(F.transform(c, lambda x: F.concat(F.lit(f"{name}: "), x)), "\n")
    some = lambda c: F.when(c != "", c)
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("## Post "), F.col("label"), F.lit(" — "), F.col("author")),
        F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" | "), F.col("timestamp"), F.lit(" | "), F.col("post_url")),
        some(_markdown("s.body", "images")),
        some(lines("Attachment", F.col("s.attachments"))),
        some(lines("Sig", F.col("s.signature"))),
    )
    return _labelled(posts).select("thread_id", F.struct(*sort_key()).alias("key"), text.alias("markdown"))


def render_html(posts: DataFrame, *more: str) -> DataFrame:
    """(thread_id, key, html) of every post, and the columns ``more``; images by reference."""
    rows = lambda name, c: F.array_join(F.transform(c, lambda x: F.concat(F.lit(f'<p class="{name}">'), html_escape(x), F.lit("</p>"))), "\n")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit('<article id="post-'), html_escape(F.col("label")), F.lit('">')),
        F.concat(F.lit("<h2>Post "), html_escape(F.col("label")), F.lit(" — "), html_escape(F.col("author")), F.lit("</h2>")),
        F.concat(F.lit("<p>Page "), F.col("page").cast("string"), F.lit(" | "), html_escape(F.col("timestamp")), F.lit(' | <a href="'), html_escape(F.col("post_url")), F.lit('">link</a></p>')),
        _html("s.body", "images"),
        rows("attachment", F.col("s.attachments")),
        rows("signature", F.col("s.signature")),
        F.lit("</article>"),
    )
    return _labelled(posts).select("thread_id", F.struct(*sort_key()).alias("key"), *more, text.alias("html"))


def with_embedded(posts: DataFrame, images: DataFrame) -> DataFrame:
    """Posts whose ``images`` are inline where their content is known, with ``n_embedded`` and ``n_fallback``.

    Every row is a post of its own, also without an id or with the id of another one.  Only images that the body can show are counted: a post without body shows none.
    """
    columns = posts.columns
    posts = _rowed(posts)
    each = resolve_images(posts, images, keys=("__row",)).groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "uri"))), lambda x: x["uri"]).alias("uris"))
    out = posts.join(each, "__row", "left").withColumn("images", F.coalesce("uris", F.array().cast("array<string>")))
    inline = F.size(F.filter(_shown(), lambda x: x.startswith("data:")))
    return out.withColumn("n_embedded", inline).withColumn("n_fallback", F.size(_shown()) - inline).select(*columns, "n_embedded", "n_fallback")


def _rowed(posts: DataFrame) -> DataFrame:
    """The posts, staged, with a number of their own for each row."""
    return Stage(posts.sparkSession, "rowed").put("posts", posts.withColumn("__row", F.monotonically_increasing_id()))


def _shown() -> Column:
    """Images of a post that its body can show."""
    return F.when(F.coalesce("body_text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.col("images"))


def embedded_pieces(posts: DataFrame, images: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """(thread_id, key, row, piece, cut, text): the HTML of every post with its images inline, in pieces that no row need hold together.

    A post is rendered with marks at its images' places and taken apart there.  Contents are cut once for each digest, into base64 of a multiple of three bytes,
    so the pieces of an image follow one another without a seam.
    """
    posts = _rowed(posts)
    token = uuid.uuid4().hex
    marked = posts.withColumn("images", F.transform("images", lambda x, i: F.concat(F.lit(f"{token}:"), i.cast("string"), F.lit(":"))))
    html = render_html(marked, "__row").select("thread_id", "key", F.col("__row").alias("row"), "html")
    taken = html.select("thread_id", "key", "row", F.split("html", f"{token}:[0-9]+:").alias("texts"), F.regexp_extract_all("html", F.lit(f"{token}:([0-9]+):"), F.lit(1)).alias("marks"))
    text = F.transform("texts", lambda x, i: F.struct((2 * i).alias("piece"), x.alias("text"), F.lit(None).cast("int").alias("idx")))
    image = F.transform("marks", lambda x, i: F.struct((2 * i + 1).alias("piece"), F.lit(None).cast("string").alias("text"), (x.cast("int") + 1).alias("idx")))
    each = Stage(posts.sparkSession, "pieces").put("pieces", taken.select("thread_id", "key", "row", F.explode(F.concat(text, image)).alias("x")).select("thread_id", "key", "row", "x.*"))
    unit = (part_bytes // 2 * 3 // 4) // 3 * 3
    files = images.select("thread_id", "path", "content").filter("content IS NOT NULL").withColumn("digest", F.sha2("content", 256))
    known = files.groupBy("thread_id", "path").agg(F.min("digest").alias("digest"))
    contents = files.dropDuplicates(["digest"]).select("digest", "content", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("content") - 1) / unit).cast("int")))).alias("n"))
    coded = F.translate(F.base64(F.substring("content", F.col("n") * unit + 1, F.lit(unit))), "\r\n", "")
    chunks = Stage(posts.sparkSession, "chunks").put("chunks", contents.select("digest", (F.col("n") + 1).alias("cut"), coded.alias("text")))
    refs = posts.select(F.col("__row").alias("row"), F.col("thread_id").alias("__thread"), F.posexplode("images").alias("pos", "path")).select("row", "__thread", (F.col("pos") + 1).alias("idx"), "path")
    asked = each.filter("idx IS NOT NULL").drop("text").join(refs, ["row", "idx"]).join(known.withColumnRenamed("thread_id", "__thread"), ["__thread", "path"], "left")
    plain = squeeze(F.col("path"))
    asked = asked.withColumn("digest", F.when(~is_outside(plain) & (plain != ""), F.col("digest")))
    head = F.when(F.col("digest").isNull(), html_escape(plain)).otherwise(F.concat(F.lit("data:"), mime_type(plain), F.lit(";base64,")))
    out = ["thread_id", "key", "row", "piece", "cut", "text"]
    zero = F.lit(0).alias("cut")
    texts = each.filter("idx IS NULL").select("thread_id", "key", "row", "piece", zero, "text")
    heads = asked.select("thread_id", "key", "row", "piece", zero, head.alias("text"))
    return texts.unionByName(heads).unionByName(asked.join(chunks, "digest").select(out))


def assemble_threads(rendered: DataFrame, column: str, *, joiner: str = "\n\n") -> DataFrame:
    """(thread_id, document, posts): the sections of a thread in order, for threads that fit a row."""
    whole = rendered.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("key", column))).alias("x"))
    return whole.select("thread_id", F.array_join(F.transform("x", lambda r: r[column]), joiner).alias("document"), F.size("x").alias("posts"))


def thread_parts(rendered: DataFrame, column: str) -> DataFrame:
    """Sections sorted by thread and order over range partitions, for threads of any size: written, they are ordered part files."""
    return rendered.repartitionByRange("thread_id", "key").sortWithinPartitions("thread_id", "key").select("thread_id", "key", column)


def document_parts(threads: DataFrame, pieces: DataFrame, column: str, *, head: Column, foot: Column, joiner: str = "\n", part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """Whole documents of threads of any size: parts (thread_id, part, text) and a manifest (thread_id, parts, bytes, posts).

    Part 0 is the header, the last one the footer; all parts of a thread, one behind the other, are its document.  ``pieces`` are sections (thread_id, key, ``column``), or
    parts of sections in order of ``row``, ``piece`` and ``cut`` where they have these.  ``head`` and ``foot`` are made of the columns of ``threads`` and of ``posts``.

    Pieces are dealt to parts by the bytes before them, summed over range partitions, so a thread is split while it is put together, and no part has more
    than ``part_bytes`` bytes (header and footer aside).
    """
    stage, unit = Stage(pieces.sparkSession, "documents"), part_bytes // 2
    inner = [c for c in ("row", "piece", "cut") if c in pieces.columns]
    named = pieces.withColumnRenamed(column, "text")
    opens = F.lit(True)
    for c in inner:
        opens = opens & (F.col(c) == 0) if c != "row" else opens
    step = max(1, unit // 4 - len(joiner.encode()))
    long = F.octet_length("text") + len(joiner.encode()) > unit
    cuts = F.when(long, F.sequence(F.lit(0), F.floor((F.length("text") - 1) / step).cast("int"))).otherwise(F.array(F.lit(0)))
    each = named.select("thread_id", "key", *inner, opens.alias("opens"), "text", F.explode(cuts).alias("sub"))
    each = each.select("thread_id", "key", *inner, (F.col("opens") & (F.col("sub") == 0)).alias("opens"), "sub", F.when(long, F.substring("text", F.col("sub") * step + 1, F.lit(step))).otherwise(F.col("text")).alias("text"))
    size = F.octet_length("text") + F.when(F.col("opens"), len(joiner.encode())).otherwise(0)
    placed = scanned(each, ["thread_id"], [F.col("key"), *map(F.col, inner), F.col("sub")], sums={"place": F.lit(1), "upto": size})
    told = F.when(F.col("opens") & (F.col("place") > 1), F.concat(F.lit(joiner), F.col("text"))).otherwise(F.col("text"))
    part = (F.floor((F.col("upto") - size) / unit) + 1).cast("int")
    placed = placed.select("thread_id", part.alias("part"), "opens", F.struct("place", told.alias("text")).alias("x"))
    body = placed.groupBy("thread_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "").alias("text"), F.count_if("opens").alias("posts"))
    body = stage.put("body", body)
    sizes = body.groupBy("thread_id").agg(F.max("part").alias("last"), F.sum("posts").alias("posts"))
    ends = threads.join(sizes, "thread_id")
    first = ends.select("thread_id", F.lit(0).alias("part"), head.alias("text"))
    last = ends.select("thread_id", (F.col("last") + 1).alias("part"), foot.alias("text"))
    here = body.join(threads.select("thread_id").distinct(), "thread_id", "left_semi").select("thread_id", "part", "text")
    parts = stage.put("parts", here.unionByName(first).unionByName(last))
    manifest = parts.groupBy("thread_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.octet_length("text")).alias("bytes")).join(sizes.select("thread_id", "posts"), "thread_id")
    return parts, manifest


def html_parts(threads: DataFrame, pieces: DataFrame, column: str = "html", *, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """``document_parts`` with the header and footer of ``html_document``."""
    return document_parts(threads, pieces, column, head=_html_head(), foot=F.lit(f"\n{HTML_FOOT}"), part_bytes=part_bytes)


def markdown_parts(threads: DataFrame, pieces: DataFrame, column: str = "markdown", *, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """``document_parts`` with the header of ``markdown_document``."""
    return document_parts(threads, pieces, column, head=_markdown_head(), foot=F.lit("\n"), part_bytes=part_bytes)


def thread_document(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """One nested document per thread: title, source, start page, total and its public posts in order."""
    public = posts.drop("raw_html")
    folded = public.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct(F.struct(*sort_key()).alias("key"), F.struct(*[c for c in public.columns if c != "thread_id"]).alias("post")))).alias("x"))
    return threads.join(folded, "thread_id", "left").select(*threads.columns, F.greatest(F.size("x"), F.lit(0)).cast("long").alias("total_posts"), F.transform("x", lambda r: r["post"]).alias("posts"))


def thread_document_parts(posts: DataFrame, threads: DataFrame, *, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """``thread_document`` as JSON text for threads of any size: parts and a manifest as of ``document_parts``.

    A thread's parts, one behind the other, are one JSON document; null fields are left out, as a JSON writer does.  Threads without posts have none.
    """
    public = posts.drop("raw_html")
    each = public.select("thread_id", F.struct(*sort_key()).alias("key"), F.to_json(F.struct(*[c for c in public.columns if c != "thread_id"])).alias("json"))
    facts = F.to_json(F.struct(*threads.columns, F.col("posts").alias("total_posts")))
    head = F.concat(F.substring(facts, 1, F.length(facts) - 1), F.lit(',"posts":['))
    return document_parts(threads, each, "json", head=head, foot=F.lit("]}\n"), joiner=",", part_bytes=part_bytes)


def _html_head() -> Column:
    title, url = html_escape(F.col("title")), html_escape(F.col("source_url"))
    return F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8"><title>'), title, F.lit(f'</title><style>{STYLE}</style></head><body>\n<h1>'), title, F.lit('</h1>\n<p><a href="'), url, F.lit('">source</a>, '), F.col("posts").cast("string"), F.lit(" posts</p>\n"))


def html_document(threads: DataFrame, assembled: DataFrame) -> DataFrame:
    """(thread_id, document): a page with header, sections and footer of every thread (thread_id, title, source_url), for threads that fit a row."""
    return threads.join(assembled, "thread_id").select("thread_id", F.concat(_html_head(), F.col("document"), F.lit(f"\n{HTML_FOOT}")).alias("document"))


def _markdown_head() -> Column:
    return F.concat(F.lit("# "), F.col("title"), F.lit("\n\nSource: "), F.col("source_url"), F.lit("\nPosts: "), F.col("posts").cast("string"), F.lit("\n\n"))


def markdown_document(threads: DataFrame, assembled: DataFrame) -> DataFrame:
    return threads.join(assembled, "thread_id").select("thread_id", F.concat(_markdown_head(), F.col("document"), F.lit("\n")).alias("document"))
