"""Forum pages to posts: one narrow job that emits a row per page with its posts nested.

A page never fails: without HTML it has no posts, a malformed link or page url is no url, and depth costs no recursion.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import lines as L
from quillstack.functions.text import compose_text, dedupe_all_lines, dedupe_consecutive_lines, normalize_multiline, normalize_space, strip_attachment_artifacts
from quillstack.functions.urls import normalize_thread_url, should_skip_image
from quillstack.operators.dom import Node, tree
from quillstack.operators.validate import NO_AUTHOR, NO_DATE, judged_posts, validation_of

#: Where forum pages show authors, dates and contents.
AUTHORS = (".author", ".username", "[class*=author]", "[class*=user]")
DATES = (".date", "time", "[class*=date]", "[class*=time]")
CONTENTS = (".message", ".content", ".post-content", ".postbody", "[class*=message]", "[class*=content]")
#: Link texts that are no author names, and that are no attachment names.
NO_NAMES = frozenset(("quote", "reply", "subscribe", "forums", "trades", "news", "calendar", "market", "brokers", "create account", "login", "logout", "search", "top of page", "more"))
NO_LABELS = frozenset(("", "image", "attached image", "click to enlarge", "download"))
ICON_HINTS = ("/images/attach/", "file type:")
OPENER_NOT = ("quote", "breadcrumb", "pagination", "toolbar", "footer")
PERMALINK, NUMBER = re.compile(r"/thread/post/(\d+)"), re.compile(r"#\s*([\d,]+)")
IMAGE = re.compile(r"\.(?:jpg|jpeg|png|gif|webp|bmp|svg)(?:\?|$)", re.I)
DEFAULT_TITLE = "Forum thread"
DOUBLE_BREAK, SINGLE_BREAK = frozenset(("p", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")), frozenset(("div", "li", "tr", "table", "ul", "ol", "hr"))
#: How well an element fits as a post, and as the first post of a thread.  A feature counts (worth of one, most) from a least value on.
POST_WEIGHTS = {
    "characters": (1 / 120, 4.0, 30),
    "content characters": (1 / 200, 4.0, 20),
    "date element": (4.0, 4.0, 1),
    "date in text": (3.0, 3.0, 1),
    "says joined": (1.0, 1.0, 1),
    "says quote": (0.5, 0.5, 1),
    "says attached image": (0.5, 0.5, 1),
    "block element": (0.5, 0.5, 1),
    "anchor itself": (-4.0, 0.0, 1),
}
OPENER_WEIGHTS = {
    "characters": (1 / 180, 5.0, 80),
    "content characters": (1 / 250, 4.0, 80),
    "author": (2.0, 2.0, 1),
    "date": (4.0, 4.0, 1),
    "date in text": (3.0, 3.0, 1),
    "says joined": (1.0, 1.0, 1),
    "block element": (0.5, 0.5, 1),
}
POST_LEAST, OPENER_LEAST = 1.0, 5.0
POST_TAGS, OPENER_TAGS = frozenset(("div", "article", "li", "section")), frozenset(("div", "article", "section", "li", "td"))
NO_OPENER_TAGS = frozenset(("script", "style", "noscript", "svg", "path"))
OUTER = frozenset(("body", "html", "document"))

#: What the tree of a page yields: links and posts before the rules that columns apply to them.
RAW_LINK = "struct<href:string,url:string,text:string>"
RAW_BLOCK = "struct<label:string,post_id:string,post_number:string,post_url:string,author:string,timestamp:string,body:string,signature:string,labels:array<string>,pictures:array<string>,raw_html:string>"
RAW = f"thread_id string, page int, page_url string, title string, links array<{RAW_LINK}>, blocks array<{RAW_BLOCK}>"


def absolute(page_url: str, href: str) -> str:
    """Absolute url of a link; a malformed one is empty."""
    return short_url(page_url, href) if len(page_url) + len(href) <= 1000 else joined_url(page_url, href)


def joined_url(page_url: str, href: str) -> str:
    try:
        return urljoin(page_url, href)
    except ValueError:
        return ""


#: A page asks for the same urls several times.  Long ones, which may hold whole images, are not kept.
short_url = lru_cache(maxsize=1 << 12)(joined_url)


def host_of(url: str) -> str:
    try:
        return urlparse(url).netloc
    except ValueError:
        return ""


def score(features: dict[str, float], weights: dict[str, tuple[float, float, float]]) -> float:
    """Sum of what the features are worth."""
    return sum(min(features.get(name, 0) * one, most) for name, (one, most, least) in weights.items() if features.get(name, 0) >= least)


def is_permalink(a: Node) -> bool:
    return bool(PERMALINK.search(a.attrs["href"]))


def is_number(a: Node) -> bool:
    return is_permalink(a) and bool(NUMBER.fullmatch(a.text))


def label_of(a: Node) -> str:
    found = NUMBER.search(a.text)
    return found[1].replace(",", "") if found else ""


class Marks:
    """Post links of a page in document order: how many stand inside an element is a difference of two places."""

    def __init__(self, page: Node):
        self.permalinks = [a for a in page.anchors if is_permalink(a)]
        self.numbers = [a for a in self.permalinks if is_number(a)]
        self._at = {kind: [a.first for a in own] for kind, own in (("permalinks", self.permalinks), ("numbers", self.numbers))}

    def count(self, kind: str, node: Node) -> int:
        return bisect_left(self._at[kind], node.last) - bisect_left(self._at[kind], node.first + 1)


def first_text(node: Node, selectors: tuple[str, ...]) -> str:
    """Text of the first element of the first selector that has some."""
    for s in selectors:
        a, b = node.span(s)
        if a < b and (text := node.index.find(s)[1][a].text):
            return text
    return ""


def title_of(page: Node) -> str:
    for tag in ("h1", "title"):
        found = next(iter(page.select(tag)), None)
        if found is not None and (found.text or tag == "title"):
            return found.text
    return DEFAULT_TITLE


def expected_numbers(links: Column) -> Column:
    """Numbers of the post links of a page, each once, in order."""
    number = r"^#\s*([0-9,]+)$"
    own = F.filter(links, lambda x: x["href"].rlike(PERMALINK.pattern) & x["text"].rlike(number))
    return F.array_distinct(F.transform(own, lambda x: F.translate(F.regexp_extract(x["text"], number, 1), ",", "")))


def content_of(block: Node) -> Node:
    """The longest content element of twenty characters or more, else the block.

    An element inside a content element is never longer, so only outermost ones are looked at.
    """
    best, most = block, 19
    for s in CONTENTS:
        (at, last), found = block.span(s), block.index.find(s)
        while at < last:
            node = found[1][at]
            if "quote" in node.classes.lower():
                at += 1
                continue
            if len(node.text) > most:
                best, most = node, len(node.text)
            at = bisect_left(found[0], node.last)
    return best


def said(text: str) -> dict[str, float]:
    low = text.lower()
    return {"characters": len(text), "says joined": "joined" in low, "says quote": "quote" in text, "says attached image": "attached image" in low}


def container_of(anchor: Node, marks: Marks) -> Node | None:
    """The best ancestor that holds one number anchor; the walk ends at the body or after an element with very much text."""
    best, top, node, known = None, POST_LEAST, anchor, {}
    while node is not None and node.tag not in OUTER:
        text, own = node.text, node.classes.lower()
        if len(text) >= 30 and "quote" not in own and node.tag != "blockquote" and marks.count("numbers", node) == 1 and marks.count("permalinks", node) <= 6:
            key = (node.said_first, node.said_last, *(node.span(s) for s in DATES + CONTENTS))
            if key not in known:
                content = content_of(node)
                dated = bool(first_text(node, DATES))
                known[key] = {**said(text), "content characters": len(content.text), "date element": dated, "date in text": not dated and bool(L.timestamp_of(text))}
            value = score(known[key] | {"block element": node.tag in POST_TAGS, "anchor itself": node is anchor}, POST_WEIGHTS)
            if value > top:
                best, top = node, value
        if len(text) > 4000:
            break
        node = node.up
    return best


def primary_anchor(block: Node) -> Node | None:
    return next(filter(is_number, block.anchors), None) or next(filter(is_permalink, block.anchors), None)


def identity_of(block: Node, page_url: str) -> tuple[str, str, str]:
    """(id, number, url) of a post."""
    a = primary_anchor(block)
    if a is None:
        return "", "", page_url
    url = absolute(page_url, a.attrs["href"])
    found = PERMALINK.search(url)
    return found[1] if found else "", label_of(a), url


class Link:
    """A link as the rules of authors, files and images see it."""

    #: What a url's parts say about its target.
    PARTS = {"post": "/thread/post/", "attached": "/attachment/", "picture": "/attachment/image/", "download": "download"}

    def __init__(self, a: Node, page_url: str):
        self.node, self.href, self.text = a, a.attrs["href"], a.text
        self.low, self.url = self.text.lower(), image_url(page_url, a.attrs["href"])
        self.target = {name for name, part in self.PARTS.items() if part in (self.url.lower() if name == "download" else self.url)}

    @property
    def is_file(self) -> bool:
        return "attached" in self.target and "picture" not in self.target

    @property
    def is_attachment(self) -> bool:
        if not self.url or "post" in self.target or self.low in ("reply", "quote", "subscribe"):
            return False
        return self.is_file or (bool(self.target & {"attached", "download"}) and self.low not in NO_LABELS)

    @property
    def shows_image(self) -> bool:
        return not self.is_file and ("picture" in self.target or bool(IMAGE.search(self.url)) or "click to enlarge" in self.low)

    @property
    def label(self) -> str:
        """Text of a file link, else the file's name."""
        if self.text.startswith("! "):
            return L.squeeze(self.text[2:]) or self._name
        return self.text or self._name

    @property
    def _name(self) -> str:
        return re.split(r"[?#]", self.url, maxsplit=1)[0].rstrip("/").rpartition("/")[2]

    def names_author(self, host: str) -> bool:
        inside = any(self.PARTS[x] in self.href for x in ("post", "attached")) or (self.href.startswith("http") and host not in self.href)
        odd = self.low.startswith(("#", "quoting ")) or "posts" in self.low or self.text.isdigit() or self.low in NO_NAMES
        return 0 < len(self.text) <= 40 and not inside and not odd


def is_word_name(line: str) -> bool:
    """A short string without blanks that may be an author's name."""
    low = line.lower()
    return 0 < len(line) <= 30 and " " not in line and low not in NO_NAMES and not low.startswith("quoting ") and not L.TIMESTAMP.search(line) and not L.is_stats(line)


def author_of(block: Node, host: str) -> str:
    """By author elements, else by a short link, else by a short word."""
    by_link = (a.text for a in block.anchors if Link(a, "").names_author(host))
    by_word = filter(is_word_name, map(L.squeeze, block.strings()))
    return first_text(block, AUTHORS) or next(by_link, "") or next(by_word, NO_AUTHOR)


def timestamps_of(block: Node) -> Iterator[str]:
    """Candidates in order of trust."""
    for s in DATES:
        for n in block.select(s):
            yield L.timestamp_of(" ".join(n.strings()))
    a = primary_anchor(block)
    if a is not None and a.up is not None:
        yield L.timestamp_of(" ".join(a.up.strings()))
    some = [L.squeeze(x) for x in block.strings()[:40]]
    yield L.timestamp_of(" | ".join(some))
    yield from map(L.timestamp_of, some)


def timestamp_of(block: Node) -> str:
    return next(filter(None, timestamps_of(block)), NO_DATE)


def opener_of(page: Node, blocks: list[tuple[str, Node]], marks: Marks, host: str) -> Node | None:
    """The first post of page one when it has no number: the best element before the first block, up to six levels up."""
    if not blocks or blocks[0][0] not in ("2", ""):
        return None
    title, taken, known, best, top = title_of(page), [n for _, n in blocks], {}, None, float("-inf")

    def fit(node: Node) -> float:
        text, own = node.text, node.classes.lower()
        if node.tag in NO_OPENER_TAGS or any(x in own for x in OPENER_NOT) or not 80 <= len(text) <= 12000 or text == title:
            return float("-inf")
        if marks.count("numbers", node) or marks.count("permalinks", node) > 1 or any(b.holds(node) for b in taken):
            return float("-inf")
        key = (node.said_first, node.said_last, *(node.span(s) for s in (*AUTHORS, *DATES, *CONTENTS, "a[href]")))
        if key not in known:
            dated = timestamp_of(node) != NO_DATE
            known[key] = {**said(text), "content characters": len(content_of(node).text), "author": author_of(node, host) != NO_AUTHOR, "date": dated, "date in text": not dated and bool(L.timestamp_of(text))}
        return score(known[key] | {"block element": node.tag in OPENER_TAGS}, OPENER_WEIGHTS)

    at, depth = blocks[0][1], 0
    while at is not None and at.tag not in OUTER and depth < 6:
        for sibling in at.up.kids if at.up is not None else ():
            if sibling is at:
                break
            for node in (sibling, *sibling.nodes()) if isinstance(sibling, Node) else ():
                if (value := fit(node)) > top:
                    best, top = node, value
        at, depth = at.up, depth + 1
    return best if top >= OPENER_LEAST else None


def blocks_of(page: Node, number: int, host: str, marks: Marks) -> list[tuple[str, Node]]:
    """(label, block) of a page's posts by number; of several blocks of a label the longest, the first of equals.

    Without any such block the containers of other post links count, in document order.
    """
    found: dict[str, tuple[int, Node]] = {}
    for a in marks.numbers:
        if (block := container_of(a, marks)) is not None:
            label, size = identity_of(block, "")[1], len(block.markup)
            if label and (label not in found or size > found[label][0]):
                found[label] = (size, block)
    blocks = sorted(((k, n) for k, (_, n) in found.items()), key=lambda x: (len(x[0].lstrip("0")), x[0].lstrip("0")))
    if not blocks:
        other = {n.first: n for a in marks.permalinks if (n := container_of(a, marks)) is not None}
        blocks = [(identity_of(n, "")[1], n) for n in other.values()]
    opener = opener_of(page, blocks, marks, host) if number == 1 else None
    return [("1", opener), *blocks] if opener is not None else blocks


def layout_lines(node: Node) -> list[str]:
    """Lines as shown: breaks and block elements end lines, at most two empty lines in a row."""
    parts: list[str] = []
    todo: list[Node | str] = list(reversed(node.kids))
    while todo:
        x = todo.pop()
        if not isinstance(x, Node):
            parts.append(x)
        elif x.tag in ("br", "img"):
            parts.append("\n" if x.tag == "br" else " ")
        else:
            todo.append("\n\n" if x.tag in DOUBLE_BREAK else "\n" if x.tag in SINGLE_BREAK else "")
            todo.extend(reversed(x.kids))
    out: list[str] = []
    for raw in "".join(parts).replace("\xa0", " ").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = L.squeeze(raw)
        if line or out[-2:] != ["", ""]:
            out.append(line)
    return out


def body_of(node: Node, timestamp: str, label: str) -> str:
    """Text of a content element.

    A line ``Quoting ...`` opens a quotation that an empty line or ``Ignored`` ends; its lines get ``> ``.
    """
    out: list[str] = []
    quoting = False

    def gap() -> None:
        if out and out[-1]:
            out.append("")

    def say(line: str) -> None:
        if not (quoting and out and out[-1] == line):
            out.append(line)

    for line in layout_lines(node):
        low = line.lower()
        if not line:
            quoting = False
            gap()
        elif low.startswith("quoting "):
            gap()
            quoting = True
            out.append(f"> {line}")
        elif low == "ignored":
            quoting = False
            gap()
        elif low != "disliked":
            if "{quote}" in low:
                line = L.squeeze(re.sub(r"\{quote\}", "", line, flags=re.I))
            if line.lower().startswith("attached image"):
                mark = "> {image}" if quoting else L.PLACEHOLDER
                if not out or out[-1] != mark:
                    out.append(mark)
            elif line and not L.is_noise(line, timestamp, label):
                say(f"> {line}" if quoting else line)
    kept: list[str] = []
    before = None
    for line in out:
        if line == "" or line != before:
            kept.append(line)
        before = line
    return "\n".join(L.single_blanks(kept)).strip()


def image_url(page_url: str, src: str) -> str:
    """Absolute url; a thumbnail of an attached image is the image."""
    url = absolute(page_url, src)
    return url.replace("/thumbnail", "") if "/attachment/image/" in url and "/thumbnail" in url else url


def source_of(img: Node) -> str:
    return next((img.attrs[k] for k in ("data-src", "data-lazy-src", "src") if img.attrs.get(k)), "")


def is_icon(img: Node, url: str) -> bool:
    about = " ".join((url, img.attrs.get("alt", ""), img.attrs.get("title", ""))).lower()
    return any(h in about for h in ICON_HINTS)


def file_row(a: Node, root: Node, label: str) -> Node | None:
    """The short element around a file link that tells its size or downloads."""
    node = a
    while node is not None and node is not root:
        text, low = node.text, node.text.lower()
        if len(text) <= 300 and label in text and ("downloads" in low or "file type:" in low or L.SIZE.search(text)):
            return node
        node = node.up if len(text) <= 300 else None  # an outer element is no shorter
    return None


def attachments_of(root: Node, page_url: str) -> list[str]:
    """Labels of link attachments, then of files with size and downloads; all of them leave the tree."""
    labels, gone, links = [], [], [Link(a, page_url) for a in root.anchors]
    for x in links:
        if x.is_attachment and not x.is_file:
            gone.append(x.node)
            if (name := x.text or x.label).lower() not in NO_LABELS:
                labels.append(name)
    for x in links:
        if not x.is_file or x.label.lower() in NO_LABELS:
            continue
        row = file_row(x.node, root, x.label)
        told = [n.text for n in (row, x.node.up) if n is not None]
        facts = [L.squeeze(f) for t in told for p in (L.SIZE, L.DOWNLOADS) for f in p.findall(t)]
        labels.append(" | ".join(dict.fromkeys([x.label, *facts])))
        gone.append(row or x.node)
    gone += [img for img in root.select("img") if is_icon(img, absolute(page_url, source_of(img)))]
    for node in gone:
        node.remove()
    for node in (root, *root.nodes()):
        node.kids = [k for k in node.kids if isinstance(k, Node) or not L.HEADING.fullmatch(L.squeeze(k))]
    return labels


def split_signature(content: Node) -> tuple[Node, Node | None]:
    """(body, signature) as copies: what follows the first rule among its siblings, and signature elements."""
    body, sign = content.copy(), Node("div", {})
    rule = next(iter(body.select("hr")), None)
    if rule is not None:
        parent = rule.up
        at = next(i for i, k in enumerate(parent.kids) if k is rule)
        for kid in parent.kids[at + 1 :]:
            if isinstance(kid, Node) or kid.strip():
                sign.add(kid)
        parent.kids = parent.kids[:at]
        body.number()
    for node in body.select("[class*=signature]") + body.select("[id*=signature]"):
        if node.up is not None:
            node.remove()
            sign.add(node)
    return body.number(), sign.number() if sign.kids else None


def images_of(content: Node, page_url: str) -> list[str]:
    """Absolute urls of shown images, then of links to images, in order."""
    shown = ((img, image_url(page_url, source_of(img))) for img in content.select("img") if source_of(img))
    return [url for img, url in shown if not is_icon(img, url)] + [x.url for x in (Link(a, page_url) for a in content.anchors) if x.shows_image]


def post_of(label: str, block: Node, page_url: str, host: str) -> dict:
    ident, number, url = identity_of(block, page_url)
    number, time = number or label, timestamp_of(block)
    content = content_of(block)
    body, sign = split_signature(content)
    return {
        "label": label,
        "post_id": ident,
        "post_number": number,
        "post_url": url,
        "author": author_of(block, host),
        "timestamp": time,
        "labels": attachments_of(body, page_url) + (attachments_of(sign, page_url) if sign else []),
        "body": body_of(body, time, number),
        "signature": body_of(sign, NO_DATE, "") if sign else "",
        "pictures": images_of(content, page_url),
        "raw_html": block.markup,
    }


def finished(block: Callable[[str], Column]) -> list[Column]:
    """Columns of a post of a page as its table has it: lines cleaned, lists without repeats and without the page's own furniture."""
    some = lambda x: F.filter(x, lambda v: v != "")
    return [
        *(block(c).alias(c) for c in ("label", "post_id", "post_number", "post_url", "author", "timestamp")),
        strip_attachment_artifacts(normalize_multiline(block("body"))).alias("body_text"),
        dedupe_all_lines(dedupe_consecutive_lines(strip_attachment_artifacts(normalize_multiline(block("signature"))))).alias("signature_text"),
        F.array_distinct(some(F.transform(block("labels"), normalize_space))).alias("attachment_labels"),
        F.array_distinct(F.filter(block("pictures"), lambda u: (u != "") & ~should_skip_image(u))).alias("image_urls"),
        block("raw_html").alias("raw_html"),
    ]


def finished_link(link: Column) -> Column:
    """A link with its normalised url and the page that the url names."""
    page = F.regexp_extract(link["url"], r"[?&]page=([0-9]{1,9})(?:[&#]|$)", 1)
    return F.struct(link["href"].alias("href"), normalize_thread_url(link["url"]).alias("url"), F.when(page != "", page.cast("int")).alias("page"), link["text"].alias("text"))


def parse_html(html: str | None, page: int | None, page_url: str | None) -> dict:
    """Title, links and posts of a page, as its tree has them."""
    root, url = tree(html), page_url or ""
    host, marks = host_of(url), Marks(root)
    return {
        "title": title_of(root),
        "links": [{"href": href, "url": absolute(url, href), "text": a.text} for a in root.anchors if (href := a.attrs["href"].strip())],
        "blocks": [post_of(label, b, url, host) for label, b in blocks_of(root, page or 0, host, marks)],
    }


#: Characters of HTML that are parsed and handed back at a time; one longer page is a slice alone.
SLICE = 1 << 20


def slices(batch: pd.DataFrame, limit: int = SLICE) -> Iterator[pd.DataFrame]:
    """Rows in their order, so many at a time that their HTML stays within the limit."""
    begin = total = 0
    for i, html in enumerate(batch.html):
        size = len(html) if isinstance(html, str) else 0
        if i > begin and total + size > limit:
            yield batch.iloc[begin:i]
            begin, total = i, 0
        total += size
    yield batch.iloc[begin:]


def raw_trees(raw_pages: DataFrame) -> DataFrame:
    """What the trees of raw pages yield, before columns apply their rules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows = [parse_html(h, None if pd.isna(p) else int(p), u) for h, p, u in zip(batch.html, batch.page, batch.page_url)]
            yield pd.concat([batch[["thread_id", "page", "page_url"]].reset_index(drop=True), pd.DataFrame(rows, columns=["title", "links", "blocks"])], axis=1)

    return raw_pages.select("thread_id", "page", "page_url", "html").mapInPandas(run, RAW)


def parse_pages(raw_pages: DataFrame) -> DataFrame:
    """One row per page of raw pages (thread_id, page, page_url, html); no shuffle.  Pages without HTML have no blocks.

    A Python worker makes the tree and finds posts in it; numbers, urls, lines and lists are columns over what it found.  Where only posts are read, ``posts_of_pages`` computes fewer of them.
    """
    return raw_trees(raw_pages).select("thread_id", "page", "page_url", "title", F.transform("links", finished_link).alias("links"), expected_numbers(F.col("links")).alias("expected"), F.transform("blocks", lambda b: F.struct(*finished(lambda c: b[c]))).alias("blocks"))


def last_page() -> Column:
    """Of a parsed page: the largest page that its links to the same thread name, null if none does."""
    place = lambda u: F.lower(F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+:(//[^?#]*)", 1), "/+$", ""))
    own = place(F.trim("page_url"))
    number = lambda x: F.coalesce(x["page"], F.when(x["text"].rlike("^[0-9]{1,9}$"), x["text"].cast("int")))
    found = F.array_compact(F.transform(F.filter("links", lambda x: place(x["url"]) == own), number))
    return F.when(F.size(found) > 0, F.greatest(F.array_max(found), F.col("page")))


def posts_of(parsed: DataFrame) -> DataFrame:
    """Judged posts of parsed pages, with composed text and ``raw_html``."""
    return _judged(parsed.select("thread_id", "page", F.inline("blocks")))


def posts_of_pages(raw_pages: DataFrame) -> DataFrame:
    """The rows of ``posts_of(parse_pages(raw_pages))``.  Posts become rows before their rules apply, so that only columns that are read are computed, each once."""
    each = raw_trees(raw_pages).select("thread_id", "page", F.inline("blocks"))
    return _judged(each.select("thread_id", "page", *finished(F.col)))


def _judged(each: DataFrame) -> DataFrame:
    out = each.withColumn("text", compose_text(F.col("body_text"), F.col("attachment_labels"), F.col("signature_text"))).withColumn("images", F.array().cast("array<string>"))
    return judged_posts(out.drop("label"))


def validated_pages(parsed: DataFrame) -> DataFrame:
    """(thread_id, page, validation) without a shuffle: a page's posts are still nested in its row."""
    signals = lambda b: (b["post_id"] != "").cast("int") + (b["post_number"] != "").cast("int") + (b["timestamp"] != NO_DATE).cast("int")
    some = lambda b: (compose_text(b["body_text"], b["attachment_labels"], b["signature_text"]) != "") | (F.size(b["image_urls"]) > 0)
    good = F.filter("blocks", lambda b: (signals(b) >= 2) & some(b))
    labels = F.filter(F.transform(good, lambda b: b["post_number"]), lambda x: x != "")
    unknown = F.size(F.filter(good, lambda b: b["timestamp"] == NO_DATE))
    told = parsed.withColumn("__good", F.size(good))
    return told.select("thread_id", "page", validation_of(F.col("page"), F.col("expected"), labels, F.col("__good"), F.size("blocks") - F.col("__good"), unknown).alias("validation"))
