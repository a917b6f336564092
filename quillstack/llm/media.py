"""Interleaved documents: ordered text and media references, with payloads resolved by digest.

``parse`` turns a page's HTML into one sequence of items in reading order: a text item per
block of text, and a media item per image, whose caption is the figure's caption or else its alternative
text.  A media item names its payload by digest (``sha256:...``) and holds no bytes.  ``store``
keeps payloads as 8-bit samples in the portable grey-map format, 64 samples a row, each
payload once per task.  ``features`` reads the stored bytes back and describes them;
``resolve`` joins a digest's description to every reference, so positions and captions stay with their
items, and a payload that many documents share travels as one short row.

Defined cases: null HTML or text is empty.  A reference whose digest is not stored
keeps its position and caption with a null payload.  Repeated rows give repeated sequences.  Text without any tag is one
text item; blank text is none.  Empty tables give no rows.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.batches import bounded, small_batches, texts
from quillstack.staging import Stage

ROW = 64
#: Elements that begin or end a block of text, and elements whose text is not shown.
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead title tr ul".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))

ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class Interleaved(HTMLParser):
    """Collects (kind, text, digest, caption) in reading order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: list[dict] | None = None
        self.captioning = False

    def flush(self) -> None:
        said = " ".join("".join(self.words).split())
        self.words = []
        if not said:
            return
        if self.captioning and self.figure:
            for item in self.figure:
                item["caption"] = said
        else:
            self.items.append({"kind": "text", "text": said, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "img":
            self.flush()
            at = dict(attrs)
            item = {"kind": "media", "text": None, "digest": (at.get("src") or "").removeprefix("sha256:") or None, "caption": (at.get("alt") or "").strip() or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag in BLOCKS or tag == "figcaption":
            self.flush()
            if tag == "figure":
                self.figure = []
            self.captioning = tag == "figcaption" or self.captioning

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS or tag == "figcaption":
            self.flush()
            if tag == "figcaption":
                self.captioning = False
            elif tag == "figure":
                self.figure, self.captioning = None, False

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words.append(data)


def interleaved(html: str | None) -> list[dict]:
    """Items of a page with their positions from 0."""
    for text in (html or "", (html or "").replace("<![", "&lt;![")):
        parser = Interleaved()
        try:
            parser.feed(text)
            parser.close()
            break
        except AssertionError:  # a marked section that the tokeniser does not know: taken as text
            continue
    parser.flush()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def parse(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items) with the ordered items of every page; a narrow job."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            items = pa.array([interleaved(h) for h in batch.column("html").to_pylist()], ITEMS)
            yield pa.RecordBatch.from_arrays([batch.column(0), items], names=[id_col, "items"])

    return pages.select(F.col(id_col), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"`{id_col}` {kind}, items array<{ITEM}>")


ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def payload_of(text: str) -> bytes:
    """UTF-8 bytes, filled with zeros up to a positive multiple of 64."""
    data = text.encode()
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b"\0")


def to_media(payload: bytes, n_bytes: int) -> bytes:
    """A binary grey map of the payload; a comment tells how many bytes were before filling."""
    return b"P5\n# bytes %d\n%d %d\n255\n" % (n_bytes, ROW, len(payload) // ROW) + payload


def from_media(media: bytes) -> tuple[int, bytes]:
    """(unfilled length, payload) of a stored grey map."""
    magic, comment, size, depth, samples = media.split(b"\n", 4)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not a grey map of 8-bit samples")
    return int(comment.split()[-1]), samples


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples, and the mean step to the next sample, as hundredths."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    n, step = len(x), int(np.abs(np.diff(x)).sum())
    total, square = int(x.sum()), int((x * x).sum())
    return f"{total * 100 // n}:{(square * n - total * total) * 100 // (n * n)}:{step * 100 // n}"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def store(docs: DataFrame, text_col: str) -> DataFrame:
    """(digest, media) of every text, each once per task; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: set[bytes] = set()
        for batch in bounded(batches):
            rows = {}
            for t in texts(batch.column(0)):
                d = digest_of(t)
                short = bytes.fromhex(d[:24])
                if short not in have:
                    rows[d] = to_media(payload_of(t), len(t.encode()))
                    if len(have) < 1 << 20:
                        have.add(short)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.binary())], names=["digest", "media"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "digest string, media binary")


def features(stored: DataFrame) -> DataFrame:
    """What the stored bytes say, one row per stored row; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0), batch.column(1)):
                media = media.as_py()
                n, payload = from_media(media)
                rows.append((digest.as_py(), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds)], names=names)

    return stored.mapInArrow(run, FEATURES)


def resolve(items: DataFrame, described: DataFrame, payload: str = "payload") -> DataFrame:
    """Every item (any columns with ``digest``) with its payload's description as one struct, null where there is none.

    A column of the items named like ``payload`` is replaced.
    """
    told = described.select("digest", F.struct(*(c for c in described.columns if c != "digest")).alias(payload))
    return items.select(*(c for c in items.columns if c != payload)).join(told, "digest", "left")


def media_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, position, kind, text, digest, caption), one row per item."""
    return parse(pages, id_col, html_col).select(id_col, F.inline("items"))


def page_of(text: str) -> str:
    """A page that shows a whole document: a paragraph per line, and between its halves a figure that stands for the document.

    The figure's caption tells the document's size.
    """
    lines = text.split("\n")
    figure = f'<figure><img src="sha256:{digest_of(text)}"><figcaption>{len(text)} characters in {len(lines)} lines</figcaption></figure>'
    half = len(lines) // 2
    return "".join([*(f"<p>{escape(x)}</p>" for x in lines[:half]), figure, *(f"<p>{escape(x)}</p>" for x in lines[half:])])


def documents_as_media(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption, n_items, text_chars).

    Each document becomes a page of its paragraphs around one figure; the text is the figure's payload.  The page is
    parsed into its ordered items, the payload is stored and read back, and the digest joins them.  ``position`` and ``caption`` are
    the figure's; ``n_items`` and ``text_chars`` count all items and the characters of the text items among them.
    """
    small_batches(spark)
    stage = Stage(spark, "media")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            items = pa.array([interleaved(page_of(t)) for t in texts(batch.column(1))], ITEMS)
            yield pa.RecordBatch.from_arrays([batch.column(0), items], names=["doc_id", "items"])

    pages = docs.mapInArrow(run, f"doc_id long, items array<{ITEM}>")
    figure = F.get(F.filter("items", lambda x: x["kind"] == "media"), F.lit(0))
    chars = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x["text"]), F.lit(0)))
    refs = pages.select("doc_id", figure.alias("x"), F.size("items").alias("n_items"), chars.alias("text_chars")).select("doc_id", "x.digest", "x.position", "x.caption", "n_items", "text_chars")
    refs = stage.put("items", refs)
    stored = stage.put("stored", store(docs, "text"))
    described = features(stored)
    names = [c for c in described.columns if c != "digest"]
    described = stage.put("described", described.groupBy("digest").agg(F.min(F.struct(*names)).alias("x")).select("digest", "x.*"))
    return resolve(refs, described).select("doc_id", "payload.*", "position", "caption", "n_items", "text_chars")
