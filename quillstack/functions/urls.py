"""URL and image-name functions as columns."""

from __future__ import annotations

import unicodedata
from urllib.parse import uses_netloc, uses_params

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.functions.text import WS, filled, let, slugify, squeeze

#: Parts of urls of images that are no content, and extensions of images.
SKIP_HINTS = ("avatar", "smiley", "emoji", "icon", "logo", "sprite", "blank", "spacer", "pixel")
IMAGE_EXTENSION = r"(?i)\.(?:jpg|jpeg|png|gif|webp|bmp|svg)(?:\?|$)"
#: Media types by extension.
MIME = (("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"), ("gif", "image/gif"), ("webp", "image/webp"), ("bmp", "image/bmp"), ("svg", "image/svg+xml"), ("html", "text/html"), ("txt", "text/plain"), ("pdf", "application/pdf"))


#: Scheme, rest with authority, authority, path, query and fragment of a url.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?((?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?)$"
#: An address in brackets: groups of hexadecimal digits, a gap, an older address at the end, a zone; or an address of a later version.
_GROUP, _OLD = "[0-9A-Fa-f]{1,4}", r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _bracketed() -> str:
    """Pattern of what may stand in brackets, by the number of groups before and after a gap."""
    forms = [f"(?:{_GROUP}:){{7}}{_GROUP}", f"(?:{_GROUP}:){{6}}{_OLD}"]
    for before in range(8):
        left = f"(?:{_GROUP}(?::{_GROUP}){{{before - 1}}})?" if before == 1 else f"{_GROUP}(?::{_GROUP}){{{before - 1}}}" if before else ""
        left = _GROUP if before == 1 else left
        most = 7 - before
        tail = [""] + [f"{_GROUP}(?::{_GROUP}){{{n - 1}}}" for n in range(1, most + 1)] + [f"(?:{_GROUP}:){{{n}}}{_OLD}" for n in range(0, most - 1)]
        forms.append(f"{left}::(?:{'|'.join(tail)})")
    return rf"(?:(?:{'|'.join(forms)})(?:%[^%]+)?|v[0-9A-Fa-f]+\.[\s\S]+)"


def _like_marks() -> str:
    """Characters that stand for one of ``/?#@:`` in their compatibility form: no authority may hold one."""
    return "".join(chr(c) for c in range(0x2000, 0x10000) if not 0xD800 <= c < 0xE000 and set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:"))


MARKS, BRACKETED = f"[{_like_marks()}]", f"^[^\\[]*\\[{_bracketed()}\\]"


def _decoded(c: Column) -> Column:
    """A parameter's part as text: plus signs are blanks, a per cent sign without two digits stands for itself."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_thread_url(url: Column) -> Column:
    """Without page number and fragment; equal parameters side by side, in order of their first ones, encoded anew.  What is no url only loses blanks at its ends."""

    def query(raw: Column) -> Column:
        """The parameters in their new order, joined."""
        pairs = F.transform(F.filter(F.split(raw, "&"), lambda x: x != ""), lambda x: F.struct(_decoded(F.regexp_extract(x, "^[^=]*", 0)).alias("k"), _decoded(F.regexp_extract(x, r"^[^=]*=([\s\S]*)$", 1)).alias("v")))
        kept = F.filter(pairs, lambda x: x["k"] != "page")
        of = lambda rows, name: F.transform(F.filter(rows, lambda x: x["k"] == name), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"])))
        return let(kept, lambda rows: F.array_join(F.flatten(F.transform(F.array_distinct(F.transform(rows, lambda x: x["k"])), lambda name: of(rows, name))), "&"))

    def whole(u: Column) -> Column:
        part = lambda n: F.regexp_extract(u, PARTS, n)
        scheme, host = F.lower(part(1)), part(3)
        path = F.when(scheme.isin(*uses_params, ""), F.regexp_replace(part(4), r"^((?:[\s\S]*/)?[^;/]*);$", "$1")).otherwise(part(4))
        path = F.when((host != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
        rooted = path.startswith("//") | (scheme.isin(*(x for x in uses_netloc if x)) & ((path == "") | path.startswith("/")))
        place = F.when(host != "", F.concat(F.lit("//"), host, path)).when(rooted, F.concat(F.lit("//"), path)).otherwise(path)
        out = let(query(part(5)), lambda q: F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), place, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
        opens, closes = host.contains("["), host.contains("]")
        odd = (opens != closes) | (opens & closes & ~host.rlike(BRACKETED)) | F.replace(F.replace(host, F.lit(":"), F.lit("")), F.lit("@"), F.lit("")).rlike(MARKS)
        return F.when(odd, F.lit(None).cast("string")).otherwise(F.regexp_replace(out, r"\?+$", ""))

    stripped = F.regexp_replace(filled(url), f"^{WS}|{WS[4:]}$", "")
    clean = lambda x: F.translate(F.regexp_replace(x, r"^[\x00-\x20]+", ""), "\t\r\n", "")
    return let(stripped, lambda x: F.coalesce(let(clean(x), whole), x))


def page_url(normal_url: Column, page: Column) -> Column:
    """Url of a page of an already normalised thread url; page one is the url itself."""
    mark = F.when(normal_url.contains("?"), "&").otherwise("?")
    return F.when(page > 1, F.concat(normal_url, mark, F.lit("page="), page.cast("string"))).otherwise(normal_url)


def thread_key(normal_url: Column) -> Column:
    """Slug of the last part of the path."""
    path = F.regexp_replace(F.regexp_extract(normal_url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    return slugify(F.element_at(F.split(path, "/"), -1))


def normalize_image_url(url: Column) -> Column:
    """Thumbnails of attached images become the image."""
    return F.when(url.contains("/attachment/image/") & url.contains("/thumbnail"), F.replace(url, F.lit("/thumbnail"), F.lit(""))).otherwise(url)


def should_skip_image(url: Column) -> Column:
    return F.lower(filled(url)).rlike("|".join(SKIP_HINTS))


def is_image_url(url: Column) -> Column:
    return filled(url).rlike(IMAGE_EXTENSION)


def guess_extension(url: Column) -> Column:
    """Extension of the path, at most five characters with its dot, else ``.jpg``."""
    path = F.regexp_extract(filled(url), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    found = F.lower(F.regexp_extract(name, r"[^.].*(\.[^.]+)$", 1))
    return F.when((found != "") & (F.length(found) <= 5), found).otherwise(".jpg")


def mime_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in MIME:
        out = F.when(extension == k, v).otherwise(out)
    return out


def is_outside(plain: Column) -> Column:
    """An inline content or a web address, by its lower-cased beginning."""
    low = F.lower(plain)
    return low.startswith("data:") | low.startswith("http://") | low.startswith("https://")


def data_uri(path: Column, content: Column) -> Column:
    """Inline form of a local image; urls and paths without content stay as they are.

    ``base64`` breaks lines unless ``spark.sql.chunkBase64String.enabled`` is off, so breaks are removed here.
    """
    plain = squeeze(path)
    payload = F.translate(F.base64(content), "\r\n", "")
    return F.when((plain == "") | is_outside(plain) | content.isNull(), plain).otherwise(F.concat(F.lit("data:"), mime_type(plain), F.lit(";base64,"), payload))
