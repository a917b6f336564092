"""Text functions as columns, all of them in the JVM.

A text is taken apart with ``split`` and put together again, so that entities and lines are handled one by one without leaving the plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.functions import lines as L

#: White space as Python and HTML see it; ``\\s`` alone is ASCII in Java.
WS = r"(?U)[\s\x1c-\x1f]+"
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned, also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def repair_cp1252(c: Column) -> Column:
    """C1 control codes become the characters that Windows-1252 has there."""
    return F.translate(filled(c), "".join(map(chr, L.CP1252)), "".join(L.CP1252.values()))


def repair_sequences(c: Column) -> Column:
    """Wrongly decoded sequences, in the order of their table."""
    out = repair_cp1252(c)
    for bad, good in L.MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def _named() -> Column:
    """The characters of all named references by the first letter and the name, as the language's own table has them."""
    table: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        table.setdefault(name[0], {})[name] = value
    return F.from_json(F.lit(json.dumps(table)), "map<string,map<string,string>>")


#: Names that stand for themselves without a semicolon; the longest one counts.
BARE = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _numbered(reference: Column) -> Column:
    """The character of a numeric reference: Windows-1252 for control codes, a replacement for what is no character, nothing for what must not be used."""
    hexadecimal = F.lower(F.substring(reference, 2, 1)) == "x"
    digits = F.regexp_replace(reference, "^#[xX]?0*|;$", "")
    number = F.when(F.length(digits) > 7, F.lit(1 << 30)).otherwise(F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).cast("long"))
    decimal = F.when(F.length(digits) > 7, F.lit(1 << 30)).otherwise(F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("long")))

    def character(n: Column) -> Column:
        letter = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        nothing = n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        control = F.translate(letter, "".join(map(chr, L.CP1252)), "".join(L.CP1252.values()))
        return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(n.between(0x80, 0x9F), control).when(nothing, "").otherwise(letter)

    return let(F.when(hexadecimal, number).otherwise(decimal), character)


def _dereferenced(part: Column) -> Column:
    """What follows an ampersand, with the reference at its beginning resolved."""

    def resolved(reference: Column) -> Column:
        rest = lambda n: F.substr(part, n + 1)
        named = let(
            _named(),
            lambda table: F.coalesce(
                F.concat(F.try_element_at(F.try_element_at(table, F.substring(reference, 1, 1)), reference), rest(F.length(reference))),
                let(F.regexp_extract(reference, BARE, 0), lambda name: F.when(name != "", F.concat(F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), name), rest(F.length(name))))),
                F.concat(F.lit("&"), part),
            ),
        )
        plain = F.when(reference == "", F.concat(F.lit("&"), part))
        for name, letter in (("amp;", "&"), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("nbsp;", "\xa0")):
            plain = plain.when(reference == name, F.concat(F.lit(letter), rest(F.lit(len(name)))))
        return plain.when(reference.startswith("#"), F.concat(_numbered(reference), rest(F.length(reference)))).otherwise(named)

    return let(F.regexp_extract(part, REFERENCE, 0), resolved)


def html_unescape(c: Column) -> Column:
    """All character references resolved, named and numeric, with and without a semicolon."""
    whole = let(F.split(c, "&"), lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), _dereferenced), "")))
    return F.when(c.contains("&"), whole).otherwise(c)


def repair_mojibake(c: Column) -> Column:
    return repair_sequences(html_unescape(filled(c)))


def squeeze(c: Column) -> Column:
    """White space to single blanks, without repairing; stays in the JVM."""
    return F.trim(F.regexp_replace(filled(c), WS, " "))


def normalize_space(c: Column) -> Column:
    return squeeze(repair_mojibake(c))


def is_blank(c: Column) -> Column:
    """Whether nothing is left after repairing; a text with a letter or digit outside entities needs no repair to tell."""
    plain = F.regexp_replace(filled(c), r"&[#A-Za-z0-9]*;?|\x{C2}", "").rlike(r"[\p{L}\p{N}]")
    return normalize_space(F.when(plain, "x").otherwise(c)) == ""


def slugify(c: Column, max_len: int = 80) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(squeeze(c)), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(slug, 1, max_len)
    return F.when(cut == "", "thread").otherwise(cut)


def safe_filename(c: Column, max_len: int = 120) -> Column:
    ends = "^[._]+|[._]+$"
    name = F.regexp_replace(F.regexp_replace(filled(c), r"(?U)[^\w.\-]+", "_"), ends, "")
    name = F.substring(name, 1, max_len)
    name = F.regexp_replace(F.when(name == "", "file").otherwise(name), ends, "")
    return F.when(name == "", "file").otherwise(name)


def normalize_timestamp(c: Column) -> Column:
    """All timestamps, neighbours that are equal once, joined; empty if there is none."""
    found = F.transform(F.regexp_extract_all(filled(c), F.lit("(?iU)" + L.TIMESTAMP_PATTERN), F.lit(0)), squeeze)
    kept = F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1) != x))
    return F.array_join(kept, " | ")


def is_stats_line(line: Column) -> Column:
    low = F.lower(line)
    return (low.contains("joined ") & low.contains("posts")) | low.startswith("| joined ")


def is_noise_line(line: Column, timestamp: Column, label: Column) -> Column:
    """Blank, interface word, statistics, digits only, or an echo of the timestamp or label."""
    plain = squeeze(line)
    echo = (timestamp != "Unknown date") & (plain == squeeze(timestamp))
    labelled = (filled(label) != "") & plain.startswith(F.concat(F.lit("# "), filled(label)))
    return (line == "") | F.lower(line).isin(*sorted(L.INTERFACE)) | is_stats_line(line) | line.rlike(r"^(?U:\d+)$") | F.coalesce(echo, F.lit(False)) | labelled


def content_lines(text: Column, timestamp: Column, label: Column) -> Column:
    """Lines of a text that are not noise, joined again."""
    return F.array_join(F.filter(F.split(filled(text), "\n"), lambda x: ~is_noise_line(squeeze(x), timestamp, label)), "\n")


def attachment_label(label: Column, row_text: Column, url: Column) -> Column:
    """Label (else the file name of the url) with the sizes and download counts of its row."""
    name = F.regexp_replace(squeeze(label), r"^! ", "")
    name = F.when(name == "", F.element_at(F.split(F.regexp_extract(filled(url), r"^[^?#]*", 0), "/"), -1)).otherwise(name)
    row = squeeze(row_text)
    sizes = F.regexp_extract_all(row, F.lit("(?i)" + L.SIZE.pattern), F.lit(0))
    downloads = F.regexp_extract_all(row, F.lit("(?i)" + L.DOWNLOADS.pattern), F.lit(0))
    return F.array_join(F.concat(F.array(name), F.array_distinct(F.concat(sizes, downloads))), " | ")


def split_lines(c: Column) -> Column:
    """Lines of a text; a line end at its end opens no further line."""
    return let(F.split(filled(c), LINE_END), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def stripped_end(c: Column) -> Column:
    return F.regexp_replace(c, WS + "$", "")


def join_lines(x: Column) -> Column:
    """Lines as one text: runs of empty lines become one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.array_join(x, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def _known(c: str | Column, text: Column) -> Column:
    """A null text stays null."""
    return F.when((F.col(c) if isinstance(c, str) else c).isNotNull(), text)


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_multiline(c: str | Column) -> Column:
    """Every line normalised, runs of empty lines as one, none at the ends."""
    return _known(c, join_lines(F.transform(split_lines(_column(c)), normalize_space)))


def _keyed(c: Column) -> Column:
    """(key, line) of every line: as normalised, and without blanks at its end."""
    return F.transform(split_lines(c), lambda x: F.struct(normalize_space(x).alias("key"), stripped_end(x).alias("line")))


def dedupe_consecutive_lines(c: str | Column) -> Column:
    """Without lines equal to the line directly before; an empty line in between lets a repeat stay."""

    def kept(rows: Column) -> Column:
        stays = F.filter(rows, lambda x, i: (x["key"] == "") | (i == 0) | (F.get(rows, i - 1)["key"] != x["key"]))
        return F.regexp_replace(F.array_join(F.transform(stays, lambda x: x["line"]), "\n"), r"^\n+|\n+$", "")

    return _known(c, let(_keyed(_column(c)), kept))


def dedupe_all_lines(c: str | Column) -> Column:
    """First occurrence of each line; a line of which nothing is left when normalised is an empty one, and runs of these become one.

    Lines are sorted by key and place, so equal ones stand side by side.
    """

    def kept(rows: Column) -> Column:
        first = F.filter(rows, lambda x, i: (x["key"] == "") | (i == 0) | (F.get(rows, i - 1)["key"] != x["key"]))
        shown = F.transform(first, lambda x: F.struct(x["at"].alias("at"), F.when(x["key"] == "", "").otherwise(x["line"]).alias("line")))
        return join_lines(F.transform(F.sort_array(shown), lambda x: x["line"]))

    placed = F.sort_array(F.transform(_keyed(_column(c)), lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"), x["line"].alias("line"))))
    return _known(c, let(placed, kept))


def is_attachment_artifact(line: Column) -> Column:
    """A normalised line that only describes an attached file."""
    whole = "|".join(p.pattern for p in (L.HEADING, L.SIZE, L.DOWNLOADS))
    return (line == "|") | F.lower(line).startswith("file type:") | line.rlike(f"^(?iU:{whole})$")


def strip_attachment_artifacts(c: str | Column) -> Column:
    """Without the lines that describe attached files; every other line normalised."""
    return _known(c, join_lines(F.filter(F.transform(split_lines(_column(c)), normalize_space), lambda x: ~is_attachment_artifact(x))))


def export_sections(body: str | Column, text: str | Column, labels: str | Column, signature: str | Column) -> Column:
    """(body, attachments, signature) of a post for export: lines of the body that name an attachment or a signature go to the lists, which hold each value once."""
    some = lambda x: F.filter(x, lambda v: v != "")
    source = F.when(filled(_column(body)) != "", _column(body)).otherwise(filled(_column(text)))
    told = F.transform(split_lines(normalize_multiline(source)), lambda x: F.struct(x.alias("line"), normalize_space(x).alias("key")))
    attached = F.coalesce(F.transform(_column(labels), normalize_space), F.array().cast("array<string>"))
    signed = F.transform(split_lines(normalize_multiline(filled(_column(signature)))), normalize_space)

    def parted(rows: Column) -> Column:
        named = lambda head: F.transform(F.filter(rows, lambda x: x["key"].startswith(f"{head}:")), lambda x: F.trim(F.substr(x["key"], F.lit(len(head) + 2))))
        kept = F.filter(rows, lambda x: ~x["key"].rlike("^(?:Attachment|Sig):"))
        whole = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^\n+|\n+$", "")
        return F.struct(whole.alias("body"), F.array_distinct(some(F.concat(attached, named("Attachment")))).alias("attachments"), F.array_distinct(some(F.concat(signed, F.transform(named("Sig"), normalize_space)))).alias("signature"))

    return let(told, parted)


def compose_text(body: Column, labels: Column, signature: Column) -> Column:
    """Body, attachment lines and signature lines as one text, blank-line separated."""
    some = lambda c: F.when(filled(c) != "", c)
    attached = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("Attachment: "), x)), "\n")
    signed = F.array_join(F.transform(F.filter(F.split(filled(signature), "\n"), lambda x: squeeze(x) != ""), lambda x: F.concat(F.lit("Sig: "), x)), "\n")
    return F.concat_ws("\n\n", some(body), some(attached), some(signed))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
