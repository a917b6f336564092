"""Text helpers for code that already runs per row, as the page parser does.  The columns of ``text`` are tested against the line functions here."""

from __future__ import annotations

import html
import re
from itertools import groupby

#: Sequences left by a wrong decoding, and what they stood for, longest first where they overlap.
MOJIBAKE = (
    ("â€™", "’"),
    ("â€˜", "‘"),
    ("â€œ", "“"),
    ("â€\x9d", "”"),
    ("â€“", "–"),
    ("â€”", "—"),
    ("â€¦", "…"),
    ("Â ", " "),
    ("Â\xa0", " "),
    ("\ufeff", ""),
)


def _cp1252() -> dict[int, str]:
    table = {}
    for code in range(0x80, 0xA0):
        try:
            table[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            continue  # five codes have no character: they stay
    return table


CP1252 = _cp1252()
#: What any repair of a resolved text starts from: without it the text is whole.
SPOILT = re.compile("[\x80-\x9f\ufeff\u00c2]|\u00e2\u20ac")
#: Where an image stands in a text, and how files and times are written on pages.
PLACEHOLDER = "[[POST_IMAGE]]"
SIZE = re.compile(r"\b\d+(?:\.\d+)?\s*(?:KB|MB|GB|bytes?)\b", re.I)
DOWNLOADS = re.compile(r"\b\d+[\d,]*\s+downloads\b", re.I)
HEADING = re.compile(r"Attached File\(s\)", re.I)
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
TIMESTAMP_PATTERN = MONTH + r"\s+\d{1,2},\s+(?:\d{4}\s+)?\d{1,2}:\d{2}(?:am|pm)(?:\s*\([^)]*\))?"
TIMESTAMP = re.compile(TIMESTAMP_PATTERN, re.I)


def repair(text: str | None) -> str:
    """Entities resolved, control codes and wrongly decoded sequences repaired."""
    out = html.unescape(text or "")
    if not SPOILT.search(out):
        return out
    out = out.translate(CP1252)
    for bad, good in MOJIBAKE:
        out = out.replace(bad, good)
    return out


def squeeze(text: str | None) -> str:
    """Repaired text on one line with single blanks."""
    return " ".join(repair(text).split())


def trim_blanks(lines: list[str]) -> list[str]:
    """Without empty lines at either end."""
    a, b = 0, len(lines)
    while a < b and lines[a] == "":
        a += 1
    while b > a and lines[b - 1] == "":
        b -= 1
    return lines[a:b]


def single_blanks(lines) -> list[str]:
    """Runs of empty lines become one, none at the ends."""
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return trim_blanks(out)


def multiline(text: str | None) -> str:
    return "\n".join(single_blanks(squeeze(x) for x in (text or "").splitlines()))


def _keyed(text: str | None) -> list[tuple[str, str]]:
    """(squeezed line, line without blanks at its end) of every line."""
    return [(squeeze(x), x.rstrip()) for x in (text or "").splitlines()]


def drop_echoes(text: str | None) -> str:
    """Without lines equal to the line directly before; an empty line in between lets a repeat stay."""
    runs = ((key, list(same)) for key, same in groupby(_keyed(text), key=lambda x: x[0]))
    return "\n".join(trim_blanks([line for key, same in runs for _, line in (same[:1] if key else same)]))


def distinct_lines(text: str | None) -> str:
    """First occurrence of each line; lines of which nothing is left when squeezed are empty ones, and runs of these become one."""
    rows = _keyed(text)
    first = {key: i for i, (key, _) in reversed(list(enumerate(rows)))}
    return "\n".join(single_blanks(line if key else "" for i, (key, line) in enumerate(rows) if not key or first[key] == i))


def attachment_artifact(line: str) -> bool:
    """A line that only describes an attached file."""
    return bool(line == "|" or line.lower().startswith("file type:") or HEADING.fullmatch(line) or SIZE.fullmatch(line) or DOWNLOADS.fullmatch(line))


def without_artifacts(text: str | None) -> str:
    lines = (squeeze(x) for x in (text or "").splitlines())
    return "\n".join(single_blanks(x for x in lines if not attachment_artifact(x)))


def timestamp_of(text: str | None) -> str:
    """All timestamps of a text, neighbours that are equal once, joined."""
    out: list[str] = []
    for x in map(squeeze, TIMESTAMP.findall(text or "")):
        if not out or out[-1] != x:
            out.append(x)
    return " | ".join(out)


def is_stats(line: str) -> bool:
    low = line.lower()
    return low.startswith("| joined ") or ("joined " in low and "posts" in low)


#: Whole lines of the page's own interface.
INTERFACE = frozenset(("quote", "reply to thread", "subscribe", "more", "top of page", "image", "disliked", "ignored"))


def is_noise(line: str, timestamp: str, label: str) -> bool:
    """Not part of what the author wrote.  A line equal to the author's name is kept."""
    plain = squeeze(line)
    if not line or line.lower() in INTERFACE or is_stats(line) or re.fullmatch(r"\d+", line):
        return True
    return (timestamp != "Unknown date" and plain == squeeze(timestamp)) or bool(label and plain.startswith(f"# {label}"))


def sections(body: str | None, text: str | None, labels, signature: str | None) -> tuple[str, list[str], list[str]]:
    """Body, attachments and signature lines of a post for export."""
    attached = [x for x in map(squeeze, labels if labels is not None else ()) if x]
    signed = [x for x in multiline(signature).splitlines() if x]
    kept = []
    for line in multiline(body or text).splitlines():
        head, mark, rest = squeeze(line).partition(":")
        if mark and head in ("Attachment", "Sig"):
            if rest.strip():
                (attached if head == "Attachment" else signed).append(rest.strip())
        else:
            kept.append(line.rstrip())
    return "\n".join(kept).strip(), list(dict.fromkeys(attached)), list(dict.fromkeys(x for x in map(squeeze, signed) if x))
