"""Terms of a text: runs of digits, letters A-Z (lower-cased) and all characters beyond ASCII."""

from __future__ import annotations

#: What becomes of each byte of a UTF-8 text: separators turn into spaces, A-Z into a-z.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: The same class as a pattern for lower-cased texts, in Java's and RE2's form.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: str | None) -> bytes:
    """UTF-8 bytes of a text with every separator as a space; a null text is an empty one."""
    return (text or "").encode().translate(TABLE)
