"""Text folding shared by the corpus operators."""

from __future__ import annotations

import re
import unicodedata

COMBINING = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
WORD = re.compile(r"[^\W_]+")


def _byte(c: str) -> int:
    try:
        return c.encode("cp1252")[0]
    except UnicodeError:
        return ord(c)


# characters that stand for the bytes 80..BF when UTF-8 is read as a one-byte encoding
_TAIL = "".join(re.escape(c) for c in {chr(b) for b in range(0x80, 0xC0)} | {bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xC0)} if c)
MANGLED = re.compile(f"[ÂÃ][{_TAIL}]|â[€\x80][{_TAIL}]")


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte encoding, sequence by sequence."""
    if "Ã" in text or "Â" in text or "â" in text:
        return MANGLED.sub(lambda m: bytes(map(_byte, m.group())).decode("utf-8", "replace"), text)
    return text


def fold(text: str) -> str:
    """Without case and accents; compatibility forms are spelled out."""
    if text.isascii():
        return text.lower()
    return COMBINING.sub("", unicodedata.normalize("NFKD", text)).lower()


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case and accents."""
    return WORD.findall(fold(text))
