"""Words, lines and shingles, as every operator of this package reads them.

A word is a run of characters other than space and U+0009 to U+000D.  On UTF-8
bytes that is exactly what ``bytes.split()`` yields.
"""

from __future__ import annotations

#: Java and RE2 syntax.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
HASH_SEED = 42


def code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased (``bytes.lower`` leaves the rest alone)."""
    return line.strip(SPACES).lower()
