"""Words of whole texts as bytes, piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of text that are split into words at once.
PIECE = 1 << 22


def byte_table(digits: bool) -> bytes:
    """Letters to lower case, everything else but bytes of other scripts (and digits, if wanted) to a space."""

    def of(c: int) -> int:
        if 65 <= c <= 90:
            return c + 32
        return c if c >= 128 or 97 <= c <= 122 or digits and 48 <= c <= 57 else 32

    return bytes(map(of, range(256)))


def pieces(text: bytes | None, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Words of a text (null: none) by a table of :func:`byte_table`, some at a time; no word is cut."""
    plain, at = (text or b"").translate(table), 0
    while at < len(plain):
        end = plain.find(b" ", at + piece)
        end = len(plain) if end < 0 else end
        found = plain[at:end].split()
        if found:
            yield found
        at = end
