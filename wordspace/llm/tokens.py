"""Words of letters and digits of a text in UTF-8, as bytes.

A 256-byte table lower-cases A-Z, keeps 0-9 and all bytes beyond ASCII, and blanks the rest;
what ``bytes.split`` then yields are the words. A long text is split in slices, so its words
never stand in memory all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
#: What each byte becomes.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
#: Bytes of a text split at once.
SLICE = 1 << 20


def word_lists(text: str | None, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from about ``size`` bytes each; null has none."""
    clean = (text or "").encode().translate(TABLE)
    begin = 0
    while begin < len(clean):
        end = len(clean)
        if begin + size < end:
            end = clean.rfind(b" ", begin + 1, begin + size)
            if end < 0:
                # One word fills the slice.
                end = clean.find(b" ", begin + size)
                end = len(clean) if end < 0 else end
        yield clean[begin:end].split()
        begin = end + 1
