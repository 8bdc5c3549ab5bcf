"""Cuts of a text at which byte-level BPE with the usual pre-token pattern can be split safely.

A pre-token holds a space only at its start, so a text may be cut before any space
that a non-space follows: the parts' tokens, joined, are the whole text's tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Python's white space holds all that the pattern's does, so each cut is safe.
CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")


def cut(text: str) -> list[str]:
    """Parts of `text`; all but the first have lost their leading space."""
    return CUT.split(text) if text[:1].isspace() or _ODD.search(text) else text.split(" ")


class PartCache(dict):
    """Encoded parts by their text without the leading space; cleared when it reaches `limit`."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = 400_000, longest: int = 64):
        self.encode, self.limit, self.longest = encode, limit, longest

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(" " + part)
        if len(part) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = cut(text)
        head = self.encode(first) if first else b""
        return head + b"".join(map(self.__getitem__, rest))
