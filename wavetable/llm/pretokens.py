"""Pre-tokenisation shared by the encoder and the token counter."""

from __future__ import annotations

import unicodedata

import regex

#: Up to here every code point has been assigned, with one general category, in all Unicode versions in use.
SETTLED = "ɏ"
#: Pre-tokens that a worker remembers, and characters of one at most; longer ones are worked out each time.
REMEMBERED, LONGEST = 400_000, 64


def settled(text: str) -> bool:
    """Whether libraries built on different Unicode versions classify every character alike.

    Texts with unassigned code points are left whole to the library at hand.
    """
    if text.isascii() or max(text) <= SETTLED:
        return True
    return all(unicodedata.category(c) != "Cn" for c in set(text))


class Pieces(dict):
    """What ``make`` gives for a pre-token, made once while it stays in the cache."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, piece: str):
        out = self._make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


def splitter(pattern: str):
    """``findall`` of the pattern."""
    return regex.compile(pattern).findall
