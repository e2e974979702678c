"""Cutting texts where no token can cross, for byte-level BPE vocabularies
with the usual letter / digit / symbol / white-space pattern.

A single space between two characters that are not white space always starts
a match of the pattern, so a text falls apart there into chunks that can be
tokenized, and remembered, one by one.  Texts with adjacent white space are
cut only at such single spaces.
"""
from __future__ import annotations

import re

from convgraph.llm.common import worker_cache

_ADJACENT = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Entries a worker's memo holds before it starts anew (a memory bound; the
#: results do not depend on it).
MEMO_ENTRIES = 400_000


def chunks(text: str) -> list[str]:
    """Pieces of the text; all but the first had one space in front."""
    return _SINGLE.split(text) if _ADJACENT.search(text) else text.split(" ")


_BEFORE_SINGLE = re.compile(r"(?<=\S)(?= \S)")


def spaced_chunks(text: str) -> list[str]:
    """The same pieces with their space in front; together they are the text."""
    if "\0" in text or _ADJACENT.search(text):
        return _BEFORE_SINGLE.split(text)
    return text.replace(" ", "\0 ").split("\0")


class Memo(dict):
    """Remembers fn(key); a key longer than ``longest`` is computed each time."""

    def __init__(self, fn, prefix: str = "", longest: int = 256):
        super().__init__()
        self.fn, self.prefix, self.longest = fn, prefix, longest

    def __missing__(self, key):
        value = self.fn(self.prefix + key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def trim(self, entries: int = MEMO_ENTRIES):
        if len(self) > entries:
            self.clear()


def memo(name: str, fn, prefix: str = "") -> Memo:
    """The worker-wide memo of that name (made on first use)."""
    box = worker_cache(name)
    if "memo" not in box:
        box["memo"] = Memo(fn, prefix)
    box["memo"].fn = fn
    return box["memo"]
