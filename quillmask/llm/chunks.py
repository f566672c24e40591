"""Encoding of whole texts by pre-tokens that are remembered: most of them have been met before.

The merges of byte-level BPE never cross the matches of the splitting pattern, so the ids of the matches, joined, are the
ids of the text. What is remembered bounds memory, not results: it has two generations, and the older one goes when the
younger is full.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Pre-tokens of more characters are encoded each time that they occur.
LONGEST = 48
#: Pre-tokens of a generation: two take about 130 MB of a worker.
REMEMBERED = 400_000


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


@lru_cache(1)
def odd_characters() -> str:
    """Characters up to U+FFFF whose class (letter, number, white space, other) isn't the same for the two libraries of expressions."""
    import regex

    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    pairs = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    return "".join(sorted(set().union(*(set(regex.findall(a, everything)) ^ set(re.findall(b, everything)) for a, b in pairs))))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of a pattern of the regex library in a text. Where the standard library's classes are the same, its expressions are quicker."""
    import regex

    whole = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in plain:
        return whole
    ascii_, other = re.compile(plain, re.ASCII).findall, re.compile(plain).findall
    odd = re.compile(f"[{re.escape(odd_characters())}\U00010000-\U0010ffff]").search

    def split(text: str) -> list[str]:
        if text.isascii():
            return ascii_(text) if not odd_ascii(text) else whole(text)
        return whole(text) if odd(text) else other(text)

    odd_ascii = re.compile(r"[\x1c-\x1f]").search
    return split


class Chunked(dict):
    """Packed ids by pre-token. `split` gives a text's pre-tokens, `encode` the ids of one of them."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[str], list[int]], remembered: int = REMEMBERED):
        self.split, self.encode_one, self.room = split, encode, remembered
        self.older: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            ids = packed(self.encode_one(token))
        if len(token) <= LONGEST:
            self[token] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The text's ids, packed."""
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text or "")))
