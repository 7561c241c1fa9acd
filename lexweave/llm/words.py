"""Cutting texts into the pieces that byte-level BPE merges within."""

from __future__ import annotations

import re

import regex

#: The splitting pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The same pattern for texts of ASCII without \x1c-\x1f and of Latin letters only, where the faster engine's classes agree.
_FAST = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LATIN}]")
_FULL = regex.compile(PATTERN)


def pieces(text: str) -> list[str]:
    """The pieces of a text, in order; joined they are the text."""
    return _FULL.findall(text) if _OTHER.search(text) else _FAST.findall(text)
