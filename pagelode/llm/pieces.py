"""Splitting of texts into pieces before merges, and a bounded memory of what pieces become."""

from __future__ import annotations

import re

import public_tokenizers

PATTERN = public_tokenizers.PATTERN
#: White space, letters and numbers up to U+024F; their classes are the same in every Unicode version.
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: White space as the splitting libraries know it, whatever the version of the regex module.
_ALL_SPACE = r"\t-\r \x85\xa0  -     　"

plain = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*").fullmatch


def splitter(pattern: str):
    """text -> its pieces. Plain texts under the usual pattern go through the standard module, which is twice as fast."""
    import regex

    explicit = pattern.replace(r"[^\s", f"[^{_ALL_SPACE}").replace(r"\S", f"[^{_ALL_SPACE}]").replace(r"\s", f"[{_ALL_SPACE}]")
    full = regex.compile(explicit).findall
    if pattern != PATTERN:
        return full
    quick = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    ).findall
    return lambda text: quick(text) if plain(text) else full(text)


class Memo(dict):
    """Piece -> what encode makes of it, in two generations of bounded size."""

    def __init__(self, encode, most: int = 200_000):
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece):
        got = self.old.get(piece)
        if got is None:
            got = self.encode(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got
