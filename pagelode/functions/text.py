"""Token estimates and sentences as SQL functions, and packing under a budget as one pass over the parts of a text.

Greedy packing: a buffer grows while the estimates sum to the budget at most; it is then flushed, and kept if its own estimate
reaches the minimum. A paragraph above the budget is packed by sentences. A buffer is a list of parts, joined once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TOKENS, MIN_TOKENS, CHARS_PER_TOKEN = 512, 10, 4
#: Characters that are trimmed from parts.
_BLANK = "' \\t\\n\\r\\u000b\\u000c\\u00a0\\u0085\\u2028\\u2029'"
_TRIMMED = " \t\n\r\v\f\xa0\x85\u2028\u2029"
#: White space of Unicode, as the SQL functions have it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SENTENCE_END = re.compile(f"(?<=[.!?])[{_SPACE}]+")


def _tokens(x: str, utf16: bool) -> str:
    length = f"length(encode({x}, 'UTF-16BE')) / 2" if utf16 else f"length({x})"
    return f"cast(floor(({length}) / {CHARS_PER_TOKEN}) as int)"


def _sentences(x: str) -> str:
    return f"filter(transform(split({x}, r'(?<=[.!?])(?U)\\s+'), s -> btrim(s, {_BLANK})), s -> s <> '')"


def estimate_tokens(text: str, utf16: bool = False) -> Column:
    """A quarter of the characters, rounded down. utf16 counts characters beyond the basic plane twice."""
    return F.expr(_tokens(text, utf16))


def sentences(text: str) -> Column:
    """Cut behind . ! ? where white space follows; trimmed, blanks dropped."""
    return F.expr(_sentences(text))


def tokens_of(text: str, utf16: bool = False) -> int:
    return (len(text.encode("utf-16-be", "surrogatepass")) // 2 if utf16 else len(text)) // CHARS_PER_TOKEN


def _parts(pieces) -> list[str]:
    return [x for x in (p.strip(_TRIMMED) for p in pieces) if x]


def _packed(parts: list[str], joint: str, most: int, least: int, utf16: bool, large=None) -> list[str]:
    """large: what becomes of a part above the budget; without it such a part is a buffer of its own."""
    out, held, size = [], [], 0

    def flush():
        if held:
            text = joint.join(held)
            if tokens_of(text, utf16) >= least:
                out.append(text)
            held.clear()

    for part in parts:
        n = tokens_of(part, utf16)
        if large and n > most:
            flush()
            out += large(part)
            size = 0
            continue
        if held and size + n > most:
            flush()
            size = 0
        held.append(part)
        size += n
    flush()
    return out


def chunked(text: str | None, most: int = MAX_TOKENS, least: int = MIN_TOKENS, utf16: bool = False) -> list[str]:
    """The chunks of one section's text."""
    text = (text or "").strip(_TRIMMED)
    if not text:
        return []
    if tokens_of(text, utf16) <= most:
        return [text] if tokens_of(text, utf16) >= least else []
    by_sentence = lambda p: _packed(_parts(_SENTENCE_END.split(p)), " ", most, least, utf16)
    return _packed(_parts(text.split("\n\n")), "\n\n", most, least, utf16, by_sentence)


def chunk_texts(text: str, most: int = MAX_TOKENS, least: int = MIN_TOKENS, utf16: bool = False) -> Column:
    """The chunks of a text column, arrays of strings."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunked(t if isinstance(t, str) else None, most, least, utf16))

    return chunks(F.col(text))


def with_heading(heading: str | None, text: str) -> str:
    """The heading above the text, or the text alone; the heading isn't counted in the budget."""
    return f"{heading}\n\n{text}" if heading and heading.strip(" ") else text
