"""Tokens of texts in common scripts, cut in arrays of code points; they equal those of the expression in functions/text.py.

A text is plain if all its characters are: each has one lower-case character, and its class is the same in all versions of Unicode.
Texts with others (Greek's final sigma, combining marks, rare scripts) go by the expression.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as T

#: Latin letters with their signs, general punctuation, currency, ideographs and kana with their punctuation.
PLAIN = ((0x00, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20AC), (0x3000, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5))
#: Characters that are cut at once.
CHUNK = 1 << 20

_GONE, _SPACE, _WORD, _SINGLE = range(4)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What becomes of a character of the basic plane, and the class of that."""
    becomes, kind = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, np.uint8)
    accents = dict(zip(T.ACCENTED, T.PLAIN))
    for low, high in PLAIN:
        for code in range(low, high + 1):
            c = chr(code).lower()
            c = accents.get(c, c)
            group = unicodedata.category(c)
            becomes[code] = ord(c)
            if c in "\t\n\r" or group[0] == "Z":
                kind[code] = _SPACE
            elif group in ("Cc", "Cf", "Mn"):
                kind[code] = _GONE
            elif group[0] == "P" or (c.isascii() and not c.isalnum()) or 0x4E00 <= code <= 0x9FFF:
                kind[code] = _SINGLE
            else:
                kind[code] = _WORD
    return becomes, kind


_BECOMES, _KIND = _tables()


def is_plain(text: Column) -> Column:
    """Runs of ASCII pass without a look at the other ranges; the pattern neither goes back nor recurs."""
    others = "".join(rf"\x{{{max(low, 0x80):X}}}-\x{{{high:X}}}" for low, high in PLAIN)
    return text.rlike(rf"\A(?:[\x00-\x7F]++|[{others}]++)*+\z")


def cuts(size: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """[from, to) of rows whose sizes come to about `most` together."""
    upto = np.cumsum(size.astype(np.int64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """[from, to) of rows that have about CHUNK bytes together."""
    return cuts(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))


def _width(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int64)


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The texts' characters with a line end after each text, where texts end there, where tokens begin, and all tokens."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(t + "\n" for t in texts.to_pylist()).encode("utf-32-le"), np.uint32)
    kind = _KIND[codes]
    there = np.flatnonzero(kind != _GONE)  # what goes doesn't part a word
    kind = kind[there]
    begins = (kind == _SINGLE) | ((kind == _WORD) & np.concatenate([[True], kind[:-1] != _WORD]))
    held = kind >= _WORD
    out = _BECOMES[codes[there[held]]]
    width = _width(out)
    offsets = np.concatenate([(np.cumsum(width) - width)[begins[held]], [width.sum()]]).astype(np.int32)
    data = out.tobytes().decode("utf-32-le").encode("utf-8")
    found = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    return codes, np.cumsum(size + 1), there[begins], found


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of tokens of each plain text, and all tokens in order."""
    _, ends, at, found = _cut(texts)
    return np.diff(np.searchsorted(at, ends), prepend=0), found


def pieces(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Of each plain text its tokens as they stand and what lies between them, by turns, as token_pieces gives them; and its tokens.

    A word as it stands goes on to the next space or single character.
    """
    codes, ends, at, found = _cut(texts)
    kind = _KIND[codes]
    stops = np.flatnonzero((kind == _SPACE) | (kind == _SINGLE))
    to = np.where(kind[at] == _SINGLE, at + 1, stops[np.searchsorted(stops, at)])
    width = _width(codes)
    width[ends - 1] = 0
    upto = np.concatenate([[0], np.cumsum(width)])
    n = np.diff(np.searchsorted(at, ends), prepend=0)
    edges = np.concatenate([[0], np.cumsum(n)])
    firsts = 2 * edges + np.arange(len(n) + 1)
    offsets = np.empty(firsts[-1] + 1, np.int32)
    offsets[firsts[:-1]] = upto[np.concatenate([[0], ends[:-1]])]
    before = 2 * np.arange(len(at)) + np.repeat(np.arange(len(n)), n)
    offsets[before + 1], offsets[before + 2], offsets[-1] = upto[at], upto[to], upto[-1]
    data = "".join(texts.to_pylist()).encode()
    parts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    lists = lambda edges, values: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)
    return lists(firsts, parts), lists(edges, found)
