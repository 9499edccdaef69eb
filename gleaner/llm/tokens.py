"""Token ids of whole texts with a cache of pre-tokens.

Byte-pair encoding works inside pre-tokens, so a text's ids are those of its pre-tokens in order.
Texts made only of common white space, ASCII and Latin letters (below U+0237) are cut into pre-tokens
here with numpy, and every distinct pre-token is encoded once by the tokenizers library's model; a
text with any other character (where normalisation or character classes could differ), or with what may be
the string of an added token, is encoded whole by the library. Both ways give the ids of
Tokenizer.from_file(path).encode(text, add_special_tokens=False); the tests compare them with it.

Which cutting is right follows from the file's normaliser, pre-tokeniser and model; a file with others than
the two known here is always encoded whole. A pre-token is found by one 64-bit hash and must agree in a second
one, of other values; a text in which one doesn't is encoded whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from . import grams

#: Distinct pre-tokens kept before the cache starts anew; bounds it at about 100 MB.
CACHE = 800_000
#: Characters of text handled at once; a longer text is handled alone.
SLICE_CHARS = 1 << 17

_END = 0x237
_LETTER, _NUMBER, _SPACE, _OTHER, _FOREIGN = 1, 2, 3, 4, 9


def _class(code: int) -> int:
    c = chr(code)
    if c in "\t\n\r ":
        return _SPACE
    kind = unicodedata.category(c)
    if kind[0] == "C" or kind[0] == "Z" or code >= _END or len(c.lower()) > 1 or ord(c.lower()) >= _END:
        return _FOREIGN
    return {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)


_CLASS = np.array([*(_class(k) for k in range(_END)), _FOREIGN], np.uint8)
_LOWER = np.array([ord(chr(k).lower()) if _CLASS[k] != _FOREIGN else k for k in range(_END + 1)], np.uint32)
_VALUE = grams.stream(21, _END + 1)
_CHECK = grams.stream(22, _END + 1)
#: The parts of a file for which the cutting here is right, by kind; "words" is lower case without white space.
_KNOWN = {
    "bytes": (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}),
    "words": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
            ],
        },
    ),
}


def _plain(part):
    """A part of a file without offsets' settings, which don't change ids."""
    if isinstance(part, dict):
        return {k: _plain(v) for k, v in part.items() if k != "trim_offsets"}
    return [_plain(x) for x in part] if isinstance(part, list) else part


def kind_of(file: dict) -> str | None:
    """"bytes" (a leading space belongs to its word), "words" (lower case, white space dropped), or None: encode whole."""
    model = file["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        return None
    if file.get("truncation") or file.get("padding") or file.get("post_processor"):
        return None
    for kind, (normalizer, cutter) in _KNOWN.items():
        if _plain(file["normalizer"]) == normalizer and _plain(file["pre_tokenizer"]) == cutter:
            return kind
    return None
#: The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_IN = {b: chr(b) if b in _KEPT else chr(256 + sum(x not in _KEPT for x in range(b))) for b in range(256)}


class _Table:
    """A hash table from 64-bit keys to numbers in flat arrays, 12 bytes a slot, looked up for many keys at once."""

    def __init__(self, most: int):
        self.mask = (1 << (2 * most).bit_length()) - 1
        self.keys, self.values, self.used = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for unknown ones. Keys aren't 0."""
        out, at, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slots(keys)
        while len(at):
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            at, slot = at[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, first: int) -> None:
        """Numbers different unknown keys from first on."""
        at, slot = np.arange(len(keys)), self._slots(keys)
        self.used += len(keys)
        while len(at):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.values[slot[won]] = keys[at[won]], first + at[won]
            on = np.ones(len(at), bool)
            on[won] = False
            at, slot = at[on], (slot[on] + 1) & self.mask


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.kind = kind_of(parts)
        # The first two characters, in either case, of each added token: a text that has them is encoded whole.
        self.added = {tuple(ord(c) for c in x["content"][:2].lower()) for x in parts.get("added_tokens") or []}
        del parts
        self.whole = Tokenizer.from_file(path)
        self.model, self.size, self.spaced = self.whole.model, self.whole.get_vocab_size(), self.kind == "bytes"
        self.clear()

    def clear(self) -> None:
        self.known = _Table(CACHE + SLICE_CHARS)
        self.n = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count, self.check = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.uint64)

    def _learn(self, word: str, check: np.uint64) -> None:
        text = word.encode().decode("latin-1").translate(_STAND_IN)
        ids, k = [x.id for x in self.model.tokenize(text)], self.n
        if k == len(self.start):
            self.start, self.count, self.check = (np.resize(x, 2 * k) for x in (self.start, self.count, self.check))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[k], self.count[k], self.check[k] = self.used, len(ids), check
        self.used += len(ids)
        self.n += 1

    def _cut(self, code: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of pre-tokens; at: where texts start, and the end."""
        n = len(code)
        edge = np.zeros(n + 4, bool)
        edge[at] = True
        start = edge[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        padded, kinds = np.concatenate([code, [0, 0, 0]]), np.concatenate([kind, [0, 0, 0]])
        quote = np.flatnonzero(start & (code == 39))
        quote = quote[(kinds[quote + 1] == _LETTER) & ~edge[quote + 1]]
        if self.spaced and len(quote):
            quote = quote[edge[quote] | (code[quote - 1] != 32)]
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b)) & ~edge[quote + 2]
        start[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        after = after[after < n]
        start[after] |= kind[after] == _LETTER
        if self.spaced:
            spaces = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n]) if n else np.zeros(0, np.int64)
            start[spaces] = True
            start[spaces[code[spaces] == 32] + 1] = False
        else:
            start |= kind == _NUMBER
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        if not self.spaced:
            keep = kind[begin] != _SPACE
            begin, end = begin[keep], end[keep]
        return begin, end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32."""
        if self.kind is None:
            return [self._library(t) for t in texts]
        if self.n > CACHE:
            self.clear()
        code = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(_END))
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        kind = _CLASS[code]
        foreign = set(np.searchsorted(at, np.flatnonzero(kind == _FOREIGN), "right").tolist())
        for pair in self.added:
            low = _LOWER[code]
            found = low == pair[0]
            if len(pair) > 1:
                found[:-1] &= low[1:] == pair[1]
                found[-1:] = False
            foreign.update(np.searchsorted(at, np.flatnonzero(found), "right").tolist())
        if not self.spaced:
            code = _LOWER[code]
        begin, end = self._cut(code, kind, at)
        up, down = grams._powers(len(code))
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(_VALUE[code] * up, out=total[1:])
        hashed = grams.mix((total[end] - total[begin]) * down[begin])
        np.cumsum(_CHECK[code] * up, out=total[1:])
        check = (total[end] - total[begin]) * down[begin]
        group, keys = pd.factorize(np.where(hashed == 0, np.uint64(1), hashed))
        found = self.known.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.n + len(new) > CACHE + SLICE_CHARS:  # one text with very many pre-tokens
                self.clear()
                found[:], new = -1, np.arange(len(keys))
                if len(keys) > CACHE + SLICE_CHARS:
                    self.known = _Table(len(keys))
            first = np.zeros(len(keys), np.int64)
            first[group[::-1]] = np.arange(len(group))[::-1]
            found[new] = self.n + np.arange(len(new))
            self.known.add(keys[new], self.n)
            for i in first[new].tolist():
                self._learn(code[begin[i] : end[i]].tobytes().decode("utf-32-le"), check[i])
        which = found[group] if len(group) else np.zeros(0, np.int64)
        foreign.update(np.searchsorted(at, begin[self.check[which] != check], "right").tolist())
        count = self.count[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.start[which] - ends[:-1], count) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(begin, at)]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in foreign:
            out[k - 1] = self._library(texts[k - 1])
        return out

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that the cache serves all of its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, coder: Encoder) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, ids of each text) for bounded runs of rows; null counts as the empty text."""
    i = 0
    texts: list[str] = []
    size = 0
    for k in range(len(column)):
        text = column[k].as_py() or ""
        if texts and size + len(text) > SLICE_CHARS:
            yield i, coder.encode(texts)
            i, texts, size = k, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield i, coder.encode(texts)
