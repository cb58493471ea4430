"""Words of whole Arrow batches as 64-bit hashes, by array operations on
the UTF-8 bytes.  A batch is taken in pieces of a few megabytes, so that
the arrays in a task stay small; a text is never cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text goes alone).
PIECE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants from a counter."""
    at = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(at) | np.uint64(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[48:58] = _LETTERS[97:123] = _LETTERS[128:] = True
_SPACED = np.ones(256, dtype=bool)
_SPACED[[32, 9, 10, 11, 12, 13]] = False
_BYTE = constants(256, 7)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Words:
    """Words of some texts: ``first[i]:first[i + 1]`` are those of text i;
    ``start``/``end`` are byte places in ``data`` (lower-cased)."""

    rows: slice
    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def string(self, a: int, b: int) -> str:
        """Words a to b (exclusive), joined by one space."""
        return " ".join(self.data[s:e].tobytes().decode("utf-8", "replace")
                        for s, e in zip(self.start[a:b], self.end[a:b]))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[slice]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield slice(a, min(b, n))
        a = min(b, n)


def words(texts: pa.Array, letters: bool, limit: int = PIECE_BYTES) -> Iterator[Words]:
    """Hashed words, piece by piece: of letters, digits and non-ASCII bytes,
    or of everything between ASCII white space; A-Z lower-cased."""
    offsets, everything = utf8(texts)
    table = _LETTERS if letters else _SPACED
    for rows in pieces(offsets, limit):
        at = offsets[rows.start:rows.stop + 1]
        data = _LOWER[everything[at[0]:at[-1]]]
        at = at - at[0]
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = table[data]
        begins = np.empty(len(data) + 1, dtype=bool)
        begins[1:] = inside[1:] & ~inside[:-1]
        begins[0] = inside[0]
        cut = at[1:-1]
        cut = cut[cut < len(data)]
        begins[cut] = inside[cut]  # a word does not run into the next text
        start = np.flatnonzero(begins[:-1])
        body = np.flatnonzero(inside[:-1])
        slot = np.searchsorted(body, start)
        size = np.diff(np.append(slot, len(body)))
        end = start + size
        place = np.arange(len(body)) - np.repeat(slot, size)
        power = np.ones(int(place.max()) + 1 if len(place) else 1, dtype=np.uint64)
        power[1:] = _BASE
        power = np.cumprod(power, dtype=np.uint64)
        value = _BYTE[data[body]] * power[place]
        total = np.add.reduceat(value, slot) if len(slot) else np.zeros(0, np.uint64)
        yield Words(rows, data, np.searchsorted(start, at), start, end,
                    mix(total + size.astype(np.uint64) * _BYTE[1]))


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of every k consecutive words (also across texts; the caller
    keeps those inside one text)."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, dtype=np.uint64)
    for j, c in enumerate(constants(k, 1000 + seed)):
        total += hashes[j:j + n] * c
    return mix(total + np.uint64(k))
