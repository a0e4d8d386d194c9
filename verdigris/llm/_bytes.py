"""Numpy helpers over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from verdigris.llm._shared import ship

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: One random value per byte, for polynomial hashes modulo 2**64.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, for i under n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column and its n + 1 offsets, without copying. Nulls must have been replaced."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes together, one document at least."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space (or the bytes marked in `between`), A-Z lower-cased, and each document's range of words."""
    own = LOWER[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    white = between[own]
    before, after = np.empty_like(white), np.empty_like(white)
    before[0], before[1:] = True, white[:-1]
    after[-1], after[:-1] = True, white[1:]
    edges = at[:-1][at[:-1] < len(own)]
    before[edges] = True
    after[edges[edges > 0] - 1] = True
    start, end = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    up, down = powers(len(own))
    total = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[own] * up, out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(start, at)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its word shingles; a document with fewer words has its whole sequence as one."""
    for lo, hi in slices(offsets):
        words, at = word_hashes(data, offsets[lo : hi + 1])
        n = max(0, len(words) - width + 1)
        grams = words[:n].copy()
        for j in range(1, width):
            grams = mix(grams + np.uint64(0xA0761D6478BD642F)) + words[j : n + j]
        grams = mix(grams)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                h = np.array([b - a], np.uint64)
                for j in range(a, b):
                    h = mix(h + np.uint64(0xE7037ED1A0B428DB)) + words[j : j + 1]
                yield mix(h)
            else:
                yield np.zeros(0, np.uint64)


ship(__name__)
