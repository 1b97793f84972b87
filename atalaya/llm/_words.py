"""Words and word shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a run of bytes other than space and bytes 9 to 13; A-Z count as a-z. A word's hash is a polynomial in the
values of its bytes, taken from differences of one running sum over a piece. Pieces are cut between texts, at about PIECE
bytes, so that the arrays by byte, eight bytes and more each, stay small whatever the caller gives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._common import pieces

U = np.uint64
#: Bytes of texts that are hashed at once; with a space for each text still within the least table of powers.
PIECE = 3 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES[_SPACE] = 0
#: Multipliers of the words of a shingle by place.
_PLACES = mix(np.arange(1, 65, dtype=U) * U(0xA24BAED4963EE407)) | U(1)
_powers = (np.ones(1, U), np.ones(1, U))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 1 << 24:  # not kept: a single very long text
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


@dataclass
class Words:
    """hashes, first and end byte of each word, and the range of words (n + 1 bounds) of each text."""

    hashes: np.ndarray
    first: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of texts whose bytes are data[offsets[i]:offsets[i + 1]]; first and end count from the start of data."""
    parts, bounds, n = [], [np.zeros(1, np.int64)], 0
    for i, j in pieces(offsets, PIECE):
        w = _piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append((w.hashes, w.first + offsets[i], w.end + offsets[i]))
        bounds.append(w.bounds[1:] + n)
        n += len(w.hashes)
    if not parts:
        return _piece(data, offsets)
    return Words(*map(np.concatenate, zip(*parts, strict=True)), np.concatenate(bounds))


def _piece(data: np.ndarray, offsets: np.ndarray) -> Words:
    n, lens = len(offsets) - 1, np.diff(offsets)
    at = offsets[:-1] + np.arange(n)  # each text is followed by one space
    spaced = np.full(len(data) + n, 32, np.uint8)
    if len(data):
        spaced[np.arange(len(data)) + np.repeat(np.arange(n), lens)] = data
    space = _SPACE[spaced]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, end = edge[::2], edge[1::2]
    up, down = _power(len(spaced) + 1)
    total = np.zeros(len(spaced) + 1, U)
    np.cumsum(_VALUES[spaced] * up[: len(spaced)], out=total[1:])
    hashes = mix((total[end] - total[first]) * down[first])
    bounds = np.searchsorted(first, np.append(at, len(spaced)))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    return Words(hashes, first - owner, end - owner, bounds)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, across text borders too; empty with fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = hashes[:n] * _PLACES[0]
    for k in range(1, size):
        out += hashes[k : k + n] * _PLACES[k]
    return mix(out + U(size))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; with fewer words than size the whole sequence is one; none without words."""
    w = words(data, offsets)
    every, out = shingles(w.hashes, size), []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - size + 1]) if b - a >= size else shingles(w.hashes[a:b], b - a) if b > a else np.zeros(0, U))
    return out
