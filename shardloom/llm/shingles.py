"""Word shingles of texts as 64-bit hashes, for a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np

# Blanks: space and the control characters 9 to 13. A-Z to a-z. All else belongs to words.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 9, 10, 11, 12, 13]] = True

_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer than ``width`` words, but not none, is one shingle; one without words has none.
    Texts are hashed a megabyte at a time; one very long text is a piece of its own.
    """
    out, piece, size = [], [], 0
    for text in texts:
        piece.append(text)
        size += len(text) + 1
        if size >= _SLICE:
            out += _piece(piece, width)
            piece, size = [], 0
    return out + (_piece(piece, width) if piece else [])


def in_slices(sets: list[np.ndarray], most: int = _SLICE):
    """Lists of some sets in a row with about ``most`` hashes together."""
    held, size = [], 0
    for s in sets:
        held.append(s)
        size += len(s)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _piece(texts: list[bytes], width: int) -> list[np.ndarray]:
    joined = np.frombuffer(b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    inside = np.r_[False, ~IS_BLANK[joined]]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in texts]
    lengths = ends - starts
    # A word's hash is the sum of its bytes' random numbers, each times a power of its place.
    chars = np.flatnonzero(inside[1:])
    values = _BYTES[joined[chars]] * powers(_STEP, int(lengths.max()))[chars - np.repeat(starts, lengths)]
    words = mix(np.add.reduceat(values, np.r_[0, np.cumsum(lengths)[:-1]]) + lengths.astype(np.uint64))
    first = np.searchsorted(starts, np.r_[0, ends_of_text])
    whole = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j in range(width):
        whole += words[j : j + len(whole)] * np.uint64(pow(_STEP, 2 * j + 1, 1 << 64))
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            short = words[a:b] * powers(_STEP, 2 * width)[1 : 2 * (b - a) : 2]
            # The word count keeps a short text apart from shingles.
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
