"""Vectorised fingerprints of words, word shingles and byte strings: two independent lanes of 64 bits each.

Every step adds eight bytes (or a word's fingerprint) to the mixed state, state = mix(state) + next, with mix a bijection that spreads every bit. So
nothing is linear in the bytes, and patterns that defeat sums of powers modulo 2^64 (Thue-Morse words) are as good as random ones. Two unequal things agree in
both lanes with a chance of about 2^-128, in one with 2^-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Different starts make different lanes.
_SEEDS = np.random.Generator(np.random.PCG64(20240131)).integers(1, 1 << 63, (2, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: _MASK[n] keeps the first n bytes of a window.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are digested one by one.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def windows(data: bytes) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros after the end."""
    return np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))


class Strings:
    """Fingerprints of substrings of one text, in one lane."""

    def __init__(self, data: bytes, lane: int):
        self.seeds = _SEEDS[lane]
        self.dense = {8: windows(data)}

    def _pieces(self, width: int) -> np.ndarray:
        """Fingerprints of `width` bytes (a power of two) from every position on."""
        if width not in self.dense:
            half = self._pieces(width // 2)
            n = max(0, len(half) - width // 2)
            made = mix(half[:n] + self.seeds[width.bit_length() - 4])
            made += half[width // 2 : width // 2 + n]
            self.dense[width] = made
        return self.dense[width]

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints of the `width` bytes from each start on; all of them must lie in the text."""
        piece = min(32, 1 << max(3, width.bit_length() - 1))
        if width < 8:
            return mix((self.dense[8][starts] & _MASK[width]) + self.seeds[7])
        dense = self._pieces(piece)
        acc = np.full(len(starts), self.seeds[6], np.uint64)
        for k in [*range(0, width - piece, piece), width - piece]:  # the last piece ends with the string
            acc = mix(acc)
            acc += dense[starts + k]
        return mix(acc)


def words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+."""
    gap = np.ones(len(text) + 2, bool)
    gap[1:-1] = SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[0::2], edges[1::2]


def _hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two rows, one for each lane; a column for each word."""
    out = np.zeros((2, len(starts)), np.uint64)
    if not len(starts):
        return out
    size, window = ends - starts, windows(text)
    first = window[starts] & _MASK[np.minimum(size, 8)]
    for lane in (0, 1):
        out[lane] = mix(first + _SEEDS[lane, 0] * (size + 1).astype(np.uint64))
    for k in range(8, _LONG, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        part = window[starts[more] + k] & _MASK[np.minimum(size[more] - k, 8)]
        for lane in (0, 1):
            out[lane, more] = mix(out[lane, more] + part)
    for i in np.flatnonzero(size > _LONG):
        out[:, i] = np.frombuffer(hashlib.blake2b(text[starts[i] : ends[i]], digest_size=16).digest(), np.uint64)
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """A fingerprint of each word, first lane."""
    return _hashes(text, *words(text))[0]


def _shingled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every run of `width` words, both lanes."""
    n = max(0, hashes.shape[1] - width + 1)
    out = np.empty((2, n), np.uint64)
    for lane in (0, 1):
        acc = np.full(n, _SEEDS[lane, 1] ^ np.uint64(width), np.uint64)
        for j in range(width if n else 0):
            acc = mix(acc)
            acc += hashes[lane, j : n + j]
        out[lane] = mix(acc)
    return out


def distinct(pairs: np.ndarray) -> np.ndarray:
    """Distinct columns of two lanes in ascending order."""
    if pairs.shape[1] < 2:
        return pairs
    pairs = pairs[:, np.argsort(pairs[0])]
    same = pairs[0, 1:] == pairs[0, :-1]
    if not same.any():
        return pairs
    if (same & (pairs[1, 1:] != pairs[1, :-1])).any():  # the first lane alone does not tell them apart
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        same = (pairs[:, 1:] == pairs[:, :-1]).all(axis=0)
    return pairs[:, np.r_[True, ~same]]


def batches(sizes: list[int], most: int = 1 << 16) -> list[tuple[int, int]]:
    """(from, to) of runs of texts that together have about `most` bytes: enough for one call of numpy to pay, few enough to stay in its cache."""
    out, start, size = [], 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most or i + 1 == len(sizes):
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text its distinct shingles, ascending, as two lanes; fewer words than width make one shingle, none make none."""
    out: list[np.ndarray] = []
    for a, b in batches([len(t) for t in texts]):
        data = b" ".join(texts[a:b])
        starts, ends = words(data)
        hashes = _hashes(data, starts, ends)
        at = np.searchsorted(starts, np.r_[0, np.cumsum([len(t) + 1 for t in texts[a:b]])])
        every = _shingled(hashes, width)
        for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if last - first >= width:
                out.append(distinct(every[:, first : last - width + 1]))
            else:
                out.append(_shingled(hashes[:, first:last], last - first) if last > first else np.zeros((2, 0), np.uint64))
    return out
