"""Pieces of a byte-level tokenizer's splitting rule, found by array operations over whole batches of UTF-8 bytes.

The rule is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`. Whether a piece starts at a character depends on the four characters before
it and the one after it only, so the rule is a transducer with a finite window and any cut of a text can be judged from that much context.

Which characters are letters, digits and white space is asked of the tokenizer library itself, once a code point: libraries differ in their edition of Unicode.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import pre_tokenizers

LETTER, DIGIT, SPACE, OTHER, EDGE, UNKNOWN = range(6)
#: Characters of context that judge a cut.
BEFORE, AFTER = 4, 1
_S, _T, _M, _D, _R, _V, _L, _E = b"stmdrvle"


class Splitter:
    def __init__(self) -> None:
        self.ask = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[0xD800:0xE000] = OTHER  # half a surrogate pair is no text

    def learn(self, points: np.ndarray) -> None:
        """Kinds of code points not met before: a character that stays in one piece between two letters is a letter, and so on."""
        for kind, mate in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")):
            points = points[self.kind[points] == UNKNOWN]
            if len(points):
                pieces = self.ask.pre_tokenize_str("".join(f"\n{mate}{chr(p)}{mate}\n" for p in points.tolist()))
                starts = np.array([span[0] for _, span in pieces])
                self.kind[points[~np.isin(np.arange(len(points)) * 5 + 2, starts)]] = kind
        self.kind[points[self.kind[points] == UNKNOWN]] = SPACE

    def starts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Byte places where pieces start. data: UTF-8 of all texts, one after another. edges: ascending byte places where texts start, and the end of the last; nothing
        reaches over an edge."""
        if not len(data):
            return np.zeros(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        more = np.concatenate([data, np.zeros(3, np.uint8)])
        lead = data[at]
        points = lead.astype(np.int32)
        for low, high, mask, tail in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            if len(found := np.flatnonzero((lead >= low) & (lead < high))):
                value = points[found] & mask
                for k in range(1, tail + 1):
                    value = value << 6 | more[at[found] + k] & 0x3F
                points[found] = np.minimum(value, 0x10FFFF)
        kind = self.kind[points]
        if (unknown := kind == UNKNOWN).any():
            self.learn(np.unique(points[unknown]))
            kind = self.kind[points]
        n = len(at)
        first = np.searchsorted(at, edges[(edges >= 0) & (edges < len(data))])
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        edge[0] = edge[n] = True
        before = np.concatenate([[EDGE], kind[:-1]]).astype(np.uint8)
        before[edge[:-1]] = EDGE
        after = np.concatenate([kind[1:], [EDGE]]).astype(np.uint8)
        after[edge[1:]] = EDGE
        blank = np.concatenate([[False], points[:-1] == 32]) & (before != EDGE)
        start = np.where(kind == SPACE, (before != SPACE) | ((after != SPACE) & (after != EDGE)), (before != kind) & ~blank)
        start |= edge[:-1]
        marks = np.flatnonzero((points == 39) & start & ~edge[1:])
        if len(marks):
            near = np.concatenate([points, [0, 0]])
            one, two = near[marks + 1], np.where(edge[np.minimum(marks + 2, n)], 0, near[marks + 2])
            short = (one == _S) | (one == _T) | (one == _M) | (one == _D)
            long = ((one == _R) | (one == _V)) & (two == _E) | (one == _L) & (two == _L)
            start[marks[short | long] + 1] = False
            for found, width in ((marks[short], 2), (marks[long], 3)):
                ends = found + width
                start[ends[ends < n]] = True
        return at[start]


def pieces(data: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The pieces that begin at these places, as indices into the distinct ones."""
    offsets = np.concatenate([starts, [len(data)]]).astype(np.int32)
    array = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return array.dictionary_encode()


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, their offsets) of a string column; null counts as the empty text."""
    column = column.fill_null("").cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
