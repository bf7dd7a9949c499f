"""A byte-pair tokenizer compiled into a deterministic transducer whose transitions carry how many tokens they add.

Every prefix of a piece has one last token. It is the only token that ends there, is its own encoding, and fits the last token of the prefix before it (two tokens fit
if they stay apart when their bytes are joined and encoded). So a state needs, for each suffix of what has been read that begins some token: the place of that suffix in
the trie of tokens, the last token before the suffix, and how many tokens that prefix has more or less than the whole. These tuples are finite in number, since a
suffix is shorter than the longest token; reading a byte turns one into the next, and the token count changes by a number that depends on state and byte only. States
are made when they are first met and the tables are emptied at a bound, so memory is bounded whatever the texts are.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np

_SHIFT, _ZERO = 12, 1 << 11  # a transition is next state << _SHIFT | tokens added + _ZERO


def alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one character: printable ones as they are, the others from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Transducer:
    def __init__(self, model: dict, most_states: int = 400_000) -> None:
        """model: the parsed JSON file of a byte-level tokenizer."""
        letters = alphabet()
        vocabulary: dict[str, int] = model["model"]["vocab"]
        self.entry: dict[int, bytes] = {n: bytes(letters[c] for c in word) for word, n in vocabulary.items() if all(c in letters for c in word)}
        self.single = {e[0]: n for n, e in self.entry.items() if len(e) == 1}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        self.special = {t["content"].encode() for t in model.get("added_tokens", [])}
        for t in model.get("added_tokens", []):
            self.entry.pop(t["id"], None)
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        for n, word in self.entry.items():
            node = 0
            for b in word:
                at = self.child.get(node << 8 | b)
                if at is None:
                    at = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = at
            self.token[node] = n
        self.most_states = most_states
        self.fitting: dict[int, bool] = {}
        self.empty()

    def empty(self) -> None:
        """Forgets all states but the first."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.steps: dict[int, int] = {}

    def encode(self, data: bytes) -> list[int]:
        """The definition: of all neighbours that merge, those of the least rank first, from the left."""
        out = [self.single[b] for b in data]
        while len(out) > 1:
            found = [self.merge.get(p, (1 << 60, -1)) for p in zip(out, out[1:], strict=False)]
            best = min(found)
            if best[1] < 0:
                break
            joined, k = [], 0
            while k < len(out):
                if k + 1 < len(out) and found[k] == best:
                    joined.append(best[1])
                    k += 2
                else:
                    joined.append(out[k])
                    k += 1
            out = joined
        return out

    def fit(self, last: int, token: int) -> bool:
        """last: -1 at the start of a piece."""
        key = last << 20 | token if last >= 0 else -1 - token
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) > 4 * self.most_states:
                self.fitting.clear()
            known = self.fitting[key] = self.encode(self.entry[token] if last < 0 else self.entry[last] + self.entry[token]) == ([token] if last < 0 else [last, token])
        return known

    def step(self, state: int, byte: int) -> int:
        key = self.states[state]
        found, going = None, []
        for node, last, tokens in key:
            at = self.child.get(node << 8 | byte)
            if at is None:
                continue
            if self.inner[at]:
                going.append((at, last, tokens))
            token = self.token[at]
            if found is None and token >= 0 and self.fit(last, token):
                found = token, tokens + 1
        token, added = found  # a single byte always ends a prefix
        new = (*[(node, last, tokens - added) for node, last, tokens in going], (0, token, 0))
        if len(self.states) > self.most_states or len(self.steps) > 4 * self.most_states:
            self.empty()
            state = self.intern(key)
        out = self.steps[state << 8 | byte] = self.intern(new) << _SHIFT | added + _ZERO
        return out

    def intern(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        return n

    def run(self, data: bytes, state: int = 0) -> tuple[int, int]:
        """(state afterwards, tokens added)."""
        total = 0
        for b in data:
            way = self.steps.get(state << 8 | b)
            if way is None:
                way = self.step(state, b)
            state = way >> _SHIFT
            total += (way & 0xFFF) - _ZERO
        return state, total

    def tokens(self, data: bytes) -> int:
        return self.run(data)[1]

    def portable(self, state: int) -> bytes:
        """A state as bytes that mean the same in every worker."""
        return np.array(self.states[state], np.int64).tobytes()

    def local(self, state: bytes) -> int:
        return self.intern(tuple(map(tuple, np.frombuffer(state, np.int64).reshape(-1, 3).tolist())))


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """One transducer a worker and file."""
    return Transducer(json.loads(Path(path).read_text(encoding="utf-8")))
