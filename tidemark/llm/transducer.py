"""A minimal acyclic transducer from words to token ids, laid out for memory mapping.

States that accept the same endings are shared, so the automaton stores each suffix once. Every edge carries
how many words of the lexicon come before those it leads to; the sum along a word's path is its number, and
the number points into the table of id outputs. All arrays live in one file that workers map read-only.
"""

from __future__ import annotations

import json
import mmap
from collections.abc import Iterable, Sequence

import numpy as np

_MAGIC = b"TMLX0001"
_ALIGN = 64


class Lexicon:
    """Lookup over the mapped arrays; nothing is copied until it is touched."""

    def __init__(self, buffer) -> None:
        view = memoryview(buffer)
        if bytes(view[:8]) != _MAGIC:
            raise ValueError("not a lexicon file")
        size = int.from_bytes(view[8:16], "little")
        for name, kind, start, count in json.loads(bytes(view[16 : 16 + size])):
            setattr(self, name, np.frombuffer(buffer, dtype=kind, count=count, offset=start))
        self.longest = int(self.meta[0])

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word in the lexicon, -1 for unseen ones; all words walk the automaton together."""
        out = np.full(len(words), -1, dtype=np.int64)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        alive = np.flatnonzero((length > 0) & (length <= self.longest))
        if not len(alive) or not len(self.edge_key):
            return out
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.cumsum(length) - length
        state, number, depth = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), 0
        while len(alive):
            done = alive[length[alive] == depth]
            out[done] = np.where(self.final[state[done]] > 0, number[done], -1)
            alive = alive[length[alive] > depth]
            key = state[alive] * 256 + flat[begin[alive] + depth]
            edge = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            ok = self.edge_key[edge] == key
            alive, edge = alive[ok], edge[ok]
            number[alive] += self.edge_skip[edge]
            state[alive] = self.edge_to[edge]
            depth += 1
        return out

    def ids(self, number: int) -> np.ndarray:
        return self.out_ids[self.out_start[number] : self.out_start[number + 1]]

    def vocabulary(self) -> dict[bytes, int]:
        """Token bytes with their ranks, for the exact merge of unseen words."""
        blob, at = self.vocab_bytes.tobytes(), self.vocab_start.tolist()
        return {blob[at[i] : at[i + 1]]: r for i, r in enumerate(self.vocab_rank.tolist())}


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Edges and final flags of the minimal automaton of sorted, distinct words, built word by word."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    open_path: list[tuple[int, int, int]] = []  # parent, label, child of the last word's states that may still grow

    def settle(keep: int) -> None:
        while len(open_path) > keep:
            parent, label, child = open_path.pop()
            shape = (final[child], tuple(edges[child].items()))
            edges[parent][label] = known.setdefault(shape, child)

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        settle(shared)
        node = open_path[-1][2] if open_path else 0
        for label in word[shared:]:
            edges.append({})
            final.append(False)
            child = len(edges) - 1
            edges[node][label] = child
            open_path.append((node, label, child))
            node = child
        final[node] = True
        last = word
    settle(0)
    return edges, final


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]], vocabulary: dict[bytes, int]) -> bytes:
    """The lexicon file for (word, ids) entries, with the vocabulary that unseen words are merged by."""
    table = dict(entries)
    words = sorted(w for w in table if w)
    edges, final = _minimal(words)
    live, order = {0: 0}, [0]  # states that can be reached, in breadth-first order
    for s in order:
        for to in edges[s].values():
            if to not in live:
                live[to] = len(order)
                order.append(to)
    below: dict[int, int] = {}
    stack = [0]
    while stack:  # words that end in or below a state
        s = stack[-1]
        todo = [t for t in edges[s].values() if t not in below]
        if todo:
            stack.extend(todo)
        else:
            below[s] = final[s] + sum(below[t] for t in edges[s].values())
            stack.pop()
    key, to, skip = [], [], []
    for s in order:
        before = int(final[s])
        for label in sorted(edges[s]):
            child = edges[s][label]
            key.append(live[s] * 256 + label)
            to.append(live[child])
            skip.append(before)
            before += below[child]
    tokens = sorted(vocabulary, key=vocabulary.__getitem__)
    ids = [list(table[w]) for w in words]
    arrays = {
        "meta": np.array([max(map(len, words), default=0), len(words)], dtype="<i8"),
        "edge_key": np.array(key, dtype="<i8"),
        "edge_to": np.array(to, dtype="<i4"),
        "edge_skip": np.array(skip, dtype="<i4"),
        "final": np.array([final[s] for s in order], dtype="<u1"),
        "out_start": np.cumsum([0, *map(len, ids)]).astype("<i8"),
        "out_ids": np.array([i for x in ids for i in x], dtype="<i4"),
        "vocab_rank": np.array([vocabulary[t] for t in tokens], dtype="<i4"),
        "vocab_start": np.cumsum([0, *map(len, tokens)]).astype("<i8"),
        "vocab_bytes": np.frombuffer(b"".join(tokens), dtype="<u1"),
    }
    head, at = [], 4096
    for name, a in arrays.items():
        head.append((name, a.dtype.str, at, len(a)))
        at += -(-a.nbytes // _ALIGN) * _ALIGN
    text = json.dumps(head).encode()
    out = bytearray(at)
    out[:16] = _MAGIC + len(text).to_bytes(8, "little")
    out[16 : 16 + len(text)] = text
    for (_, _, start, _), a in zip(head, arrays.values(), strict=True):
        out[start : start + a.nbytes] = a.tobytes()
    return bytes(out)
