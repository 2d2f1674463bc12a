"""Minimal acyclic transducer: a shared-suffix automaton that maps words to sequences of ids.

Words come in byte order.  The states of the last word's path are open; as soon as a word leaves the
path, the states behind the fork are closed, and a closed state with the same outputs and targets as an
earlier one is that one.  Outputs stand as near to the root as they can (an edge holds what all words
through it begin with), so words with equal ends share them.

The automaton is a few flat arrays in one file, which tasks map into memory and search in place: edges are
sorted by ``state << 8 | byte``, and a batch of words walks them in step.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Order of the arrays in the file and their types; the header holds the root state and the arrays' lengths.
_PARTS = (("key", np.int64), ("target", np.int32), ("emit", np.int32), ("end", np.int32), ("start", np.int64), ("ids", np.int32))


class _State:
    __slots__ = ("edges", "end")

    def __init__(self):
        self.edges: dict[int, list] = {}  # byte: [target, output]
        self.end: tuple | None = None     # output at the end of a word


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file of the minimal transducer of ``entries``: distinct non-empty words in byte order with their ids."""
    known: dict[tuple, int] = {}
    edges: list[tuple[int, int, int]] = []
    ends: list[int] = []
    outputs: dict[tuple, int] = {(): 0}

    def close(state: _State) -> int:
        form = (state.end, tuple((b, t, o) for b, (t, o) in state.edges.items()))
        number = known.get(form)
        if number is None:
            number = known[form] = len(known)
            ends.append(-1 if state.end is None else outputs.setdefault(state.end, len(outputs)))
            edges.extend((number << 8 | b, t, outputs.setdefault(o, len(outputs))) for b, (t, o) in state.edges.items())
        return number

    path, last = [_State()], b""
    for word, ids in entries:
        if word <= last:
            raise ValueError("the words must be distinct, not empty and in byte order")
        fork = _shared(word, last)
        for at in range(len(last), fork, -1):
            path[at - 1].edges[last[at - 1]][0] = close(path.pop())
        for at in range(fork):  # what the shared edges hold is what the old words and the new one have in common
            edge, state = path[at].edges[word[at]], path[at + 1]
            n = _shared(edge[1], ids)
            moved, edge[1], ids = edge[1][n:], edge[1][:n], ids[n:]
            if moved:
                for other in state.edges.values():
                    other[1] = moved + other[1]
                if state.end is not None:
                    state.end = moved + state.end
        for at in range(fork, len(word)):
            path[at].edges[word[at]] = [None, ids if at == fork else ()]
            path.append(_State())
        path[-1].end = ()
        last = word
    for at in range(len(last), 0, -1):
        path[at - 1].edges[last[at - 1]][0] = close(path.pop())
    root = close(path[0])

    edges.sort()
    key, target, emit = (np.array(c, dtype=t) for c, t in zip(zip(*edges), (np.int64, np.int32, np.int32))) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    sizes = np.array([len(o) for o in outputs], dtype=np.int64)
    parts = {"key": key, "target": target, "emit": emit, "end": np.array(ends, np.int32), "start": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
             "ids": np.array([i for o in outputs for i in o], np.int32)}
    header = np.array([root] + [len(parts[name]) for name, _ in _PARTS], np.int64)
    body = [header.tobytes()] + [(raw := parts[name].tobytes()) + bytes(-len(raw) % 8) for name, _ in _PARTS]
    return b"".join(body)


class Lexicon:
    """A compiled transducer over any buffer, such as a memory-mapped file."""

    def __init__(self, buffer):
        header = np.frombuffer(buffer, np.int64, len(_PARTS) + 1)
        self.root, at = int(header[0]), header.nbytes
        for (name, kind), n in zip(_PARTS, header[1:].tolist()):
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            size = n * np.dtype(kind).itemsize
            at += size + -size % 8

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, "r"))

    @property
    def n_states(self) -> int:
        return len(self.end)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are in the lexicon, how many ids each of those has, and their ids one after the other."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        state, alive, walked = np.full(n, self.root, np.int64), np.arange(n), []
        found, stops = np.zeros(n, bool), []
        step = 0
        while len(alive):
            over = sizes[alive] == step
            done = alive[over]
            if len(done):
                end = self.end[state[done]]
                found[done[end >= 0]] = True
                stops.append((done[end >= 0], end[end >= 0]))
                alive = alive[~over]
            if not len(alive) or not len(self.key):
                break
            key = state[alive] << 8 | raw[first[alive] + step]
            at = np.searchsorted(self.key, key)
            at[at == len(self.key)] = 0
            hit = self.key[at] == key
            alive, at = alive[hit], at[hit]
            state[alive] = self.target[at]
            out = self.emit[at]
            walked.append((alive[out > 0], out[out > 0]))
            step += 1
        parts = walked + stops  # in the order of the path; an end's output comes last
        word, out = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        keep = found[word]
        word, out = word[keep], out[keep]
        order = np.argsort(word, kind="stable")
        word, out = word[order], out[order]
        count = self.start[out + 1] - self.start[out]
        total = np.zeros(n, np.int64)
        np.add.at(total, word, count)
        return found, total[found], self.ids[ragged(self.start[out], count)]


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, ...`` of every range, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
