"""Weighted acyclic automata over sequences of DEPTH byte strings, built from sorted sequences and their counts.

States of a depth that go on alike, with the same weights, are one state. A sequence shorter than DEPTH ends in empty symbols,
which sort first. Symbols are numbers in a sorted list of names of the automaton's own.
"""

from __future__ import annotations

import struct
from bisect import bisect_left

import numpy as np
import zstandard

DEPTH = 5
#: Before an array: bytes of a value, number of values.
HEAD = struct.Struct("<BQ")


def _compact(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _within(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + n[i] - 1 of all i, one after another."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _mixed(label: np.ndarray, target: np.ndarray) -> np.ndarray:
    x = label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + target.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _shared(n: np.ndarray, label: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each state's twin, the states kept): twins have the same arcs, compared one by one where hashes agree."""
    starts = np.cumsum(n) - n
    hashes = np.add.reduceat(_mixed(label, target), starts)
    order = np.lexsort((hashes, n))
    new = np.ones(len(n), bool)
    new[1:] = (np.diff(n[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
    twin = np.empty(len(n), np.int64)
    twin[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    own, other = _within(starts, n), _within(starts[twin], n)
    differ = (label[own] != label[other]) | (target[own] != target[other])
    wrong = np.add.reduceat(differ.astype(np.int64), starts) > 0
    twin[wrong] = np.flatnonzero(wrong)
    kept, number = np.unique(twin, return_inverse=True)
    return number, kept


def summed(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct sequences, the weights of equal ones added up."""
    if not len(weights):
        return columns, weights
    keys, bits = [], 0
    for c in columns:
        wide = max(int(c.max()).bit_length(), 1)
        if keys and bits + wide <= 63:
            keys[-1] = keys[-1] << wide | c
            bits += wide
        else:
            keys.append(c.astype(np.int64))
            bits = wide
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    heads = np.flatnonzero(new)
    return [c[order[heads]] for c in columns], np.add.reduceat(weights[order], heads)


class Automaton:
    """names, and of each depth: arcs of each state, their labels, and their targets, the last of which are weights."""

    def __init__(self, names: list[bytes], arcs: list[np.ndarray], labels: list[np.ndarray], targets: list[np.ndarray]):
        self.names, self.arcs, self.labels, self.targets = names, arcs, labels, targets

    @staticmethod
    def of(names: list[bytes], columns: list[np.ndarray], weights: np.ndarray) -> Automaton:
        """From sorted distinct sequences, a column of symbols for each place; names that none has are left out."""
        used = np.unique(np.concatenate([np.zeros(1, np.int64), *columns]))
        number = np.zeros(len(names), np.int64)
        number[used] = np.arange(len(used))
        columns = [number[c] for c in columns]
        names = [names[k] for k in used.tolist()]
        new = [np.zeros(len(weights), bool)]
        new[0][:1] = True
        for c in columns:
            at = new[-1].copy()
            at[1:] |= c[1:] != c[:-1]
            new.append(at)
        arcs, labels, targets = [], [], []
        after = weights.astype(np.int64)
        for d in range(DEPTH - 1, -1, -1):
            # An arc for each beginning of d + 1 symbols, out of the state of its first d.
            heads = np.flatnonzero(new[d + 1])
            n = np.bincount(np.cumsum(new[d])[heads] - 1)
            label, target = columns[d][heads], after
            after, kept = _shared(n, label, target) if len(n) else (n, n)
            at = _within((np.cumsum(n) - n)[kept], n[kept])
            arcs.insert(0, n[kept])
            labels.insert(0, label[at])
            targets.insert(0, target[at])
        return Automaton(names, arcs, labels, targets)

    def sequences(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns of all sequences in order, and their weights."""
        columns: list[np.ndarray] = []
        states = np.zeros(1 if len(self.arcs[0]) else 0, np.int64)
        for d in range(DEPTH):
            n = self.arcs[d][states].astype(np.int64)
            at = _within((np.cumsum(self.arcs[d]) - self.arcs[d])[states].astype(np.int64), n)
            columns = [*[np.repeat(c, n) for c in columns], self.labels[d][at].astype(np.int64)]
            states = self.targets[d][at].astype(np.int64)
        return columns, states

    def compose(self, asked: list[list[bytes]]) -> np.ndarray:
        """The weights of sequences of up to DEPTH names, 0 where the automaton has none: all descend side by side."""
        number = {x: k for k, x in enumerate(self.names)}
        alive = np.arange(len(asked) if len(self.arcs[0]) else 0)
        states = np.zeros(len(alive), np.int64)
        wide = len(self.names) + 1
        for d in range(DEPTH):
            label = np.array([number.get(asked[i][d], -1) if d < len(asked[i]) else 0 for i in alive.tolist()], np.int64)
            keys = np.repeat(np.arange(len(self.arcs[d])), self.arcs[d]) * wide + self.labels[d]
            at = np.minimum(np.searchsorted(keys, states * wide + label), len(keys) - 1)
            there = (label >= 0) & (keys[at] == states * wide + label)
            alive, states = alive[there], self.targets[d][at[there]].astype(np.int64)
        out = np.zeros(len(asked), np.int64)
        out[alive] = states
        return out

    def dump(self) -> bytes:
        """The arrays one after another, each behind its number of bytes a value and of values, compressed."""
        sizes = np.array([len(x) for x in self.names], np.int64)
        arrays = [np.frombuffer(b"".join(self.names), np.uint8), *[_compact(x) for x in (sizes, *self.arcs, *self.labels, *self.targets)]]
        out = b"".join(p for x in arrays for p in (HEAD.pack(x.itemsize, len(x)), x.tobytes()))
        return zstandard.ZstdCompressor(level=1).compress(out)

    @staticmethod
    def load(data: bytes) -> Automaton:
        data, at, arrays = zstandard.ZstdDecompressor().decompress(data), 0, []
        while at < len(data):
            width, n = HEAD.unpack_from(data, at)
            arrays.append(np.frombuffer(data, f"<u{width}", n, at + HEAD.size))
            at += HEAD.size + width * n
        text, (sizes, *rest) = arrays[0].tobytes(), [x.astype(np.int64) for x in arrays[1:]]
        ends = np.cumsum(sizes).tolist()
        names = [text[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        return Automaton(names, rest[:DEPTH], rest[DEPTH : 2 * DEPTH], rest[2 * DEPTH :])


def union(parts: list[Automaton]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """(names, columns, weights) of the sequences of all parts, weights of equal ones added up."""
    names = sorted({x for p in parts for x in p.names} | {b""})
    number = {x: k for k, x in enumerate(names)}
    columns: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    weights = []
    for p in parts:
        to = np.fromiter(map(number.__getitem__, p.names), np.int64, len(p.names))
        own, w = p.sequences()
        for all_, c in zip(columns, own, strict=True):
            all_.append(to[c])
        weights.append(w)
    return names, *summed([np.concatenate(c) for c in columns], np.concatenate(weights))


def place(names: list[bytes], columns: list[np.ndarray], cut: tuple[bytes, ...]) -> int:
    """How many of the sorted sequences come before the cut, a sequence of DEPTH names."""
    low, high = 0, len(columns[0])
    for c, name in zip(columns, cut, strict=True):
        k = bisect_left(names, name)
        start = low + int(np.searchsorted(c[low:high], k))
        if k == len(names) or names[k] != name:
            return start
        low, high = start, low + int(np.searchsorted(c[low:high], k, "right"))
    return low
