"""All ways to cut many byte strings into pieces of a vocabulary, as one lattice.

The lattice is the composition of each string with the automaton of the pieces: nodes are the places
between bytes, edges the pieces that fit. Sums and shortest paths go over one node distance at a
time for all strings together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from exposia.llm.text import prefix_hash, span_hash

MARK = "▁"  # stands for a space in the vocabulary


class Pieces:
    """A set of byte strings, found by hash; numbers are places in the given list."""

    def __init__(self, pieces: Sequence[bytes]):
        self.pieces = list(pieces)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            if p:
                by_length.setdefault(len(p), []).append(i)
        self.tables = []
        for length, numbers in sorted(by_length.items()):
            data = np.frombuffer(b"".join(self.pieces[i] for i in numbers), np.uint8)
            starts = np.arange(0, len(data), length)
            names = span_hash(prefix_hash(data), starts, starts + length)
            order = np.argsort(names, kind="stable")
            self.tables.append((length, names[order], np.array(numbers)[order]))

    def find(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and number of every piece in the data that ends within its limit."""
        running, place = prefix_hash(data), np.arange(len(data))
        starts, lengths, numbers = [], [], []
        for length, names, ids in self.tables:
            at = np.flatnonzero(place + length <= limit)
            name = span_hash(running, at, at + length)
            hit = np.minimum(np.searchsorted(names, name), len(names) - 1)
            ok = names[hit] == name
            starts.append(at[ok])
            numbers.append(ids[hit[ok]])
            lengths.append(np.full(int(ok.sum()), length))
        if not starts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(numbers)


class Known:
    """Numbers of hashed names in order of arrival; a few bytes a name, looked up by sorted search."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.names, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.names) > self.limit

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each of some sorted names, and which are new; these get the next numbers in order."""
        place = np.searchsorted(self.names, names)
        fresh = np.ones(len(names), bool)
        inside = place < len(self.names)
        fresh[inside] = self.names[place[inside]] != names[inside]
        number = np.empty(len(names), np.int64)
        number[~fresh] = self.numbers[place[~fresh]]
        number[fresh] = len(self.names) + np.arange(int(fresh.sum()))
        self.names = np.insert(self.names, place[fresh], names[fresh])
        self.numbers = np.insert(self.numbers, place[fresh], number[fresh])
        return number, fresh


@dataclass
class Lattice:
    """Edges in order of their end's distance from the start of its string, then of the end."""

    offsets: np.ndarray
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    owner: np.ndarray
    layers: list[slice]

    @classmethod
    def of(cls, pieces: Pieces, data: np.ndarray, offsets: np.ndarray) -> Lattice:
        n = np.diff(offsets)
        owner = np.repeat(np.arange(len(n)), n)
        start, length, piece = pieces.find(data, offsets[1:][owner])
        word = owner[start]
        source = start + word  # a string of k bytes has k + 1 nodes
        distance = start - offsets[word] + length
        order = np.lexsort((-length, source + length, distance))
        cuts = np.flatnonzero(np.diff(distance[order])) + 1
        bounds = [0, *cuts.tolist(), len(order)]
        layers = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
        return cls(offsets, source[order], (source + length)[order], piece[order], word[order], layers)

    @property
    def first(self) -> np.ndarray:
        return self.offsets[:-1] + np.arange(len(self.offsets) - 1)

    @property
    def last(self) -> np.ndarray:
        return self.offsets[1:] + np.arange(len(self.offsets) - 1)

    @property
    def nodes(self) -> int:
        return int(self.offsets[-1]) + len(self.offsets) - 1

    def log_sums(self, weights: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all paths from the start to each node. ``weights``: by edge,
        logarithms, one column or several."""
        total = np.full((self.nodes, *weights.shape[1:]), -np.inf)
        total[self.first] = 0
        for layer in self.layers:
            target = self.target[layer]
            heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            value = total[self.source[layer]] + weights[layer]
            most = np.maximum.reduceat(value, heads, axis=0)
            safe = np.where(np.isfinite(most), most, 0)
            each = np.exp(value - np.repeat(safe, np.diff(np.append(heads, len(target))), axis=0))
            with np.errstate(divide="ignore"):
                total[target[heads]] = safe + np.log(np.add.reduceat(each, heads, axis=0))
        return total

    def log_sums_back(self, weights: np.ndarray) -> np.ndarray:
        """The same from each node to the end of its string; weights in one column."""
        total = np.full(self.nodes, -np.inf)
        total[self.last] = 0
        left = self.last[self.owner] - self.source
        order = np.lexsort((self.source, left))
        cuts = np.flatnonzero(np.diff(left[order])) + 1
        for part in np.split(order, cuts):
            source = self.source[part]
            heads = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
            value = total[self.target[part]] + weights[part]
            most = np.maximum.reduceat(value, heads)
            safe = np.where(np.isfinite(most), most, 0)
            each = np.exp(value - np.repeat(safe, np.diff(np.append(heads, len(source)))))
            with np.errstate(divide="ignore"):
                total[source[heads]] = safe + np.log(np.add.reduceat(each, heads))
        return total

    def shortest(self, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the cheapest path of every string, concatenated, and their number by string."""
        best = np.full(self.nodes, np.inf)
        best[self.first] = 0
        back = np.full(self.nodes, -1)
        for layer in self.layers:
            target = self.target[layer]
            heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            value = best[self.source[layer]] + costs[layer]
            least = np.minimum.reduceat(value, heads)
            equal = np.flatnonzero(value == np.repeat(least, np.diff(np.append(heads, len(target)))))
            best[target[heads]] = least
            back[target[equal][::-1]] = equal[::-1] + layer.start  # the first of equals stays
        at, first = self.last.copy(), self.first
        steps, live = [], np.flatnonzero(at > first)
        while len(live):
            edge = back[at[live]]
            steps.append((live, self.piece[edge]))
            at[live] = self.source[edge]
            live = live[at[live] > first[live]]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(first), np.int64)
        owner = np.concatenate([s[0] for s in steps][::-1])
        piece = np.concatenate([s[1] for s in steps][::-1])
        order = np.argsort(owner, kind="stable")
        return piece[order], np.bincount(owner, minlength=len(first))


def spans_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some spans, concatenated, and where each starts."""
    n = ends - starts
    at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    return data[at], np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
