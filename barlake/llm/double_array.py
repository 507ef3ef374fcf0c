"""A double-array trie of sequences of equal length, walked by all positions of a text at once.

A transition from state s by symbol c leads to cell ``base[s] + c`` if
``parent`` of that cell is s.  Cells of all states interleave in one pair of
arrays, so a step is two gathers for any number of positions.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Places that are tried at once, and the size below which rows look for room from the start again.
_TRIES, _SMALL = 64, 6
#: Positions that are walked at once.
WINDOW = 1 << 18


def _places(groups: list[tuple[np.ndarray, np.ndarray]], width: int) -> dict[int, int]:
    """Bases for groups of (owners, rows of offsets of equal length), larger rows first."""
    used = np.zeros(4 * width + 1024, bool)
    bases, at = {}, 0
    for owners, rows in groups:
        count = rows.shape[1]
        if count < _SMALL:  # small rows fill the gaps between large ones
            at = 0
        if count == 1:  # any free cell will do
            free = np.flatnonzero(~used)
            if len(free) < len(owners):
                more = len(owners) - len(free)
                free = np.concatenate([free, np.arange(len(used), len(used) + more)])
                used = np.concatenate([used, np.zeros(more + width + 1, bool)])
            free = free[: len(owners)]
            used[free] = True
            bases.update(zip(owners.tolist(), (free - rows[:, 0]).tolist(), strict=True))
            continue
        for owner, row in zip(owners.tolist(), rows, strict=True):
            offsets = row - row[0]
            while True:
                if at + _TRIES + width + 1 > len(used):
                    used = np.concatenate([used, np.zeros(len(used) + width, bool)])
                fits = ~used[(at + np.arange(_TRIES))[:, None] + offsets].any(1)
                if fits.any():
                    break
                at += _TRIES
            cell = at + int(np.argmax(fits))
            used[cell + offsets] = True
            bases[owner] = cell - int(row[0])
    return bases


@dataclass
class DoubleArray:
    """Sequences of ``depth`` symbols; ``cells[i]`` is the accepting cell of the i-th."""

    symbols: np.ndarray
    base: np.ndarray
    parent: np.ndarray
    cells: np.ndarray
    depth: int

    @classmethod
    def of(cls, sequences: np.ndarray) -> DoubleArray:
        """The trie of distinct sequences, the rows of a matrix in lexicographic order."""
        count, depth = sequences.shape
        if not count:
            none = np.zeros(0, np.int64)
            return cls(none, np.zeros(1, np.int64), np.full(1, -1), none, depth)
        symbols = np.unique(sequences)
        local = np.searchsorted(symbols, sequences)
        width = len(symbols)
        # node numbers by depth: 0 is the root, and a node's children are neighbours
        new = np.zeros(count, bool)
        new[:1] = True
        node, total, edges = np.zeros(count, np.int64), 1, []
        for d in range(depth):
            new[1:] |= local[1:, d] != local[:-1, d]
            own = total + np.cumsum(new) - 1
            edges.append(np.stack([node[new], local[new, d], own[new]]))
            node, total = own, total + int(new.sum())
        owner, symbol, child = np.concatenate(edges, 1)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[first, len(owner)])
        groups = []
        for size in np.unique(sizes)[::-1].tolist():
            starts = first[sizes == size]
            groups.append((owner[starts], symbol[starts[:, None] + np.arange(size)]))
        bases = _places(groups, width)
        base_of = np.zeros(total, np.int64)
        base_of[list(bases)] = list(bases.values())
        cell = np.zeros(total, np.int64)
        cell[child] = base_of[owner] + symbol
        # a margin of one alphabet on each side: no step leaves the arrays; cell 0 of the margin is the root's
        last = int(cell.max(initial=0))
        parent = np.full(last + 2 * width + 2, -1, np.int64)
        base = np.zeros(len(parent), np.int64)
        at = np.where(np.arange(total) == 0, len(parent) - 1, cell + width)
        parent[at[child]] = at[owner]
        base[at] = base_of + width
        return cls(symbols, base, parent, at[node], depth)

    def walk(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a sequence begins, and its accepting cell.  Negative ids are in no sequence."""
        if not len(self.symbols) or len(ids) < self.depth:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        local = np.searchsorted(self.symbols, ids)
        local[local == len(self.symbols)] = 0
        local = np.where(self.symbols[local] == ids, local, -1)
        at = np.arange(len(ids) - self.depth + 1)
        state = np.full(len(at), len(self.parent) - 1)
        for d in range(self.depth):
            symbol = local[at + d]
            to = np.where(symbol >= 0, self.base[state] + symbol, len(self.parent) - 1)
            alive = self.parent[to] == state
            at, state = at[alive], to[alive]
        return at, state

    def windows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``walk``, ``WINDOW`` positions at a time, so that memory doesn't grow with the text."""
        for first in range(0, len(ids), WINDOW):
            at, cell = self.walk(ids[first : first + WINDOW + self.depth - 1])
            yield at + first, cell

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """How often each sequence occurs, overlaps included."""
        total = np.zeros(len(self.parent), np.int64)
        for _, cell in self.windows(ids):
            total += np.bincount(cell, minlength=len(self.parent))
        return total[self.cells]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, symbols=self.symbols, base=self.base, parent=self.parent, cells=self.cells, depth=self.depth)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> DoubleArray:
        found = np.load(io.BytesIO(data))
        return cls(found["symbols"], found["base"], found["parent"], found["cells"], int(found["depth"]))
