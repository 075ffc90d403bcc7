"""Double-array tries over number sequences: built, packed and walked with numpy.

A sequence of k numbers is a path of k * digits bytes, most significant first. Node s has the child for byte b at base[s] + b if
check[base[s] + b] == s, so a step from any number of nodes at once is two gathers and a comparison.
"""

from __future__ import annotations

import struct

import numpy as np

FREE, ROOT, BYTES = -1, 0, 256


def digits_for(largest: int) -> int:
    return max(1, (largest.bit_length() + 7) // 8)


class Trie:
    def __init__(self, base: np.ndarray, check: np.ndarray, leaf: np.ndarray, length: int, digits: int):
        self.base, self.check, self.leaf, self.length, self.digits = base, check, leaf, length, digits
        self.number = np.full(len(base), FREE, np.int32)
        self.number[leaf] = np.arange(len(leaf))

    @classmethod
    def build(cls, sequences: np.ndarray, digits: int) -> Trie:
        """The trie of the distinct rows of an (n, length) array; row i is accepted in state leaf[i]."""
        n, length = sequences.shape
        shifts = np.arange(digits - 1, -1, -1) * 8
        path = ((sequences[:, :, None] >> shifts) & (BYTES - 1)).reshape(n, length * digits)
        room = _Room(4 * BYTES)
        state = np.zeros(n, np.int64)
        for column in path.T:
            edges, inverse = np.unique(state * BYTES + column, return_inverse=True)
            state = room.place(edges // BYTES, edges % BYTES)[inverse]
        return cls(room.base.astype(np.int32), room.check.astype(np.int32), state.astype(np.int32), length, digits)

    def packed(self) -> bytes:
        return struct.pack("<IIII", len(self.base), len(self.leaf), self.length, self.digits) + b"".join(
            a.astype("<i4").tobytes() for a in (self.base, self.check, self.leaf))

    @classmethod
    def unpacked(cls, blob: bytes) -> Trie:
        slots, leaves, length, digits = struct.unpack_from("<IIII", blob)
        base, check = (np.frombuffer(blob, "<i4", slots, 16 + 4 * i * slots) for i in range(2))
        return cls(base, check, np.frombuffer(blob, "<i4", leaves, 16 + 8 * slots), length, digits)

    def walk(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, accepting states) of all places where a sequence starts in an array of numbers; 0 is in none."""
        at = np.flatnonzero(text[:max(0, len(text) - self.length + 1)])
        state = np.full(len(at), ROOT, np.int64)
        for word in range(self.length):  # all positions step together
            value = text[at + word]
            for digit in range(self.digits - 1, -1, -1):
                step = self.base[state] + ((value >> (8 * digit)) & (BYTES - 1))
                alive = self.check[step] == state
                at, state, value = at[alive], step[alive], value[alive]
        return at, state


class _Room:
    """The growing arrays. Nodes with many children take the first places that suit, nodes with one fill the gaps."""

    def __init__(self, slots: int):
        self.base, self.check = np.zeros(slots, np.int64), np.full(slots, FREE, np.int64)
        self.check[ROOT] = -2
        self.rng = np.random.default_rng(0)

    def grow(self, slots: int) -> None:
        self.base = np.append(self.base, np.zeros(slots, np.int64))
        self.check = np.append(self.check, np.full(slots, FREE, np.int64))

    def place(self, parent: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Slots of the children given as sorted (parent, byte) edges."""
        starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        sizes = np.diff(np.append(starts, len(parent)))
        out = np.zeros(len(parent), np.int64)
        least = BYTES
        while least > 1:
            least //= 2
            lower, upper = max(least, 2), BYTES + 1 if 2 * least == BYTES else 2 * least
            todo = np.flatnonzero((sizes >= lower) & (sizes < upper))
            misses = 0
            while len(todo):
                size = sizes[todo]
                owner = np.repeat(np.arange(len(todo)), size)
                edge = np.repeat(starts[todo] - np.cumsum(size) + size, size) + np.arange(size.sum())
                # the last BYTES slots stay free, so that a step from any node stays inside
                base = self.rng.integers(1, len(self.base) - 2 * BYTES + 1, len(todo))
                slot = base[owner] + byte[edge]
                claim = np.where(self.check[slot] == FREE, owner, -1)
                taken = np.full(len(self.base), -1, np.int64) if len(todo) > 64 else None
                if taken is not None:
                    taken[slot] = claim
                    mine = (taken[slot] == owner) & (claim == owner)
                else:
                    _, first = np.unique(slot, return_index=True)
                    mine = np.zeros(len(slot), bool)
                    mine[first] = True
                    mine &= claim == owner
                good = np.logical_and.reduceat(mine, np.append(0, np.cumsum(size)[:-1]))
                chosen = good[owner]
                out[edge[chosen]] = slot[chosen]
                self.check[slot[chosen]] = parent[edge[chosen]]
                self.base[parent[starts[todo[good]]]] = base[good]
                misses = 0 if good.mean() > 0.1 else misses + 1
                todo = todo[~good]
                if misses > 3 and len(todo):
                    self.grow(int(2 * sizes[todo].sum()) + BYTES)
                    misses = 0
        single = starts[sizes == 1]
        if len(single):
            free = np.flatnonzero(self.check[BYTES:len(self.base) - BYTES] == FREE) + BYTES
            if len(free) < len(single):
                self.grow(len(single) - len(free))
                free = np.flatnonzero(self.check[BYTES:len(self.base) - BYTES] == FREE) + BYTES
            free = free[:len(single)]
            out[single] = free
            self.check[free] = parent[single]
            self.base[parent[single]] = free - byte[single]
        return out
