"""A cuckoo filter over 64-bit hashes that can be stored as bytes.

Buckets hold four 16-bit marks; a key's mark is in one of two buckets, each found from the other by
the mark alone, so marks can be moved and removed. If no place is found the filter turns ``full``:
it then answers "maybe" for every key, which is slower and still right.
"""

from __future__ import annotations

import numpy as np

from tiltframe.llm.text import mix

SLOTS = 4
MAX_MOVES = 500
_MAGIC = np.uint64(0x5BD1E995C3B2AE35)


class CuckooFilter:
    def __init__(self, table: np.ndarray, full: bool = False):
        self.table, self.full = table, full

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        """A filter for about n keys, at most two thirds filled by them."""
        buckets = 1 << max(4, (3 * n // (2 * SLOTS)).bit_length())
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16, offset=2).reshape(-1, SLOTS).copy()
        return cls(table, full=data[0] == 1)

    def to_bytes(self) -> bytes:
        return bytes([int(self.full), 0]) + self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        marks = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return marks, first, self._other(first, marks)

    def _other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        step = mix(marks.astype(np.uint64) * _MAGIC) & np.uint64(len(self.table) - 1)
        return bucket ^ step.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(keys), bool)
        marks, a, b = self._places(keys)
        return (self.table[a] == marks[:, None]).any(1) | (self.table[b] == marks[:, None]).any(1)

    def add(self, keys: np.ndarray) -> None:
        """Add keys, each of which is not held yet."""
        marks, a, b = self._places(keys)
        todo = np.arange(len(keys))
        for bucket in (a, b):  # all at once, as far as their buckets have room
            todo = todo[self._fill(bucket[todo], marks[todo])]
        for i in todo.tolist():
            self._place(int(b[i]), int(marks[i]))

    def _fill(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Put marks into free places of their buckets; the indices of those that found none."""
        order = np.argsort(bucket, kind="stable")
        own = bucket[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        free = np.argsort(self.table[own] != 0, axis=1, kind="stable")
        room = (self.table[own] == 0).sum(1)
        fits = rank < room
        self.table[own[fits], free[fits, rank[fits]]] = marks[order[fits]]
        return np.sort(order[~fits])

    def _place(self, bucket: int, mark: int) -> None:
        if self.full:
            return
        for move in range(MAX_MOVES):
            row = self.table[bucket]
            empty = np.flatnonzero(row == 0)
            if len(empty):
                row[empty[0]] = mark
                return
            at = (bucket + move) % SLOTS
            mark, row[at] = int(row[at]), mark
            bucket = int(self._other(np.array([bucket]), np.array([mark], np.uint16))[0])
        self.full = True

    def remove(self, keys: np.ndarray) -> None:
        """Remove keys that are held."""
        if self.full:
            return
        marks, a, b = self._places(keys)
        for mark, one, two in zip(marks.tolist(), a.tolist(), b.tolist(), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
