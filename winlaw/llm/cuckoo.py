"""Cuckoo filter: a set of 64-bit keys with insertion and deletion, as one byte string.

Buckets of four 16-bit fingerprints; a key's second bucket is its first xor a
hash of its fingerprint, so either is found from the other. Lookups of many keys
are vectorised. A filter answers "maybe" for a key that was put in, always.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _hash(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class CuckooFilter:
    MAX_KICKS = 500

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        assert buckets & (buckets - 1) == 0
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(64, int(keys / (SLOTS * 0.8)) + 1)
        return cls(1 << (need - 1).bit_length())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(len(raw) // (2 * SLOTS), np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _hash(keys)
        mask = np.uint64(len(self.table) - 1)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = h & mask
        return prints, one.astype(np.int64), self._other(one, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.table) - 1)
        return ((np.asarray(bucket, np.uint64) ^ _hash(prints)) & mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self._places(keys)
        return (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)

    @staticmethod
    def _rank(sorted_values: np.ndarray) -> np.ndarray:
        """Of sorted values, the place of each among its equals."""
        n = len(sorted_values)
        first = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[:n]
        return np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))

    def _put(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Puts prints where their buckets have room; says which found some."""
        placed = np.zeros(len(prints), bool)
        if not len(prints):
            return placed
        order = np.argsort(buckets, kind="stable")
        own = buckets[order]
        rank, empty = self._rank(own), self.table[own] == 0
        ok = rank < empty.sum(1)
        slot = np.argsort(~empty[ok], axis=1, kind="stable")[np.arange(int(ok.sum())), rank[ok]]
        self.table[own[ok], slot] = prints[order[ok]]
        placed[order[ok]] = True
        return placed

    def insert(self, keys: np.ndarray) -> bool:
        """False if the table is too full; it must then be built anew at twice the size, as it has lost a key."""
        prints, one, two = self._places(keys)
        left = ~self._put(prints, one)
        left[left] = ~self._put(prints[left], two[left])
        prints, place = prints[left], np.where(prints[left] & 1, one[left], two[left])
        for kick in range(self.MAX_KICKS):  # those without room push others out, one of a bucket at a time
            if not len(prints):
                return True
            first = np.unique(place, return_index=True)[1]
            slot = (prints[first].astype(np.int64) + kick) % SLOTS
            out = self.table[place[first], slot]
            self.table[place[first], slot] = prints[first]
            prints[first], place[first] = out, self._other(place[first], out)
            left = ~self._put(prints, place)
            prints, place = prints[left], place[left]
        return not len(prints)

    def delete(self, keys: np.ndarray) -> None:
        """Keys that were put in; deleting others would take away a different key's fingerprint."""
        prints, one, two = self._places(keys)
        for either in (0, 1):
            place = (one, two)[either]
            both = place.astype(np.int64) << 16 | prints
            order = np.argsort(both, kind="stable")
            same = self.table[place[order]] == prints[order][:, None]
            rank = self._rank(both[order])
            ok = rank < same.sum(1)
            slot = np.argsort(~same[ok], axis=1, kind="stable")[np.arange(int(ok.sum())), rank[ok]]
            self.table[place[order[ok]], slot] = 0
            rest = np.sort(order[~ok])
            prints, one, two = prints[rest], one[rest], two[rest]
