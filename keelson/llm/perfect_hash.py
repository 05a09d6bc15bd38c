"""Minimal perfect hashing of 128-bit keys, vectorised.

A shard is built level by level: each key still unplaced picks one bit of the
level's bit array; bits picked once are kept and their keys are placed, the
others go to the next level.  A key's index is the number of kept bits before
its own, over all levels, so n keys fill 0 to n-1 exactly.  Beside the bits a
shard holds a 64-bit fingerprint per key (a key that was never added is then
answered with -1) and whatever value arrays the caller indexes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAMMA = 2
MAX_LEVELS = 60
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _slot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF)
    return (_mix(_mix(a + salt) ^ b) % np.uint64(size)).astype(np.int64)


@dataclass
class Shard:
    sizes: np.ndarray  # bits in each level
    bits: np.ndarray  # packed, each level padded to whole 64-bit words
    ranks: np.ndarray  # kept bits before each 64-bit word
    prints: np.ndarray  # uint64 by index

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> tuple[Shard, np.ndarray]:
        """The shard of distinct keys (a, b) and the index of each."""
        with np.errstate(over="ignore"):
            left, levels, sizes = np.arange(len(a)), [], []
            while len(left):
                if len(levels) == MAX_LEVELS:
                    raise ValueError("keys are not distinct")
                size = max(64, -(-GAMMA * len(left) // 64) * 64)
                slot = _slot(a[left], b[left], len(levels), size)
                once = np.bincount(slot, minlength=size) == 1
                levels.append(once)
                sizes.append(size)
                left = left[~once[slot]]
            flat = np.concatenate(levels) if levels else np.zeros(0, bool)
            words = np.packbits(flat, bitorder="little").view(np.uint64)
            ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            shard = cls(np.array(sizes, np.int64), words, ranks, np.zeros(len(a), np.uint64))
            index = shard._index(a, b)
            shard.prints[index] = b
            return shard, index

    def _index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        with np.errstate(over="ignore"):
            for level, size in enumerate(self.sizes.tolist()):
                if not len(left):
                    break
                at = base + _slot(a[left], b[left], level, size)
                word, bit = at >> 6, (at & 63).astype(np.uint64)
                hit = (self.bits[word] >> bit) & np.uint64(1) == 1
                below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
                found[left[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
                left = left[~hit]
                base += size
        return found

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for keys that were never added."""
        found = self._index(a, b)
        wrong = found >= 0
        wrong[wrong] = self.prints[found[wrong]] != b[wrong]
        found[wrong] = -1
        return found

    def to_bytes(self) -> dict[str, bytes]:
        return {k: getattr(self, k).tobytes() for k in ("sizes", "bits", "ranks", "prints")}

    @classmethod
    def from_bytes(cls, parts: dict[str, bytes]) -> Shard:
        kinds = {"sizes": np.int64, "bits": np.uint64, "ranks": np.int64, "prints": np.uint64}
        return cls(**{k: np.frombuffer(parts[k], kind) for k, kind in kinds.items()})
