"""Counting quotient filter over 64-bit fingerprints, bulk-built and merged with numpy.

A fingerprint splits into a quotient (its home slot) and a remainder. Remainders lie sorted in runs, one run
per occupied quotient; two bit vectors (occupied quotients, ends of runs) recover every quotient, so the filter
holds its multiset of fingerprints without loss and filters merge by walking their sorted remainders.
"""

from __future__ import annotations

import numpy as np


class CountingQuotientFilter:
    """Slots in order of fingerprint: ``remainders`` and ``counts``; ``occupied`` by quotient, ``runends`` by slot."""

    def __init__(self, remainder_bits: int, occupied: np.ndarray, runends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.r = remainder_bits
        self.occupied, self.runends, self.remainders, self.counts = occupied, runends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int, counts: np.ndarray | None = None, total_bits: int = 64) -> CountingQuotientFilter:
        """From uint64 fingerprints below 2**total_bits in any order, with repeats."""
        order = np.argsort(fingerprints, kind="stable")
        keys = fingerprints[order]
        weights = np.ones(len(keys), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return cls._of_sorted(keys[first], np.add.reduceat(weights, first) if len(first) else weights, quotient_bits, total_bits)

    @classmethod
    def _of_sorted(cls, keys: np.ndarray, weights: np.ndarray, quotient_bits: int, total_bits: int) -> CountingQuotientFilter:
        """From ascending fingerprints without repeats."""
        r = total_bits - quotient_bits
        quotients = (keys >> np.uint64(r)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        runends = np.r_[quotients[1:] != quotients[:-1], True] if len(keys) else np.zeros(0, bool)
        return cls(r, occupied, runends, keys & np.uint64((1 << r) - 1), weights)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, ascending, and their counts: the n-th run belongs to the n-th occupied quotient."""
        run = np.cumsum(np.r_[0, self.runends[:-1]]) if len(self.runends) else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[run.astype(np.int64)]
        return (quotients << np.uint64(self.r)) | self.remainders, self.counts

    def to_bytes(self) -> tuple[bytes, bytes, bytes, bytes]:
        return np.packbits(self.occupied).tobytes(), np.packbits(self.runends).tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def from_bytes(cls, quotient_bits: int, parts: tuple[bytes, bytes, bytes, bytes], total_bits: int = 64) -> CountingQuotientFilter:
        remainders = np.frombuffer(parts[2], np.uint64)
        occupied = np.unpackbits(np.frombuffer(parts[0], np.uint8))[: 1 << quotient_bits].astype(bool)
        runends = np.unpackbits(np.frombuffer(parts[1], np.uint8))[: len(remainders)].astype(bool)
        return cls(total_bits - quotient_bits, occupied, runends, remainders, np.frombuffer(parts[3], np.int64))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], quotient_bits: int, total_bits: int = 64) -> CountingQuotientFilter:
        """Lossless sum: the sorted runs of two filters are walked side by side, equal fingerprints add their counts; then the next two."""
        todo = [f.items() for f in filters] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        while len(todo) > 1:
            todo = [_merge_sorted(*todo[k : k + 2]) if k + 1 < len(todo) else todo[k] for k in range(0, len(todo), 2)]
        return cls._of_sorted(*todo[0], quotient_bits, total_bits)


def _merge_sorted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists without repeats and their counts to one."""
    (x, n), (y, m) = a, b
    at = np.searchsorted(x, y)
    both = x[np.minimum(at, len(x) - 1)] == y if len(x) else np.zeros(len(y), bool)
    n = n.copy()
    n[at[both]] += m[both]
    y, m, at = y[~both], m[~both], at[~both] + np.arange(int((~both).sum()))
    keys, counts, own = np.empty(len(x) + len(y), np.uint64), np.empty(len(x) + len(y), np.int64), np.ones(len(x) + len(y), bool)
    own[at] = False
    keys[at], counts[at], keys[own], counts[own] = y, m, x, n
    return keys, counts
