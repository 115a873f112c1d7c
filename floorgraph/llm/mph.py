"""Minimal perfect hashing: a cascade of bit arrays over distinct 64-bit hashes.

At each level every remaining key is hashed into a bit array of ``GAMMA`` bits
a key; keys that have their position alone set its bit, the others go on to
the next level.  A key's index is the rank of its bit, so n keys map one to
one to 0..n-1 in about 3.7 bits a key plus ranks.  Keys that were not in the
set get an arbitrary index or none; a fingerprint array tells them apart.

A shard's keys are half of a 128-bit hash.  The few that share that half with
another are kept aside in a list with their fingerprints.
"""

from __future__ import annotations

import io

import numpy as np

GAMMA = 2.0
_SEEDS = np.uint64(0x9E3779B97F4A7C15)


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((int(_SEEDS) * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks  # bits: one byte-packed array of all levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        rest = np.asarray(keys, np.uint64)
        while len(rest):
            size = max(64, (int(GAMMA * len(rest)) + 63) // 64 * 64)
            at = (_mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("the keys are not distinct")
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        words = np.bitwise_count(bits.view(np.uint64)).astype(np.int64) if len(bits) else np.zeros(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(words)))[:-1].astype(np.uint32) if len(words) else np.zeros(0, np.uint32)
        return cls(np.array(sizes, np.int64), bits, ranks)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        words, offset = self.bits.view(np.uint64), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64) + offset
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = self.ranks[at[hit] >> 6].astype(np.int64) + np.bitwise_count(below[hit]).astype(np.int64)
            left = left[~hit]
            offset += size
        return out


def _upper(marks: np.ndarray) -> np.ndarray:
    return (marks >> np.uint64(32)).astype(np.uint32)


class CountShard:
    """A shard of the index: perfect hash, and by its index a fingerprint and counts, columns of their smallest types.

    ``twins`` are the (keys, marks, counts) of the keys that several marks share.
    Narrow fingerprints are the upper 32 bits of the marks.
    """

    def __init__(self, hash_: PerfectHash, marks: np.ndarray, counts: list[np.ndarray], twins: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.hash, self.marks, self.counts, self.twins = hash_, marks, counts, twins

    @classmethod
    def build(cls, keys: np.ndarray, marks: np.ndarray, counts: np.ndarray, narrow: bool = False) -> CountShard:
        """Shard of rows whose (key, mark) are distinct."""
        _, place, n = np.unique(keys, return_inverse=True, return_counts=True)
        twin = n[place] > 1
        alone = np.flatnonzero(~twin)
        hash_ = PerfectHash.build(keys[alone])
        order = np.empty(len(alone), np.int64)
        order[hash_.index(keys[alone])] = alone
        columns = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in counts[order].T]
        return cls(hash_, _upper(marks[order]) if narrow else marks[order], columns, (keys[twin], marks[twin], counts[twin]))

    def lookup(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Counts of each key, zero for keys that the index lacks."""
        out = np.zeros((len(keys), len(self.counts)), np.int64)
        if len(self.marks):
            at = self.hash.index(keys)
            known = np.flatnonzero(at >= 0)
            own = _upper(marks) if self.marks.dtype == np.uint32 else marks
            known = known[self.marks[at[known]] == own[known]]
            for k, column in enumerate(self.counts):
                out[known, k] = column[at[known]]
        for key, mark, row in zip(*self.twins, strict=True):
            out[(keys == key) & (marks == mark)] = row
        return out

    def dump(self) -> bytes:
        f = io.BytesIO()
        twins = dict(zip(("twin_keys", "twin_marks", "twin_counts"), self.twins, strict=True))
        columns = {f"counts_{k}": c for k, c in enumerate(self.counts)}
        np.savez(f, sizes=self.hash.sizes, bits=self.hash.bits, ranks=self.hash.ranks, marks=self.marks, **columns, **twins)
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CountShard:
        z = np.load(io.BytesIO(data))
        return cls(PerfectHash(z["sizes"], z["bits"], z["ranks"]), z["marks"], [z[f"counts_{k}"] for k in range(sum(n.startswith("counts_") for n in z.files))], (z["twin_keys"], z["twin_marks"], z["twin_counts"]))

    @property
    def nbytes(self) -> int:
        return self.hash.bits.nbytes + self.hash.ranks.nbytes + self.marks.nbytes + sum(c.nbytes for c in self.counts) + sum(t.nbytes for t in self.twins)
