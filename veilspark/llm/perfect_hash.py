"""Minimal perfect hashing of 64-bit keys, in numpy: n keys to the places 0 to n - 1, in a few bits a key.

Keys are dealt over bits by a hash of their level; a key that has a bit to itself takes it, the others go on to the next level.
A key's place is the number of set bits before its own, counted by words of 64 bits. What is left after the last level (keys
that are there twice) is listed.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

from veilspark.llm.common import mixed

LEVELS = 32
#: Bits a key on each level.
ROOM = 2


def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    step = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    return (mixed(keys + step) % np.uint64(bits)).astype(np.int64)


@dataclass
class PerfectHash:
    """words: the levels' bits end to end; level i has the words from first[i] to first[i + 1]. before: bits set before each word. rest: keys by list."""

    words: np.ndarray
    first: np.ndarray
    before: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash of some keys, and the place of each; of keys that are there twice each copy has its own."""
        keys = np.asarray(keys, np.uint64)
        left, parts, level = np.arange(len(keys)), [], 0
        while len(left) and level < LEVELS:
            bits = 64 * max(1, -(-ROOM * len(left) // 64))
            bit = _bit(keys[left], level, bits)
            alone = np.bincount(bit, minlength=bits) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            left, level = left[~alone[bit]], level + 1
        words = np.concatenate([np.zeros(0, "<u8"), *parts])
        first = np.cumsum([0, *(len(x) for x in parts)])
        before = np.cumsum(np.concatenate(([0], np.bitwise_count(words)))).astype(np.int64)
        out = cls(words, first, before, keys[left])
        place = out.places(keys)
        place[left] = before[-1] + np.arange(len(left))
        return out, place

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; of a key that isn't among those hashed, any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level in range(len(self.first) - 1):
            if not len(left):
                break
            low, high = int(self.first[level]), int(self.first[level + 1])
            bit = _bit(keys[left], level, 64 * (high - low))
            word, shift = low + (bit >> 6), (bit & 63).astype(np.uint64)
            have = self.words[word] >> shift & np.uint64(1) != 0
            below = self.words[word] & ((np.uint64(1) << shift) - np.uint64(1))
            out[left[have]] = (self.before[word] + np.bitwise_count(below))[have]
            left = left[~have]
        for i, key in enumerate(self.rest):
            out[left[keys[left] == key]] = int(self.before[-1]) + i
        return out


@dataclass
class Table:
    """Values of 128-bit keys behind a perfect hash: a key's second half is its fingerprint.

    A key that isn't there is taken for one that is with probability 2^-64."""

    hash: PerfectHash
    fingerprint: np.ndarray
    count: np.ndarray
    holder: np.ndarray

    @classmethod
    def of(cls, one: np.ndarray, two: np.ndarray, count: np.ndarray, holder: np.ndarray) -> Table:
        hashed, place = PerfectHash.of(one)
        back = np.empty(len(place), np.int64)
        back[place] = np.arange(len(place))
        return cls(hashed, two[back].astype(np.uint64), np.minimum(count[back], 2**32 - 1).astype(np.uint32), holder[back].astype(np.int64))

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't there."""
        at = self.hash.places(one)
        at[(at >= 0) & (self.fingerprint[at] != two)] = -1
        if len(self.hash.rest):  # keys that share their first half
            twice = np.flatnonzero(np.isin(one, self.hash.rest))
            for i in twice:
                own = np.flatnonzero((self.hash.rest == one[i]) & (self.fingerprint[len(self.fingerprint) - len(self.hash.rest) :] == two[i]))
                at[i] = len(self.fingerprint) - len(self.hash.rest) + own[0] if len(own) else -1
        return at

    def bytes(self) -> bytes:
        out = io.BytesIO()
        h = self.hash
        np.savez(out, words=h.words, first=h.first, rest=h.rest, fingerprint=self.fingerprint, count=self.count, holder=self.holder)
        return out.getvalue()

    @classmethod
    def read(cls, data: bytes) -> Table:
        x = np.load(io.BytesIO(data))
        before = np.cumsum(np.concatenate(([0], np.bitwise_count(x["words"])))).astype(np.int64)
        return cls(PerfectHash(x["words"], x["first"], before, x["rest"]), x["fingerprint"], x["count"], x["holder"])
