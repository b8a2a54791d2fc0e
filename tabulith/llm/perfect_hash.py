"""A minimal perfect hash over 64-bit keys, built level by level from collision-free bits."""

from __future__ import annotations

import io

import numpy as np

from .common import MIX, mix64

#: bits for each key left at a level
GAMMA = 1.7
#: after so many levels the few keys left are kept in a sorted list
LEVELS = 24
_WORD = 64


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * int(MIX) & 0xFFFFFFFFFFFFFFFF))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The index file of each key."""
    return (hashed(keys, 1000) % np.uint64(buckets)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (hashed(keys, 2000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """``slots(keys)`` maps the n keys it was built from onto 0..n-1; a strange key gives any slot or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ones = np.bitwise_count(bits).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """``keys`` are distinct."""
        left, sizes, words = keys, [], []
        while len(left) and len(sizes) < LEVELS:
            m = -(-int(len(left) * GAMMA + 1) // _WORD) * _WORD
            at = (hashed(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(m)
            left = left[~alone[at]]
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        return cls(np.asarray(sizes, np.int64), bits, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, m in enumerate(self.sizes.tolist()):
            if not len(todo):
                return out
            at = (hashed(keys[todo], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, bit = at // _WORD, (at % _WORD).astype(np.uint64)
            value = self.bits[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.ranks[word] + below)[hit]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.ranks[-1] + at[hit]
        return out


def dump(keys: np.ndarray, values: dict[str, np.ndarray]) -> bytes:
    """An index file: the hash, and by slot a fingerprint of the key and the values."""
    mph = PerfectHash.build(keys)
    at = mph.slots(keys)
    out = {"sizes": mph.sizes, "bits": mph.bits, "rest": mph.rest, "print": np.empty(len(keys), np.uint32)}
    out["print"][at] = fingerprint(keys)
    for name, v in values.items():
        out[name] = np.empty_like(v)
        out[name][at] = v
    buffer = io.BytesIO()
    np.savez(buffer, **out)
    return buffer.getvalue()


class Index:
    """Reads what ``dump`` wrote."""

    def __init__(self, data: bytes):
        loaded = np.load(io.BytesIO(data))
        self.values = {k: loaded[k] for k in loaded.files}
        self.mph = PerfectHash(self.values.pop("sizes"), self.values.pop("bits"), self.values.pop("rest"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which keys are there by their fingerprints, and the values of those."""
        at = self.mph.slots(keys)
        there = at >= 0
        there[there] = self.values["print"][at[there]] == fingerprint(keys[there])
        return there, {k: v[at[there]] for k, v in self.values.items() if k != "print"}
