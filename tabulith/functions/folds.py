"""Deterministic fold, split and sample numbers from a key hash.

A hash of the key gives the same fold on any partitioning and on any rerun,
so lost executors never change a split.  Shuffled splits of other libraries
cannot be matched row for row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import q


def unit_hash(keys, seed: int = 42) -> Column:
    """Uniform value in [0, 1) from the key columns."""
    h = F.xxhash64(*[q(k) if isinstance(k, str) else k for k in keys], F.lit(seed))
    return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)


def fold(keys, k: int, seed: int = 42) -> Column:
    h = F.xxhash64(*[q(c) if isinstance(c, str) else c for c in keys], F.lit(seed))
    return F.pmod(h, F.lit(k)).cast("int")


def mod_fold(key: str, k: int) -> Column:
    """Fold by an integer key itself; easy to restate in SQL."""
    return F.pmod(q(key), F.lit(k)).cast("int")


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashed(x, so_far=42, wide: bool = False) -> np.ndarray:
    """What Spark's ``xxhash64`` makes of an integer column (a bigint if ``wide``), after the hash of the columns before it."""
    x, h = np.atleast_1d(np.asarray(x)).astype(np.int64).view(np.uint64), np.atleast_1d(np.asarray(so_far)).astype(np.uint64)
    if wide:
        h = (h + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1)
        h = _turned(h, 27) * _P1 + _P4
    else:
        h = (h + _P5 + np.uint64(4)) ^ ((x & np.uint64(0xFFFFFFFF)) * _P1)
        h = _turned(h, 23) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))
