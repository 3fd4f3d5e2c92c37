"""Three-wise binary fuse filters with 8-bit fingerprints, in numpy.

Follows the published construction (Graf and Lemire, 2022): each key owns
three slots in consecutive segments and the xor of its slots equals its
fingerprint. Building peels keys that are alone in a slot, wave by wave; all
keys of a wave are handled in one array operation. A filter never misses a
key it was built from; other keys pass with probability about 1/256.
"""

from __future__ import annotations

import math

import numpy as np

U64 = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer over key + seed."""
    with np.errstate(over="ignore"):
        h = keys + U64(seed)
        h ^= h >> U64(33)
        h *= U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(33)
        h *= U64(0xC4CEB9FE1A85EC53)
        h ^= h >> U64(33)
    return h


def _layout(n: int) -> tuple[int, int]:
    """(segment length, number of segments a first slot may fall in)."""
    if n <= 1:
        return 4, 1
    seg = 1 << min(18, int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
    return seg, max(1, math.ceil(n * factor / seg) - 2)


def _slots(h: np.ndarray, seg: int, count: int) -> np.ndarray:
    """The three slots of each hash, shape (n, 3)."""
    first = ((h >> U64(32)) * U64(seg * count)) >> U64(32)
    mask = U64(seg - 1)
    second = (first + U64(seg)) ^ ((h >> U64(18)) & mask)
    third = (first + U64(2 * seg)) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> U64(32))) & U64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Filter over ``keys`` (uint64, repeats allowed): (seed, segment length,
    segment count, fingerprint bytes)."""
    keys = np.unique(keys.astype(U64))
    n = len(keys)
    seg, count = _layout(n)
    size = seg * (count + 2)
    for seed in range(1, 1000):
        h = _mix(keys, seed)
        slots = _slots(h, seg, count)
        waves = _peel(slots, size)
        if waves is None:
            continue
        table = np.zeros(size, dtype=np.uint8)
        fp = _prints(h)
        for idx, own in reversed(waves):
            s = slots[idx]
            others = table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]
            table[own] = fp[idx] ^ others   # own slot is still 0 here
        return seed, seg, count, table.tobytes()
    raise RuntimeError(f"no seed builds a filter over {n} keys")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Waves of (key index, slot it owns) in peeling order; None if stuck."""
    n = len(slots)
    index = np.arange(n, dtype=np.int64)
    held = np.bincount(slots.ravel(), minlength=size)
    xors = np.zeros(size, dtype=np.int64)
    np.bitwise_xor.at(xors, slots.ravel(), np.repeat(index, 3))
    waves, left = [], n
    alone = np.flatnonzero(held == 1)
    while left and len(alone):
        who, first = np.unique(xors[alone], return_index=True)
        own = alone[first]
        waves.append((who, own))
        left -= len(who)
        touched = slots[who].ravel()
        np.subtract.at(held, touched, 1)
        np.bitwise_xor.at(xors, touched, np.repeat(who, 3))
        touched = np.unique(touched)
        alone = touched[held[touched] == 1]
    return waves if not left else None


def contains(filt: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    seed, seg, count, data = filt
    table = np.frombuffer(data, dtype=np.uint8)
    h = _mix(keys.astype(U64), seed)
    s = _slots(h, seg, count)
    return (table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]) == _prints(h)
