"""Static binary-fuse filters (3-wise, 8-bit fingerprints) built and probed with numpy.

A filter over n distinct 64-bit keys takes about 9 bits a key.  It never misses a key it was
built from and lets about 1/256 of the others through.  Filters are immutable bytes:
a header (seed, segment length, segment count) followed by the fingerprint array.
"""

from __future__ import annotations

import struct

import numpy as np

_HEADER = "<QII"
_MAX_TRIES = 64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply / xor-shift rounds) of key + seed."""
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, seg_len: int, seg_count: int) -> np.ndarray:
    """Three slots per key, in three consecutive segments: shape (3, n)."""
    high = h >> np.uint64(32)
    first = (high * np.uint64(seg_count)) >> np.uint64(32)
    mask = np.uint64(seg_len - 1)
    base = first * np.uint64(seg_len)
    offsets = (h & mask, (h >> np.uint64(11)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40) & mask,
               (h >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(36) & mask)
    return np.stack([base + np.uint64(i * seg_len) + o for i, o in enumerate(offsets)]).astype(np.int64)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8)


def _size(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of starting segments for n keys."""
    if n <= 1:
        return 4, 1
    seg_len = min(1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    return seg_len, max(1, int(np.ceil(n * factor / seg_len)) - 2)


def build(keys: np.ndarray) -> bytes:
    """The filter of the given 64-bit keys (repeats allowed; no keys: a filter that rejects all)."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if n == 0:
        return b""
    seg_len, seg_count = _size(n)
    with np.errstate(over="ignore"):
        for attempt in range(_MAX_TRIES):
            seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & 0xFFFFFFFFFFFFFFFF
            order = _peel(_places(h := _mix(keys, seed), seg_len, seg_count), (seg_count + 2) * seg_len)
            if order is not None:
                break
            if attempt % 8 == 7:  # unlucky: give it more room
                seg_count += max(1, seg_count // 16)
        else:
            raise RuntimeError(f"no binary-fuse filter found for {n} keys")
        places, prints = _places(h, seg_len, seg_count), _fingerprint(h)
    table = np.zeros((seg_count + 2) * seg_len, dtype=np.uint8)
    for rows, slots in reversed(order):  # last peeled first; the keys of a round have slots of their own
        table[slots] = 0
        p = places[:, rows]
        table[slots] = prints[rows] ^ table[p[0]] ^ table[p[1]] ^ table[p[2]]
    return struct.pack(_HEADER, seed, seg_len, seg_count) + table.tobytes()


def _peel(places: np.ndarray, n_slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot each holds alone); None if some keys can't be freed."""
    n = places.shape[1]
    count = np.bincount(places.ravel(), minlength=n_slots)
    owner = np.zeros(n_slots, dtype=np.int64)  # xor of the keys in a slot: the key itself where it is alone
    for p in places:
        np.bitwise_xor.at(owner, p, np.arange(n))
    rounds, left = [], n
    alone = np.flatnonzero(count == 1)
    while len(alone):
        rows, first = np.unique(owner[alone], return_index=True)
        slots = alone[first]
        rounds.append((rows, slots))
        left -= len(rows)
        for p in places[:, rows]:
            np.subtract.at(count, p, 1)
            np.bitwise_xor.at(owner, p, rows)
        touched = np.unique(places[:, rows])
        alone = touched[count[touched] == 1]
    return rounds if left == 0 else None


def contains(filter_bytes: bytes | None, keys: np.ndarray) -> np.ndarray:
    """For each key, whether it may be in the filter."""
    if not filter_bytes:
        return np.zeros(len(keys), dtype=bool)
    seed, seg_len, seg_count = struct.unpack_from(_HEADER, filter_bytes)
    table = np.frombuffer(filter_bytes, dtype=np.uint8, offset=struct.calcsize(_HEADER))
    with np.errstate(over="ignore"):
        h = _mix(keys.astype(np.uint64), seed)
        p = _places(h, seg_len, seg_count)
        return (table[p[0]] ^ table[p[1]] ^ table[p[2]]) == _fingerprint(h)
