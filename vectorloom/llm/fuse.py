"""Binary fuse filters (three positions, 16-bit fingerprints) over 64-bit keys, built and probed with numpy."""

from __future__ import annotations

import struct

import numpy as np

U = np.uint64
M1, M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
HEAD = struct.Struct("<QIIQ")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + U(seed)
    h = (h ^ (h >> U(33))) * M1
    h = (h ^ (h >> U(33))) * M2
    return h ^ (h >> U(33))


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three positions a key, in consecutive segments."""
    first = ((h >> U(32)) * U(segments)) >> U(32)
    low = [h & U(segment - 1), (h >> U(18)) & U(segment - 1), (h >> U(36)) & U(segment - 1)]
    return np.stack([(first + U(i)) * U(segment) + low[i] for i in range(3)]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> U(32))) & U(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of uint64 keys. Keys are peeled a layer at a time; a layer's keys share none of the places that they are peeled at."""
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(3, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    size = int(np.ceil(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))))) + 3 * segment
    segments = max(1, -(-size // segment) - 2)
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        at = _places(h, segment, segments)
        total = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=total)
        owner = np.zeros(total, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        layers, left = [], n
        alone = np.nonzero(count == 1)[0]
        while len(alone):
            who, one = np.unique(owner[alone], return_index=True)
            layers.append((who, alone[one]))
            left -= len(who)
            spots = at[:, who]
            np.subtract.at(count, spots.ravel(), 1)
            for row in spots:
                np.bitwise_xor.at(owner, row, who)
            touched = np.unique(spots)
            alone = touched[count[touched] == 1]
        if not left:
            break
    else:
        raise RuntimeError("the keys could not be peeled")
    prints, table = _print(h), np.zeros(total, np.uint16)
    for who, spot in reversed(layers):
        table[spot] = 0
        table[spot] = prints[who] ^ table[at[0, who]] ^ table[at[1, who]] ^ table[at[2, who]]
    return HEAD.pack(seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments, n) + table.tobytes()


def maybe_in(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter's set: always for those that are, for one in 65,536 of the others."""
    seed, segment, segments, n = HEAD.unpack_from(blob)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint16, offset=HEAD.size)
    h = _mix(keys, seed)
    at = _places(h, segment, segments)
    return _print(h) == table[at[0]] ^ table[at[1]] ^ table[at[2]]
