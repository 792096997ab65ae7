"""Sorted runs of suffixes: front coding, and merging by a loser tree that never compares a known prefix again."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the longest common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def front_code(suffixes: list[bytes], extras: list[bytes]) -> bytes:
    """A sorted run as bytes: of each suffix what it shares with the one before, the rest, and its extra."""
    out, before = [struct.pack("<I", len(suffixes))], b""
    for s, extra in zip(suffixes, extras, strict=True):
        known = common_prefix(before, s)
        out.append(struct.pack("<HHH", known, len(s) - known, len(extra)))
        out += (s[known:], extra)
        before = s
    return b"".join(out)


def front_decode(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(shared with the one before, suffix, extra) of each suffix of a run, one at a time."""
    (n,), at, before = struct.unpack_from("<I", run), 4, b""
    for _ in range(n):
        known, more, extra = struct.unpack_from("<HHH", run, at)
        at += 6
        before = before[:known] + run[at : at + more]
        yield known, before, run[at + more : at + more + extra]
        at += more + extra


def merge(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """(shared with the one before, suffix, extra) of all runs in order.

    Each run's head knows how many bytes it shares with the last winner. Of two heads the one that shares more is the
    lesser; only heads that share as many are compared, from there on, and the loser then shares with the winner what
    that comparison found. On the way up the tree of losers all heads know what they share with the same suffix: the
    last winner, which had beaten each of them.
    """
    streams = [front_decode(r) for r in runs]
    k = 1
    while k < len(streams):
        k *= 2
    heads: list = [next(s, None) for s in streams] + [None] * (k - len(streams))
    shared = [0] * k
    losers = [0] * k

    def less(i: int, j: int) -> bool:
        """Whether head i wins against j; the loser learns what it shares with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        n = common_prefix(a[1], b[1], shared[i])
        if a[1][n:] <= b[1][n:]:
            shared[j] = n
            return True
        shared[i] = n
        return False

    level = list(range(k))
    size = k
    while size > 1:
        up = []
        for i in range(0, size, 2):
            a, b = level[i], level[i + 1]
            w = less(a, b)
            losers[(size + i) // 2] = b if w else a
            up.append(a if w else b)
        level, size = up, size // 2
    winner = level[0]
    while heads[winner] is not None:
        _, suffix, extra = heads[winner]
        yield shared[winner], suffix, extra
        heads[winner] = next(streams[winner], None)
        shared[winner] = heads[winner][0] if heads[winner] is not None else 0
        at = (k + winner) // 2
        while at:
            other = losers[at]
            if not less(winner, other):
                losers[at], winner = winner, other
            at //= 2


def shared_with_before(sorted_rows: list[bytes]) -> np.ndarray:
    """For each of a sorted list what it shares with the one before."""
    return np.array([0] + [common_prefix(a, b) for a, b in zip(sorted_rows, sorted_rows[1:], strict=False)], np.int64)[: len(sorted_rows)]
