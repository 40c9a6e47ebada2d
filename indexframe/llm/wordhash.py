"""Hashes of all words of a byte string at once, by a rolling polynomial."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once, at most.
SLICE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(SLICE + 1, base, np.uint64)
            p[0] = 1
            _tables.append(np.multiply.accumulate(p))
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0x94D049BB133111EB)


def bounds(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't gaps."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    return edge[::2], edge[1::2]


class Prefix:
    """Prefix sums of a byte string of at most SLICE bytes, for hashes of its pieces."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self.down = _powers()
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def slices(data: bytes) -> list[bytes]:
    """Pieces of at most SLICE bytes, cut after white space where there is some."""
    out, at = [], 0
    while len(data) - at > SLICE:
        to = max(data.rfind(s, at, at + SLICE) for s in (b" ", b"\n", b"\t")) + 1
        if to <= at:
            to = at + SLICE
        out.append(data[at:to])
        at = to
    return [*out, data[at:]]
