"""Content-chosen anchors: every window of ``length`` symbols is assigned to the smallest of
its k-grams, and neighbouring windows with the same anchor form one segment.

Two equal windows choose the same anchor at the same offset wherever they stand, so windows
need only be compared within groups of equal anchors, and equal segments stand for all of
their windows at once. About 2 in (length - k + 2) symbols are anchors.

Unlike texts meet in many short grams, the more of them the larger the corpus is. A window has
at least half of its other symbols before its anchor, or after it, so segments that share a
window agree in that many symbols on one side. ``sides`` tells them apart.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random 64-bit number for each byte.
BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, np.uint64)
SIDE = 14


class Segments(NamedTuple):
    """Arrays with one entry a segment: the row it stands in, the place of its first window
    in that row, its number of windows, its anchor's hash, that of the whole segment, and, where
    asked for, two of ``SIDE`` bits: of the symbols right before the anchor and right after it, 0
    where the segment has too few."""

    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray
    sides: np.ndarray | None = None


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def segments(symbols: np.ndarray, sizes: np.ndarray, length: int, k: int, sides: bool = False) -> Segments:
    """The segments of rows of 64-bit symbols that stand one behind the other in ``symbols``;
    ``sizes`` has their lengths. No window crosses two rows."""
    n, w = len(symbols), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return Segments(none, none, none, none, none, none.astype(np.int32))
    size = 1 << max(12, (n + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=total[1:])
    grams = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    # the low half orders equal hashes by place; the anchor is the least in each window
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(keyed) % w
    blocks = np.concatenate([keyed, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    place = (np.minimum(after[:starts], before[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place[row[:starts] != row[length - 1 :]] = -1
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, starts))
    keep = place[first] >= 0
    first, count = first[keep], count[keep]
    anchor = grams[place[first]]
    stop = first + count + length - 1
    whole = mix(((total[stop] - total[first]) * down[first]) ^ (count.astype(np.uint64) << np.uint64(40)))
    where = row[first]
    both = None
    if sides:
        half, at = (length - k + 1) // 2, place[first]

        def side(start: np.ndarray, there: np.ndarray) -> np.ndarray:
            start = np.where(there, start, 0)
            h = mix((total[start + half] - total[start]) * down[start]) >> np.uint64(64 - SIDE)
            return np.where(there, np.maximum(h, np.uint64(1)), np.uint64(0)).astype(np.int32)

        both = side(at - half, at - half >= first) << SIDE | side(at + k, at + k + half <= stop)
    return Segments(where, first - (ends - sizes)[where], count, anchor.view(np.int64), whole.view(np.int64), both)
