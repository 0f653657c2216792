"""Windows of bytes and their anchors, vectorised.

The anchor of a window of `length` bytes is the smallest hash of its GRAM-byte strings, the
leftmost if there are several. It depends on the bytes of the window alone: equal windows have
equal anchors at equal places. A segment is a stretch of windows that share one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shared import spread

GRAM = 128
#: Starts of windows that are looked at in one go.
BLOCK = 1 << 18
_U = np.uint64
_ODD = spread(np.arange(900, 960, dtype=_U)) | _U(1)
_LOW = _U((1 << 24) - 1)


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x ^= x >> _U(32)
    x *= _ODD[k]
    x ^= x >> _U(29)
    return x


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 128 and of the 256 bytes at each place (of zeros beyond the end)."""
    n = len(data)
    raw = np.zeros(n + 264, np.uint8)
    raw[:n] = data
    h = np.empty(n + 256, _U)
    for r in range(8):
        part = raw[r : r + (len(h) - r + 7) // 8 * 8]
        h[r::8] = part[: len(part) // 8 * 8].view(_U)[: len(h[r::8])]
    with np.errstate(over="ignore"):
        h = _mix(h, 0)
        for k, size in enumerate((8, 16, 32, 64)):
            h = _mix(h[:-size] * _ODD[10 + k] + h[size:], k + 1)
        h = h[: n + 128]
        return h[:n], _mix(h[:-128] * _ODD[20] + h[128:], 6)[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width], for every i that has so many."""
    n = len(x) - width + 1
    rows = -(-len(x) // width) + 1
    padded = np.full(rows * width, np.iinfo(_U).max, _U)
    padded[: len(x)] = x
    table = padded.reshape(rows, width)
    before = np.minimum.accumulate(table, 1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, n, ahead, anchor, content) of all segments, in blocks.

    n windows start at `start` of the text and on; their anchor is `ahead` of the first of them;
    content is a hash of all n + length - 1 bytes.
    """
    if length < 256:
        raise ValueError("length must be at least 256")
    width = length - GRAM + 1
    ends = offsets[1:] - length + 1  # windows of a text start before this
    has = ends > offsets[:-1]
    for first in range(0, len(data), BLOCK):
        last = min(first + BLOCK, len(data))
        piece = data[first : min(last + length - 1 + width, len(data))]
        lo, hi = np.clip(offsets[:-1][has] - first, 0, last - first), np.clip(ends[has] - first, 0, last - first)
        some = hi > lo
        if not some.any():
            continue
        lo, hi, texts = lo[some], hi[some], np.flatnonzero(has)[some]
        change = np.zeros(last - first + 1, np.int8)
        change[lo] = 1
        change[hi] -= 1
        inside = np.cumsum(change[:-1]).astype(bool)
        h, long = gram_hashes(piece)
        place = np.arange(len(h), dtype=_U)
        least = sliding_min(np.append((h & ~_LOW) | place, np.full(width, np.iinfo(_U).max, _U)), width)[: last - first]
        at = (least & _LOW).astype(np.int64)
        turn = np.empty(last - first, bool)
        turn[0] = True
        turn[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
        turn[lo] = True
        begin = np.flatnonzero(turn & inside)
        stop = np.minimum(np.append(begin[1:], last - first), hi[np.searchsorted(lo, begin, "right") - 1])
        text = texts[np.searchsorted(lo, begin, "right") - 1]
        n = stop - begin
        size = n + length - 1
        with np.errstate(over="ignore"):
            content = long[begin] * _ODD[30]
            covered = np.full(len(begin), 256)
            while (covered < size - 256).any():
                content += _mix(long[begin + np.minimum(covered, size - 256)] * _ODD[31], 7)
                content *= _ODD[32]
                covered = covered + 256
            content += long[begin + size - 256] * _ODD[33] + size.astype(_U) * _ODD[34]
            content = _mix(content, 8)
        anchor = at[begin]
        yield text, begin + first - offsets[text], n, anchor - begin, h[anchor].view(np.int64), content.view(np.int64)
