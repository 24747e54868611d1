"""Rolling hashes and runs over byte and word sequences, for whole arrays at a time."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    if len(_powers.get(base, ())) <= n:
        steps = np.full(max(n + 1, _STEP + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


def powers(n: int) -> np.ndarray:
    return _power(_BASE, n)[:n]


def inverse_powers(n: int) -> np.ndarray:
    return _power(_INVERSE, n)[:n]


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = values + np.uint64((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end]; starts must not fall. Works through pieces of bounded size."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        low = starts[done]
        upto = max(done + 1, int(np.searchsorted(starts, low + _STEP // 2, "left")))
        high = int(ends[done:upto].max())
        size = int(high - low)
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        part = values[low:high].astype(np.uint64) + np.uint64(1)
        np.cumsum(part * _power(_BASE, size)[:size], out=sums[1:])
        a, b = starts[done:upto] - low, ends[done:upto] - low
        out[done:upto] = (sums[b] - sums[a]) * _power(_INVERSE, size)[a]
        done = upto
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    reach, low = 1, values
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of maximal runs of true values; a run also ends before a true break."""
    before = np.empty(len(mask), bool)
    if len(mask):
        before[0] = False
        before[1:] = mask[:-1]
    first = np.flatnonzero(mask & (~before | breaks))
    after = np.concatenate((~mask[1:] | breaks[1:], [True])) if len(mask) else mask
    last = np.flatnonzero(mask & after)
    return first, last - first + 1


def split_runs(first: np.ndarray, length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut into pieces of at most `most`."""
    pieces = -(-length // most)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + nth * most
    end = np.minimum(begin + most, np.repeat(first + length, pieces))
    return begin, end - begin


def same_ranges(values: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
    """Whether values[a:a + length] equals values[b:b + length] for all; in bounded pieces."""
    ends = np.cumsum(length)
    done = 0
    while done < len(a):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + _STEP, "right")))
        n = length[done:upto]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (values[np.repeat(a[done:upto], n) + within] != values[np.repeat(b[done:upto], n) + within]).any():
            return False
        done = upto
    return True
