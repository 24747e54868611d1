"""Two-stage suffix sorting of one text to a limited depth, in whole-array steps."""

from __future__ import annotations

import numpy as np

from eventloom.llm import rolling


def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last is not."""
    n = len(text)
    change = np.append(text[:-1] != text[1:], True)
    at = np.where(change, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    inner = following < n - 1
    out = np.zeros(n, bool)
    out[inner] = text[following[inner]] < text[following[inner] + 1]
    return out


class _Text:
    """Keys and hashes of ranges, past the end as if zeros followed."""

    def __init__(self, text: np.ndarray, depth: int):
        padded = np.append(text, np.zeros(depth + 16, np.uint8))
        n = len(padded) - 8
        self.keys = np.zeros(n, np.uint64)
        for i in range(8):
            self.keys |= padded[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.sums = np.zeros(len(padded) + 1, np.uint64)
        np.cumsum((padded.astype(np.uint64) + np.uint64(1)) * rolling.powers(len(padded)), out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the ranges from a and b have equal hashes; a and b may be in any order."""
        inverse = rolling.inverse_powers(len(self.sums))
        return (self.sums[a + length] - self.sums[a]) * inverse[a] == (
            self.sums[b + length] - self.sums[b]
        ) * inverse[b]


def _numbered(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each group, groups numbered from 0); members of a group are neighbours."""
    new = np.append(True, group[1:] != group[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _sorted(text: _Text, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes `at` in the order of their first `depth` bytes.

    Groups that agree on their key are refined where their members first differ, which is found
    by bisection over hashes of ranges. A group whose members all agree to the depth is done.
    """
    key = text.keys[at]
    order = np.argsort(key, kind="stable")
    out, key = at[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    spots = np.arange(len(out))
    group = np.cumsum(new) - 1
    while len(spots):
        sizes = np.bincount(group)
        many = sizes[group] > 1
        spots, group = spots[many], group[many]
        if not len(spots):
            break
        begin, group = _numbered(group)
        mine, leader = out[spots], out[spots[begin]][group]
        differs = ~text.same(mine, leader, depth)
        rest = np.logical_or.reduceat(differs, begin)[group]
        if not rest.any():
            break
        spots, mine, leader, differs = spots[rest], mine[rest], leader[rest], differs[rest]
        begin, group = _numbered(group[rest])
        common = np.full(len(mine), depth)
        a, b = mine[differs], leader[differs]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), depth - 1)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            agrees = text.same(a, b, middle)
            low = np.where(open_ & agrees, middle, low)
            high = np.where(open_ & ~agrees, middle - 1, high)
        common[differs] = low
        key = text.keys[mine + np.minimum.reduceat(common, begin)[group]]
        order = np.lexsort((key, group))
        out[spots] = mine[order]
        group, key = group[order], key[order]
        group = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))) - 1
    return out


def _needed(small: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes, and those behind them up to the next that is sorted directly."""
    at = np.arange(len(small))
    direct = np.maximum.accumulate(np.where(small, at, -1))
    last = np.append(-1, direct[:-1])  # the last one directly sorted before each place
    return np.maximum.accumulate(np.where(wanted, at, -1)) > last


def suffix_order(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in the order of at least their first `depth` bytes; equal ones in any order.

    Only suffixes smaller than their successors are sorted directly. The others follow from
    one scan over the buckets of first bytes: whatever stands before a suffix in the text and is
    greater than it comes next in the bucket of its own first byte. With a mask `wanted`, only those
    suffixes and the ones that their order follows from are put in order.
    """
    small = _smaller_than_next(text)
    needed = np.ones(len(text), bool) if wanted is None else _needed(small, wanted)
    direct = _sorted(_Text(text, depth), np.flatnonzero(small & needed), depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    passes = needed & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def pass_on(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[passes[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            bounds = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(before)], strict=True):
                waiting[first[a]].append(before[a:b])

    pass_on(np.array([len(text)]))  # the empty suffix, smaller than all
    out = []
    for byte in range(256):
        while waiting[byte]:
            found, waiting[byte] = np.concatenate(waiting[byte]), []
            out.append(found)
            pass_on(found)
        own = direct[cuts[byte] : cuts[byte + 1]]
        out.append(own)
        pass_on(own)
    return np.concatenate(out)


def repeated(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes, of the valid ones, share their first `length` bytes with another valid one."""
    found = np.zeros(len(text), bool)
    if valid.sum() < 2:
        return found
    order = suffix_order(text, length, valid)
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    joined = np.append(text, np.zeros(length, np.uint8))
    common = _common(joined, a, b, length)
    found[a[common]] = True
    found[b[common]] = True
    return found


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether adjacent suffixes have a common prefix of `length` bytes.

    Hashes tell the candidates, which are then compared. If the pair one byte before is a
    candidate too, only the last byte is left to compare.
    """
    sums = rolling.range_hashes(text, np.arange(len(text) - length + 1), np.arange(length, len(text) + 1))
    same = np.flatnonzero(sums[a] == sums[b])
    partner = np.full(len(text) + 1, -2, np.int64)
    partner[a[same]] = b[same]
    left, right = a[same], b[same]
    known = np.where((left > 0) & (partner[left - 1] == right - 1) & (right > 0), length - 1, 0)
    out = np.zeros(len(a), bool)
    if rolling.same_ranges(text, left + known, right + known, length - known):
        out[same] = True
    else:  # a collision of hashes: compare all in full
        for i, x, y in zip(range(len(a)), a.tolist(), b.tolist(), strict=True):
            out[i] = (text[x : x + length] == text[y : y + length]).all()
    return out
