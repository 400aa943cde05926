"""Enhanced suffix array over the contexts of one bucket, and its common-prefix intervals.

The suffixes are those window starts of short contexts whose anchor another context also has. They
are sorted by their text, longest common prefixes of neighbours are read off, and a stack scan
turns these into the tree of common-prefix intervals. An interval whose members all have the same
byte to the left is not maximal: the interval one byte to the left has the same members and a
longer prefix, so it is left out.
"""

from __future__ import annotations

import numpy as np

_8 = np.uint64(8)


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(prefix length, first, last) of every interval of two or more neighbours, by a stack scan;
    ``lcp[i]`` is the common prefix of suffixes i and i + 1. Parents come before their children."""
    found, stack = [], []
    for i, length in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > length:
            depth, first = stack.pop()
            found.append((depth, first, i))
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    return found[::-1]


class Suffixes:
    """Window starts in ``text``, the contexts joined, of those that may repeat."""

    def __init__(self, text: bytes, offset: np.ndarray, length: np.ndarray, group: np.ndarray, at: np.ndarray, width: int):
        self.text = np.frombuffer(text + bytes(16), np.uint8)
        self.width = width
        count = length - width + 1
        self.context = np.repeat(np.arange(len(offset)), count)
        self.start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.position = offset[self.context] + self.start
        self.end = (offset + length)[self.context]
        # Equal windows have their anchor at the same place, so only these can be equal.
        self.rank = group[self.context] * 256 + (self.start - at[self.context] + 128)

    def _keep(self, chosen: np.ndarray) -> None:
        for name in ("context", "start", "position", "end", "rank"):
            setattr(self, name, getattr(self, name)[chosen])

    def _words(self, at: int, n: int) -> np.ndarray:
        """``n`` (at most 8) bytes of each suffix from ``at`` on, as a number in text order."""
        view = np.ndarray((len(self.text) - 7,), ">u8", self.text, 0, (1,))
        return view[self.position + at].astype(np.uint64) >> np.uint64(64 - 8 * n)

    def _refine(self, value: np.ndarray, singles: bool = False) -> None:
        """Sort by one more value inside each rank; a suffix alone in its rank has no repeat."""
        order = np.lexsort((value, self.rank))
        rank, value = self.rank[order], value[order]
        new = np.ones(len(order), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (value[1:] != value[:-1])
        self._keep(order)
        self.rank = np.cumsum(new) - 1
        if not singles:
            self._keep(np.bincount(self.rank)[self.rank] > 1 if len(order) else order)

    def sort_windows(self) -> None:
        """Keep the suffixes whose whole window repeats, in groups of equal windows."""
        for at in range(0, self.width, 8):
            self._refine(self._words(at, min(8, self.width - at)))

    def drop_extendable(self) -> None:
        """Drop groups with the same byte to the left of every member."""
        if not len(self.rank):
            return
        left = np.where(self.start > 0, self.text[self.position - 1].astype(np.int64), -1)
        first = np.flatnonzero(np.diff(self.rank, prepend=-1))
        low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
        diverse = (low == -1) | (low != high)
        which = np.cumsum(np.diff(self.rank, prepend=self.rank[0]) != 0)
        self._keep(diverse[which])

    def sort_rest(self) -> np.ndarray:
        """Order each group by what follows the window; common prefix of each suffix with the next
        one of its group, -1 at the last of a group. An end of context sorts before any byte."""
        root, rest = self.rank.copy(), self.end - self.position
        columns = []
        for at in range(self.width, int(rest.max(initial=0)), 7):
            n = np.clip(rest - at, 0, 7)
            ok = n > 0
            value = np.zeros(len(rest), np.uint64)
            view = np.ndarray((len(self.text) - 7,), ">u8", self.text, 0, (1,))
            bytes7 = view[self.position[ok] + at].astype(np.uint64) >> _8
            cut = (_8 * (np.uint64(7) - n[ok].astype(np.uint64)))
            value[ok] = ((bytes7 >> cut << cut) << _8) | n[ok].astype(np.uint64)
            columns.append(value)
        order = np.lexsort((*columns[::-1], root))
        self._keep(order)
        self.rank = root[order]
        same = np.zeros(len(order), bool)
        same[:-1] = self.rank[1:] == self.rank[:-1]
        lcp = np.where(same, self.width, -1)
        open_, at = same.copy(), self.width
        left = self.end - self.position
        while open_.any():
            i = np.flatnonzero(open_)
            inside = (left[i] > at) & (left[i + 1] > at)
            j = i[inside]
            equal = self.text[self.position[j] + at] == self.text[self.position[j + 1] + at]
            open_[:] = False
            open_[j[equal]] = True
            lcp[j[equal]] += 1
            at += 1
        return lcp

    def repeat_groups(self):
        """Sort, and give the maximal repeats as arrays (lengths, firsts, lasts), parents first.

        Groups of two, which are most, are one interval each and need no stack."""
        lcp = self.sort_rest()
        if not len(lcp):
            return []
        first = np.flatnonzero(np.diff(self.rank, prepend=-1))
        size = np.diff(np.append(first, len(lcp)))
        pairs = first[size == 2]
        found = [(lcp[pairs], pairs, pairs + 1)]
        for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            tree = intervals(lcp[f : f + n - 1].tolist())
            found.append(tuple(np.array(x) + (f if k else 0) for k, x in enumerate(zip(*tree, strict=True))))
        return found


def earlier_windows(
    text: bytes, offset: np.ndarray, length: np.ndarray, group: np.ndarray, at: np.ndarray, ids: np.ndarray, width: int
) -> np.ndarray:
    """Per context, as bits by window start, the windows that a context with a smaller id also has."""
    suffixes = Suffixes(text, offset, length, group, at, width)
    suffixes.sort_windows()
    suffixes.drop_extendable()
    masks = np.zeros(len(offset), np.uint64)
    groups = suffixes.repeat_groups()
    longest = np.zeros(len(suffixes.rank), np.int64)
    owner = ids[suffixes.context]
    for lengths, firsts, lasts in groups:
        if len(firsts) and (lasts - firsts == 1).all():
            a, b = owner[firsts], owner[lasts]
            np.maximum.at(longest, firsts[a > b], lengths[a > b])
            np.maximum.at(longest, lasts[b > a], lengths[b > a])
            continue
        for n, f, s in zip(lengths.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
            members = owner[f : s + 1]
            longest[f : s + 1][members > members.min()] = n
    hit = longest > 0
    run = (np.uint64(1) << (longest[hit] - width + 1).astype(np.uint64)) - np.uint64(1)
    np.bitwise_or.at(masks, suffixes.context[hit], run << suffixes.start[hit].astype(np.uint64))
    return masks
