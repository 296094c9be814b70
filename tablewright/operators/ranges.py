"""Pairs within a distance as ranges instead of edges, and maximum matchings over them.

The rows of a block lie on lines: all values but those of the column with most values are equal. On a line that is sorted by
that column the rows within a distance of a row are one range, because every step of the distance, rounded as it is, rises with
the gap. A row has a range for each line near its own, however many rows these hold, so that memory grows with rows and lines,
not with pairs.
"""

from __future__ import annotations

import time
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np

from .flows import TICKS

#: Pairs of lines that are looked at at a time, and ranges that are searched for at a time.
CHUNK = 1 << 20


def distances(x: Sequence[np.ndarray], y: Sequence[np.ndarray], p: float = 1) -> np.ndarray:
    """Of rows given by their columns, summed in the order of these, as the radius join does."""
    total = 0.0
    for a, b in zip(x, y):
        gap = np.abs(a - b)
        total = total + (gap if p == 1 else gap ** float(p))
    return total if p == 1 else total ** (1.0 / p)


class Ranges:
    """The rows of y within alpha of each row of x; x and y have a row for each row and a column for each column.

    `order` has y's rows in the order that ranges count in; row i of x meets order[lo[k]:hi[k]] for each k from start[i] to
    start[i + 1], its own line first. Rows with a value that is no number meet nothing, nor do rows of different blocks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, alpha: float, p: float = 1, blocks: tuple[np.ndarray, np.ndarray] | None = None):
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        d, whole = x.shape[1], np.flatnonzero(~np.isnan(y).any(axis=1))
        values = [len(np.unique(np.r_[x[:, c], y[:, c]])) for c in range(d)]
        line = int(np.argmax(values))
        if blocks is not None:
            # One column more, with a step of more than alpha from block to block.
            x, y = (np.c_[t, np.asarray(b) * (2.0 * alpha + 1)] for t, b in zip((x, y), blocks))
            values.append(len(np.unique(np.r_[blocks[0], blocks[1]])))
            d += 1
        rest = sorted((c for c in range(d) if c != line), key=lambda c: -values[c])
        self.line_of, profiles_x = _lines(x, rest)
        of_y, profiles_y = _lines(y[whole], rest)
        self.order = whole[np.lexsort((y[whole, line], of_y))]
        ys = np.ascontiguousarray(y[self.order].T)
        first = np.searchsorted(np.sort(of_y), np.arange(len(profiles_y) + 1))
        with np.errstate(invalid="ignore", over="ignore"):
            u, v, apart = self._near(profiles_x, profiles_y, rest, d, alpha, p)
            members = np.argsort(self.line_of, kind="stable")
            begin = np.searchsorted(self.line_of[members], np.arange(len(profiles_x) + 1))
            found = []
            for at in _chunks(np.diff(begin)[u]):
                sizes = np.diff(begin)[u[at]]
                rows = members[np.repeat(begin[u[at]], sizes) + _counted(sizes)]
                found.append((rows, *self._search(x[rows], ys, line, np.repeat(first[v[at]], sizes), np.repeat(first[v[at] + 1], sizes), alpha, p), np.repeat(apart[at], sizes)))
        rows, lo, hi, far = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 4
        keep = np.flatnonzero(hi > lo)
        keep = keep[np.lexsort((lo[keep], far[keep], rows[keep]))]
        self.lo, self.hi = lo[keep], hi[keep]
        self.start = np.searchsorted(rows[keep], np.arange(len(x) + 1))
        #: x's rows by line, and along each.
        self.along = np.lexsort((x[:, line], self.line_of))

    @staticmethod
    def _near(a: np.ndarray, b: np.ndarray, rest: list[int], d: int, alpha: float, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines of x and of y that are within alpha but for the column along them, and their distance."""
        if not rest:
            u = np.repeat(np.arange(len(a)), len(b))
            return u, np.tile(np.arange(len(b)), len(a)), np.zeros(len(u))
        order = np.argsort(b[:, 0], kind="stable")
        wide = alpha + 1e-9 * (alpha + np.abs(a[:, 0]))
        lo, hi = np.searchsorted(b[order, 0], a[:, 0] - wide, "left"), np.searchsorted(b[order, 0], a[:, 0] + wide, "right")
        by_column, out = [rest.index(c) for c in range(d) if c in rest], []
        for at in _chunks(hi - lo):
            n = np.maximum(hi[at] - lo[at], 0)
            u = np.repeat(np.arange(at.start, at.stop), n)
            v = order[np.repeat(lo[at], n) + _counted(n)]
            apart = distances([a[u, k] for k in by_column], [b[v, k] for k in by_column], p)
            near = apart <= alpha
            out.append((u[near], v[near], apart[near]))
        return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))

    @staticmethod
    def _search(x: np.ndarray, ys: np.ndarray, line: int, begin: np.ndarray, end: np.ndarray, alpha: float, p: float) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row of x on the line of y from begin to end, by bisection with the distance itself."""

        def bisect(lo: np.ndarray, hi: np.ndarray, low) -> np.ndarray:
            lo, hi = lo.copy(), hi.copy()
            while len(at := np.flatnonzero(lo < hi)):
                mid = (lo[at] + hi[at]) >> 1
                up = low(at, mid)
                lo[at[up]], hi[at[~up]] = mid[up] + 1, mid[~up]
            return lo

        within = lambda at, mid: distances([x[at, c] for c in range(x.shape[1])], [col[mid] for col in ys], p) <= alpha
        middle = bisect(begin, end, lambda at, mid: ys[line][mid] < x[at, line])
        return bisect(begin, middle, lambda at, mid: ~within(at, mid)), bisect(middle, end, within)

    def sums(self, weights_x: np.ndarray, weights_y: np.ndarray) -> tuple[int, int]:
        """Pairs, and pairs of the rows that each stands for."""
        before = np.r_[0, np.cumsum(np.asarray(weights_y, dtype=np.int64)[self.order])]
        own = np.repeat(np.asarray(weights_x, dtype=np.int64), np.diff(self.start))
        return int((self.hi - self.lo).sum()), int((own * (before[self.hi] - before[self.lo])).sum())


def _lines(rows: np.ndarray, rest: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's line, and the lines' values in the columns of rest."""
    if not rest:
        return np.zeros(len(rows), dtype=np.int64), np.zeros((1, 0))
    profiles, of = np.unique(rows[:, rest] + 0.0, axis=0, return_inverse=True)
    return of.ravel(), profiles


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _chunks(sizes: np.ndarray) -> list[slice]:
    """Slices of which each has a sum of sizes of about CHUNK, or one entry."""
    sums, out, at = np.cumsum(np.maximum(sizes, 0)), [], 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CHUNK, "right")))
        out.append(slice(at, end))
        at = end
    return out


def match_ranges(r: Ranges, supply: np.ndarray, demand: np.ndarray, seconds: float | None = None) -> list[tuple[int, int, int]]:
    """A maximum matching as (row of x, row of y, pairs), by Hopcroft-Karp over ranges. A phase touches each row of y once,
    because rows that are done with are skipped over. TimeoutError beyond `seconds`."""
    until, ticks = None if seconds is None else time.monotonic() + seconds, 0
    lo, hi, start = r.lo.tolist(), r.hi.tolist(), r.start.tolist()
    free_x, free_y = [int(k) for k in supply], [int(k) for k in np.asarray(demand)[r.order]]
    n_y = len(free_y)
    held: list[dict[int, int]] = [{} for _ in range(n_y)]

    def tick() -> None:
        nonlocal ticks
        ticks += 1
        if until is not None and ticks % TICKS == 0 and time.monotonic() > until:
            raise TimeoutError

    def following(up: list[int], at: int) -> int:
        while up[at] != at:
            up[at] = up[up[at]]
            at = up[at]
        return at

    # Along each line the first rows left of the own range, which is the best on one line; then of all ranges.
    left = [y if k else y + 1 for y, k in enumerate(free_y)] + [n_y]
    for every in (False, True):
        for x in r.along.tolist():
            for k in range(start[x], start[x + 1] if every else min(start[x] + 1, start[x + 1])):
                while free_x[x] and (y := following(left, lo[k])) < hi[k]:
                    tick()
                    n = min(free_x[x], free_y[y])
                    held[y][x] = held[y].get(x, 0) + n
                    free_x[x] -= n
                    free_y[y] -= n
                    if not free_y[y]:
                        left[y] = y + 1

    while True:
        level = [0 if k else -1 for k in free_x]
        front, unseen, at_level, found = [x for x, k in enumerate(free_x) if k], list(range(n_y + 1)), [], False
        while front:
            reached, following_front = [], []
            depth = len(at_level) + 1
            for x in front:
                tick()
                for k in range(start[x], start[x + 1]):
                    while (y := following(unseen, lo[k])) < hi[k]:
                        unseen[y] = y + 1
                        reached.append(y)
                        if free_y[y]:
                            found = True
                        for z in held[y]:
                            if level[z] < 0:
                                level[z] = depth
                                following_front.append(z)
            reached.sort()
            at_level.append(reached)
            front = following_front
        if not found:
            break
        alive = [list(range(len(ys) + 1)) for ys in at_level]
        now, holders = start[:-1], {}
        for first in [x for x, k in enumerate(free_x) if k]:
            path, x = [], first
            while free_x[first]:
                tick()
                ys, up, y = at_level[level[x]], alive[level[x]], None
                while now[x] < start[x + 1]:
                    k = now[x]
                    i = following(up, bisect_left(ys, lo[k]))
                    if i == len(ys) or ys[i] >= hi[k]:
                        now[x] += 1
                        continue
                    y = ys[i]
                    if free_y[y]:
                        break
                    own = holders.get(y)
                    if own is None:
                        own = holders[y] = [z for z in held[y] if level[z] == level[x] + 1]
                    while own and (level[own[-1]] != level[x] + 1 or not held[y].get(own[-1])):
                        own.pop()
                    if own:
                        break
                    up[i], y = i + 1, None
                if y is None:
                    # A dead end is left for the rest of the phase.
                    level[x] = -1
                    if not path:
                        break
                    x = path.pop()[0]
                elif free_y[y]:
                    n = min([free_x[first], free_y[y], *(held[b][z] for _, b, z in path)])
                    for a, b, z in path:
                        held[b][a] = held[b].get(a, 0) + n
                        held[b][z] -= n
                        if not held[b][z]:
                            del held[b][z]
                    held[y][x] = held[y].get(x, 0) + n
                    free_x[first] -= n
                    free_y[y] -= n
                    path, x = [], first
                else:
                    path.append((x, y, holders[y][-1]))
                    x = holders[y][-1]
    order = r.order.tolist()
    return [(x, order[y], k) for y, own in enumerate(held) for x, k in own.items()]
