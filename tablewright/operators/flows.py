"""Maximum matchings of bipartite graphs whose nodes have counts, in one task: Hopcroft-Karp, push-relabel, Edmonds-Karp.

Edges are two integer arrays, four bytes each, sorted by the left node; only pairs in use have entries of their own. All
three give the same size; each can be stopped by a time limit.
"""

from __future__ import annotations

import time
from collections import deque

import numpy as np

#: Steps between two looks at the clock.
TICKS = 2048
FAR = 1 << 60


class Graph:
    """Left nodes with rows to give, right nodes with rows to take, and what is matched so far."""

    def __init__(self, a: np.ndarray, b: np.ndarray, supply: dict, demand: dict, seconds: float | None = None):
        self.left, x = np.unique(a, return_inverse=True)
        self.right, y = np.unique(b, return_inverse=True)
        order = np.lexsort((y, x))
        self.near = y[order].astype(np.int32)
        self.start = np.searchsorted(x[order], np.arange(len(self.left) + 1)).tolist()
        self.free_x = [int(supply[k]) for k in self.left.tolist()]
        self.free_y = [int(demand[k]) for k in self.right.tolist()]
        #: For each right node, the left nodes that hold rows of it and how many.
        self.held: list[dict[int, int]] = [{} for _ in self.free_y]
        self.until, self.ticks = None if seconds is None else time.monotonic() + seconds, 0

    def of(self, x: int) -> list[int]:
        return self.near[self.start[x] : self.start[x + 1]].tolist()

    def tick(self) -> None:
        self.ticks += 1
        if self.until is not None and self.ticks % TICKS == 0 and time.monotonic() > self.until:
            raise TimeoutError

    def move(self, x: int, y: int, k: int) -> None:
        """k more rows (or fewer, if negative) of the pair, without a change of what is free."""
        n = self.held[y].get(x, 0) + k
        if n:
            self.held[y][x] = n
        else:
            self.held[y].pop(x, None)

    def greedy(self) -> None:
        """Left nodes with few neighbours first."""
        degrees = np.diff(self.start)
        for x in np.argsort(degrees, kind="stable").tolist():
            for y in self.of(x):
                if not self.free_x[x]:
                    break
                k = min(self.free_x[x], self.free_y[y])
                if k:
                    self.move(x, y, k)
                    self.free_x[x] -= k
                    self.free_y[y] -= k

    def augment(self, path: list[tuple[int, int, int]], last: int, end: int) -> None:
        """Shift rows along x -> y held by z -> ..., and from the last left node to a right node with rows left."""
        first = path[0][0] if path else last
        k = min([self.free_x[first], self.free_y[end], *(self.held[y][z] for _, y, z in path)])
        for x, y, z in path:
            self.move(x, y, k)
            self.move(z, y, -k)
        self.move(last, end, k)
        self.free_x[first] -= k
        self.free_y[end] -= k

    def pairs(self) -> dict[tuple, int]:
        left, right = self.left.tolist(), self.right.tolist()
        return {(left[x], right[y]): k for y, own in enumerate(self.held) for x, k in own.items()}


def hopcroft_karp(g: Graph) -> None:
    """Phases: levels by breadth from all left nodes with rows left, then disjoint paths along rising levels."""
    while True:
        level, seen = [-1] * len(g.free_x), bytearray(len(g.free_y))
        queue, found = deque(x for x, k in enumerate(g.free_x) if k), False
        for x in queue:
            level[x] = 0
        while queue:
            x = queue.popleft()
            g.tick()
            for y in g.of(x):
                if seen[y]:
                    continue
                seen[y] = 1
                if g.free_y[y]:
                    found = True
                for z in g.held[y]:
                    if level[z] < 0:
                        level[z] = level[x] + 1
                        queue.append(z)
        if not found:
            return
        arcs: dict[int, list[int]] = {}
        for first in [x for x, k in enumerate(g.free_x) if k]:
            while g.free_x[first] and level[first] == 0:
                path, x, end = [], first, None
                while True:
                    g.tick()
                    left = arcs.get(x)
                    if left is None:
                        left = arcs[x] = g.of(x)[::-1]
                    step = None
                    while left and step is None:
                        y = left[-1]
                        if g.free_y[y]:
                            step, end = y, y
                        else:
                            step = next((z for z in g.held[y] if level[z] == level[x] + 1), None)
                            if step is None:
                                left.pop()
                    if end is not None:
                        break
                    if step is not None:
                        path.append((x, y, step))
                        x = step
                        continue
                    # A dead end is left for the rest of the phase.
                    level[x] = -1
                    if not path:
                        break
                    x = path.pop()[0]
                if end is None:
                    break
                g.augment(path, x, end)


def edmonds_karp(g: Graph) -> None:
    """One shortest path after the other."""
    for first in range(len(g.free_x)):
        while g.free_x[first]:
            came, queue, end = {first: None}, deque([first]), None
            while queue and end is None:
                x = queue.popleft()
                g.tick()
                for y in g.of(x):
                    if g.free_y[y]:
                        end = (x, y)
                        break
                    for z in g.held[y]:
                        if z not in came:
                            came[z] = (x, y)
                            queue.append(z)
            if end is None:
                break
            path, x = [], end[0]
            while came[x] is not None:
                path.append((*came[x], x))
                x = came[x][0]
            g.augment(path[::-1], *end)


def push_relabel(g: Graph) -> None:
    """Rows of left nodes are pushed to the neighbour of the least label; a right node that has too many is relabelled
    and pushes back to the holder that has the nearest other neighbour. Labels are set to exact distances now and then,
    and left nodes from which no free row can be reached are given up."""
    n_y = len(g.free_y)
    while True:
        label = _distances(g)
        active = deque(x for x, k in enumerate(g.free_x) if k and min((label[y] for y in g.of(x)), default=FAR) < FAR)
        if not active:
            return
        given_up, pushes = [], 0
        while active and pushes <= n_y + len(g.free_x):
            x = active[0]
            g.tick()
            pushes += 1
            y = min(g.of(x), key=label.__getitem__)
            if label[y] > n_y:
                given_up.append(active.popleft())
                continue
            if g.free_y[y]:
                k = min(g.free_x[x], g.free_y[y])
                g.move(x, y, k)
                g.free_x[x] -= k
                g.free_y[y] -= k
            else:
                g.move(x, y, 1)
                g.free_x[x] -= 1
                far, z = min((min((label[w] for w in g.of(h) if w != y), default=FAR), h) for h in g.held[y])
                label[y] = max(label[y], far + 1)
                g.move(z, y, -1)
                if not g.free_x[z] and z != x:
                    active.append(z)
                g.free_x[z] += 1
            if not g.free_x[x]:
                active.popleft()
            elif len(active) > 1:
                active.rotate(-1)


def _distances(g: Graph) -> list[int]:
    """From each right node, the fewest push-backs to one with rows left; FAR if there is none."""
    x_of = np.repeat(np.arange(len(g.free_x)), np.diff(g.start))
    order = np.argsort(g.near, kind="stable")
    by_y, edges = x_of[order], np.searchsorted(g.near[order], np.arange(len(g.free_y) + 1))
    # Right nodes that each left node holds rows of.
    holds: list[list[int]] = [[] for _ in g.free_x]
    for y, own in enumerate(g.held):
        for x in own:
            holds[x].append(y)
    label, done = [0 if k else FAR for k in g.free_y], bytearray(len(g.free_x))
    queue = deque(y for y, k in enumerate(g.free_y) if k)
    while queue:
        y = queue.popleft()
        g.tick()
        for x in by_y[edges[y] : edges[y + 1]].tolist():
            if not done[x]:
                done[x] = 1
                for w in holds[x]:
                    if label[w] == FAR:
                        label[w] = label[y] + 1
                        queue.append(w)
    return label


SOLVERS = {"hopcroft_karp": hopcroft_karp, "push_relabel": push_relabel, "edmonds_karp": edmonds_karp}


def match_counts(a: np.ndarray, b: np.ndarray, supply: dict, demand: dict, exact: bool = True, algorithm: str = "hopcroft_karp", seconds: float | None = None) -> dict[tuple, int]:
    """A maximum matching of the edges (a, b): (x, y) -> pairs. Not exact: greedy alone. TimeoutError beyond `seconds`."""
    g = Graph(np.asarray(a), np.asarray(b), supply, demand, seconds)
    g.greedy()
    if exact:
        SOLVERS[algorithm](g)
    return g.pairs()
