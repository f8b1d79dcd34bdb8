"""Betweenness over an undirected graph, for many sources at once.

Trees that hang on the graph are folded into their roots, which counts them in closed form. Sources of what is left are
searched in batches with numpy; a vertex stands for as many as were folded into it.

Where most of what is left has two neighbours, runs of such vertices are chains between nodes. A search then takes
nodes and chains only: how far a chain's ends are says which of its vertices are reached from which end.
"""

from __future__ import annotations

import heapq
from functools import partial
from typing import NamedTuple

import numpy as np

BATCH_CELLS = 1 << 19  # sources x vertices that are searched at once
CHAIN_CELLS = 1 << 19  # sources x chains
FAR = 1 << 40


def fold(near: dict[object, set]) -> tuple[dict[object, set], dict, dict]:
    """The graph without the trees that hang on it; how many vertices each one of it stands for; and, for every vertex of
    near, the pairs whose paths pass it because one of them is in a tree below it or it is in a tree itself."""
    core, held, squares, whole = {v: set(n) for v, n in near.items()}, dict.fromkeys(near, 1), dict.fromkeys(near, 0), {}
    ends = [v for v, n in core.items() if len(n) == 1]
    while ends:
        v = ends.pop()
        if len(core.get(v, ())) != 1:
            continue
        (root,) = core.pop(v)
        core[root].discard(v)
        held[root] += held[v]
        squares[root] += held[v] ** 2
        if len(core[root]) == 1:
            ends.append(root)
    for first in near:
        if first not in whole:
            part, stack = {first}, [first]
            while stack:
                for w in near[stack.pop()]:
                    if w not in part:
                        part.add(w)
                        stack.append(w)
            whole.update(dict.fromkeys(part, len(part)))
    passed = {v: (whole[v] - 1) ** 2 - squares[v] - (whole[v] - held[v]) ** 2 for v in near}
    return core, {v: held[v] for v in core}, passed


def packed(near: dict[object, set], held: dict) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The vertices in order, and by their number: where the neighbours of each begin, the neighbours, what each stands for."""
    names = sorted(near)
    number = {v: i for i, v in enumerate(names)}
    begin = np.concatenate([[0], np.cumsum([len(near[v]) for v in names], dtype=np.int64)])
    ends = np.fromiter((number[w] for v in names for w in sorted(near[v])), np.int64, int(begin[-1]))
    return names, begin, ends, np.array([held[v] for v in names], float)


def shares(begin: np.ndarray, ends: np.ndarray, held: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Sums over the sources, as often as each stands for, of the shares of shortest paths that pass each vertex."""
    n = len(begin) - 1
    total, size = np.zeros(n), max(1, min(256, BATCH_CELLS // max(1, n)))
    seen, mark, degree = np.zeros(size * n, bool), np.zeros(size * n, np.int64), np.diff(begin)
    for at in range(0, len(sources), size):
        v = np.asarray(sources[at : at + size])
        base = np.arange(len(v)) * n
        seen[:] = False
        seen[base + v] = True
        level, paths, times = [(v, base)], [np.ones(len(v))], held[v]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            v, base = level[-1]
            d = degree[v]
            tail = np.repeat(np.arange(len(v)), d)
            w = ends[np.repeat(begin[v] - np.cumsum(d) + d, d) + np.arange(len(tail))]
            cell = w + base[tail]
            fresh = ~seen[cell]
            tail, w, cell = tail[fresh], w[fresh], cell[fresh]
            if not len(cell):
                break
            seen[cell] = True
            mark[cell] = np.arange(len(cell))
            first = mark[cell] == np.arange(len(cell))  # one edge for each vertex that is reached
            v, c = w[first], cell[first]
            mark[c] = np.arange(len(c))
            head = mark[cell]
            level.append((v, c - v))
            paths.append(np.bincount(head, paths[-1][tail], len(v)))
            steps.append((tail, head))
        below, where, what = np.zeros(len(level[-1][0])), [], []
        for k in range(len(steps) - 1, -1, -1):
            v, base = level[k + 1]
            where.append(v)
            what.append(below * times[base // n])
            tail, head = steps[k]
            below = paths[k] * np.bincount(tail, ((held[v] + below) / paths[k + 1])[head], len(level[k][0]))
        if where:
            total += np.bincount(np.concatenate(where), np.concatenate(what), n)
    return total


class Chains(NamedTuple):
    """A graph as nodes and chains between them. A chain of n edges has n + 1 slots, its ends included."""

    nodes: np.ndarray  # vertex of each node
    near: list  # of each node: (node, edges) of the chains to other nodes
    a: np.ndarray  # nodes at the ends of each chain
    b: np.ndarray
    length: np.ndarray  # its edges
    slot: np.ndarray  # its first slot
    walk: np.ndarray  # vertex of each slot
    upto: np.ndarray  # what a chain's inner vertices stand for, summed up to each slot
    chain: np.ndarray  # of each vertex: its chain, or -1 of a node
    place: np.ndarray  # its place in the chain, or its number as a node
    sources: np.ndarray  # all vertices, those of chains that begin at one node together


def chains(begin: np.ndarray, ends: np.ndarray, held: np.ndarray) -> Chains:
    """Nodes are the vertices without exactly two neighbours, and one vertex of each ring."""
    n, starts, to = len(begin) - 1, begin.tolist(), ends.tolist()
    node = [starts[v + 1] - starts[v] != 2 for v in range(n)]
    open_, walks = [not x for x in node], []

    def follow(first: int, v: int) -> None:
        path = [first]
        while not node[v]:
            open_[v] = False
            x, y = to[starts[v]], to[starts[v] + 1]
            before = path[-1]
            path.append(v)
            v = y if x == before else x
        walks.append([*path, v])

    for v in range(n):
        if node[v]:
            for w in to[starts[v] : starts[v + 1]]:
                if open_[w] or (node[w] and v < w):
                    follow(v, w)
    for v in range(n):
        if open_[v]:
            node[v], open_[v] = True, False
            follow(v, to[starts[v]])
    walks.sort(key=lambda path: path[0])
    nodes = np.flatnonzero(np.array(node, bool))
    chain, place = np.full(n, -1), np.zeros(n, np.int64)
    place[nodes] = np.arange(len(nodes))
    near: list[list] = [[] for _ in nodes]
    a, b = (np.array([place[path[k]] for path in walks], np.int64) for k in (0, -1))
    length = np.array([len(path) - 1 for path in walks], np.int64)
    slot = np.concatenate([[0], np.cumsum(length + 1)[:-1]]).astype(np.int64)
    for x, y, m in zip(a.tolist(), b.tolist(), length.tolist(), strict=True):
        if x != y:
            near[x].append((y, m))
            near[y].append((x, m))
    upto, sources, by_node = np.zeros(int((length + 1).sum())), [], [[] for _ in nodes]
    for e, path in enumerate(walks):
        inner = path[1:-1]
        chain[inner], place[inner] = e, np.arange(1, len(path) - 1)
        upto[slot[e] + 1 : slot[e] + len(path) - 1] = np.cumsum(held[inner])
        by_node[a[e]] += inner
    for v, inner in zip(nodes.tolist(), by_node, strict=True):
        sources += [v, *inner]
    return Chains(nodes, near, a, b, length, slot, np.array([v for path in walks for v in path], np.int64), upto, chain, place, np.array(sources, np.int64))


def _from_node(near: list, first: int) -> tuple[np.ndarray, np.ndarray]:
    """How far every node is, and by how many shortest paths."""
    far, paths, heap = [FAR] * len(near), [0.0] * len(near), [(0, first)]
    far[first], paths[first] = 0, 1.0
    while heap:
        d, x = heapq.heappop(heap)
        if d > far[x]:
            continue
        for y, m in near[x]:
            if d + m < far[y]:
                far[y], paths[y] = d + m, paths[x]
                heapq.heappush(heap, (d + m, y))
            elif d + m == far[y]:
                paths[y] += paths[x]
    return np.array(far, np.int64), np.array(paths)


def chain_shares(c: Chains, held: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What shares gives, by nodes and chains."""
    k, e, slots = len(c.nodes), len(c.a), len(c.upto)
    known: dict[int, tuple] = {}

    def search(x: int) -> tuple[np.ndarray, np.ndarray]:
        if x not in known:
            if len(known) * k > 1 << 23:
                known.clear()
            known[x] = _from_node(c.near, x)
        return known[x]

    at_nodes = np.zeros(k)
    fixed, down, up = np.zeros(slots + 1), np.zeros(slots + 1), np.zeros(slots + 1)  # differences from slot to slot
    stands = np.append(held[c.nodes], 0.0)
    size = max(1, CHAIN_CELLS // (e + 1))
    for begin in range(0, len(sources), size):
        v = np.asarray(sources[begin : begin + size])
        n, own, place, times = len(v), c.chain[v], c.place[v], held[v]
        # the last column is a source within a chain, which parts it in two
        far, paths = np.full((n, k + 1), FAR), np.zeros((n, k + 1))
        left, right = np.tile(np.append(c.a, k), (n, 1)), np.tile(np.append(c.b, k), (n, 1))
        low, high = np.zeros((n, e + 1), np.int64), np.tile(np.append(c.length, 1), (n, 1))
        base = np.tile(np.append(c.slot, 0), (n, 1))
        for i, (x, p) in enumerate(zip(own.tolist(), place.tolist(), strict=True)):
            if x < 0:
                far[i, :k], paths[i, :k] = search(p)
                continue
            (d1, s1), (d2, s2) = search(int(c.a[x])), search(int(c.b[x]))
            d1, d2 = d1 + p, d2 + (c.length[x] - p)
            far[i, :k] = np.minimum(d1, d2)
            paths[i, :k] = s1 * (d1 <= d2) + s2 * (d2 <= d1)
            far[i, k], paths[i, k] = 0, 1.0
            right[i, x], high[i, x] = k, p
            left[i, e], right[i, e], low[i, e], high[i, e], base[i, e] = k, c.b[x], p, c.length[x], c.slot[x]
        row = np.arange(n)[:, None] * (k + 1)
        left, right, far, paths = left + row, right + row, far.ravel(), paths.ravel()
        on = far[left] < FAR
        weight = np.broadcast_to(times[:, None], on.shape)[on]
        left, right, low, high, base = left[on], right[on], low[on], high[on], base[on]
        edges = high - low
        twice = far[right] + edges - far[left]  # twice the place, from low, where the two sides meet
        last = base + low + np.clip((twice - 1) // 2, 0, edges - 1)  # of those reached from the left end
        first = base + low + np.clip(twice // 2 + 1, 1, edges)  # of those reached from the right end
        low, high = base + low, base + high
        to_left, to_right = c.upto[last] - c.upto[low], c.upto[high - 1] - c.upto[first - 1]
        tie = np.flatnonzero((twice % 2 == 0) & (twice > 0) & (twice < 2 * edges))
        middle = low[tie] + twice[tie] // 2
        what, s1, s2 = c.upto[middle] - c.upto[middle - 1], paths[left[tie]], paths[right[tie]]
        to_left[tie] += what * s1 / (s1 + s2)
        to_right[tie] += what * s2 / (s1 + s2)
        below = np.bincount(left, to_left, n * (k + 1)) + np.bincount(right, to_right, n * (k + 1))
        ahead, back = np.flatnonzero(twice == 2 * edges), np.flatnonzero(twice == 0)  # chains on shortest paths to nodes
        tail, head = np.concatenate([left[ahead], right[back]]), np.concatenate([right[ahead], left[back]])
        order = np.argsort(-far[head], kind="stable")
        tail, head, flow = tail[order], head[order], np.zeros(len(order))
        ratio, more = paths[tail] / paths[head], stands[head % (k + 1)]
        steps = np.flatnonzero(np.diff(far[head], prepend=-1, append=-1))
        for x, y in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            flow[x:y] = ratio[x:y] * (more[x:y] + below[head[x:y]])
            np.add.at(below, tail[x:y], flow[x:y])
        through = np.zeros(len(order))
        through[order] = flow
        to_left[ahead] += through[: len(ahead)]
        to_right[back] += through[len(ahead) :]
        below = below.reshape(n, k + 1)
        at = np.flatnonzero(own < 0)
        below[at, place[at]] = 0
        at_nodes += times @ below[:, :k]
        x, y = weight * (to_left + c.upto[low]), weight * (to_right - c.upto[high - 1])
        count = lambda where, what: np.bincount(where, what, slots + 1)
        fixed += count(low + 1, x) - count(last + 1, x) + count(first, y) - count(high, y)
        down += count(low + 1, weight) - count(last + 1, weight)
        up += count(first, weight) - count(high, weight)
    total = np.zeros(len(held))
    inner = np.flatnonzero(c.chain[c.walk] >= 0)
    total[c.walk[inner]] = (np.cumsum(fixed)[:-1] - np.cumsum(down)[:-1] * c.upto + np.cumsum(up)[:-1] * np.append(0.0, c.upto[:-1]))[inner]
    total[c.nodes] = at_nodes
    return total


def searcher(begin: np.ndarray, ends: np.ndarray, held: np.ndarray):
    """The sources in a good order, and what gives the shares of some of them: by chains, where there are few for the edges."""
    n = len(begin) - 1
    inner = int((np.diff(begin) == 2).sum())
    if 4 * (len(ends) // 2 - inner) <= len(ends) // 2:
        found = chains(begin, ends, held)
        return found.sources, partial(chain_shares, found, held)
    return np.arange(n), partial(shares, begin, ends, held)


def betweenness(near: dict[object, set]) -> dict:
    """Sums over all sources of the shares of shortest paths that pass each vertex; ends do not count."""
    core, held, passed = fold(near)
    names, begin, ends, weight = packed({v: n for v, n in core.items() if n}, held)
    found = {v: float(x) for v, x in passed.items()}
    sources, search = searcher(begin, ends, weight)
    for v, x in zip(names, search(sources), strict=True):
        found[v] += float(x)
    return found
