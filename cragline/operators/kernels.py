"""Sequential graph algorithms on one graph, in plain Python; feedback.py runs them in tasks.

A graph is a dict from vertex to a dict of successors and weights. Vertices are taken in sorted order, successors
in the order given; the DataFrame operators give edges sorted by (source, target), so that their results depend
on the graph alone.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable

from cragline.operators.centrality import betweenness as central_between

Graph = dict[object, dict[object, float]]


def build(edges: Iterable[tuple], isolated: Iterable = ()) -> Graph:
    rows = list(edges)
    g: Graph = {v: {} for v in sorted({x for e in rows for x in e[:2]} | set(isolated))}
    for e in rows:
        g[e[0]][e[1]] = g[e[0]].get(e[1], 0) + (e[2] if len(e) > 2 else 1)
    return g


def without(g: Graph, gone: set) -> Graph:
    return {v: {w: x for w, x in out.items() if w not in gone} for v, out in g.items() if v not in gone}


def drop_edges(g: Graph, gone: set[tuple]) -> Graph:
    return {v: {w: x for w, x in out.items() if (v, w) not in gone} for v, out in g.items()}


def reverse(g: Graph) -> Graph:
    back: Graph = {v: {} for v in g}
    for v, out in g.items():
        for w, x in out.items():
            back[w][v] = x
    return back


def both_ways(g: Graph) -> dict[object, set]:
    """Neighbours, directions and self-loops apart."""
    near: dict[object, set] = {v: set() for v in g}
    for v, out in g.items():
        for w in out:
            if v != w:
                near[v].add(w)
                near[w].add(v)
    return near


def _finish_order(g: Graph) -> list:
    """Vertices by descending finishing time of a stack search that explores the last successor first."""
    seen, order = set(), deque()
    for v in g:
        stack = [(v, False)]
        while stack:
            w, done = stack.pop()
            if done:
                order.appendleft(w)
            elif w not in seen:
                seen.add(w)
                stack.append((w, True))
                stack += [(x, False) for x in g[w] if x not in seen]
    return list(order)


def components(g: Graph) -> list[list]:
    """Strongly connected components in the order in which two searches find them."""
    back, seen, found = reverse(g), set(), []
    for v in _finish_order(g):
        if v in seen:
            continue
        stack, part = [v], []
        while stack:
            w = stack.pop()
            if w not in seen:
                seen.add(w)
                part.append(w)
                stack += [x for x in back[w] if x not in seen]
        found.append(part)
    return found


def connected(near: dict[object, set]) -> dict:
    """The smallest vertex that each vertex is connected with."""
    found: dict = {}
    for root in sorted(near):
        stack = [root]
        while stack:
            v = stack.pop()
            if v not in found:
                found[v] = root
                stack += near[v]
    return found


def acyclic(g: Graph) -> bool:
    return topological(g) is not None


def topological(g: Graph) -> list | None:
    """Smallest-first topological order; None for a cyclic graph."""
    indegree = {v: 0 for v in g}
    for out in g.values():
        for w in out:
            indegree[w] += 1
    heap = sorted(v for v, d in indegree.items() if not d)
    order = []
    while heap:
        v = heapq.heappop(heap)
        order.append(v)
        for w in g[v]:
            indegree[w] -= 1
            if not indegree[w]:
                heapq.heappush(heap, w)
    return order if len(order) == len(g) else None


def dsm_order(g: Graph) -> list:
    """Post-order of searches from the members of each component in turn."""
    order, seen = [], set()
    for part in components(g):
        for v in sorted(part):
            if v in seen:
                continue
            seen.add(v)
            stack = [(v, iter(g[v]))]
            while stack:
                w, successors = stack[-1]
                x = next((x for x in successors if x not in seen), None)
                if x is None:
                    order.append(w)
                    stack.pop()
                else:
                    seen.add(x)
                    stack.append((x, iter(g[x])))
    return order


def back_edges(g: Graph) -> list[tuple]:
    """(source, target, weight) above the diagonal, by matrix place."""
    place = {v: i for i, v in enumerate(dsm_order(g))}
    return sorted(((v, w, x) for v, out in g.items() for w, x in out.items() if place[v] < place[w]), key=lambda e: (place[e[0]], place[e[1]]))


def probe(g: Graph, root) -> set:
    """Vertices that a depth-first probe from root finds on cycles through root."""
    stack, waiting, visited, path, on_cycle = [root], {root}, set(), [], set()
    while stack:
        v = stack.pop()
        waiting.discard(v)
        visited.add(v)
        while path and v not in g[path[-1]]:
            path.pop()
        path.append(v)
        for w in g[v]:
            if w in visited or w in waiting:
                if w in waiting:
                    stack.remove(w)
                    stack.append(w)
                if w == root or w in on_cycle:
                    on_cycle.update(path)
            else:
                stack.append(w)
                waiting.add(w)
    return on_cycle


def vertex_cycles(g: Graph) -> list[set]:
    """Distinct probed cycles: one of the same size and edge count that holds the probed vertex is the same."""
    found: list[tuple[int, int, set]] = []
    for v in sorted(x for part in components(g) if len(part) > 1 for x in part):
        on = probe(g, v)
        n = sum(1 for a in on for b in g[a] if b in on)
        if len(on) > 1 and n > 1 and not any(len(s) == len(on) and m == n and v in s for _, m, s in found):
            found.append((len(on), n, on))
    return [s for *_, s in found]


def simple_cycles(g: Graph, max_length: int | None = None) -> list[tuple]:
    """Elementary cycles, each from its smallest vertex; only those up to max_length where it is given."""
    found = []
    parts = {v: i for i, part in enumerate(components(g)) for v in part}
    for root in g:
        if root in g[root]:
            found.append((root,))
        stack = [(root, iter(g[root]))]
        path, on = [root], {root}
        while stack:
            v, successors = stack[-1]
            w = next(successors, None)
            if w is None:
                stack.pop()
                on.discard(path.pop())
            elif w == root and len(path) > 1:
                found.append(tuple(path))
            elif w > root and w not in on and parts[w] == parts[root] and (max_length is None or len(path) < max_length):
                path.append(w)
                on.add(w)
                stack.append((w, iter(g[w])))
    return found


def shortest_path(g: Graph, a, b) -> list | None:
    """Fewest edges from a to b; None without a path."""
    before, queue = {a: None}, deque([a])
    while queue:
        v = queue.popleft()
        if v == b:
            path = [v]
            while before[path[-1]] is not None:
                path.append(before[path[-1]])
            return path[::-1]
        for w in g[v]:
            if w not in before:
                before[w] = v
                queue.append(w)
    return None


def distances(g: Graph, source, head_weight: dict) -> dict:
    """Least sums of the weights of the vertices entered on the way from source."""
    best, heap, done = {source: 0.0}, [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        for w in g[v]:
            x = d + head_weight.get(w, 1.0)
            if x < best.get(w, float("inf")):
                best[w] = x
                heapq.heappush(heap, (x, w))
    return best


def ordering_fas(g: Graph) -> tuple[list, set[tuple]]:
    """Vertices in order by sinks, sources and the greatest surplus of out-edges; arcs that run backwards in it."""
    out, into, left = {v: set(o) - {v} for v, o in g.items()}, {v: set(i) - {v} for v, i in reverse(g).items()}, set(g)
    head, tail = [], deque()
    sinks, sources = [v for v in g if not out[v]], [v for v in g if not into[v]]
    surplus = [(len(into[v]) - len(out[v]), v) for v in g]  # with entries that no longer hold
    heapq.heapify(surplus)

    def remove(v) -> None:
        left.discard(v)
        for w in out[v]:
            into[w].discard(v)
            if not into[w]:
                sources.append(w)
            heapq.heappush(surplus, (len(into[w]) - len(out[w]), w))
        for w in into[v]:
            out[w].discard(v)
            if not out[w]:
                sinks.append(w)
            heapq.heappush(surplus, (len(into[w]) - len(out[w]), w))

    while left:
        while batch := sorted({v for v in sinks if v in left}):
            sinks.clear()
            for v in batch:
                tail.appendleft(v)
                remove(v)
        while batch := sorted({v for v in sources if v in left}):
            sources.clear()
            for v in batch:
                head.append(v)
                remove(v)
        while left:
            x, v = heapq.heappop(surplus)
            if v in left and x == len(into[v]) - len(out[v]):
                head.append(v)
                remove(v)
                break
    order = head + list(tail)
    place = {v: i for i, v in enumerate(order)}
    return order, {(v, w) for v, o in g.items() for w in o if place[v] >= place[w]}


def linked(out: dict[object, set], into: dict[object, set], starts: Iterable, ends: Iterable) -> bool:
    """Whether a path leads from a start to an end: a search from both sides, which is over when the smaller one is."""
    ahead, behind = set(starts), set(ends)
    if not ahead.isdisjoint(behind):
        return True
    fore, rear = list(ahead), list(behind)
    while fore and rear:
        forth = len(ahead) <= len(behind)
        edges, own, other, step = (out, ahead, behind, []) if forth else (into, behind, ahead, [])
        for v in fore if forth else rear:
            for w in edges[v]:
                if w in other:
                    return True
                if w not in own:
                    own.add(w)
                    step.append(w)
        if forth:
            fore = step
        else:
            rear = step
    return False


def _peel(out: dict[object, set], into: dict[object, set], first: Iterable) -> None:
    """Take vertices out of a graph, and then, again and again, those without an edge in or out: no cycle needs them."""
    stack = list(first)
    while stack:
        v = stack.pop()
        if v not in out:
            continue
        for here, there in ((out, into), (into, out)):
            for w in here.pop(v):
                if w != v:
                    there[w].discard(v)
                    if not there[w]:
                        stack.append(w)


def greedy_fas(g: Graph) -> set[tuple]:
    """The lightest edge within a strong component goes, until none is left; ties by names.

    An edge that is on no cycle never comes to be on one, so one pass over the edges by weight does it.
    """
    out, into, gone = {v: set(o) for v, o in g.items()}, {v: set(i) for v, i in reverse(g).items()}, set()
    _peel(out, into, [v for v in g if not (out[v] and into[v])])
    for _, v, w in sorted((x, v, w) for v, o in g.items() for w, x in o.items()):
        if w in out.get(v, ()):
            out[v].discard(w)
            into[w].discard(v)
            if v == w or linked(out, into, [w], [v]):
                gone.add((v, w))
            _peel(out, into, [x for x in {v, w} if not (out[x] and into[x])])
    return gone


def cycle_within(g: Graph, inside: list) -> list[tuple] | None:
    """The edges of a shortest cycle among the vertices given, or None."""
    kept, best = set(inside), None
    own = {v: {w: x for w, x in g[v].items() if w in kept} for v in inside}
    for v in inside:
        for w in own[v]:
            path = [v] if w == v else shortest_path(own, w, v)
            if path and (best is None or len(path) < len(best)):
                best = path
                if len(best) <= 2:
                    break
    return None if best is None else list(zip(best, best[1:] + best[:1], strict=True))


def _lightest_hitting(cycles: list[list[tuple]], weight: dict[tuple, float], steps: list[int]) -> set[tuple]:
    """A lightest set of edges with one of each cycle, by branch and bound; takes from the steps left."""
    best: list = [float("inf"), set()]

    def bound(open_: list[list[tuple]], shut: frozenset) -> float:
        total, used = 0.0, set()
        for c in open_:  # cycles without a common edge each cost at least their lightest one
            if used.isdisjoint(c):
                used.update(c)
                total += min((weight[e] for e in c if e not in shut), default=float("inf"))
        return total

    def branch(chosen: list[tuple], cost: float, open_: list[list[tuple]], shut: frozenset) -> None:
        steps[0] -= 1
        if steps[0] < 0:
            raise ValueError("the strong component is too dense for an exact feedback arc set within the steps given")
        if not open_:
            if cost < best[0]:
                best[:] = [cost, set(chosen)]
            return
        if cost + bound(open_, shut) >= best[0]:
            return
        free = min(([e for e in c if e not in shut] for c in open_), key=len)
        for e in sorted(free, key=lambda e: (weight[e], e)):
            branch([*chosen, e], cost + weight[e], [c for c in open_ if e not in c], shut)
            shut = shut | {e}

    branch([], 0.0, sorted(cycles, key=len), frozenset())
    return best[1]


def exact_fas(g: Graph, most_steps: int = 2_000_000) -> set[tuple]:
    """A lightest feedback arc set. In each strong component, the lightest set that hits all cycles found so far is
    taken out, and cycles that are left are added, until none is. Raises ValueError when the search takes more than most_steps steps."""
    gone, steps = {(v, v) for v in g if v in g[v]}, [most_steps]
    for part in components(g):
        if len(part) < 2:
            continue
        part = sorted(part)
        own = {v: {w: x for w, x in g[v].items() if w in set(part) and w != v} for v in part}
        weight = {(v, w): x for v, out in own.items() for w, x in out.items()}
        cycles: list[list[tuple]] = []
        chosen: set[tuple] = set()
        while True:
            rest, fresh = drop_edges(own, chosen), 0
            while found := cycle_within(rest, part):
                cycles.append(found)
                rest, fresh = drop_edges(rest, set(found)), fresh + 1
            if not fresh:
                break
            chosen = _lightest_hitting(cycles, weight, steps)
        gone |= chosen
    return gone


def _fvs(g: Graph, score, self_loops: bool) -> set:
    """While there are cycles, the vertex of the highest score on one goes; ties by name.

    Scores never grow as vertices go, and a vertex that is on no cycle never comes to be on one: each is looked at when its
    score is the highest, and a search tells whether it is on a cycle.
    """
    left, back, gone = {v: set(o) for v, o in g.items()}, {v: set(i) for v, i in reverse(g).items()}, set()
    out, into = ({v: {w for w in x if self_loops or w != v} for v, x in e.items()} for e in (left, back))  # what cycles may need
    _peel(out, into, [v for v in g if not (out[v] and into[v])])
    heap = [(-score(v, left, back), v) for v in out]
    heapq.heapify(heap)
    while heap:
        x, v = heapq.heappop(heap)
        if v not in out:
            continue
        if (now := -score(v, left, back)) != x:
            heapq.heappush(heap, (now, v))
            continue
        if linked(out, into, out[v], into[v]):
            gone.add(v)
            for here, there in ((left, back), (back, left)):
                for w in here.pop(v):
                    if w != v:
                        there[w].discard(v)
        _peel(out, into, [v])
    return gone


def minimal_set(g: Graph, chosen: Iterable) -> set:
    """A valid feedback vertex set without those that it does not need, which are tried in the order given."""
    chosen = list(chosen)
    kept, back = set(chosen), reverse(g)
    out, into = ({v: {w for w in x if w not in kept} for v, x in e.items() if v not in kept} for e in (g, back))
    for v in chosen:
        after, before = {w for w in g[v] if w in out}, {w for w in back[v] if w in out}
        if v not in g[v] and not linked(out, into, after, before):
            kept.discard(v)
            out[v], into[v] = after, before
            for w in after:
                into[w].add(v)
            for w in before:
                out[w].add(v)
    return kept


def _degree(v, g, back) -> float:
    return len(g[v]) + len(back[v])


def feedback_vertices(g: Graph, strategy: str) -> set:
    """greedy and scc: highest degree on a cycle; score: degree + half in x out + self-loop; local: greedy, then drops."""
    if strategy == "greedy":
        return _fvs(g, _degree, True)
    if strategy == "scc":
        return _fvs(g, _degree, False)
    if strategy == "score":
        return _fvs(g, lambda v, h, back: _degree(v, h, back) + 0.5 * len(h[v]) * len(back[v]) + (v in h[v]), True)
    if strategy != "local":
        raise ValueError(f"unknown strategy {strategy!r}")
    return minimal_set(g, sorted(feedback_vertices(g, "greedy")))


def feedback_size(g: Graph) -> int:
    """The smallest valid set of the four strategies; 0 for an acyclic graph."""
    if acyclic(g):
        return 0
    sizes = [len(s) for s in (feedback_vertices(g, k) for k in ("greedy", "scc", "score", "local")) if acyclic(without(g, s))]
    if sizes:
        return min(sizes)
    parts = [c for c in components(g) if len(c) > 1]
    return max(1, sum(v in g[v] for v in g) + max(1, len(parts) // 2))


def approximate_fvs(g: Graph, special: set | None = None, weights: dict | None = None) -> set:
    """Feedback vertices (of cycles through `special`, where given) by distance cuts in the strong components.

    Within a component, distances from a special vertex enter vertices at their weight. The level whose vertices
    weigh least against what lies on its nearer side is cut, and both sides go on.
    """
    weights, gone, work = weights or {}, set(), [set(g)]
    while work:
        inside = work.pop()
        sub = {v: {w: x for w, x in g[v].items() if w in inside and w not in gone} for v in sorted(inside) if v not in gone}
        for part in components(sub):
            roots = sorted(v for v in part if special is None or v in special)
            if not roots or (len(part) == 1 and part[0] not in sub[part[0]]):
                continue
            if len(part) == 1:
                gone.add(part[0])
                continue
            own = {v: {w: x for w, x in sub[v].items() if w in set(part)} for v in part}
            root = roots[0]
            far = distances(own, root, weights)
            levels: dict[float, list] = {}
            for v, d in far.items():
                levels.setdefault(d, []).append(v)
            near, best = weights.get(root, 1.0), None
            for d in sorted(levels)[1:]:
                cost = sum(weights.get(v, 1.0) for v in levels[d])
                if best is None or cost / near < best[0]:
                    best = (cost / near, d)
                near += cost
            chosen = {root} if best is None or weights.get(root, 1.0) <= sum(weights.get(v, 1.0) for v in levels[best[1]]) else set(levels[best[1]])
            gone |= chosen
            work.append(set(part) - chosen)
    return gone


def eliminate(near: dict[object, set], cost, enough: int | None = None) -> int:
    """The width of the elimination order that takes the vertex of least cost each time; a width of `enough` ends it.

    The cost of a vertex may depend on its neighbours and on the edges among them; it is asked again where those change.
    """
    near, width = {v: set(n) for v, n in near.items()}, 0
    now = {v: cost(near, v) for v in near}
    heap = [(x, v) for v, x in now.items()]  # with entries that no longer hold
    heapq.heapify(heap)
    while near:
        x, v = heapq.heappop(heap)
        if v not in near or x != now[v]:
            continue
        around = near.pop(v)
        width = max(width, len(around))
        if enough is not None and width >= enough:
            break
        changed = set(around)
        for w in around:
            near[w].discard(v)
        for w in around:
            for u in around - near[w] - {w}:
                near[w].add(u)
                near[u].add(w)
                changed |= near[w] & near[u]
        for w in changed:
            if (x := cost(near, w)) != now[w]:
                now[w] = x
                heapq.heappush(heap, (x, w))
    return width


def fill(near: dict[object, set], v) -> int:
    around = sorted(near[v])
    return sum(1 for i, a in enumerate(around) for b in around[i + 1 :] if b not in near[a])


def clique_bound(near: dict[object, set]) -> int:
    """The largest clique less one for up to 50 vertices, else the largest degree."""
    if len(near) > 50:
        return max((len(n) for n in near.values()), default=0)
    best, stack = 0, [(0, set(near), set())]
    while stack:
        size, open_, shut = stack.pop()
        best = max(best, size)
        if size + len(open_) <= best or not open_:
            continue
        pivot = max(open_ | shut, key=lambda v: len(near[v] & open_))
        for v in sorted(open_ - near[pivot]):
            stack.append((size + 1, open_ & near[v], shut & near[v]))
            open_, shut = open_ - {v}, shut | {v}
    return max(0, best - 1)


def in_order_width(near: dict[object, set], enough: int | None = None) -> int:
    """Width of the triangulation that makes each vertex's later neighbours a clique, in vertex order; a width of
    `enough` ends it.

    A vertex hands its later neighbours on to the first of them, which thereby has all that the cliques give it.
    """
    width, handed = 0, {}
    for v in sorted(near):
        later = {w for w in near[v] if w > v}
        for more in handed.pop(v, ()):
            if len(more) > len(later):
                later, more = more, later
            later |= more
        later.discard(v)
        width = max(width, len(later))
        if enough is not None and width >= enough:
            break
        if later:
            handed.setdefault(min(later), []).append(later)
    return width


def without_trees(near: dict[object, set]) -> dict[object, set]:
    """What is left when vertices of at most one neighbour go, again and again. Elimination orders by degree or by fill
    take those first, with a width of at most 1, so no hub is asked for its cost after each of its leaves."""
    near = {v: set(n) for v, n in near.items()}
    ends = [v for v, n in near.items() if len(n) < 2]
    while ends:
        for w in near.pop(v := ends.pop()):
            near[w].discard(v)
            if len(near[w]) == 1:
                ends.append(w)
    return near


def treewidth_bound(g: Graph, modulator: set = frozenset()) -> int:
    """eta: 0 for up to one vertex, 1 for an acyclic graph, else the least width above 1 that a heuristic gives."""
    near = both_ways(without(g, set(modulator)))
    if len(near) <= 1:
        return 0
    if acyclic(g):
        return 1
    least, core = None, without_trees(near)
    for width in (lambda: clique_bound(near), lambda: eliminate(core, lambda n, v: len(n[v]), least), lambda: eliminate(core, fill, least), lambda: in_order_width(near, least)):
        if (w := width()) > 1 and (least is None or w < least):
            least = w
        if least == 2:  # none above 1 is less
            break
    return len(near) - 1 if least is None else least


def importance(near: dict[object, set], between: dict) -> dict:
    """Degree + 10 x betweenness + half the triangles of each vertex."""
    triangles = {v: len(around) * (len(around) - 1) // 2 - fill(near, v) for v, around in near.items()}
    return {v: len(near[v]) + 10 * between[v] + 0.5 * triangles[v] for v in near}


def _modulator_search(g: Graph, score: dict | None = None):
    """A search for modulators by target and size; widths and orders are computed once for all its calls."""
    near = both_ways(g)
    between = central_between(near)
    weight, cuts = importance(near, between), articulation_points(near)
    falling = lambda x: lambda v: (-x(v), v)
    degree = falling(lambda v: len(near[v]))
    by_degree, central = sorted(g, key=degree), sorted(g, key=falling(between.get))
    orders = [
        sorted(g, key=falling(lambda v: score.get(v, 0.0))) if score else by_degree,
        sorted(feedback_vertices(g, "greedy"), key=degree),
        sorted(g, key=falling(weight.get)),
        by_degree,
        [v for v in central if v in cuts] + [v for v in central if v not in cuts],
    ]
    widths: dict[frozenset, int] = {}

    def width(chosen: list) -> int:
        key = frozenset(chosen)
        if key not in widths:
            widths[key] = treewidth_bound(g, set(key))
        return widths[key]

    def search(target: int, most: int) -> tuple[set, int]:
        best = None
        for order in orders:
            for n in range(1, min(most, len(order)) + 1):
                if (eta := width(order[:n])) <= target:
                    if best is None or n + 0.1 * eta < best[0]:
                        best = (n + 0.1 * eta, set(order[:n]), eta)
                    break
        return best[1:] if best else (set(by_degree[:most]), width(by_degree[:most]))

    return search


def modulator(g: Graph, target: int, most: int, score: dict | None = None) -> tuple[set, int]:
    """Vertices whose removal brings eta to the target, and eta. Candidates come from five orders: score, feedback
    vertices, structural importance, degree, and bottlenecks (articulation points, then the highest betweenness). The best
    has the least size + eta / 10. Where none meets the target, the vertices of the highest degree."""
    return _modulator_search(g, score)(target, most)


def modulator_options(g: Graph, most: int, options: int) -> list[tuple[list, int, float]]:
    """Up to `options` different modulators with eta and size + eta / 10, the least first: those for the targets 1 to 5
    and, for the target 3, for growing limits of their size."""
    search = _modulator_search(g)
    limits = range(min(3, most), most + 1, max(1, most // 4))
    tried = [search(t, most) for t in range(1, min(5, most) + 1)] + [search(3, n) for n in limits]
    found = {tuple(sorted(chosen)): eta for chosen, eta in tried}
    rows = [(list(chosen), eta, len(chosen) + 0.1 * eta) for chosen, eta in found.items()]
    return sorted(rows, key=lambda r: (r[2], r[0]))[:options]


def betweenness(near: dict[object, set], sources: list) -> dict:
    """Sums over the sources of the shares of shortest paths that pass each vertex; ends do not count."""
    total = {v: 0.0 for v in near}
    for s in sources:
        order, paths, far, before = [], {s: 1.0}, {s: 0}, {s: []}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in sorted(near[v]):
                if w not in far:
                    far[w], paths[w], before[w] = far[v] + 1, 0.0, []
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total


def articulation_points(near: dict[object, set]) -> set:
    """Vertices whose removal parts their component."""
    found, number, low = set(), {}, {}
    for root in sorted(near):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack, children = [(root, None, iter(sorted(near[root])))], 0
        while stack:
            v, parent, it = stack[-1]
            w = next(it, None)
            if w is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if parent != root and low[v] >= number[parent]:
                        found.add(parent)
                    children += parent == root
            elif w not in number:
                number[w] = low[w] = len(number)
                stack.append((w, v, iter(sorted(near[w]))))
            elif w != parent:
                low[v] = min(low[v], number[w])
        if children > 1:
            found.add(root)
    return found


def kernelised_dfvs(g: Graph, k: int, modulator_set: set, eta: int) -> set | None:
    """Feedback vertices of up to k, by zones: None where no such set is found.

    A small set hits the remainder; the rest falls into zones, each represented by the vertices of its strong
    components with the highest degree, as many as the kernel bound allows. What is chosen among modulator, hitting set and representatives is made valid and minimal.
    """
    outside = without(g, modulator_set)
    hit = feedback_vertices(outside, "greedy")
    rest = without(outside, hit)
    near = both_ways(rest)
    zones, seen = [], set()
    for v in sorted(near):
        if v not in seen:
            zone, stack = set(), [v]
            while stack:
                w = stack.pop()
                if w not in zone:
                    zone.add(w)
                    stack += near[w] - zone
            seen |= zone
            zones.append(zone)
    all_near = both_ways(g)
    room = max(1, (k * max(1, len(modulator_set))) ** (eta * eta))
    representatives = {v for zone in zones for v in sorted(zone, key=lambda v: (-len(all_near[v]), v))[:room]}
    pool = sorted(modulator_set | hit | representatives, key=lambda v: (-len(all_near[v]), v))
    chosen = set(modulator_set | hit)
    if not acyclic(without(g, chosen)):
        for v in pool:
            chosen.add(v)
            if acyclic(without(g, chosen)):
                break
        else:
            return None
    chosen = minimal_set(g, sorted(chosen, key=lambda v: (len(all_near[v]), v)))
    return chosen if len(chosen) <= k else None
