"""Modulators of graphs with all their edges: the proofs by minors against the search, and the query against plain Python."""

import datetime
import random

import numpy as np
import pytest

from cragline.operators import feedback, graph, modulators
from cragline.operators import kernels as K
from cragline.plans.queries import QUERIES


def _columns(edges):
    return np.array([e[0] for e in edges]), np.array([e[1] for e in edges])


def _eta(g, gone):
    """As defined, from whole orders."""
    near = K.both_ways(K.without(g, gone))
    if len(near) <= 1:
        return 0
    if K.acyclic(g):
        return 1
    core = K.without_trees(near)
    widths = [K.eliminate(core, lambda n, v: len(n[v])), K.eliminate(core, K.fill), K.clique_bound(near), K.in_order_width(near)]
    return min((w for w in widths if w > 1), default=len(near) - 1)


def test_query_takes_all_handoffs(spark, tmp_path):
    # a ring is what everyone hands on most often; the rest is in the rarer partners
    users, r, rows = list(range(90)), random.Random(1), []
    for day in range(40):
        start = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
        rows += [(len(rows) + i, start + datetime.timedelta(seconds=i), v) for i, v in enumerate(users if day < 10 else r.sample(users, 90))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    days = {}
    for _, ts, v in sorted(rows, key=lambda r: (r[1], r[0])):
        days.setdefault(ts.date(), []).append(v)
    g = K.build(sorted({(a, b) for day in days.values() for a, b in zip(day, day[1:], strict=False) if a != b}))
    chosen, eta = K.modulator(g, 3, 4)
    assert len(chosen) == 4 and eta == _eta(g, chosen) > 10
    assert sorted(tuple(r) for r in QUERIES["modulator"](spark, str(tmp_path)).collect()) == [(v, eta, 4 + 0.1 * eta) for v in sorted(chosen)]


@pytest.mark.parametrize("seed", range(40))
def test_proofs_give_what_the_search_gives(seed):
    r = random.Random(seed)
    n = r.randint(52, 75)
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(int(n * r.choice([0.8, 1, 1.5, 3, 8, 20])))}
    edges |= {(h, r.randrange(n)) for h in range(r.choice([0, 0, 3, 6])) for _ in range(n)}
    if seed % 5 == 0:
        edges = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    g, (src, dst) = K.build(sorted(edges)), _columns(sorted(edges))
    target, most = r.choice([0, 1, 3, 3, 5]), r.choice([0, 1, 2, 4])
    chosen, eta = modulators.modulator(src, dst, target, most)
    assert (chosen, eta) == K.modulator(g, target, most) and eta == _eta(g, chosen)
    named = modulators.modulator(*(np.array([f"v{x:03}" for x in ends], object) for ends in (src, dst)), target, most)
    assert named == ({f"v{v:03}" for v in chosen}, eta)


@pytest.mark.parametrize("seed", range(20))
def test_minors_bound_the_widths(seed):
    r = random.Random(seed)
    n = r.randint(2, 60)
    edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 8 * n))})
    near = K.both_ways(K.build(edges, range(n)))
    a, b = _columns(edges)
    least = min(K.eliminate(near, lambda x, v: len(x[v])), K.eliminate(near, K.fill), K.in_order_width(near))
    assert all(modulators.minor_degree(n, *modulators.pairs(n, a, b), enough) <= least for enough in (1, 3, 10, n))
    assert modulators.cyclic(n, a, b) != K.acyclic(K.build(edges))


def test_known_bounds():
    clique = [(a, b) for a in range(30) for b in range(a)]
    assert modulators.minor_degree(30, *modulators.pairs(30, *_columns(clique)), 29) == 29
    # each edge of a clique as a path of ten: still its minor
    paths, n = [], 12
    for a, b in [(a, b) for a in range(12) for b in range(a)]:
        way = [a, *range(n, n + 9), b]
        paths, n = paths + list(zip(way, way[1:], strict=False)), n + 9
    assert modulators.minor_degree(n, *modulators.pairs(n, *_columns(paths)), 5) >= 5


def test_more_edges_than_other_operators_take(spark):
    r = random.Random(1)
    edges = sorted({(v, r.randrange(4000)) for v in range(4000) for _ in range(70)})
    assert len(edges) > feedback.EDGE_LIMIT
    rows = feedback.modulator(graph.cut(spark.createDataFrame([(*e, 1) for e in edges], "src long, dst long, weight long"))).collect()
    near = K.both_ways(K.build(edges))
    chosen = sorted(near, key=lambda v: (-len(near[v]), v))[:4]
    assert sorted(x.v for x in rows) == sorted(chosen) and {x.eta for x in rows} == {max(len(n - set(chosen)) for v, n in near.items() if v not in chosen)}
    assert feedback.modulator(spark.createDataFrame([], "src long, dst long, weight long")).count() == 0
