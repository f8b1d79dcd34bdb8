"""Betweenness over chains of vertices with two neighbours, against the plain search and closed forms."""

import random
import time

import numpy as np
import pytest

from cragline.operators import centrality as C
from cragline.operators import feedback, graph
from cragline.operators import kernels as K


def strung(seed):
    """Few nodes with chains between them, loops, parallel chains and plain edges among them, sometimes a ring and trees."""
    r = random.Random(seed)
    n = new = r.randint(1, 8)
    edges = []
    for _ in range(r.randint(1, 14)):
        a, b, m = r.randrange(n), r.randrange(n), r.randint(1, 6)
        path = [a, *range(new, new + m + 1), b]
        if r.random() < 0.3 and a != b:
            path = [a, b]
        new += len(path) - 2
        edges += zip(path, path[1:], strict=False)
    if r.random() < 0.4:
        m = r.randint(3, 7)
        edges += [(new + k, new + (k + 1) % m) for k in range(m)]
        new += m
    for k in range(r.randint(0, 6)):
        edges.append((r.randrange(new + k), new + k))
    return sorted({(a, b, 1) for a, b in edges})


@pytest.mark.parametrize("seed", range(40))
def test_chains_give_what_the_plain_search_gives(seed):
    near = K.both_ways(K.build(strung(seed)))
    core, held, passed = C.fold(near)
    names, begin, ends, held = C.packed({v: n for v, n in core.items() if n}, held)
    if not names:
        pytest.skip("a forest")
    found = C.chains(begin, ends, held)
    assert sorted(found.sources.tolist()) == list(range(len(names)))
    every = C.chain_shares(found, held, found.sources)
    assert every == pytest.approx(C.shares(begin, ends, held, np.arange(len(names))))
    half = len(names) // 2
    assert every == pytest.approx(C.chain_shares(found, held, found.sources[:half]) + C.chain_shares(found, held, found.sources[half:]))
    want, given = K.betweenness(near, sorted(near)), dict(zip(names, every, strict=True))
    assert want == pytest.approx({v: x + given.get(v, 0) for v, x in passed.items()})


def test_long_ring_takes_seconds():
    began, n = time.monotonic(), 20_001
    found = C.betweenness({v: {(v + 1) % n, (v - 1) % n} for v in range(n)})
    half = (n - 1) // 2
    assert set(found.values()) == {half * (half - 1.0)}
    assert time.monotonic() - began < 60


def test_query_form_over_chains(spark):
    edges = [(a, b, 1) for k in range(6) for a, b in zip([k, *range(10 + 40 * k, 45 + 40 * k)], [*range(10 + 40 * k, 45 + 40 * k), (k * 2 + 1) % 6], strict=True)]
    near = K.both_ways(K.build(sorted(edges)))
    found = feedback.betweenness(graph.cut(spark.createDataFrame(edges, "src long, dst long, weight long")))
    assert {r.v: r.betweenness for r in found.collect()} == pytest.approx(K.betweenness(near, sorted(near)))
