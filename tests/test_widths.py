"""Widths of graphs with hubs that hold trees, and of orders, against plain definitions."""

import random
import time

import pytest

from cragline.operators import kernels as K


def _plain_in_order(near, enough=None):
    near, width, done = {v: set(n) for v, n in near.items()}, 0, set()
    for v in sorted(near):
        done.add(v)
        later = near[v] - done
        width = max(width, len(later))
        if enough is not None and width >= enough:
            break
        for w in later:
            near[w] |= later - {w}
    return width


@pytest.mark.parametrize("seed", range(60))
def test_widths_as_defined(seed):
    r = random.Random(seed)
    n = r.randint(2, 60)
    g = K.build(sorted({(r.randrange(n), r.randrange(n), 1) for _ in range(r.randint(1, 2 * n))}))
    near = K.both_ways(g)
    for enough in (None, 2, 3, 5):
        assert K.in_order_width(near, enough) == _plain_in_order(near, enough)
    core = K.without_trees(near)
    assert all(len(around) > 1 for around in core.values())
    for cost in (lambda n, v: len(n[v]), K.fill):
        assert max(1, K.eliminate(near, cost)) == max(1, K.eliminate(core, cost))


def test_eta_of_hubs_with_trees_takes_seconds():
    began, r = time.monotonic(), random.Random(1)
    # everyone leads to someone of a small number; the only ring is a pair, so that no two ways lead apart
    g = K.build(sorted([(0, 1, 1), (1, 0, 1)] + [(v, min(v - 1, int(r.expovariate(1 / 100))), 1) for v in range(2, 90_000)]))
    assert K.treewidth_bound(g) == max(map(len, K.both_ways(g).values()))
    assert time.monotonic() - began < 60
