import itertools
import random

import pytest
from pyspark.sql import functions as F

from cragline.operators import feedback, graph, removal
from cragline.operators import kernels as K

MATRIX = [("A", "B", 1), ("B", "C", 2), ("C", "D", 3), ("B", "A", 6), ("C", "A", 5), ("D", "A", 4), ("D", "C", 2), ("A", "H", 7), ("E", "C", 9), ("E", "H", 2), ("G", "E", 2), ("H", "D", 9), ("H", "G", 5)]
TWO_RINGS = [("A", "B", 1), ("B", "C", 2), ("C", "D", 3), ("B", "A", 6), ("C", "A", 5), ("D", "A", 4), ("E", "F", 2), ("F", "G", 7), ("G", "H", 9), ("H", "E", 9), ("A", "E", 9), ("E", "A", 3)]


def frame(spark, edges):
    return spark.createDataFrame([(a, b, w) for a, b, w in edges], "src string, dst string, weight long")


def random_edges(seed, n=9, p=0.25):
    r = random.Random(seed)
    return [(f"v{a}", f"v{b}", r.randint(1, 5)) for a in range(n) for b in range(n) if a != b and r.random() < p] or [("v0", "v1", 1)]


def test_matrix_order_and_back_edges():
    g = K.build(MATRIX, ["F"])
    assert K.dsm_order(g) == list("FDCBEGHA")
    assert [(a, b) for a, b, _ in K.back_edges(g)] == [("D", "C"), ("D", "A"), ("C", "A"), ("B", "A"), ("E", "H")]


def test_probed_cycles_and_what_if():
    g = K.build(TWO_RINGS)
    assert sorted(map(sorted, K.vertex_cycles(g))) == [list("ABCD"), list("ABCDEFGH"), list("EFGH")]
    after = {(a, b): len(K.vertex_cycles(K.drop_edges(g, {(a, b)}))) for a, b, _ in K.back_edges(g)}
    assert after == {("D", "A"): 3, ("C", "A"): 3, ("B", "A"): 3, ("H", "E"): 2, ("E", "A"): 2}
    assert not K.vertex_cycles(K.build([("A", "B"), ("B", "C")])) and [sorted(s) for s in K.vertex_cycles(K.build([("A", "B"), ("B", "C"), ("C", "A")]))] == [list("ABC")]


@pytest.mark.parametrize("seed", range(40))
def test_kernels_keep_their_promises(seed):
    edges = random_edges(seed, random.Random(seed).randint(3, 8), 0.3)
    g = K.build(sorted(edges))
    weight = lambda arcs: sum(g[a][b] for a, b in arcs)
    order, arcs = K.ordering_fas(g)
    assert sorted(order) == sorted(g) and len(arcs) <= len(edges) / 2
    for found in (arcs, K.greedy_fas(g), K.exact_fas(g)):
        assert K.acyclic(K.drop_edges(g, found))
    if len(edges) <= 12:
        best = min(weight(s) for n in range(len(edges) + 1) for s in itertools.combinations([e[:2] for e in edges], n) if K.acyclic(K.drop_edges(g, set(s))))
        assert weight(K.exact_fas(g)) == best
    for chosen in (*(K.feedback_vertices(g, s) for s in ("greedy", "scc", "score", "local")), K.approximate_fvs(g)):
        assert K.acyclic(K.without(g, chosen))
    assert (K.feedback_size(g) == 0) == K.acyclic(g)
    near = K.both_ways(g)
    widths = [K.eliminate(near, lambda n, v: len(n[v])), K.eliminate(near, K.fill), K.in_order_width(near)]
    assert K.clique_bound(near) <= min(widths)
    cycles = K.simple_cycles(g)
    assert len(set(cycles)) == len(cycles) and (not cycles) == K.acyclic(g)
    chosen = K.kernelised_dfvs(g, K.feedback_size(g), K.modulator(g, 3, 4)[0], 2)
    assert chosen is None or K.acyclic(K.without(g, chosen))


def test_exact_arc_sets_of_large_components():
    ring = K.build([(i, (i + 1) % 40, 3 - (i == 7)) for i in range(40)])
    assert K.exact_fas(ring) == {(7, 8)}
    r = random.Random(5)
    chords = K.build([(i, (i + 1) % 18, r.randint(1, 9)) for i in range(18)] + [(i, (i * 7 + 3) % 18, r.randint(1, 9)) for i in range(18) if (i * 7 + 3) % 18 != i])
    found = K.exact_fas(chords)
    cost = lambda arcs: sum(chords[a][b] for a, b in arcs)
    assert K.acyclic(K.drop_edges(chords, found)) and cost(found) <= min(cost(K.greedy_fas(chords)), cost(K.ordering_fas(chords)[1]))
    # the best order of all, by subsets
    best = {frozenset(): 0}
    for n in range(18):
        step = {}
        for done, c in best.items():
            for v in set(range(18)) - done:
                x = c + sum(w for u, w in chords[v].items() if u in done)
                key = done | {v}
                if x < step.get(key, 1 << 30):
                    step[key] = x
        best = dict(sorted(step.items(), key=lambda i: i[1])[:40_000])
    assert cost(found) <= min(best.values())
    with pytest.raises(ValueError):
        K.exact_fas(chords, most_steps=2)


def test_small_graphs():
    ring = K.build([("A", "B", 1), ("B", "C", 10), ("C", "A", 1)])
    assert len(K.exact_fas(ring)) == 1 and ("B", "C") not in K.exact_fas(ring)
    assert K.shortest_path(ring, "A", "C") == ["A", "B", "C"] and K.shortest_path(K.build([("A", "B")]), "B", "A") is None
    assert K.topological(ring) is None and K.topological(K.build([("B", "C"), ("A", "B")])) == ["A", "B", "C"]
    path = K.both_ways(K.build([("A", "B"), ("B", "C")]))
    assert K.betweenness(path, sorted(path)) == {"A": 0.0, "B": 2.0, "C": 0.0} and K.articulation_points(path) == {"B"}
    assert K.treewidth_bound(ring) == 2 and K.treewidth_bound(ring, {"A", "B"}) == 0 and K.treewidth_bound(K.build([("A", "B"), ("B", "C")])) == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_iterations_match_the_kernels(spark, seed):
    edges = random_edges(seed, 12, 0.14)
    df, g = graph.cut(frame(spark, edges)), K.build(sorted(edges))
    want = {v: min(part) for part in K.components(g) for v in part}
    parts = graph.cut(graph.strong_components(df, kernel_limit=0))
    assert {r.v: r.component for r in parts.collect()} == want == {r.v: r.component for r in graph.strong_components(df).collect()}
    assert graph.has_cycle(df, 0) == graph.has_cycle(df) == graph.is_cyclic(df).first().cyclic == (not K.acyclic(g))
    near, comps = K.both_ways(g), {}
    for v in sorted(near):
        stack = [v]
        while stack:
            w = stack.pop()
            if w not in comps:
                comps[w] = v
                stack += near[w]
    for limit in (0, 1000):
        assert {r.v: r.component for r in graph.connected_components(df, limit).collect()} == comps
    line = {tuple(r) for r in graph.line_digraph(df, parts).collect()}
    inner = [(a, b) for a, b, _ in edges if want[a] == want[b]]
    assert line == {(a, b, c, d) for a, b in inner for c, d in inner if b == c}
    score = {e: 1 / len(inner) for e in inner}
    for _ in range(5):
        new = dict.fromkeys(inner, 0.0)
        for e in inner:
            to = [f for f in inner if f[0] == e[1]]
            for f in to or [e]:
                new[f] += score[e] / max(1, len(to))
        score = new
    got = {(r.src, r.dst): r.score for r in graph.line_pagerank(df, parts).collect()}
    assert got.keys() == {x for e in line for x in (e[:2], e[2:])} and all(abs(score[e] - s) < 1e-12 for e, s in got.items())
    gone = {(r.src, r.dst) for r in graph.pagerank_fas(df).collect()}
    assert K.acyclic(K.drop_edges(g, gone))


def test_modulators_by_structure():
    # two cliques joined at one vertex: the joint is the articulation point, the fallback takes the highest degrees
    cliques = [(a, b, 1) for part in ("abcdx", "efghx") for a in part for b in part if a != b]
    g = K.build(cliques)
    near = K.both_ways(g)
    between = K.betweenness(near, sorted(near))
    assert K.articulation_points(near) == {"x"}
    weight = K.importance(near, between)
    assert weight["x"] == 8 + 10 * between["x"] + 0.5 * 12 and weight["a"] == 4 + 10 * between["a"] + 0.5 * 6
    assert K.modulator(g, 3, 1) == ({"x"}, 3) and K.treewidth_bound(g) == 4
    assert K.modulator(g, 1, 2) == ({"x", "a"}, K.treewidth_bound(g, {"x", "a"}))
    rows = K.modulator_options(g, 4, 9)
    assert rows[0] == (["x"], 3, 1.3) and [r[2] for r in rows] == sorted(r[2] for r in rows) and len({tuple(r[0]) for r in rows}) == len(rows) > 1
    assert K.modulator_options(g, 4, 1) == rows[:1]


def test_frames_of_kernels(spark):
    df = graph.cut(frame(spark, TWO_RINGS))
    assert feedback.dsm_order(df).count() == 8
    back = graph.cut(feedback.back_edges(df))
    assert feedback.first_min_back_edge(back).first().weight == min(r.weight for r in feedback.min_back_edges(back).collect())
    impact = feedback.edge_whatif(df).collect()
    assert len(impact) == back.count() and all(r.payoff == r.new_cycles / r.weight for r in impact)
    assert {(r.src, r.dst) for r in feedback.optimal_back_edges(df).collect()} == {("A", "B")}
    assert len(feedback.optimal_back_edges(frame(spark, [("A", "B", 1), ("B", "C", 1), ("C", "A", 1)])).collect()) == 3
    lines = [r.line for r in feedback.dsm_matrix(df, feedback.dsm_order(df)).orderBy("pos").collect()]
    assert len(lines) == 8 and all(line.split()[i] == "-" for i, line in enumerate(lines))
    assert feedback.is_feedback_set(df, feedback.fvs(df)).first().valid
    assert feedback.fvs_size(df).first().k == 2
    found = [r.v for r in feedback.modulator(df).collect()]
    assert feedback.is_modulator(df, found).first().valid and not feedback.is_modulator(df, [], 1).first().valid
    options = feedback.fvs_options(df, options=2).collect()
    assert [r.option for r in options] == list(range(1, len(options) + 1)) and all(r.k == 2 for r in options)
    given = feedback.fvs_parameters(df, given=found).first()
    assert given == feedback.fvs_parameters(df).first() and given.quality == 10 * given.k + 5 * given.modulator_size + given.eta
    full = {r.v: r.betweenness for r in feedback.betweenness(df).collect()}
    assert full == {r.v: r.betweenness for r in feedback.betweenness(df, sample=8).collect()}
    assert feedback.degree_sample(df, 3).count() == 3
    stats = graph.graph_stats(df).first()
    assert (stats.n_vertices, stats.n_edges, stats.largest) == (8, 12, 8)
    assert graph.line_statistics(graph.line_digraph(df)).first().n_vertices == 12


def test_streams(spark, tmp_path):
    from cragline.streaming.changes import EVENT_SCHEMA, event_stream, windowed_changes

    rows = spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    rows.write.parquet(str(tmp_path / "in"))
    query = windowed_changes(event_stream(spark, str(tmp_path / "in"), EVENT_SCHEMA)).writeStream.format("memory").queryName("changes").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("changes").agg(F.sum("n")).first()[0] == 40


def test_cycle_removal(spark):
    ring = removal.cycle_removal(frame(spark, [("A", "B", 1), ("B", "C", 1), ("C", "A", 1), ("C", "D", 1)]))
    assert sorted(r.v for r in ring.cycles.collect()) == ["A", "B", "C"] and ring.edges.count() == 1
    assert {r.cycle_count for r in ring.counts.collect()} == {1} and len(removal.edge_info(ring).collect()) == 1
    none = removal.cycle_removal(frame(spark, [("A", "B", 1), ("B", "C", 1)]))
    assert none.cycles.count() == none.edges.count() == none.vertices.count() == none.counts.count() == 0
