"""Feedback sets, orders, cycles, widths and centralities of graphs as DataFrames.

The algorithms of kernels.py are sequential. Those that work within connected parts run as one task for each
part; those on candidates or sources run as one task for some of them, with the graph sent along. A graph that
is sent whole to a task may have EDGE_LIMIT edges at most, which is checked; modulator takes any number.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.operators import centrality as C
from cragline.operators import kernels as K
from cragline.operators import modulators as M
from cragline.operators.graph import connected_components, vertices

EDGE_LIMIT = 200_000


def _collected(edges: DataFrame):
    """The edges as a broadcast variable, sorted; refuses graphs that are too large for one task."""
    rows = edges.select("src", "dst", "weight").limit(EDGE_LIMIT + 1).collect()
    if len(rows) > EDGE_LIMIT:
        raise ValueError(f"this operator takes graphs of up to {EDGE_LIMIT} edges")
    return edges.sparkSession.sparkContext.broadcast(sorted(map(tuple, rows)))


def _kind(edges: DataFrame) -> str:
    return edges.schema["src"].dataType.simpleString()


def by_part(edges: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(graph) -> rows, run on each connected part of the graph in a task of its own; refuses parts that are too large for one."""
    parts = connected_components(edges)
    sizes = edges.select("src").join(parts.withColumnRenamed("v", "src"), "src").groupBy("component").agg(F.count("*").alias("n"))
    if not sizes.filter(F.col("n") > EDGE_LIMIT).isEmpty():
        raise ValueError(f"this operator takes connected parts of up to {EDGE_LIMIT} edges")
    names = [f.split()[0] for f in schema.split(", ")]
    rows = edges.select("src", "dst", "weight").join(parts.withColumnRenamed("v", "src"), "src")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        g = K.build(sorted(frame[["src", "dst", "weight"]].itertuples(index=False, name=None)))
        return pd.DataFrame(list(kernel(g)), columns=names)

    return rows.groupBy("component").applyInPandas(run, schema)


def on_whole(edges: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(graph) -> rows, run on the whole graph in one task."""
    given = _collected(edges)
    names = [f.split()[0] for f in schema.split(", ")]
    one = edges.sparkSession.range(1, numPartitions=1)
    return one.mapInPandas(lambda it: (pd.DataFrame(list(kernel(K.build(given.value))), columns=names) for _ in it), schema)


def dsm_order(edges: DataFrame) -> DataFrame:
    """v, pos: the order of the design structure matrix. Vertices and edges count as inserted in sorted order."""
    return on_whole(edges, lambda g: ((v, i) for i, v in enumerate(K.dsm_order(g))), f"v {_kind(edges)}, pos long")


def back_edges(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """src, dst, weight, src_pos, dst_pos of the edges above the diagonal."""
    order = dsm_order(edges) if order is None else order
    rows = edges.join(order.select(F.col("v").alias("src"), F.col("pos").alias("src_pos")), "src").join(order.select(F.col("v").alias("dst"), F.col("pos").alias("dst_pos")), "dst")
    return rows.filter("src_pos < dst_pos").select("src", "dst", "weight", "src_pos", "dst_pos")


def min_back_edges(back: DataFrame) -> DataFrame:
    """The back edges of least weight."""
    return back.join(F.broadcast(back.agg(F.min("weight").alias("least"))), F.col("weight") == F.col("least")).drop("least")


def first_min_back_edge(back: DataFrame) -> DataFrame:
    """The first back edge of least weight in matrix order; one row, or none."""
    return back.orderBy("weight", "src_pos", "dst_pos").limit(1).select("src", "dst", "weight")


def dsm_matrix(edges: DataFrame, order: DataFrame) -> DataFrame:
    """One row of text for each vertex in order: weights by column, - on the diagonal, 0 where there is no edge.

    A matrix is for printing: the number of vertices decides the number of columns of the text.
    """
    at = order.select(F.col("v").alias("src"), F.col("pos").alias("row"))
    to = order.select(F.col("v").alias("dst"), F.col("pos").alias("col"))
    cell = lambda col, text: F.struct(F.col(col).alias("col"), text.alias("text"))
    held = edges.join(at, "src").join(to, "dst").filter("row <> col").select("row", cell("col", F.col("weight").cast("long").cast("string")).alias("cell"))
    held = held.unionByName(order.select(F.col("pos").alias("row"), cell("pos", F.lit("-")).alias("cell")))
    rows = held.groupBy("row").agg(F.array_sort(F.collect_list("cell")).alias("cells")).join(order, F.col("row") == F.col("pos")).join(F.broadcast(order.agg(F.max("pos").alias("last"))))
    # cells that are 0 are runs, written at once
    before = lambda i: F.when(i == 0, -1).otherwise(F.try_element_at("cells", F.greatest(i, F.lit(1)))["col"])
    pieces = F.transform("cells", lambda c, i: F.concat(F.repeat(F.lit(" 0"), (c["col"] - before(i) - 1).cast("int")), F.lit(" "), c["text"]))
    tail = F.repeat(F.lit(" 0"), (F.col("last") - F.element_at("cells", -1)["col"]).cast("int"))
    return rows.select("pos", "v", F.substring(F.concat(F.array_join(pieces, ""), tail), 2, (1 << 31) - 1).alias("line"))


def vertex_cycles(edges: DataFrame) -> DataFrame:
    """cycle_id, v: cycles as probed from each vertex in turn."""
    return on_whole(edges, lambda g: ((i, v) for i, s in enumerate(K.vertex_cycles(g)) for v in sorted(s)), f"cycle_id long, v {_kind(edges)}")


def edge_whatif(edges: DataFrame, candidates: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """src, dst, weight, old_cycles, new_cycles, payoff of removing each candidate edge.

    Candidates: the back edges, or of more than limit ones the first limit of least weight (0: all). payoff is
    new_cycles / weight. One task for each of a few candidates.
    """
    given = _collected(edges)
    if candidates is None:
        back = back_edges(edges)
        candidates = back if not limit or back.count() <= limit else min_back_edges(back).orderBy("src_pos", "dst_pos").limit(limit)
    rows = candidates.select("src", "dst", "weight").repartition("src", "dst")

    def run(it):
        g = K.build(given.value)
        old = len(K.vertex_cycles(g))
        for frame in it:
            new = [len(K.vertex_cycles(K.drop_edges(g, {(a, b)}))) for a, b in zip(frame["src"], frame["dst"], strict=True)]
            yield frame.assign(old_cycles=old, new_cycles=new, payoff=[n / w for n, w in zip(new, frame["weight"], strict=True)])

    kind = _kind(edges)
    return rows.mapInPandas(run, f"src {kind}, dst {kind}, weight {edges.schema['weight'].dataType.simpleString()}, old_cycles long, new_cycles long, payoff double")


def sparse_whatif(edges: DataFrame) -> DataFrame:
    """src, dst, weight, new_back_edges, payoff of each back edge: (old - new sum of back-edge weights) / weight."""
    given = _collected(edges)

    def run(it):
        g = K.build(given.value)
        old = sum(w for *_, w in K.back_edges(g))
        for frame in it:
            after = [K.back_edges(K.drop_edges(g, {(a, b)})) for a, b in zip(frame["src"], frame["dst"], strict=True)]
            yield frame.assign(new_back_edges=[len(x) for x in after], payoff=[(old - sum(w for *_, w in x)) / y for x, y in zip(after, frame["weight"], strict=True)])

    kind = _kind(edges)
    return back_edges(edges).select("src", "dst", "weight").repartition("src", "dst").mapInPandas(run, f"src {kind}, dst {kind}, weight {edges.schema['weight'].dataType.simpleString()}, new_back_edges long, payoff double")


def simple_cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """path, length of each elementary cycle, from its smallest vertex; by connected part."""
    return by_part(edges, lambda g: ((list(c), len(c)) for c in K.simple_cycles(g, max_length)), f"path array<{_kind(edges)}>, length long")


def optimal_back_edges(edges: DataFrame) -> DataFrame:
    """src, dst, weight, cycles: the edges on the most elementary cycles, of those the lightest; all ties."""
    cycles = simple_cycles(edges)
    steps = F.transform(F.col("path"), lambda v, i: F.struct(v.alias("src"), F.col("path")[(i + 1) % F.size("path")].alias("dst")))
    counts = cycles.select(F.explode(steps).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("cycles")).join(edges, ["src", "dst"])
    most = counts.agg(F.max(F.struct("cycles", (-F.col("weight")).alias("w"))).alias("most"))
    return counts.join(F.broadcast(most)).filter("cycles = most.cycles AND -weight = most.w").select("src", "dst", "weight", "cycles")


def ordering_order(edges: DataFrame) -> DataFrame:
    """v, pos of each connected part's vertices in the order of the surplus heuristic."""
    return by_part(edges, lambda g: ((v, i) for i, v in enumerate(K.ordering_fas(g)[0])), f"v {_kind(edges)}, pos long")


def ordering_fas(edges: DataFrame) -> DataFrame:
    """src, dst, weight: the arcs that run backwards in that order."""
    order = ordering_order(edges)
    rows = edges.join(order.select(F.col("v").alias("src"), F.col("pos").alias("a")), "src").join(order.select(F.col("v").alias("dst"), F.col("pos").alias("b")), "dst")
    return rows.filter("a >= b").select("src", "dst", "weight")


def min_fas(edges: DataFrame, mode: str = "greedy") -> DataFrame:
    """src, dst, weight of a feedback arc set: greedy by weight, or a lightest one, which raises an error on components that take too long."""
    kernel = {"greedy": K.greedy_fas, "exact": K.exact_fas}[mode]
    kind = _kind(edges)
    return by_part(edges, lambda g: sorted(kernel(g)), f"src {kind}, dst {kind}").join(edges, ["src", "dst"]).select("src", "dst", "weight")


def fvs(edges: DataFrame, strategy: str = "greedy") -> DataFrame:
    """v: a feedback vertex set; strategies greedy, scc, score and local."""
    return by_part(edges, lambda g: ((v,) for v in sorted(K.feedback_vertices(g, strategy))), f"v {_kind(edges)}")


def fvs_size(edges: DataFrame) -> DataFrame:
    """One row: k, the size of the smallest set that the strategies find."""
    return on_whole(edges, lambda g: [(K.feedback_size(g),)], "k long")


def is_feedback_set(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: valid, whether no cycle is left without the chosen vertices."""
    from cragline.operators.graph import is_cyclic

    rest = edges.join(chosen.select(F.col("v").alias("src")), "src", "left_anti").join(chosen.select(F.col("v").alias("dst")), "dst", "left_anti")
    return is_cyclic(rest).select((~F.col("cyclic")).alias("valid"))


def approx_fvs(edges: DataFrame, special: list | None = None, weights: dict | None = None) -> DataFrame:
    """v: feedback vertices by distance cuts; with `special`, of the cycles through those vertices."""
    wanted = None if special is None else set(special)
    return by_part(edges, lambda g: ((v,) for v in sorted(K.approximate_fvs(g, wanted, weights))), f"v {_kind(edges)}")


def treewidth_bound(edges: DataFrame, modulator: list | None = None) -> DataFrame:
    """One row: eta."""
    gone = set(modulator or ())
    return on_whole(edges, lambda g: [(K.treewidth_bound(g, gone),)], "eta long")


def modulator(edges: DataFrame, target: int = 3, max_size: int = 4) -> DataFrame:
    """v, eta, quality: the modulator's vertices, the width they leave, and size + eta / 10. One task takes the whole graph, of any size."""

    def run(it):
        frames = list(it)
        if frames:
            src, dst = (np.concatenate([frame[c].to_numpy() for frame in frames]) for c in ("src", "dst"))
            frames.clear()
            chosen, eta = M.modulator(src, dst, target, max_size)
            yield pd.DataFrame([(v, eta, len(chosen) + 0.1 * eta) for v in sorted(chosen)], columns=["v", "eta", "quality"])

    return edges.select("src", "dst").repartition(1).mapInPandas(run, f"v {_kind(edges)}, eta long, quality double")


def is_modulator(edges: DataFrame, chosen: list, target: int = 3) -> DataFrame:
    """One row: eta, and valid, whether the graph without the chosen vertices has a width of at most target."""
    return treewidth_bound(edges, chosen).select("eta", (F.col("eta") <= target).alias("valid"))


def fvs_parameters(edges: DataFrame, max_size: int = 4, target: int = 3, given: list | None = None) -> DataFrame:
    """One row: k, modulator_size, eta, quality (10 k + 5 size + eta) and kernel_bound ((k size)^(eta^2), as log10), of the
    modulator that is found, or of the given one."""

    def run(g):
        k = K.feedback_size(g)
        chosen, eta = K.modulator(g, target, max_size) if given is None else (set(given), K.treewidth_bound(g, set(given)))
        size = len(chosen)
        return [(k, size, eta, 10.0 * k + 5 * size + eta, _kernel_bound(k, size, eta))]

    return on_whole(edges, run, "k long, modulator_size long, eta long, quality double, log10_kernel_bound double")


def _kernel_bound(k: int, size: int, eta: int) -> float:
    return eta * eta * math.log10(k * size) if k * size else 0.0


def fvs_options(edges: DataFrame, max_size: int = 4, options: int = 3) -> DataFrame:
    """option (from 1), k, modulator (array), eta, quality (size + eta / 10), log10_kernel_bound: the best of several searches."""

    def run(g):
        k = K.feedback_size(g)
        return [(n, k, chosen, eta, quality, _kernel_bound(k, len(chosen), eta)) for n, (chosen, eta, quality) in enumerate(K.modulator_options(g, max_size, options), 1)]

    return on_whole(edges, run, f"option int, k long, modulator array<{_kind(edges)}>, eta long, quality double, log10_kernel_bound double")


def kernel_dfvs(edges: DataFrame, max_size: int = 4, target: int = 3) -> DataFrame:
    """v: a feedback vertex set of at most k vertices through the zone decomposition; none where it finds none."""

    def run(g):
        k = K.feedback_size(g)
        chosen, eta = K.modulator(g, target, max_size)
        return [(v,) for v in sorted(K.kernelised_dfvs(g, k, chosen, eta) or ())]

    return on_whole(edges, run, f"v {_kind(edges)}")


def betweenness(edges: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """v, betweenness over the undirected graph, summed over sources; with `sample`, over a seeded sample, scaled by n / sample.

    Without a sample, trees are folded into their roots first, on the driver. Sources are spread over tasks, each with the
    whole graph, and searched in batches, by chains of vertices with two neighbours where those are most of the graph.
    """
    spark, kind = edges.sparkSession, _kind(edges)
    tasks = 4 * spark.sparkContext.defaultParallelism  # small ones, so that none is waited for long
    near = K.both_ways(K.build(_collected(edges).value))
    if sample is None:
        core, held, passed = C.fold(near)
        names, *packed = C.packed({v: n for v, n in core.items() if n}, held)
        order, search = C.searcher(*packed)
        sources, scale = spark.range(0, len(order), 1, tasks), 1.0  # each task has neighbouring ones
        base = spark.createDataFrame([(v, float(x)) for v, x in passed.items()], f"v {kind}, x double")
    else:
        names, *packed = C.packed(near, dict.fromkeys(near, 1))
        order, search = range(len(names)), partial(C.shares, *packed)
        chosen = vertices(edges).orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(sample)
        numbers, scale = {v: i for i, v in enumerate(names)}, len(names) / max(1, min(sample, len(names)))
        sources = spark.createDataFrame([(numbers[r.v],) for r in chosen.collect()], "id long").repartition(tasks, "id")
        base = vertices(edges).withColumn("x", F.lit(0.0))
    given = spark.sparkContext.broadcast((names, np.asarray(order), search))

    def run(it):
        names, order, search = given.value
        for frame in it:
            yield pd.DataFrame({"v": names, "x": search(order[frame["id"].to_numpy()]) * scale})

    return base.unionByName(sources.mapInPandas(run, f"v {kind}, x double")).groupBy("v").agg(F.sum("x").alias("betweenness"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """v: vertices without which their connected part falls apart."""
    return by_part(edges, lambda g: ((v,) for v in sorted(K.articulation_points(K.both_ways(g)))), f"v {_kind(edges)}")


def degree_sample(edges: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """v: a sample without replacement, weighted by degree, the same for the same seed."""
    from cragline.operators.graph import degrees

    draw = (F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return degrees(edges).withColumn("_key", -F.log(draw) / F.col("degree")).orderBy("_key", "v").limit(size).select("v")
