"""What to remove from a dependency graph so that its cycles go: the composite of cycles, edges, vertices and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.operators import feedback, graph
from cragline.operators.priority import edge_cycle_counts


@dataclass(frozen=True)
class CycleRemoval:
    cycles: DataFrame  # cycle_id, v
    edges: DataFrame  # src, dst, round
    vertices: DataFrame  # v
    counts: DataFrame  # src, dst, weight, cycle_count


def cycle_removal(edges: DataFrame, max_size: int = 4, target: int = 3) -> CycleRemoval:
    """The cycles of edges, the edges and vertices to remove, and how many cycles each edge is in.

    A graph without cycles gives four empty tables.
    """
    edges = graph.cut(edges.select("src", "dst", "weight"))
    cycles = graph.cut(graph.cycle_components(edges))
    counts = edge_cycle_counts(edges, cycles)
    if cycles.isEmpty():
        return CycleRemoval(cycles, edges.select("src", "dst", F.lit(0).alias("round")).limit(0), graph.vertices(edges).limit(0), counts)
    return CycleRemoval(cycles, graph.pagerank_fas(edges), feedback.kernel_dfvs(edges, max_size, target), counts)


def edge_info(removal: CycleRemoval) -> DataFrame:
    """The edges to remove: most cycles first, then removed sources, removed targets, and light edges."""
    source = removal.vertices.select(F.col("v").alias("src"), F.lit(True).alias("remove_source"))
    target = removal.vertices.select(F.col("v").alias("dst"), F.lit(True).alias("remove_target"))
    rows = removal.counts.join(removal.edges.select("src", "dst"), ["src", "dst"], "left_semi").join(source, "src", "left").join(target, "dst", "left")
    rows = rows.select("src", "dst", "weight", "cycle_count", F.coalesce("remove_source", F.lit(False)).alias("remove_source"), F.coalesce("remove_target", F.lit(False)).alias("remove_target"))
    return rows.orderBy(F.desc("cycle_count"), F.desc("remove_source"), F.desc("remove_target"), "weight", "src", "dst")
