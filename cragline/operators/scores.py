"""How much the removal of a vertex would simplify an undirected graph.

The score weighs a vertex's degree, its neighbourhood and what it holds together against a target width. Every
part is an expression over four numbers of a vertex: neighbours n, edges among them t, degree d (each edge counts
for both ends, so 2 n), and neighbours above the target h. The expressions are kept as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.operators.graph import triangles, undirected


def steps(target: int) -> list[dict[str, str]]:
    """Columns to add, a stage at a time; later stages use earlier ones."""
    t, up, base = f"{float(target)}e0", f"{float(target + 1)}e0", f"{float(max(1, target))}e0"  # doubles, not decimals
    bridge = "(n >= 2 AND t < pairs * 0.3e0)"
    return [
        {"pairs": "n * (n - 1) / 2e0"},
        {"cc": "CASE WHEN pairs > 0 THEN t / pairs ELSE 0e0 END", "fill": f"n / {base}"},
        {
            "importance": f"CASE WHEN n < 2 THEN 0e0 ELSE cc * least(1e0, n / {up}) END + CASE WHEN n <= 1 THEN 0.1e0 ELSE least(1e0, (1e0 - cc) * least(1e0, fill) + least(1e0, fill) * (1e0 - cc)) END"
            f" + CASE WHEN n <= {t} THEN 0.2e0 ELSE cc * least(2e0, fill) END",
            "clique": f"CASE WHEN n <= {t} THEN 0.2e0 ELSE (pairs - t) / pairs * least(2e0, fill) END",
            "penalty": f"least(0.5e0, CASE WHEN {bridge} THEN 0.3e0 ELSE 0e0 END + CASE WHEN n >= 3 AND {bridge} THEN 0.2e0 ELSE 0e0 END + CASE WHEN n >= 2 AND h >= 2 THEN least(0.3e0, h * 0.1e0) ELSE 0e0 END)",
        },
        {"low_d": "min(d) OVER ()", "high_d": "max(d) OVER ()", "low_i": "min(importance) OVER ()", "high_i": "max(importance) OVER ()"},
        {
            "by_degree": f"CASE WHEN high_d > low_d THEN (d - low_d) / ((high_d - low_d) * 1e0) ELSE 0e0 END * CASE WHEN d > {t} THEN 1e0 + (d - {t}) / {base} ELSE 1e0 - ({t} - d) / {base} * 0.5e0 END * 0.3e0",
            "by_importance": "CASE WHEN high_i > low_i THEN (importance - low_i) / (high_i - low_i) * 0.25e0 ELSE 0e0 END",
            "by_excess": f"CASE WHEN d > {t} THEN least(1e0, (d - {t}) / {base}) * 0.25e0 ELSE 0e0 END",
            "by_reduction": f"CASE WHEN n = 0 THEN 0.1e0 ELSE least(1e0, least(1e0, n / {up}) * 0.4e0 + clique * 0.4e0 + h / (greatest(1, n) * 1e0) * 0.2e0) * 0.15e0 END",
        },
        {"score": f"(by_degree + by_importance + by_excess + by_reduction - penalty) * CASE WHEN d > {1.5 * target}e0 THEN 1.3e0 ELSE 1e0 END * (1e0 + greatest(0e0, d - {t}) / {base})"},
        {"removal_score": "round(greatest(0e0, least(10e0, score)), 9)"},
    ]


def neighbourhoods(edges: DataFrame, target: int) -> DataFrame:
    """v, n, t, d, h of each vertex with an edge."""
    e = undirected(edges)
    size = triangles(edges).select("v", F.col("degree").alias("n"), F.col("triangles").alias("t"))
    near = e.union(e.select("v", "u")).toDF("v", "w")
    above = near.join(size.select(F.col("v").alias("w"), (2 * F.col("n")).alias("d")), "w").groupBy("v").agg(F.count_if(F.col("d") > target).alias("h"))
    return size.join(above, "v").select("v", "n", "t", (2 * F.col("n")).alias("d"), "h")


def vertex_removal_score(edges: DataFrame, target: int = 3) -> DataFrame:
    """v, removal_score (0 to 10). The extremes that normalise it come from one aggregate row, not from a window."""
    rows = neighbourhoods(edges, target)
    for stage in steps(target):
        if any("OVER ()" in x for x in stage.values()):
            ends = rows.agg(*[F.expr(x.removesuffix(" OVER ()")).alias(k) for k, x in stage.items()])
            rows = rows.join(F.broadcast(ends))
        else:
            rows = rows.withColumns({k: F.expr(x) for k, x in stage.items()})
    return rows.select("v", "removal_score")


def removal_sql(target: int, neighbours: str) -> str:
    """The stages as nested selects over `neighbours`, a relation with v, n, t, d, h."""
    for stage in steps(target):
        neighbours = f"(SELECT *, {', '.join(f'{x} AS {k}' for k, x in stage.items())} FROM {neighbours})"
    return f"SELECT v, removal_score FROM {neighbours}"


def adaptive_removal_score(scores: DataFrame, target: int, current: int) -> DataFrame:
    """Scores raised by how far the current width is above the target, 10 at most."""
    factor = 1.0 + max(0, current - target) / max(1, target)
    return scores.withColumn("removal_score", F.least(F.lit(10.0), F.col("removal_score") * factor))


def structural_importance(edges: DataFrame, centrality: DataFrame) -> DataFrame:
    """v, importance: degree + 10 x betweenness + half the triangles."""
    rows = triangles(edges).join(centrality, "v")
    return rows.select("v", (F.col("degree") + 10 * F.col("betweenness") + 0.5 * F.col("triangles")).alias("importance"))
