"""Weighted directed graphs as edges(src, dst, weight): building, pruning, degrees, components, line graphs, PageRank.

Iterations write each round to the shared folder, so lineage does not grow and a lost executor costs one round.
Graphs of up to KERNEL_EDGES edges, which are counted first, skip the rounds: their components are found on the
driver, with the same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.operators import kernels as K
from cragline.sources.scratch import cut, discard

KERNEL_EDGES = 200_000


def package_of(c: str):
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", "")).otherwise("")


def class_edges(refs: DataFrame) -> DataFrame:
    """refs(owner_fqn, target_fqn[, refs]) -> src, dst, weight: references by ordered pair, self references dropped."""
    n = F.sum("refs") if "refs" in refs.columns else F.count("*")
    return refs.filter("owner_fqn <> target_fqn").groupBy(F.col("owner_fqn").alias("src"), F.col("target_fqn").alias("dst")).agg(n.alias("weight"))


def package_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy(package_of("src").alias("s"), package_of("dst").alias("d")).agg(F.sum("weight").alias("weight")).filter("s <> d").withColumnsRenamed({"s": "src", "d": "dst"})


def package_edge_members(edges: DataFrame) -> DataFrame:
    """package_src, package_dst, src, dst, weight: the class edges behind each package edge."""
    rows = edges.select(package_of("src").alias("package_src"), package_of("dst").alias("package_dst"), "src", "dst", "weight")
    return rows.filter("package_src <> package_dst")


def keep_in_codebase(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges both of whose ends are in one of packages(package)."""
    known = packages.select("package").distinct()
    rows = edges.withColumn("_s", package_of("src")).withColumn("_d", package_of("dst"))
    rows = rows.join(known.withColumnRenamed("package", "_s"), "_s", "left_semi").join(known.withColumnRenamed("package", "_d"), "_d", "left_semi")
    return rows.select("src", "dst", "weight")


def undirected(edges: DataFrame) -> DataFrame:
    """u, v with u < v, each pair once; self-loops dropped."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """v, out_degree, in_degree, degree."""
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left after vertices without incoming or without outgoing edges are peeled away, again and again."""
    core, n = cut(edges.select("src", "dst")), -1
    while True:
        left = core.count()
        if left in (n, 0):
            return core
        n, before = left, core
        core = cut(core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        discard(before)


def _small(edges: DataFrame, limit: int) -> K.Graph | None:
    """The graph itself, where it has at most limit edges."""
    rows = edges.select("src", "dst").limit(limit + 1).collect() if limit else [None]
    return K.build(sorted({tuple(r) for r in rows})) if len(rows) <= limit else None


def _named(edges: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(rows, ", ".join(f"{c} {kind}" for c in columns.split()))


def has_cycle(edges: DataFrame, kernel_limit: int = KERNEL_EDGES) -> bool:
    g = _small(edges, kernel_limit)
    return not cyclic_core(edges).isEmpty() if g is None else not K.acyclic(g)


def is_cyclic(edges: DataFrame, kernel_limit: int = KERNEL_EDGES) -> DataFrame:
    """One row: cyclic."""
    return edges.sparkSession.createDataFrame([(has_cycle(edges, kernel_limit),)], "cyclic boolean")


def _spread(edges: DataFrame, labels: DataFrame, keep_largest: bool = False) -> DataFrame:
    """labels(v, label) after the smallest label has flowed along edges (a -> b) to a fixed point."""
    before = old = None
    while True:
        flow = edges.join(labels.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), "label")
        labels = cut(labels.unionByName(flow).groupBy("v").agg(F.min("label").alias("label")))
        discard(old)
        old = labels
        now = tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("v", "label").cast("decimal(38,0)"))).first())
        if now == before:
            return labels
        before = now


def connected_components(edges: DataFrame, kernel_limit: int = KERNEL_EDGES) -> DataFrame:
    """v, component: the smallest vertex that v is connected with, directions apart."""
    g = _small(edges, kernel_limit)
    if g is not None:
        return _named(edges, sorted(K.connected(K.both_ways(g)).items()), "v component")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    both = cut(both)
    return _spread(both, both.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v"))).withColumnRenamed("label", "component")


def strong_components(edges: DataFrame, kernel_limit: int = KERNEL_EDGES) -> DataFrame:
    """v, component for every vertex: the smallest vertex of its strongly connected component.

    Forward colours give every vertex the smallest one that reaches it. Within a colour, what reaches the colour's
    vertex backwards is one component. Found components leave, and the rest goes on.
    """
    g = _small(edges, kernel_limit)
    if g is not None:
        return _named(edges, [(v, min(part)) for part in K.components(g) for v in part], "v component")
    every = vertices(edges)
    rest = cut(edges.select("src", "dst").distinct())
    found = None
    while True:
        rest = cyclic_core(rest)
        if rest.isEmpty():
            break
        ahead = rest.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        start = vertices(rest).withColumn("label", F.col("v"))
        colour = _spread(ahead, start)
        same = rest.join(colour.select(F.col("v").alias("src"), F.col("label").alias("c1")), "src").join(colour.select(F.col("v").alias("dst"), F.col("label").alias("c2")), "dst").filter("c1 = c2")
        back = cut(same.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        roots = colour.filter("v = label")
        reached = _spread(back, roots)
        part = reached.select("v", F.col("label").alias("component"))
        found = part if found is None else found.unionByName(part)
        gone = part.select("v")
        rest = cut(rest.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return every.withColumn("component", F.col("v"))
    return every.join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def cycle_components(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """cycle_id, v: the strongly connected components of more than one vertex."""
    parts = strong_components(edges) if components is None else components
    large = parts.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return parts.join(large, "component").select(F.col("component").alias("cycle_id"), "v")


def graph_stats(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """One row: vertices, edges, components, trivial and other ones, the largest size."""
    sizes = (strong_components(edges) if components is None else components).groupBy("component").agg(F.count("*").alias("n"))
    numbers = sizes.agg(F.sum("n").alias("n_vertices"), F.count("*").alias("n_components"), F.count_if(F.col("n") == 1).alias("n_trivial"), F.count_if(F.col("n") > 1).alias("n_nontrivial"), F.max("n").alias("largest"))
    return numbers.crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))


def line_digraph(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """a_src, a_dst, b_src, b_dst: edge a leads to edge b where a ends and b begins, within one strong component."""
    parts = strong_components(edges) if components is None else components
    rows = edges.select("src", "dst").join(parts.select(F.col("v").alias("src"), F.col("component").alias("c1")), "src").join(parts.select(F.col("v").alias("dst"), F.col("component").alias("c2")), "dst").filter("c1 = c2 AND src <> dst")
    a = rows.select(F.col("src").alias("a_src"), F.col("dst").alias("a_dst"))
    b = rows.select(F.col("src").alias("a_dst"), F.col("dst").alias("b_dst"), F.col("c1"))
    return a.join(b, "a_dst").select("a_src", "a_dst", F.col("a_dst").alias("b_src"), "b_dst")


def line_statistics(line: DataFrame) -> DataFrame:
    """One row: line vertices and edges, sources, sinks, mean number of successors, density."""
    a, b = F.struct(F.col("a_src").alias("s"), F.col("a_dst").alias("d")), F.struct(F.col("b_src").alias("s"), F.col("b_dst").alias("d"))
    ends = line.select(a.alias("e"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(line.select(b, F.lit(0), F.lit(1)))
    each = ends.groupBy("e").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    n = F.count("*")
    return each.agg(n.alias("n_vertices"), F.sum("o").alias("n_edges"), F.count_if(F.col("i") == 0).alias("sources"), F.count_if(F.col("o") == 0).alias("sinks"), F.avg("o").alias("mean_degree"), (F.sum("o") / F.when(n > 1, n * (n - 1))).alias("density"))


def line_pagerank(edges: DataFrame, components: DataFrame | None = None, iterations: int = 5) -> DataFrame:
    """src, dst, score of each edge within a strong component: PageRank over the line digraph, `iterations` rounds without damping.

    An edge hands its score, in equal shares, to the edges that leave its end. All of those get the same, so a round
    sums scores by vertex and needs no row for each pair of edges.
    """
    parts = strong_components(edges) if components is None else components
    tail, head = (parts.select(F.col("v").alias(c), F.col("component").alias(f"_{c}")) for c in ("src", "dst"))
    inner = cut(edges.filter("src <> dst").select("src", "dst").join(tail, "src").join(head, "dst").filter("_src = _dst").select("src", "dst"))
    out = inner.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out"))
    given = out.join(F.broadcast(inner.agg(F.count("*").alias("n")))).select("v", "out", (F.lit(1.0) / F.col("n")).alias("score"))  # of each edge that leaves v
    for _ in range(iterations):
        into = inner.join(given.select(F.col("v").alias("src"), "score"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum("score").alias("score"))
        given = out.join(into, "v").select("v", "out", (F.col("score") / F.col("out")).alias("score"))
    return inner.join(given.select(F.col("v").alias("src"), "score"), "src").select("src", "dst", "score")


def first_cut(edges: DataFrame, scores: DataFrame, components: DataFrame) -> DataFrame:
    """src, dst of the edge with the highest score in each strong component; ties: less weight, then names."""
    rows = edges.join(scores.withColumn("score", F.round("score", 9)), ["src", "dst"]).join(components.withColumnRenamed("v", "src"), "src")
    best = Window.partitionBy("component").orderBy(F.desc("score"), "weight", "src", "dst")
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").select("src", "dst", "component")


def pagerank_fas(edges: DataFrame, iterations: int = 5) -> DataFrame:
    """src, dst, round: edges whose removal leaves no cycle. Each round cuts one edge of each cyclic component.

    Self-loops are cut in round 0.
    """
    rest = cut(edges.filter("src <> dst").select("src", "dst", "weight"))
    gone = edges.filter("src = dst").select("src", "dst", F.lit(0).alias("round"))
    n = 0
    while has_cycle(rest):
        n += 1
        parts = cut(strong_components(rest))
        best = cut(first_cut(rest, line_pagerank(rest, parts, iterations), parts).select("src", "dst"))
        gone = gone.unionByName(best.select("src", "dst", F.lit(n).alias("round")))
        rest = cut(rest.join(best, ["src", "dst"], "left_anti"))
    return gone


def triangles(edges: DataFrame) -> DataFrame:
    """v, degree, triangles, clustering over the undirected graph; clustering 0 below degree two.

    Pairs of neighbours start from the smaller vertex of an edge only, so each triangle is made once.
    """
    e = undirected(edges)
    found = e.alias("x").join(e.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").join(e.select("u", F.col("v").alias("w")), ["u", "w"]).select("u", "v", "w")
    counts = found.select(F.explode(F.array("u", "v", "w")).alias("v")).groupBy("v").agg(F.count("*").alias("triangles"))
    degree = e.select(F.explode(F.array("u", "v")).alias("v")).groupBy("v").agg(F.count("*").alias("degree"))
    rows = degree.join(counts, "v", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    d = F.col("degree")
    return rows.withColumn("clustering", F.when(d < 2, 0.0).otherwise(2.0 * F.col("triangles") / F.when(d >= 2, d * (d - 1))))
