"""Queries over the tables of a folder, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.functions import names
from cragline.operators import churn, clone_blocks, clones, detectors, feedback, graph, metrics, priority, ranking, removal, report, scores
from cragline.sources import star

Query = Callable[[SparkSession, str], DataFrame]


def _access(spark: SparkSession, d: str) -> DataFrame:
    return star.accesses(spark, d)


def _methods(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return metrics.method_metrics(_access(spark, d)).select("class_fqn", "method", *columns)


def _detected(name: str, spark: SparkSession, d: str) -> DataFrame:
    access = _access(spark, d)
    level = detectors.RULES[name].level
    if level == "method":
        return detectors.detect(metrics.method_metrics(access), name)
    if level == "callee":
        return detectors.detect(metrics.callers(access), name)
    return detectors.detect(metrics.with_parents(metrics.class_metrics(access)), name)


def _high_cbo(spark: SparkSession, d: str) -> DataFrame:
    return detectors.high_coupling(metrics.coupling(_access(spark, d)))


def _god_long(spark: SparkSession, d: str) -> DataFrame:
    found = graph.cut(_detected("god_class", spark, d))  # read by each ranking step
    return ranking.metric_ranks(detectors.long_form(found, "god_class"))


def _located(instances: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """instances(class_fqn, effort_rank) with path: the class key modulo the number of users stands for its file."""
    users = star.read(spark, d, "events").agg((F.max("user_id") + 1).alias("users"))
    key = F.substring_index(F.substring_index("class_fqn", "::", 1), ".C", -1).try_cast("long")
    own = [c for c in instances.columns if c in ("type", "class_fqn")]
    return instances.join(F.broadcast(users)).select(*own, (key % F.col("users")).alias("path"), "effort_rank")


def _prioritized(instances: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    commits = star.commit_files(spark, d)
    instances = graph.cut(_located(instances, spark, d))
    return priority.prioritize(instances, churn.scm_log(commits), churn.commit_changes(commits))


def god_class_priority(spark: SparkSession, d: str) -> DataFrame:
    """God classes by the worth of mending them: change rank against effort rank."""
    overall = ranking.overall_ranks(_god_long(spark, d))
    return _prioritized(overall.select(F.col("instance").alias("class_fqn"), F.col("overall_rank").alias("effort_rank")), spark, d)


def cbo_priority(spark: SparkSession, d: str) -> DataFrame:
    """Highly coupled classes; the effort is the coupling itself."""
    return _prioritized(_high_cbo(spark, d).select("class_fqn", F.col("cbo").alias("effort_rank")), spark, d)


def _disharmonies(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of all that the detectors flag, in long form, by type."""
    access = graph.cut(_access(spark, d))
    methods = graph.cut(metrics.method_metrics(access))
    tables = {"method": methods, "callee": metrics.callers(access), "class": graph.cut(metrics.with_parents(metrics.class_metrics(access, methods)))}
    found = [detectors.long_form(detectors.detect(tables[rule.level], name), name) for name, rule in detectors.RULES.items()]
    return reduce(DataFrame.unionByName, found)


def _ranked_disharmonies(spark: SparkSession, d: str) -> DataFrame:
    """Every flagged class, method and callee, ranked and prioritised among those of its type."""
    overall = ranking.overall_ranks(ranking.metric_ranks(graph.cut(_disharmonies(spark, d))))
    instances = graph.cut(_located(overall.select("type", F.col("instance").alias("class_fqn"), F.col("overall_rank").alias("effort_rank")), spark, d))
    commits = star.commit_files(spark, d)
    return priority.prioritize(instances, churn.scm_log(commits), churn.commit_changes(commits), ["type"])


def _god_ranks(spark: SparkSession, d: str) -> DataFrame:
    return ranking.god_class_ranks(graph.cut(_detected("god_class", spark, d)))


def _csv(detailed: bool, spark: SparkSession, d: str) -> DataFrame:
    rows = god_class_priority(spark, d).join(_god_ranks(spark, d).drop("overall_rank"), "class_fqn").join(churn.scm_log(star.commit_files(spark, d)), "path")
    return report.csv_report(rows, "1.0", detailed)


def _acyclic_without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return graph.is_cyclic(edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")).select((~F.col("cyclic")).alias("acyclic"))


def _arc_set_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether each kind of feedback arc set leaves no cycle, and stays within half of the edges."""
    edges = graph.cut(_two(spark, d))
    sets = {"surplus": feedback.ordering_fas(edges), "greedy": feedback.min_fas(edges), "matrix": feedback.back_edges(edges)}
    half = edges.agg((F.count("*") / 2).alias("half"))
    rows = []
    for name, found in sets.items():
        found = graph.cut(found)
        size = found.agg(F.count("*").alias("n")).join(F.broadcast(half)).select(F.lit(name).alias("name"), (F.col("n") <= F.col("half")).alias("small"))
        rows.append(size.join(F.broadcast(_acyclic_without(edges, found))))
    return reduce(DataFrame.unionByName, rows)


def _vertex_set_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether each kind of feedback vertex set leaves no cycle, and its size on separate rings."""
    edges, rings = graph.cut(_two(spark, d)), graph.cut(_one(spark, d))
    rows = []
    for name in ("greedy", "scc", "score", "local"):
        size = feedback.fvs(rings, name).agg(F.count("*").alias("ring_vertices"))
        rows.append(feedback.is_feedback_set(edges, graph.cut(feedback.fvs(edges, name))).join(F.broadcast(size)).select(F.lit(name).alias("name"), "valid", "ring_vertices"))
    return reduce(DataFrame.unionByName, rows)


def _order_checks(spark: SparkSession, d: str) -> DataFrame:
    """Vertices and places of the matrix order, and whether no cycle is left without the edges above the diagonal."""
    edges = graph.cut(_two(spark, d))
    order = graph.cut(feedback.dsm_order(edges))
    counts = order.agg(F.count("*").alias("n_vertices"), F.count_distinct("pos").alias("n_places"), F.max("pos").alias("last"))
    return counts.join(F.broadcast(_acyclic_without(edges, graph.cut(feedback.back_edges(edges, order)))))


def _importance(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.cut(_two(spark, d))
    return scores.structural_importance(edges, feedback.betweenness(edges)).select("v", F.round("importance", 6).alias("importance"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    rows = star.classes(spark, d).select("class_fqn", F.concat("class_fqn", F.lit("$Inner")).alias("nested"))
    return rows.select("class_fqn", names.package_of(F.col("class_fqn")).alias("package"), names.simple_name(F.col("class_fqn")).alias("simple"), names.outer_of(F.col("nested")).alias("outer_class"))


def _line_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = star.bodies(spark, d)
    return rows.select("method", names.line_count(F.col("body")).cast("long").alias("loc"), F.size(names.normalised_lines(F.col("body"))).cast("long").alias("normalised"))


def _prone(spark: SparkSession, d: str) -> DataFrame:
    commits = star.commit_files(spark, d)
    return churn.change_proneness(churn.scm_log(commits), churn.commit_changes(commits))


def _class_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.class_edges(star.type_refs(spark, d))


def _two(spark: SparkSession, d: str) -> DataFrame:
    return star.handoffs(spark, d, 2)


def _one(spark: SparkSession, d: str) -> DataFrame:
    return star.handoffs(spark, d, 1)


def _in_codebase(spark: SparkSession, d: str) -> DataFrame:
    kept = spark.createDataFrame([("ASIA",), ("EUROPE",)], "package string")
    return graph.keep_in_codebase(_class_edges(spark, d), kept)


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = graph.cut(_two(spark, d))
    parts = graph.cut(graph.strong_components(edges))
    return edges, parts, graph.line_pagerank(edges, parts)


def _line_pagerank5(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[2].select("src", "dst", F.round("score", 9).alias("score"))


def _first_cut(spark: SparkSession, d: str) -> DataFrame:
    edges, parts, scores = _scored(spark, d)
    return graph.first_cut(edges, scores, parts)


def _dot_edges(spark: SparkSession, d: str) -> DataFrame:
    edges, parts, scores = _scored(spark, d)
    return report.dot_edges(edges, graph.first_cut(edges, scores, parts))


def _edge_cycle_counts(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.cut(_two(spark, d))
    return priority.edge_cycle_counts(edges, graph.cycle_components(edges))


def _edge_priority(spark: SparkSession, d: str) -> DataFrame:
    """Class edges by removal priority; the lightest package edges and the three heaviest vertices count as removed."""
    edges = graph.cut(_class_edges(spark, d))
    packages = graph.cut(graph.package_edges(edges))
    counted = priority.edge_cycle_counts(edges, graph.cycle_components(edges))
    package_counts = priority.edge_cycle_counts(packages, graph.cycle_components(packages))
    removed = packages.join(F.broadcast(packages.agg(F.min("weight").alias("least"))), F.col("weight") == F.col("least"))
    ends = edges.select(F.col("src").alias("v"), "weight").unionAll(edges.select("dst", "weight"))
    heavy = ends.groupBy("v").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "v").limit(3)
    return priority.edge_priority(counted, package_counts, removed, heavy)


def _ranked_cycles(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.cut(_two(spark, d))
    return priority.rank_cycles(graph.cycle_components(edges), edges)


def _simple_cycles(spark: SparkSession, d: str) -> DataFrame:
    return feedback.simple_cycles(_one(spark, d)).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


def _duplication(spark: SparkSession, d: str) -> DataFrame:
    return clones.significant_duplication(star.bodies(spark, d)).select("class_fqn", "sec", "sdc", "n_partners")


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return clones.eligible_methods(star.bodies(spark, d))


QUERIES: dict[str, Query] = {
    "god_class_priority": god_class_priority,
    "cbo_priority": cbo_priority,
    "method_metrics": lambda s, d: _methods(s, d, "cyclo", "loc", "nesting", "noav", "atfd", "own", "fdp", "laa", "cint", "cdisp"),
    "class_metrics": lambda s, d: metrics.class_metrics(_access(s, d)).drop("class_key"),
    "tcc": lambda s, d: metrics.cohesion(_access(s, d)).drop("class_key"),
    "laa": lambda s, d: _methods(s, d, "laa"),
    "cint_cdisp": lambda s, d: _methods(s, d, "cint", "cdisp"),
    "cm_cc": lambda s, d: metrics.callers(_access(s, d)),
    "high_cbo": lambda s, d: _high_cbo(s, d).drop("class_key"),
    **{name: partial(_detected, name) for name in detectors.RULES},
    "metric_dense_ranks": _god_long,
    "overall_rank": lambda s, d: ranking.overall_ranks(_god_long(s, d)),
    "scm_log": lambda s, d: churn.scm_log(star.commit_files(s, d)),
    "commit_changes": lambda s, d: churn.commit_changes(star.commit_files(s, d)),
    "suffix_sums": lambda s, d: churn.suffix_sums(churn.commit_changes(star.commit_files(s, d))),
    "change_proneness": _prone,
    "change_rank": lambda s, d: churn.change_ranks(_prone(s, d), "path").select("path", "change_proneness_rank"),
    "bubble_rows": lambda s, d: report.bubble_rows(god_class_priority(s, d)),
    "disharmonies": _disharmonies,
    "ranked_disharmonies": _ranked_disharmonies,
    "god_class_ranks": _god_ranks,
    "long_methods": lambda s, d: detectors.long_method(_methods(s, d, "loc", "cyclo")),
    "complex_methods": lambda s, d: detectors.complex_method(_methods(s, d, "loc", "cyclo")),
    "csv_report": partial(_csv, False),
    "csv_report_detailed": partial(_csv, True),
    "json_report": lambda s, d: report.json_report(god_class_priority(s, d)),
    "class_names": _names,
    "line_counts": _line_counts,
    "csv_rows": lambda s, d: report.csv_rows(god_class_priority(s, d)),
    "clone_runs": lambda s, d: clone_blocks.all_runs(_eligible(s, d)),
    "clone_chains": lambda s, d: clone_blocks.all_chains(_eligible(s, d)),
    "significant_duplication": _duplication,
    "class_edges": _class_edges,
    "package_edges": lambda s, d: graph.package_edges(_class_edges(s, d)),
    "package_edge_members": lambda s, d: graph.package_edge_members(_class_edges(s, d)),
    "in_codebase_filter": _in_codebase,
    "undirected_edges": lambda s, d: graph.undirected(_two(s, d)),
    "degrees": lambda s, d: graph.degrees(_two(s, d)),
    "triangles": lambda s, d: graph.triangles(_two(s, d)),
    "clustering": lambda s, d: graph.triangles(_two(s, d)).select("v", "clustering"),
    "vertex_removal_score": lambda s, d: scores.vertex_removal_score(graph.cut(_two(s, d))),
    "scc": lambda s, d: graph.strong_components(graph.cut(_two(s, d))),
    "cycle_components": lambda s, d: graph.cycle_components(graph.cut(_two(s, d))),
    "ranked_cycles": _ranked_cycles,
    "is_cyclic": lambda s, d: graph.is_cyclic(_two(s, d)),
    "connected_components": lambda s, d: graph.connected_components(_one(s, d)),
    "graph_stats": lambda s, d: graph.graph_stats(graph.cut(_two(s, d))),
    "line_digraph": lambda s, d: graph.line_digraph(graph.cut(_two(s, d))),
    "line_pagerank5": _line_pagerank5,
    "pagerank_fas_first_cut": _first_cut,
    "edge_cycle_counts": _edge_cycle_counts,
    "edge_priority": _edge_priority,
    "dot_edges": _dot_edges,
    "simple_cycles": _simple_cycles,
    "optimal_back_edges": lambda s, d: feedback.optimal_back_edges(graph.cut(_one(s, d))),
    "edge_info": lambda s, d: removal.edge_info(removal.cycle_removal(_one(s, d))),
    "pagerank_fas": lambda s, d: graph.pagerank_fas(_one(s, d)),
    "dsm_order": lambda s, d: feedback.dsm_order(_two(s, d)),
    "back_edges": lambda s, d: feedback.back_edges(graph.cut(_two(s, d))),
    "min_weight_back_edges": lambda s, d: feedback.min_back_edges(graph.cut(feedback.back_edges(graph.cut(_two(s, d))))),
    "edge_whatif": lambda s, d: ranking.ordinal(feedback.edge_whatif(graph.cut(_one(s, d))), "rank", F.col("old_cycles") - F.col("new_cycles"), "src", "dst"),
    "sparse_whatif": lambda s, d: ranking.ordinal(feedback.sparse_whatif(graph.cut(_one(s, d))), "rank", "payoff", "weight", "src", "dst"),
    "arc_set_checks": _arc_set_checks,
    "vertex_set_checks": _vertex_set_checks,
    "order_checks": _order_checks,
    "dsm_matrix": lambda s, d: feedback.dsm_matrix(graph.cut(_one(s, d)), graph.cut(feedback.dsm_order(_one(s, d)))),
    "line_statistics": lambda s, d: graph.line_statistics(graph.line_digraph(graph.cut(_two(s, d)))),
    "structural_importance": _importance,
    "dot_vertices": lambda s, d: report.dot_vertices(_one(s, d), feedback.fvs(graph.cut(_one(s, d)))),
    "vertex_cycles": lambda s, d: feedback.vertex_cycles(_one(s, d)),
    "gr_fas": lambda s, d: feedback.ordering_fas(graph.cut(_two(s, d))),
    "min_fas_greedy": lambda s, d: feedback.min_fas(graph.cut(_two(s, d))),
    "min_fas_exact": lambda s, d: feedback.min_fas(graph.cut(_one(s, d)), "exact"),
    "greedy_fvs": lambda s, d: feedback.fvs(graph.cut(_two(s, d))),
    "approx_fvs": lambda s, d: feedback.approx_fvs(graph.cut(_two(s, d))),
    "fvs_k": lambda s, d: feedback.fvs_size(_one(s, d)),
    "eta": lambda s, d: feedback.treewidth_bound(_one(s, d)),
    "modulator": lambda s, d: feedback.modulator(star.handoffs(s, d)),
    "fvs_parameters": lambda s, d: feedback.fvs_parameters(_one(s, d)),
    "fvs_options": lambda s, d: feedback.fvs_options(_one(s, d)),
    "kernel_dfvs": lambda s, d: feedback.kernel_dfvs(_one(s, d)),
    "betweenness": lambda s, d: feedback.betweenness(graph.cut(_two(s, d))).select("v", F.round("betweenness", 6).alias("betweenness")),
    "articulation_points": lambda s, d: feedback.articulation_points(graph.cut(_one(s, d))),
}
