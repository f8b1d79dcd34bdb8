"""Exact clones: maximal diagonal runs of equal lines, chains of runs, significant duplication.

Equal lines meet by an equi-join on the line. A diagonal's consecutive positions form an island; chains compare
neighbouring runs only, so lag finds where one ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.functions.names import line_count, normalised_lines

FEW = 5
LEAST_SDC = 2 * (FEW + 1) + 1


def eligible_methods(bodies: DataFrame, least: int = FEW) -> DataFrame:
    """bodies(class_fqn, method, body[, is_constructor, is_accessor]) -> class_fqn, method, loc, lines of the methods of
    `least` normalised lines or more that are neither constructors nor accessors. loc counts the body's lines as written."""
    for flag in ("is_constructor", "is_accessor"):
        if flag in bodies.columns:
            bodies = bodies.filter(~F.coalesce(F.col(flag), F.lit(False)))
    rows = bodies.filter("body IS NOT NULL").select("class_fqn", "method", line_count(F.col("body")).alias("loc"), normalised_lines(F.col("body")).alias("lines"))
    return rows.filter(F.size("lines") >= least)


def lines_of(methods: DataFrame) -> DataFrame:
    """class_fqn, method, pos, line of eligible methods."""
    return methods.select("class_fqn", "method", F.posexplode("lines").alias("pos", "line"))


def eligible_lines(bodies: DataFrame, least: int = FEW) -> DataFrame:
    return lines_of(eligible_methods(bodies, least))


def average_loc(methods: DataFrame) -> DataFrame:
    """One row with the mean number of lines, as written, of the eligible methods."""
    return methods.agg(F.avg("loc").alias("average"))


def seeded_pairs(methods: DataFrame, size: int = FEW + 1) -> DataFrame:
    """a, b: the pairs of methods, a < b, that share `size` lines in a row. Such rows of lines meet by their hash."""
    starts = F.sequence(F.lit(1), F.size("lines") - size + 1)
    rows = methods.filter(F.size("lines") >= size).select("method", F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("lines", i, size))))).alias("h"))
    return rows.withColumnRenamed("method", "a").join(rows.withColumnRenamed("method", "b"), "h").filter("a < b").select("a", "b").distinct()


def clone_runs(lines: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """lines(method, pos, line) -> a, b, start_a, start_b, size: the maximal runs of each pair of methods, a < b.

    With pairs(a, b), of those pairs alone: lines are then joined by pair, not all lines that are equal. With a column
    again in lines, of the pairs alone of which it is true for one method at least.
    """
    again = F.col("again") if "again" in lines.columns else F.lit(True)
    key = F.xxhash64("line")
    left = lines.select(F.col("method").alias("a"), F.col("pos").alias("x"), "line", key.alias("h"), again.alias("wanted"))
    right = lines.select(F.col("method").alias("b"), F.col("pos").alias("y"), F.col("line").alias("other"), key.alias("h"), again.alias("wanted_b"))
    both = left.join(right, "h") if pairs is None else pairs.join(left, "a").join(right, ["b", "h"])
    hits = both.filter("a < b AND line = other AND (wanted OR wanted_b)").select("a", "b", "x", "y")
    diagonal = Window.partitionBy("a", "b", F.col("x") - F.col("y")).orderBy("x")
    islands = hits.withColumn("island", F.col("x") - F.row_number().over(diagonal))
    return islands.groupBy("a", "b", (F.col("x") - F.col("y")).alias("d"), "island").agg(F.min("x").cast("long").alias("start_a"), F.min("y").cast("long").alias("start_b"), F.count("*").alias("size")).drop("d", "island")


def clone_chains(runs: DataFrame, few: int = FEW) -> DataFrame:
    """a, b, chain, clones, sdc, least_size, most_size, most_gap of each chain of two runs or more."""
    order = Window.partitionBy("a", "b").orderBy("start_a", "start_b")
    end = lambda c: F.col(f"start_{c}") - F.lag(F.col(f"start_{c}") + F.col("size")).over(order)
    rows = runs.withColumn("gap_a", end("a")).withColumn("gap_b", end("b")).withColumn("gap", F.least("gap_a", "gap_b"))
    joins = (F.col("gap_a") >= 0) & (F.col("gap_b") >= 0) & (F.col("gap") <= few)
    rows = rows.withColumn("joined", F.coalesce(joins, F.lit(False))).withColumn("chain", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order))
    gap = F.when(F.col("joined"), F.col("gap")).otherwise(0)
    chains = rows.groupBy("a", "b", "chain").agg(F.count("*").alias("clones"), (F.sum("size") + F.sum(gap)).alias("sdc"), F.min("size").alias("least_size"), F.max("size").alias("most_size"), F.max(gap).alias("most_gap"))
    return chains.filter("clones > 1")


def significant_pairs(methods: DataFrame, few: int = FEW) -> DataFrame:
    """a, b, sec, sdc of each pair of methods with a run above the average length, or with a significant chain.

    Both need a run of more than `few` lines (eligible methods have `few` at least, so their average too), so only pairs that share
    so many lines in a row are compared: a line that many methods have makes no pairs.
    """
    runs = clone_runs(lines_of(methods), seeded_pairs(methods, few + 1))
    single = runs.join(F.broadcast(average_loc(methods))).filter("size > average").groupBy("a", "b").agg(F.max("size").alias("sec")).withColumn("sdc", F.lit(0).cast("long"))
    chains = clone_chains(runs, few).filter((F.col("sdc") >= 2 * (few + 1) + 1) & (F.col("least_size") > few) & (F.col("most_gap") <= few))
    chained = chains.groupBy("a", "b").agg(F.max("most_size").alias("sec"), F.max("sdc").alias("sdc"))
    return single.unionByName(chained).groupBy("a", "b").agg(F.max("sec").alias("sec"), F.max("sdc").alias("sdc"))


def significant_duplication(bodies: DataFrame, few: int = FEW) -> DataFrame:
    """class_fqn, sec, sdc, n_partners, partners of each class with a significantly duplicated method."""
    methods = eligible_methods(bodies, few)
    owner = methods.select("class_fqn", "method").distinct()
    pairs = significant_pairs(methods, few).join(owner.select(F.col("class_fqn").alias("class_a"), F.col("method").alias("a")), "a").join(owner.select(F.col("class_fqn").alias("class_b"), F.col("method").alias("b")), "b")
    simple = lambda c: F.substring_index(c, ".", -1)
    one = pairs.select(F.col("class_a").alias("class_fqn"), "sec", "sdc", F.concat(F.col("a"), F.lit(" ↔ "), simple("class_b"), F.lit("."), F.col("b")).alias("partner"))
    two = pairs.filter("class_a <> class_b").select(F.col("class_b").alias("class_fqn"), "sec", "sdc", F.concat(F.col("b"), F.lit(" ↔ "), simple("class_a"), F.lit("."), F.col("a")).alias("partner"))
    partners = F.array_sort(F.collect_set("partner"))
    return one.unionByName(two).groupBy("class_fqn").agg(F.max("sec").alias("sec"), F.max("sdc").alias("sdc"), F.count_distinct("partner").alias("n_partners"), F.array_join(partners, "; ").alias("partners"))
