"""Ranks, priorities and normalised scores.

Rows are dealt by ranges of the order and numbered within a range; the sizes of the ranges, one row each, give what
comes before. So no task holds all rows, or all rows of a type. Dense ranks are the numbers of the distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.sources.scratch import cut


def dense_ranks(rows: DataFrame, by: list[str], value: str, descending: Column | None = None, name: str = "rank") -> DataFrame:
    """rows with the dense rank of value within `by`, ascending, or descending where the given column says so."""
    key = F.col(value) if descending is None else F.when(descending, -F.col(value)).otherwise(F.col(value))
    rows = rows.withColumn("_key", key)
    ranks = ordinal(rows.select(*by, "_key").distinct(), name, *by, "_key")
    if by:
        first = ranks.groupBy(*by).agg(F.min(name).alias("_first"))
        ranks = ranks.join(first, by).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    return rows.join(ranks, [*by, "_key"]).drop("_key")


def metric_ranks(metrics: DataFrame) -> DataFrame:
    """Long-form metrics with rank: dense within (type, idx), in the metric's direction."""
    return dense_ranks(metrics, ["type", "idx"], "value", F.col("direction") == "desc")


def overall_ranks(ranked: DataFrame) -> DataFrame:
    """type, instance, sum_of_ranks, overall_rank: the dense rank of the sum of an instance's metric ranks."""
    return dense_ranks(ranked.groupBy("type", "instance").agg(F.sum("rank").alias("sum_of_ranks")), ["type"], "sum_of_ranks", name="overall_rank")


def god_class_ranks(rows: DataFrame, legacy_tcc: bool = False) -> DataFrame:
    """rows(class_fqn, wmc, atfd, tcc) with wmc_rank, atfd_rank, tcc_rank, sum_of_ranks and overall_rank.

    TCC ranks descending; legacy_tcc gives every class rank 1 there.
    """
    rows = dense_ranks(dense_ranks(rows, [], "wmc", name="wmc_rank"), [], "atfd", name="atfd_rank")
    rows = rows.withColumn("tcc_rank", F.lit(1).cast("long")) if legacy_tcc else dense_ranks(rows, [], "tcc", F.lit(True), "tcc_rank")
    return dense_ranks(rows.withColumn("sum_of_ranks", F.col("wmc_rank") + F.col("atfd_rank") + F.col("tcc_rank")), [], "sum_of_ranks", name="overall_rank")


def ordinal(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with 1..n in the order given, which has to be total."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, (inside + F.col("_before")).cast("long")).drop("_range", "_before")


def ordinal_within(rows: DataFrame, name: str, by: list[str], *order: Column | str) -> DataFrame:
    """rows with 1..n in the order given within each `by`."""
    if not by:
        return ordinal(rows, name, *order)
    rows = ordinal(rows, name, *by, *order)
    first = rows.groupBy(*by).agg(F.min(name).alias("_first"))
    return rows.join(first, by).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def min_max(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with (value - min) / (max - min), 0 where all values are equal."""
    ends = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))  # one row
    span = F.col("_high") - F.col("_low")
    return rows.join(F.broadcast(ends)).withColumn(name, F.when(span == 0, 0.0).otherwise((F.col(value) - F.col("_low")) / F.when(span != 0, span))).drop("_low", "_high")


def priorities(rows: DataFrame, change_rank: str, effort_rank: str, *ties: str, by: list[str] | None = None) -> DataFrame:
    """rows with raw_priority (change rank less effort rank) and priority, 1 for the highest raw priority of each `by`."""
    return ordinal_within(rows.withColumn("raw_priority", F.col(change_rank) - F.col(effort_rank)), "priority", by or [], F.desc("raw_priority"), *ties)
