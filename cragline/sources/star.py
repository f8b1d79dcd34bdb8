"""Facts about a code base, projected from the star-schema tables.

Customers stand for classes (their nation for the package), orders for methods, line items for accesses to a
variable of a provider (supplier), events for entries of a change log, documents for method bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragline.functions.names import is_accessor


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region; a fixed list of countries, so it is broadcast."""
    return F.broadcast(read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_key, class_fqn, package, parent_key, nation. parent_key: class_key div 10, null for a class of its own."""
    rows = read(spark, sf_dir, "customer").join(_nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    parent = F.expr("c_custkey div 10")
    return rows.select(
        F.col("c_custkey").alias("class_key"), F.concat("n_name", F.lit(".C"), "c_custkey").alias("class_fqn"), F.col("n_name").alias("package"),
        F.when(parent != F.col("c_custkey"), parent).alias("parent_key"), F.col("c_nationkey").alias("nation"),
    )


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: the accessing class and method, the variable, its provider, and the line's facts."""
    suppliers = read(spark, sf_dir, "supplier").join(_nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(classes(spark, sf_dir), F.col("o_custkey") == F.col("class_key")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        "class_key", "class_fqn", "package", "parent_key", F.col("o_orderkey").alias("method"), F.col("l_partkey").alias("variable"), F.col("l_suppkey").alias("provider"),
        F.col("n_regionkey").alias("region"), (F.col("s_nationkey") != F.col("nation")).alias("is_foreign"), F.col("l_quantity").alias("loc"), F.col("l_linenumber").alias("depth"),
        (F.col("l_returnflag") == "R").alias("is_call"), (F.col("o_orderpriority") == "1-URGENT").alias("is_protected"), (F.col("o_orderstatus") == "O").alias("is_override"),
        (F.col("l_partkey") % 4 == 0).alias("is_public_attribute"), (F.col("l_partkey") % 4 == 1).alias("is_protected_attribute"),
    )


def type_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner_fqn, target_fqn: for each line item, the supplier's nation refers to the customer's; packages are regions."""
    nations = _nations(spark, sf_dir).select("n_nationkey", F.concat("r_name", F.lit("."), "n_name").alias("fqn"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))  # counted before the names are joined
    rows = rows.join(F.broadcast(nations.withColumnsRenamed({"fqn": "owner_fqn", "n_nationkey": "a"})), F.col("s_nationkey") == F.col("a")).join(F.broadcast(nations.withColumnsRenamed({"fqn": "target_fqn", "n_nationkey": "b"})), F.col("c_nationkey") == F.col("b"))
    return rows.select("owner_fqn", "target_fqn", F.col("n").alias("refs"))


def handoffs(spark: SparkSession, sf_dir: str, successors: int | None = None) -> DataFrame:
    """src, dst, weight: who acts after whom on the same day; with `successors`, of each src that many of the most frequent ones."""
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst")).filter("dst IS NOT NULL AND src <> dst")
    edges = rows.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    if successors is None:
        return edges
    best = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= successors).select("src", "dst", "weight")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_pos, ts, path, counts: three consecutive events are a commit, its time that of the first one.

    commit_pos 0 is the newest commit, as in log order; counts tells whether the file is of the counted kind.
    """
    rows = read(spark, sf_dir, "events").select(F.expr("event_id div 3").alias("commit"), (F.unix_date(F.to_date("ts")).cast("long") * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("at"), F.col("user_id").alias("path"), F.col("event_type").isin("click", "purchase").alias("counts"))
    times = rows.groupBy("commit").agg(F.min("at").alias("ts"))
    newest = times.agg(F.max("commit").alias("newest"))
    return rows.select("commit", "path", "counts").join(times, "commit").join(F.broadcast(newest)).select((F.col("newest") - F.col("commit")).alias("commit_pos"), "ts", "path", "counts")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_fqn, method, body, is_constructor, is_accessor: documents as method bodies of the class named by their source.

    Every 17th document counts as a constructor; the first word of a document stands for the method's name.
    """
    text, first = F.col("text"), F.lower(F.substring_index(F.ltrim("text"), " ", 1))
    accessor = is_accessor(first, text.isNotNull(), F.size(F.split(F.trim("text"), "\n")))
    return read(spark, sf_dir, "documents").select(F.col("source").alias("class_fqn"), F.col("doc_id").alias("method"), text.alias("body"), (F.col("doc_id") % 17 == 0).alias("is_constructor"), accessor.alias("is_accessor"))
