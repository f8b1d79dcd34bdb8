"""Size, complexity, cohesion and coupling metrics of methods and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.sources.scratch import cut

CLASS = ["class_key", "class_fqn"]
METHOD = [*CLASS, "method"]


def ratio(a, b, empty: float):
    """a / b as double, `empty` where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / F.when(b != 0, b).cast("double"))


def method_metrics(access: DataFrame) -> DataFrame:
    """One row for each method with at least one access.

    cyclo: 1 + branches; loc; nesting: greatest depth; noav: variables; atfd and own: foreign and own attributes;
    fdp: foreign providers; laa: own share of the attributes (1 without any); cint: foreign methods called;
    cdisp: providing regions over cint (0 without calls).
    """
    foreign = lambda *c: F.count_distinct(*[F.when(F.col("is_foreign"), F.col(x)) for x in c])
    rows = access.groupBy(*METHOD).agg(
        (F.count("*") + 1).alias("cyclo"), F.sum("loc").cast("long").alias("loc"), F.max("depth").cast("long").alias("nesting"), F.count_distinct("variable").alias("noav"),
        foreign("provider", "variable").alias("atfd"), F.count_distinct(F.when(~F.col("is_foreign"), F.col("provider")), F.when(~F.col("is_foreign"), F.col("variable"))).alias("own"),
        foreign("provider").alias("fdp"), foreign("region").alias("regions"), (F.count("*") <= 4).alias("is_accessor"), F.max("is_protected").alias("is_protected"), F.max("is_override").alias("is_override"),
    )
    rows = rows.withColumn("laa", ratio("own", F.col("own") + F.col("atfd"), 1.0)).withColumn("cint", F.col("atfd"))
    return rows.withColumn("cdisp", ratio("regions", "cint", 0.0))


def cohesion(access: DataFrame) -> DataFrame:
    """class_key, class_fqn, pairs, tcc: connected pairs of methods over all pairs; 0 for a single method.

    Two methods are connected when they share a variable. The pairs come from an equi-join on (class, variable),
    over the variables that at least two methods of the class use.
    """
    used = cut(access.select(*METHOD, "variable").distinct())
    several = used.groupBy("class_key", "variable").agg(F.count("*").alias("users")).filter("users > 1").select("class_key", "variable")
    shared = cut(used.select("class_key", "method", "variable").join(several, ["class_key", "variable"], "left_semi"))
    a, b = shared, shared.select("class_key", F.col("method").alias("other"), "variable")
    pairs = a.join(b, ["class_key", "variable"]).filter("method < other").select("class_key", "method", "other").distinct().groupBy("class_key").agg(F.count("*").alias("pairs"))
    sizes = used.groupBy(*CLASS).agg(F.count_distinct("method").alias("n"))
    rows = sizes.join(pairs, "class_key", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return rows.select(*CLASS, "pairs", ratio("pairs", F.col("n") * (F.col("n") - 1) / 2, 0.0).alias("tcc"))


def callers(access: DataFrame) -> DataFrame:
    """callee, cm, cc: distinct foreign methods that call a method, and their classes; calls within the class do not count."""
    return access.filter("is_call AND is_foreign").groupBy(F.col("variable").alias("callee")).agg(F.count_distinct("class_key", "method").alias("cm"), F.count_distinct("class_key").alias("cc"))


def used_parent_members(access: DataFrame) -> DataFrame:
    """class_key, used_parent: the parent's members that a class uses as well."""
    own = access.select("class_key", "parent_key", "variable").distinct()
    theirs = own.select(F.col("class_key").alias("parent_key"), "variable")
    return own.join(theirs, ["parent_key", "variable"]).groupBy("class_key").agg(F.count("*").alias("used_parent"))


def coupling(access: DataFrame) -> DataFrame:
    """class_key, class_fqn, cbo: distinct providers that a class is coupled to."""
    return access.groupBy(*CLASS).agg(F.count_distinct("provider").alias("cbo"))


def class_metrics(access: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """One row for each class: wmc, nom, loc, atfd, accessors, noa, nopa, woc, amw, tcc, protected, overridden, used_parent, brains.

    noa, nopa: the class's own attributes and the public ones among them; protected: methods and attributes.
    """
    from cragline.operators.detectors import METHOD_RULES

    methods = method_metrics(access) if methods is None else methods
    rows = methods.groupBy(*CLASS).agg(
        F.sum("cyclo").alias("wmc"), F.count("*").alias("nom"), F.sum("loc").alias("loc"), F.count_if("is_accessor").alias("accessors"), F.count_if("is_protected").alias("protected"),
        F.count_if("is_override").alias("overridden"), F.count_if(F.expr(METHOD_RULES["brain_method"].predicate)).alias("brains"),
    )
    own = access.filter("NOT is_foreign").groupBy("class_key", "variable").agg(F.max("is_public_attribute").alias("is_public"), F.max("is_protected_attribute").alias("is_protected"))
    own = own.groupBy("class_key").agg(F.count("*").alias("noa"), F.count_if("is_public").alias("nopa"), F.count_if("is_protected").alias("hidden"))
    foreign = access.groupBy("class_key").agg(F.count_distinct(F.when(F.col("is_foreign"), F.col("provider"))).alias("atfd"), F.max("package").alias("package"), F.max("parent_key").alias("parent_key"))
    rows = rows.join(foreign, "class_key").join(own, "class_key", "left").fillna(0, ["noa", "nopa", "hidden"]).join(cohesion(access).select("class_key", "tcc"), "class_key").join(used_parent_members(access), "class_key", "left")
    rows = rows.withColumn("protected", F.col("protected") + F.col("hidden")).withColumn("used_parent", F.coalesce("used_parent", F.lit(0))).withColumn("woc", ratio(F.col("nom") - F.col("accessors"), "nom", 0.0)).withColumn("amw", ratio("wmc", "nom", 0.0))
    return rows.select(*CLASS, "package", "parent_key", "wmc", "nom", "loc", "atfd", "accessors", "noa", "nopa", "woc", "amw", "tcc", "protected", "overridden", "used_parent", "brains")


def with_parents(metrics: DataFrame) -> DataFrame:
    """class_metrics with what the parent class brings: parent_* columns, null where the parent is not among the classes."""
    parents = metrics.select(F.col("class_key").alias("parent_key"), *[F.col(c).alias(f"parent_{c}") for c in ("nom", "wmc", "amw", "protected")])
    rows = metrics.join(parents, "parent_key", "left").withColumn("n_prot", F.coalesce("parent_protected", F.lit(0)))
    rows = rows.withColumn("bur", ratio("used_parent", "n_prot", 0.0)).withColumn("bovr", ratio("overridden", "nom", 0.0)).withColumn("nas", F.col("nom") - F.col("overridden"))
    return rows.withColumn("pnas", ratio("nas", "nom", 0.0))
