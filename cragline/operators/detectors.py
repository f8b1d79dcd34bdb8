"""Design problems as threshold predicates over metrics.

A detector is a row of a table: its predicate is an SQL expression over the metric columns, its metrics carry
the direction in which they are ranked. Adding one means adding a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of the detection strategies.
FEW, MANY, SHALLOW = 5, 7, 1
QUARTER, THIRD, HALF, TWO_THIRDS = "0.25e0", "0.33e0", "0.5e0", "0.67e0"
WMC_AVERAGE, WMC_HIGH, WMC_VERY_HIGH = 14, 31, 47
NOM_AVERAGE, NOM_HIGH, AMW_AVERAGE = 7, 12, "2.0e0"
CLASS_LOC, METHOD_LOC, CYCLO, NESTING = 195, 65, 4, 5
CBO_LIMIT = 20


@dataclass(frozen=True)
class Rule:
    predicate: str
    metrics: tuple[tuple[str, str, str], ...]  # name, column, direction of the rank
    level: str = "class"


GOD = f"atfd > {FEW} AND wmc >= {WMC_VERY_HIGH} AND tcc < {THIRD}"

METHOD_RULES = {
    "brain_method": Rule(f"loc > {METHOD_LOC} AND cyclo >= {CYCLO} AND nesting >= {NESTING} AND noav > {MANY}", (("LOC", "loc", "asc"), ("CYCLO", "cyclo", "asc"), ("MAXNESTING", "nesting", "asc"), ("NOAV", "noav", "asc")), "method"),
    "feature_envy": Rule(f"atfd > {FEW} AND laa < {THIRD} AND fdp <= {FEW}", (("ATFD", "atfd", "asc"), ("LAA", "laa", "desc"), ("FDP", "fdp", "desc")), "method"),
    "intensive_coupling": Rule(f"((cint > {MANY} AND cdisp < {HALF}) OR (cint > {FEW} AND cdisp < {QUARTER})) AND nesting > {SHALLOW}", (("CINT", "cint", "asc"), ("CDISP", "cdisp", "desc"), ("MAXNESTING", "nesting", "asc")), "method"),
    "dispersed_coupling": Rule(f"cint > {MANY} AND cdisp >= {HALF} AND nesting > {SHALLOW}", (("CINT", "cint", "asc"), ("CDISP", "cdisp", "asc"), ("MAXNESTING", "nesting", "asc")), "method"),
}

CALLEE_RULES = {"shotgun_surgery": Rule(f"cm > {MANY} AND cc > {MANY}", (("CM", "cm", "asc"), ("CC", "cc", "asc")), "callee")}

CLASS_RULES = {
    "god_class": Rule(GOD, (("ATFD", "atfd", "asc"), ("WMC", "wmc", "asc"), ("TCC", "tcc", "desc"))),
    "data_class": Rule(f"woc < {THIRD} AND ((nopa + accessors > {FEW} AND wmc < {WMC_HIGH}) OR (nopa + accessors > {MANY} AND wmc < {WMC_VERY_HIGH}))", (("WOC", "woc", "desc"), ("PublicAttrsAndAccessors", "open_members", "asc"), ("WMC", "wmc", "desc"))),
    "brain_class": Rule(f"NOT ({GOD}) AND wmc >= {WMC_VERY_HIGH} AND tcc < {HALF} AND ((brains > 1 AND loc >= {CLASS_LOC}) OR (brains = 1 AND loc >= {2 * CLASS_LOC} AND wmc >= {2 * WMC_VERY_HIGH}))", (("BrainMethods", "brains", "asc"), ("LOC", "loc", "asc"), ("WMC", "wmc", "asc"), ("TCC", "tcc", "desc"))),
    "refused_bequest": Rule(f"parent_key IS NOT NULL AND (bovr < {THIRD} OR (n_prot > {FEW} AND bur < {THIRD})) AND nom > {NOM_AVERAGE} AND (amw > {AMW_AVERAGE} OR wmc > {WMC_AVERAGE})", (("NProtM", "n_prot", "asc"), ("BUR", "bur", "desc"), ("BOvR", "bovr", "desc"), ("NOM", "nom", "asc"), ("AMW", "amw", "asc"), ("WMC", "wmc", "asc"))),
    "tradition_breaker": Rule(f"parent_amw > {AMW_AVERAGE} AND parent_nom > {NOM_HIGH // 2} AND parent_wmc >= {WMC_VERY_HIGH // 2} AND nom >= {NOM_HIGH} AND (amw > {AMW_AVERAGE} OR wmc >= {WMC_VERY_HIGH}) AND nas >= {NOM_AVERAGE} AND pnas >= {TWO_THIRDS}", (("NAS", "nas", "asc"), ("PNAS", "pnas", "asc"), ("NOM", "nom", "asc"), ("AMW", "amw", "asc"), ("WMC", "wmc", "asc"), ("Overridden", "overridden", "asc"))),
}

LONG_METHOD, COMPLEX_METHOD = f"loc > {METHOD_LOC}", f"cyclo >= {CYCLO}"
RULES = METHOD_RULES | CALLEE_RULES | CLASS_RULES
KEYS = {"class": ["class_fqn"], "method": ["class_fqn", "method"], "callee": ["callee"]}


def detect(metrics: DataFrame, name: str) -> DataFrame:
    """The rows of metrics that the detector flags: its key columns and its metrics under their column names."""
    rule = RULES[name]
    if name == "data_class":
        metrics = metrics.withColumn("open_members", F.col("nopa") + F.col("accessors"))
    return metrics.filter(F.expr(rule.predicate)).select(*KEYS[rule.level], *[c for _, c, _ in rule.metrics])


def long_form(found: DataFrame, name: str) -> DataFrame:
    """type, instance, idx, name, value, direction: one row for each metric of each flagged row."""
    rule = RULES[name]
    instance = F.concat_ws("::", *[F.col(k).cast("string") for k in KEYS[rule.level]])
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), F.lit(d).alias("direction")) for n, c, d in rule.metrics])
    return found.select(F.lit(name).alias("type"), instance.alias("instance"), F.posexplode(cells).alias("idx", "m")).select("type", "instance", "idx", "m.name", "m.value", "m.direction")


def describe(found: DataFrame, name: str) -> DataFrame:
    """found with description, such as "God Class detected: ATFD=6, WMC=50, TCC=0.10"; ratios show two decimals."""
    rule = RULES[name]
    parts = [F.format_string(f"{n}=%.2f" if found.schema[c].dataType.simpleString() == "double" else f"{n}=%d", F.col(c)) for n, c, _ in rule.metrics]
    title = name.replace("_", " ").title()
    return found.withColumn("description", F.concat(F.lit(f"{title} detected: "), F.concat_ws(", ", *parts)))


def parse_description(rows: DataFrame) -> DataFrame:
    """atfd, wmc, tcc read back from god-class descriptions; tcc has the two decimals that the text shows."""
    pattern = r"ATFD=(\d+), WMC=(\d+), TCC=([\d.]+)"
    return rows.withColumns({n: F.regexp_extract("description", pattern, i).cast(t) for i, (n, t) in enumerate((("atfd", "int"), ("wmc", "int"), ("tcc", "float")), 1)})


def long_method(rows: DataFrame) -> DataFrame:
    """Methods of more lines than a method should have."""
    return rows.filter(F.expr(LONG_METHOD))


def complex_method(rows: DataFrame) -> DataFrame:
    """Methods whose cyclomatic complexity is high."""
    return rows.filter(F.expr(COMPLEX_METHOD))


def high_coupling(cbo: DataFrame, limit: int = CBO_LIMIT) -> DataFrame:
    """Classes coupled to more than limit others."""
    return cbo.filter(F.col("cbo") > limit)
