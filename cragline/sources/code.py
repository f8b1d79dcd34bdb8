"""Sources: source trees, change logs, fact tables, and reference facts from nested types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    exclude_tests: bool = True
    test_directory: str = "src/test"


def source_tree(spark: SparkSession, folder: str, config: Config = Config(), suffix: str = ".java") -> DataFrame:
    """path, text of the files below folder with the suffix; paths that hold the test directory are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    if config.exclude_tests:
        rows = rows.filter(~F.contains("path", F.lit(config.test_directory)))
    return rows.select("path", F.decode("content", "UTF-8").alias("text"))


def change_log(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """commit_pos, ts, path of an exported log: one row for each file of each commit, newest commit 0."""
    return spark.read.schema("commit_pos long, ts long, path string").format(kind).load(path)


def counted(commits: DataFrame, suffix: str = ".java") -> DataFrame:
    """commits with counts, whether the file's old or new path ends with the suffix."""
    old = F.col("old_path") if "old_path" in commits.columns else F.lit(None).cast("string")
    return commits.withColumn("counts", F.coalesce(F.endswith("path", F.lit(suffix)), F.lit(False)) | F.coalesce(F.endswith(old, F.lit(suffix)), F.lit(False)))


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Fact tables as views, for spark.sql."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def flat_refs(refs: DataFrame) -> DataFrame:
    """refs(owner_fqn, ref_kind, targets) -> owner_fqn, target_fqn: each type of a reference once, Javadoc apart.

    targets holds the flattened names of one reference: the type, its arguments, bounds, element types and
    annotations.
    """
    rows = refs.filter("ref_kind IS NULL OR ref_kind <> 'javadoc'").select("owner_fqn", F.explode(F.array_distinct("targets")).alias("target_fqn"))
    return rows.filter("owner_fqn IS NOT NULL AND target_fqn IS NOT NULL")


IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"


def simple_facts(sources: DataFrame) -> DataFrame:
    """path, package, class_fqn, parent, imports of each source file, by regular expressions.

    An outline for files without a fact export: the first type declaration, its superclass as written, imports.
    Files without a package are left out.
    """
    package = F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    name = F.regexp_extract("text", r"(?m)\b(?:class|interface|enum|record)\s+(\w+)", 1)
    parent = F.regexp_extract("text", r"\bclass\s+\w+(?:<[^{]*?>)?\s+extends\s+([\w.]+)", 1)
    rows = sources.select("path", package.alias("package"), name.alias("name"), F.nullif(parent, F.lit("")).alias("parent"), F.regexp_extract_all("text", F.lit(IMPORT), F.lit(1)).alias("imports"))
    return rows.filter("package <> '' AND name <> ''").select("path", "package", F.concat_ws(".", "package", "name").alias("class_fqn"), "parent", "imports")


def violations(rows: DataFrame, rule: str) -> DataFrame:
    """Rows of an imported rule report whose rule name contains `rule`; n: the first number of the message."""
    return rows.filter(F.contains("rule", F.lit(rule))).withColumn("n", F.regexp_extract("message", r"(\d+)", 1).try_cast("int"))
