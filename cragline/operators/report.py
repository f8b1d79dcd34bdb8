"""Report rows: CSV, JSON, chart rows, graph text, HTML. Row text is made by expressions; files by Spark's writers."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.functions.names import stamp

#: type, title, level of the detectors, in report order.
SPECS = [
    ("god_class", "God Classes", "class"), ("data_class", "Data Classes", "class"), ("brain_method", "Brain Methods", "method"), ("brain_class", "Brain Classes", "class"),
    ("feature_envy", "Feature Envy", "method"), ("intensive_coupling", "Intensive Coupling", "method"), ("dispersed_coupling", "Dispersed Coupling", "method"),
    ("shotgun_surgery", "Shotgun Surgery", "method"), ("refused_bequest", "Refused Parent Bequest", "class"), ("tradition_breaker", "Tradition Breakers", "class"),
    ("significant_duplication", "Significant Duplication", "class"),
]
GRAPH_LIMIT = 4000


def specs(spark) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SPECS)], "pos int, type string, title string, level string")


def plain_number(value: Column) -> Column:
    """Integral values as whole numbers, others as they are."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def csv_rows(ranked: DataFrame) -> DataFrame:
    """priority, row of (class_fqn, path, effort_rank, change_proneness_rank, raw_priority, priority)."""
    return ranked.select("priority", F.concat_ws(",", "class_fqn", "priority", "raw_priority", "change_proneness_rank", "effort_rank", "path").alias("row"))


#: Headings of the class report, short and long.
CSV_HEADS = ("Ver", "Class", "Priority", "Change Proneness Rank", "Effort Rank", "Method Count", "Most Recent Commit Date", "Commit Count")
CSV_DETAIL_HEADS = (*CSV_HEADS[:5], "WMC", "WMC Rank", "ATFD", "ATFD Rank", "TCC", "TCC Rank", "Date of First Commit", *CSV_HEADS[6:], "Full Path")


def csv_report(ranked: DataFrame, version: str, detailed: bool = False) -> DataFrame:
    """pos, line: a heading at 0, then the classes by priority; each field ends with a comma, each row with eol.

    ranked: class_fqn, priority, change_proneness_rank, effort_rank, wmc, wmc_rank, atfd, atfd_rank, tcc, tcc_rank,
    earliest_commit, most_recent_commit (epoch seconds), commit_count, path. TCC has two decimals.
    """
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss")
    cents = F.floor(F.col("tcc") * 100 + 0.5)
    tcc = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    start = ["class_fqn", "priority", "change_proneness_rank", "effort_rank", "wmc"]
    if detailed:
        fields = [*start, "wmc_rank", "atfd", "atfd_rank", tcc, "tcc_rank", day("earliest_commit"), day("most_recent_commit"), "commit_count", "path"]
    else:
        fields = [*start, day("most_recent_commit"), "commit_count"]
    cells = [F.lit(version), *[F.col(x).cast("string") if isinstance(x, str) else x for x in fields]]
    heads = "".join(f"{h}," for h in (CSV_DETAIL_HEADS if detailed else CSV_HEADS))
    rows = ranked.select(F.col("priority").alias("pos"), F.concat(*[y for c in cells for y in (F.coalesce(c, F.lit("")), F.lit(","))], F.lit("eol")).alias("line"))
    return ranked.sparkSession.createDataFrame([(0, heads)], "pos long, line string").unionByName(rows)


def csv_name(project: str, version: str, at: Column) -> Column:
    """The file name of a report written at the time given."""
    return F.concat(F.lit(f"RefFirst_P{project}_PV{version}_PD"), stamp(at), F.lit(".csv"))


def dot_vertices(edges: DataFrame, removed_vertices: DataFrame) -> DataFrame:
    """v, line: a vertex of the graph text, red where it is to be removed."""
    rows = shown_vertices(edges).join(removed_vertices.select("v", F.lit(True).alias("red")), "v", "left")
    return rows.select("v", F.concat(F.col("v").cast("string"), F.when(F.col("red"), F.lit(' [color="red"]')).otherwise(""), F.lit(";")).alias("line"))


def json_report(ranked: DataFrame) -> DataFrame:
    """One row: the JSON document with all entries by priority. The report's "priority" is the raw priority."""
    entry = F.struct("priority", F.struct(F.col("class_fqn").alias("className"), F.col("path").alias("fullFilePath"), F.col("effort_rank").alias("effortRank"), F.col("change_proneness_rank").alias("changePronenessRank"), F.col("raw_priority").alias("priority")).alias("entry"))
    rows = ranked.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias("rankedDisharmonies"))
    return rows.select(F.to_json(F.struct("rankedDisharmonies", F.array().cast("array<string>").alias("errors"))).alias("json"))


def bubble_rows(ranked: DataFrame) -> DataFrame:
    """priority, row: name, effort, change, priority and the distance from the last priority, for a bubble chart."""
    last = ranked.agg(F.max("priority").alias("last"))
    rows = ranked.join(F.broadcast(last))
    return rows.select("priority", F.format_string("['%s',%d,%d,%d,%d]", "class_fqn", "effort_rank", "change_proneness_rank", "priority", F.col("last") - F.col("priority")).alias("row"))


def dot_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """src, dst, line: an edge of the graph text, red where it is to be removed."""
    rows = edges.join(removed.select("src", "dst", F.lit(True).alias("red")), ["src", "dst"], "left")
    line = F.concat(F.format_string('%s -> %s [ label = "%d" weight = "%d"', F.col("src").cast("string"), F.col("dst").cast("string"), "weight", "weight"), F.when(F.col("red"), ' color = "red"').otherwise(""), F.lit(" ];"))
    return rows.select("src", "dst", line.alias("line"))


def dot_text(edges: DataFrame, removed: DataFrame) -> str | None:
    """The whole graph as text, or None from GRAPH_LIMIT vertices and edges on."""
    from cragline.operators.graph import vertices

    if edges.count() + vertices(edges).count() >= GRAPH_LIMIT:
        return None
    lines = [r.line for r in dot_edges(edges, removed).orderBy("src", "dst").collect()]
    return "strict digraph G {\n" + "\n".join(lines) + "\n}\n"


def shown_vertices(edges: DataFrame) -> DataFrame:
    """v of the vertices to draw: anonymous classes ($ and digits at the end) without an outgoing edge are left out."""
    from cragline.operators.graph import degrees

    return degrees(edges).filter(~(F.col("v").rlike(r"\$[0-9]+$") & (F.col("out_degree") == 0))).select("v")


def html_table(rows: DataFrame, title: str) -> str:
    """A table of the rows, escaped; an empty string without rows. Rows come to the driver a partition at a time."""
    got = list(rows.toLocalIterator())
    if not got:
        return ""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "\n".join("<tr>" + "".join(f"<td>{html.escape('' if x is None else str(x))}</td>" for x in r) + "</tr>" for r in got)
    return f"<h2>{html.escape(title)}</h2>\n<table><thead><tr>{head}</tr></thead><tbody>\n{body}\n</tbody></table>\n"


def html_report(sections: list[tuple[str, DataFrame]], title: str) -> str:
    """Sections that have rows, or one line that there is nothing to report."""
    parts = [html_table(rows, name) for name, rows in sections]
    body = "".join(parts) or "<p>No disharmony found.</p>\n"
    return f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>\n<h1>{html.escape(title)}</h1>\n{body}</body></html>\n"


def write_text(text: str, path: str) -> None:
    """Write a report to a file, with its folders; an existing file is replaced."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def save(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a report table as csv (with a header), json or parquet."""
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)


def cycle_table(members: DataFrame, edges: DataFrame, removed_edges: DataFrame, removed_vertices: DataFrame) -> DataFrame:
    """cycle_id, v, edges: each class of a cycle with its edges inside it; * marks what is to be removed."""
    inside = edges.join(members.select("cycle_id", F.col("v").alias("src")), "src").join(members.select("cycle_id", F.col("v").alias("dst")), ["cycle_id", "dst"])
    inside = inside.join(removed_edges.select("src", "dst", F.lit("*").alias("mark")), ["src", "dst"], "left")
    text = F.concat(F.col("dst").cast("string"), F.lit(":"), F.col("weight").cast("string"), F.coalesce("mark", F.lit("")))
    lines = inside.groupBy("cycle_id", F.col("src").alias("v")).agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("edges"))
    rows = members.join(lines, ["cycle_id", "v"], "left").join(removed_vertices.select("v", F.lit("*").alias("gone")), "v", "left")
    return rows.select("cycle_id", F.concat(F.col("v").cast("string"), F.coalesce("gone", F.lit(""))).alias("v"), F.coalesce("edges", F.lit("")).alias("edges"))


def edge_table(ranked: DataFrame) -> DataFrame:
    """The columns of the edge section, by priority."""
    return ranked.select("priority", F.concat(F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string")).alias("edge"), "weight", "cycle_count", "package_cycle_count", "package_edge_removed", "source_removed", "target_removed")


def detail_columns(rows: DataFrame, key: list[str], detail: list[str], show: bool) -> DataFrame:
    """The key columns, and the detail columns where they are to be shown."""
    return rows.select(*key, *(detail if show else []))
