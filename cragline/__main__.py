"""Run a query over a folder of tables: python -m cragline NAME FOLDER [--out PATH] [--format table|csv|json|parquet|html] [--rows N]."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cragline", description=__doc__)
    parser.add_argument("name", help="a query, or 'list'")
    parser.add_argument("folder", nargs="?", default="")
    parser.add_argument("--out", default="")
    parser.add_argument("--format", default="table", choices=["table", "csv", "json", "parquet", "html"])
    parser.add_argument("--rows", type=int, default=50, help="rows of a printed table")
    given = parser.parse_args(args)

    from cragline.plans.queries import QUERIES

    if given.name == "list":
        print("\n".join(sorted(QUERIES)))
        return
    if given.name not in QUERIES:
        parser.error(f"unknown query {given.name!r}")
    if given.format != "table" and not given.out:
        parser.error("--out is needed to write a file")

    from pyspark.sql import SparkSession

    from cragline.operators import report

    spark = SparkSession.builder.appName(given.name).getOrCreate()
    rows = QUERIES[given.name](spark, given.folder)
    if given.format == "table":
        rows.show(given.rows, truncate=False)
    elif given.format == "html":
        report.write_text(report.html_report([(given.name, rows)], given.name), given.out)
    else:
        report.save(rows, given.out, given.format)


if __name__ == "__main__":
    main()
