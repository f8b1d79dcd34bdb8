"""Scalar functions on names, paths, bodies and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_of(fqn: Column) -> Column:
    """What stands before the last dot; empty without a dot."""
    return F.when(F.contains(fqn, F.lit(".")), F.regexp_replace(fqn, r"\.[^.]*$", "")).otherwise("")


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def outer_of(fqn: Column) -> Column:
    """The outer class of a nested one (before the first $)."""
    return F.substring_index(fqn, "$", 1)


def canonical_path(path: Column, root: str) -> Column:
    """Path below root, with forward slashes and no file:// in front."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    for prefix in (f"file://{root}/", f"{root}/"):
        path = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    return path


def line_count(body: Column) -> Column:
    """Lines of the trimmed body; 0 for an empty one."""
    body = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    return F.when(body == "", 0).otherwise(F.size(F.split(body, "\r?\n")))


def normalised_lines(body: Column) -> Column:
    """Trimmed lines without blank ones, lone braces and comment lines."""
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: ~x.isin("", "{", "}") & ~x.startswith("//") & ~x.startswith("*"))


def is_accessor(name: Column, has_body: Column, statements: Column) -> Column:
    return name.rlike("^(get|is|set)") & has_body & (statements <= 1)


def is_override(annotations: Column) -> Column:
    return F.array_contains(annotations, "Override")


def short_signature(signature: Column) -> Column:
    """name(Type,Type) without packages and type arguments inside the parentheses; a type variable as its name alone."""
    inner = F.regexp_extract(signature, r"\((.*)\)", 1)
    variable = r"Generic\{(\w+)[^}]*\}"
    inner = F.regexp_replace(inner, variable + r",\s*Generic\{\1\}>\}", "$1")  # a bound that repeats its variable
    inner = F.regexp_replace(inner, variable, "$1")
    for _ in range(3):  # nested type arguments
        inner = F.regexp_replace(inner, r"<[^<>]*>", "")
    inner = F.regexp_replace(inner, r"(?:[A-Za-z_$][\w$]*\.)+([A-Za-z_$][\w$]*)", "$1")
    return F.when(F.contains(signature, F.lit("(")), F.concat(F.substring_index(signature, "(", 1), F.lit("("), inner, F.lit(")"))).otherwise(signature)


def short_partners(partners: Column) -> Column:
    """Both sides of each a ↔ b with short signatures."""
    return F.array_join(F.transform(F.split(partners, " ↔ "), short_signature), " ↔ ")


def link(url: Column, label: Column) -> Column:
    return F.concat(F.lit('<a href="'), url, F.lit('" target="_blank">'), escape(label), F.lit("</a>"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def blob_url(origin: str, commit: str) -> str:
    """The address of a commit's files for a repository's origin."""
    return f"{origin.removesuffix('.git')}/blob/{commit}/"


def at_second(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def stamp(ts: Column) -> Column:
    """Year to minute with a twelve-hour clock, as report names have it."""
    return F.date_format(ts, "yyyyMMddhhmm")
