"""Line deduplication with a log-template tree of fixed depth.

A line's tokens with digits are variable fields. The first level of the tree is the token count, the next ones
are the leading tokens. Within a leaf, the token that most documents have at a position is fixed there, every other
position is a variable field as well, at any corpus size. Lines that this template does not fit go on in smaller
groups of the leaf. A template that recurs in enough documents is boilerplate: its first line stays, all others are
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.llm.common import discard, marked, materialize

VARIABLE = "<*>"


def _lines(texts: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """texts(_id, _hash, _body) -> _id, _hash, pos, masked, leaf, line, short of each line that is not blank.

    short: fewer than min_tokens tokens. Such a line keeps its digits and is a leaf of its own.
    """
    # whole bodies are normalised before they are parted: what needs no change is only looked through once
    plain = F.replace(F.replace("_body", F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    rows = texts.select("_id", "_hash", plain.alias("b"))
    rows = rows.select("_id", "_hash", F.when(F.contains("b", F.lit("  ")), F.regexp_replace("b", " +", " ")).otherwise(F.col("b")).alias("b"))
    edges = F.contains("b", F.lit(" \n")) | F.contains("b", F.lit("\n ")) | F.startswith("b", F.lit(" ")) | F.endswith("b", F.lit(" "))
    rows = rows.select("_id", "_hash", F.when(edges, F.regexp_replace("b", "(?m)^ | $", "")).otherwise(F.col("b")).alias("b"))
    rows = rows.select("_id", "_hash", F.posexplode(F.split("b", "\n", -1)).alias("pos", "own")).filter("own <> ''")
    rows = rows.withColumn("tokens", F.length("own") - F.length(F.replace("own", F.lit(" "), F.lit(""))) + 1).withColumn("short", F.col("tokens") < min_tokens)
    # a token with a digit, found from its start so that long tokens are read once
    masked = F.when(~F.col("short") & F.col("own").rlike("[0-9]"), F.regexp_replace("own", r"(?<!\S)[^\s0-9]*+[0-9]\S*+", VARIABLE)).otherwise(F.col("own"))
    path = F.when(F.col("short"), F.col("own")).otherwise(F.substring_index("masked", " ", depth))
    rows = rows.select("_id", "_hash", "pos", "short", "tokens", "own", masked.alias("masked"))
    return rows.select("_id", "_hash", "pos", "masked", F.xxhash64("tokens", path).alias("leaf"), F.xxhash64("masked").alias("line"), "short")


def _shapes(held: DataFrame, min_docs: int, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """held(leaf, line, tokens, n) -> leaf, line, template of the lines that the template of their group fixes well
    enough, and the intermediate tables that this reads.

    A group starts as a leaf. A token that more than half of the group's documents have at its position is fixed
    there, at most one for each position, so a group has one template. A line of whose tokens the template fixes too few goes on
    with the lines that share the commonest of its other tokens: at most half of the group, so rounds are few. Only
    lines that can no longer match are left out: supports never grow, and each fixed token has min_docs documents.
    """
    lines, done, used, before = held.withColumn("group", F.col("leaf")), None, [], None
    while True:
        words = lines.select("group", "leaf", "line", "n", F.posexplode("tokens").alias("at", "token")).filter(F.col("token") != VARIABLE)
        support = words.groupBy("group", "at", "token").agg(F.sum("n").alias("support")).filter(F.col("support") >= min_docs)
        support = support.join(lines.groupBy("group").agg(F.sum("n").alias("group_n")), "group")
        support = support.select("group", "at", "token", "support", (F.col("support") * 2 > F.col("group_n")).alias("fixed"))
        found = words.drop("n").join(support, ["group", "at", "token"]).groupBy("group", "leaf", "line")
        other = F.when(~F.col("fixed"), F.struct("support", (-F.col("at")).alias("at"), "token"))
        found = found.agg(F.count("*").alias("supported"), F.count_if("fixed").alias("fixed"), F.max(other).alias("other"))
        fields = F.size(F.filter("tokens", lambda x: x == VARIABLE))
        need = F.ceil(F.size("tokens") * similarity) - fields
        sized = lines.select("leaf", "line", "n", "tokens", need.alias("need")).join(found, ["leaf", "line"]).filter(F.col("supported") >= F.col("need"))
        sized = materialize(sized, "line-groups")
        used.append(sized)
        discard(before)
        shapes = sized.filter(F.col("fixed") >= F.col("need")).select("leaf", "line", F.xxhash64("group", F.lit(VARIABLE)).alias("template"))
        done = shapes if done is None else done.unionByName(shapes)
        rest = sized.filter((F.col("fixed") < F.col("need")) & F.col("other").isNotNull())
        rest = rest.select("leaf", "line", "n", "tokens", F.xxhash64("group", "other.at", "other.token").alias("group"))
        large = rest.groupBy("group").agg(F.sum("n").alias("group_n"), F.count("*").alias("group_lines")).filter((F.col("group_lines") > 1) & (F.col("group_n") >= min_docs))
        lines = materialize(rest.join(large.select("group"), "group", "left_semi"), "line-rest")
        before = lines
        if lines.isEmpty():
            return done, used


def line_decisions(docs: DataFrame, depth: int = 3, min_docs: int = 3, similarity: float = 0.8, min_tokens: int = 4, short_docs: int = 16) -> DataFrame:
    """_id, _hash, drop (array of line numbers) for each text that loses lines; _id and _hash name doc_id and text."""
    key = ["_id", "_hash"]
    body = F.coalesce("text", F.lit(""))
    texts_of = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(body).alias("_hash"), body.alias("_body"))
    light = materialize(_lines(texts_of, depth, min_tokens).select(*key, "pos", "leaf", "line", "short"), "lines")
    own = F.struct("_id", "_hash", "pos")
    texts = light.groupBy("leaf", "line", "short", *key).agg(F.min("pos").alias("pos"))
    lines = materialize(texts.groupBy("leaf", "line", "short").agg(F.count("*").alias("n"), F.min(own).alias("first")), "line-counts")
    # leaves with several lines that could share a template; a leaf of one line is its own template
    leaves = lines.filter("NOT short").groupBy("leaf").agg(F.sum("n").alias("leaf_n"), F.count("*").alias("leaf_lines")).filter((F.col("leaf_lines") > 1) & (F.col("leaf_n") >= min_docs)).select("leaf")
    mixed = materialize(lines.filter("NOT short").join(leaves, "leaf").select("line", "n", "first.*"), "line-leaves")
    same = mixed.select(F.col("_id").alias("i"), F.col("_hash").alias("h"), F.col("pos").alias("p"), F.col("line").alias("l"), "n")
    every = _lines(marked(texts_of, "_hash", mixed.select("_hash").distinct(), "_may").filter("_may"), depth, min_tokens).filter("NOT short")
    # of these texts' lines only the wanted ones, and few others, are shuffled
    at = F.xxhash64("_id", "_hash", "pos")
    every = marked(every.withColumn("at", at), "at", mixed.select(at.alias("at")), "_may").filter("_may")
    held = every.join(same, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_hash") == F.col("h")) & (F.col("pos") == F.col("p")) & (F.col("line") == F.col("l")))
    held = held.select("leaf", "line", "masked", "n").dropDuplicates(["leaf", "line"])
    held = materialize(held.select("leaf", "line", F.split("masked", " ").alias("tokens"), "n"), "line-tokens")
    discard(mixed)
    shapes, groups = _shapes(held, min_docs, similarity)
    # the other lines: a line that recurs by itself
    alone = lines.filter(F.col("n") >= F.when(F.col("short"), F.lit(short_docs)).otherwise(F.lit(min_docs))).join(shapes, ["leaf", "line"], "left_anti").select("leaf", "line", F.xxhash64("leaf", "line").alias("template"))
    templates = materialize(shapes.unionByName(alone), "line-templates")
    discard(lines, held, *groups)
    own_line = F.xxhash64("leaf", "line")
    placed = marked(light.withColumn("own_line", own_line), "own_line", templates.select(own_line.alias("own_line")), "_may").filter("_may")
    placed = placed.join(templates, ["leaf", "line"]).select(*key, "pos", "template")
    found = placed.groupBy("template", *key).agg(F.min("pos").alias("pos"))
    recurring = found.groupBy("template").agg(F.count("*").alias("docs"), F.min(own).alias("first")).filter(F.col("docs") >= min_docs).select("template", "first")
    recurring = materialize(recurring, "line-recurring")  # a plain table, so that the join can split a hot template
    repeats = placed.join(recurring, "template").filter(~own.eqNullSafe(F.col("first")))
    return repeats.groupBy(*key).agg(F.collect_set("pos").alias("drop"))


def _without(text: Column, drop: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(drop, i))
    return F.array_join(kept, "\n")


def dedup_lines(docs: DataFrame, depth: int = 3, min_docs: int = 3, similarity: float = 0.8, min_tokens: int = 4, short_docs: int = 16) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with text without recurring lines, and n_lines, n_dropped.

    depth: leading tokens in the tree; min_docs: documents in which a template recurs; similarity: share of a
    line's tokens that its template must fix, those with digits counted as matching; lines of fewer than min_tokens
    tokens, as all lines of scripts without blanks, have no fields and recur as they are in short_docs documents,
    min_docs at least. Blank lines stay. The first line of a
    recurring template (by doc_id, then text hash, then line) stays. Null texts stay null with no lines. Rows
    with the same doc_id and text are one document and lose the same lines; rows of one doc_id with different
    texts are different documents. An empty table gives an empty result. Columns of docs named n_lines or
    n_dropped are replaced, other columns are kept as they are.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    drop = line_decisions(docs, depth, min_docs, similarity, min_tokens, short_docs).select(F.col("_id").alias("_ld_id"), F.col("_hash").alias("_ld_hash"), F.col("drop").alias("_ld_drop"))
    drop = materialize(drop, "line-drops")
    rows = docs.select(F.struct(*own).alias("_ld_row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_ld_own"))
    rows = marked(rows, "_ld_own", drop.select(F.col("_ld_hash").alias("_ld_own")).distinct(), "_ld_may")
    # only texts that the bitmap lets through are shuffled, the others lose no line
    may = rows.filter("_ld_may").join(drop, F.col("_ld_row.doc_id").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_own") == F.col("_ld_hash")), "left").select("_ld_row.*", "_ld_drop")
    out = may.unionByName(rows.filter("NOT _ld_may").select("_ld_row.*", F.lit(None).cast(drop.schema["_ld_drop"].dataType).alias("_ld_drop")))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    out = out.withColumn("n_lines", lines).withColumn("n_dropped", F.coalesce(F.size("_ld_drop"), F.lit(0)))
    text = F.when(F.col("_ld_drop").isNotNull(), _without(F.col("text"), F.col("_ld_drop"))).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*own, "n_lines", "n_dropped")
