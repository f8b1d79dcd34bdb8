"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

A token budget flows from the root to the leaves. At each node it is shared among the children by weight, and
a child never gets more than its subtree can give (its tokens times max_epochs). What one child cannot take
goes to its siblings by weight; only what a whole subtree cannot take goes back to the siblings of its root.
A leaf's budget is met by whole epochs and then by a token-prefix of one more, each epoch in a seeded order of
its own. The prefix ends inside a document where the budget does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm.common import materialize

LEVELS = ("domain", "lang", "source")
#: Stands for null in the tree.
NONE = "(none)"
TOKEN = r"\S+"


def _weight(level: str, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(1.0))


def _share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Adds budget to nodes(parents..., weight, cap, given): the parent's `given` poured in by weight up to cap.

    Children are taken by cap / weight. The level of the pour is what is left for the children from here on
    over their weights; a child below it takes its cap. The first one above it fixes the level for the rest: it is the
    highest, as the later ones count more than its share as given away.
    """
    among = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = among.orderBy(F.col("fill"), *LEVELS[: len(parents) + 1])
    nodes = nodes.withColumn("fill", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf")))
    nodes = nodes.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    nodes = nodes.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("level", F.when(F.col("rest") > 0, (F.col("given") - F.col("before")) / F.col("rest")))
    nodes = nodes.withColumn("full", F.col("fill") <= F.coalesce(F.col("level"), F.lit(-1.0)))
    nodes = nodes.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(among))
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.greatest(F.lit(0.0), F.col("weight") * F.coalesce(F.col("level"), F.lit(0.0)))))
    return nodes.withColumn("budget", F.when(F.col("weight") > 0, share).otherwise(0.0)).drop("fill", "before", "rest", "level", "full", "given")


def leaf_budgets(leaves: DataFrame, token_budget: float, weights: dict[str, dict[str, float]] | None = None, max_epochs: int = 4) -> DataFrame:
    """leaves(domain, lang, source, tokens) -> the same with budget (long), the tokens to draw from each leaf.

    weights: by level ("domain", "lang", "source"), the weight of each name among its siblings; 1 where none is
    given, 0 draws nothing. Windows go over tree nodes only, never over documents.
    """
    weights = weights or {}
    given = F.lit(float(token_budget))
    up = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * float(max_epochs)).alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(level, weights.get(level, {})))
        nodes = nodes.withColumn("given", given) if up is None else nodes.join(up, path[:-1]).withColumnRenamed("budget", "given")
        shared = _share(nodes, path[:-1])
        up = shared.select(*path, "budget")
    return shared.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).alias("budget"))


def _order(seed: int) -> Column:
    """The place of a row in the order of the epoch `epochs` of its leaf: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("_mix_key")))


def _cuts(placed: DataFrame, plan: DataFrame, small) -> DataFrame:
    """placed(levels, at, tokens), plan(levels, epochs, rest) -> levels, epochs, cut, share.

    cut is the first place at which the running sum of a leaf passes its rest, share what each row there still gives.
    Leading digits of the places are narrowed down, two at a time: a step sums at most 256 ranges of a leaf, and only
    the rows of one range in 65,536 are put in order.
    """
    levels, found = list(LEVELS), plan.withColumn("part", F.lit("")).withColumn("before", F.lit(0).cast("long"))
    for known, digits in ((0, 2), (2, 4), (4, 32)):
        inside = placed.withColumn("part", F.substring("at", 1, known)).join(small(found.select(*levels, "part", "rest", "before")), [*levels, "part"])
        sums = inside.groupBy(*levels, "rest", "before", F.substring("at", 1, digits).alias("next"))
        sums = sums.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*levels).orderBy("next"))
        first = F.min(F.struct(F.col("next").alias("part"), (F.col("upto") - F.col("tokens")).alias("before"), "n")).alias("first")
        ends = sums.withColumn("upto", upto).filter("upto > rest").groupBy(*levels).agg(first).select(*levels, "first.*")
        found = materialize(plan.join(ends, levels), "mix-cut")
    return found.select(*levels, "epochs", F.col("part").alias("cut"), F.expr("(rest - before) div n").alias("share"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, max_epochs: int = 4, seed: int = 11, broadcast_leaves: int = 50_000) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) -> docs with tokens, domain_name, copies, prefix_tokens, tokens_taken and
    prefix, of the rows of which any token is drawn.

    Tokens are runs of non-blank characters. The budget is budget_share of all tokens. copies counts the epochs
    that hold the whole document. In the last, partial epoch of a leaf whole documents are drawn in the seeded order until one
    does not fit into the rest of the budget: of that one the first prefix_tokens tokens are drawn, as text in prefix
    (null elsewhere). So a leaf gives its budget to the token. tokens_taken = copies * tokens + prefix_tokens.

    Null levels form a leaf named (none). Texts that are null or without a token are never drawn. Repeated rows
    share one place in the order; where the budget ends there, each gives the same number of tokens, and fewer tokens than
    there are such rows are left over. Columns of docs with the names of the new ones are replaced; an empty table
    gives an empty result.

    Only leaf names, hashes and token counts are shuffled, never texts. A leaf that holds a third of all rows is
    summed by ranges of its order, and only one range is sorted. The leaves' plan is broadcast up to broadcast_leaves leaves.
    """
    new = ("tokens", "domain_name", "copies", "prefix_tokens", "tokens_taken", "prefix")
    own = [c for c in docs.columns if c.lower() not in new]
    place = [F.coalesce(x.cast("string"), F.lit(NONE)).alias(f"_mix_{k}") for k, x in zip(LEVELS, (domain, F.col("lang"), F.col("source")), strict=True)]
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).alias("_mix_key")
    rows = docs.select(*own, *place, F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("tokens"), key).filter("tokens > 0")
    light = materialize(rows.select(*[F.col(f"_mix_{k}").alias(k) for k in LEVELS], "_mix_key", "tokens"), "mix")
    leaves = light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = light.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = leaf_budgets(leaves, total * budget_share, weights, max_epochs)
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).select(*LEVELS, "epochs", "rest")
    plan = materialize(plan, "mix-plan")
    few = plan.limit(broadcast_leaves + 1).count() <= broadcast_leaves
    small = F.broadcast if few else lambda x: x
    placed = light.join(small(plan.select(*LEVELS, "epochs")), list(LEVELS)).withColumn("at", _order(seed)).select(*LEVELS, "at", "tokens")
    cuts = _cuts(placed, plan, small).select(*[F.col(k).alias(f"_mix_{k}") for k in LEVELS], "epochs", F.col("cut").alias("_mix_cut"), F.col("share").alias("_mix_share"))
    out = rows.join(small(cuts), [f"_mix_{k}" for k in LEVELS]).withColumn("_mix_at", _order(seed))
    out = out.withColumn("copies", F.col("epochs") + F.when(F.col("_mix_at") < F.col("_mix_cut"), 1).otherwise(0))
    out = out.withColumn("prefix_tokens", F.when(F.col("_mix_at") == F.col("_mix_cut"), F.col("_mix_share")).otherwise(0))
    out = out.withColumn("tokens_taken", F.col("copies") * F.col("tokens") + F.col("prefix_tokens")).filter("tokens_taken > 0")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"\s*{TOKEN}"), F.lit(0)), F.lit(1), F.col("prefix_tokens").cast("int")), "")
    return out.select(*own, "tokens", F.col("_mix_domain").alias("domain_name"), "copies", "prefix_tokens", "tokens_taken", F.when(F.col("prefix_tokens") > 0, head).alias("prefix"))
