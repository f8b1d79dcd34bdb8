"""Personal data: candidates of high recall, boosted trees over format and context, calibrated thresholds.

Four base forms (e-mail, IP address, card, phone) are always kept when they pass their own test. Wider
generators propose further spans: written-out e-mail addresses, defanged or IPv6 addresses, cards with other
separators, phone numbers without a plus sign. They cut a stretch of text in several ways, so candidates overlap.
Gradient-boosted trees score them by their format and by what the words around them say for or against their kind, and
a span is kept when its score reaches the threshold that gave the wanted precision on examples that were not fitted.
Extra spans never touch base spans; of extra spans that overlap, those with the higher scores stay.

Everything that sees a document is DataFrame expressions. Words, trees and thresholds are learned on the driver, each from
a third of a fixed number of generated examples, and go into the plan as a map and CASE expressions.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragline.llm.common import materialize
from cragline.llm.pii_examples import examples

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
AT = r"\[at\]|\(at\)|\{at\}|<at>|\[@\]|\(@\)"
DOT = r"\[dot\]|\(dot\)|\{dot\}|<dot>|\[\.\]|\(\.\)"
DOTS = r"\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)"
AT_GATE = r"(?i)[\[({<](?:at|@)[\])}>]| at [a-z0-9-]{1,63} dot "

#: (kind, pattern, gate): the text is only searched where the gate matches. The first four are the base forms,
#: in equivalent forms that read long runs once: a run can only match from its start or from the last match's end.
GENERATORS: tuple[tuple[str, str, str], ...] = (
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){11}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("email", rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}}+ ?(?:{AT}| at ) ?[a-z0-9-]{{1,63}}+(?: ?(?:{DOT}| dot |\.) ?[a-z0-9-]{{1,63}}+){{1,5}}", AT_GATE),
    ("email", rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}}+ ?(?:{AT}| at ) ?[a-z0-9-]{{1,63}}+ ?(?:{DOT}| dot |\.) ?[a-z0-9-]{{1,63}}+", AT_GATE),
    ("email", rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+(?: {{1,2}}@ {{0,2}}|@ {{1,2}})[A-Za-z0-9-]{{1,63}}+(?: ?\. ?[A-Za-z0-9-]{{2,63}}+){{1,4}}", r" @|@ "),
    ("ip", rf"(?<![0-9])[0-9]{{1,3}}+(?:(?:{DOTS})[0-9]{{1,3}}+){{3}}(?![0-9])", r"[0-9][\[({](?:\.|dot)[\])}]"),
    ("ip", rf"(?<![0-9])[0-9]{{1,3}}+(?:(?: ?dot ?| ?\. ?)[0-9]{{1,3}}+){{3}}(?![0-9])", r"[0-9] (?:\.|dot) ?[0-9]|[0-9]\. [0-9]"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{1,4}:"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![0-9A-Za-z:])", r"::"),
    ("card", r"(?<![0-9])[0-9]{4}([./_ ]| - |  )[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])", r"[0-9]{4}(?:[./_ ]| -|  )"),
    ("card", r"(?<![0-9])[0-9]{4}([./_ ]| - |  )[0-9]{6}\1[0-9]{5}(?![0-9])", r"[0-9]{4}(?:[./_ ]| -|  )"),
    ("card", r"(?<![0-9])[0-9]{2,8}(?:[ ._/-]{1,3}[0-9]{2,8}){1,5}(?![0-9])", r"[0-9]{2}[ ._/-]{1,3}[0-9]{2}"),
    ("phone", r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,4}\)[ .-]?|0[0-9]{1,4}[ ./-]|[0-9]{3}[-. ])[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])", r"[0-9][ )./-]"),
    ("phone", r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,4}\)[ .-]?|0[0-9]{1,4}[ ./-])[0-9]{4,9}(?![0-9A-Za-z])", r"[0-9][ )./-]"),
    ("phone", r"(?<![0-9A-Za-z+(.-])00[1-9][0-9]{0,2}(?:[ ./-][0-9]{1,5}){2,5}(?![0-9A-Za-z])", r"00[1-9]"),
    ("phone", r"(?<![0-9A-Za-z+(.-])(?:[0-9]{3}[-. ])?[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])", r"[0-9]{3}[-. ][0-9]{4}"),
)
BASE = 4
#: So many words before and after a candidate speak for or against its kind.
WORDS_BEFORE, WORDS_AFTER = 4, 2
FEATURES = ("gen", "length", "digits", "groups", "luhn", "octets", "cue", "before", "after", "brackets", "variety", "zero", "letters", "widest", "doubled")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits of a match of 12 to 19 digits pass Luhn's check."""
    d = F.reverse(_digits(match))
    values = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    total = F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    n = F.length(d)
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(False)


def _octets(match: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return match.rlike(rf"^{part}(?:[^0-9]+{part}){{3}}$")


def _passes(kind: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    return F.when(kind == "email", True).when(kind == "ip", _octets(match)).when(kind == "card", _luhn(match)).otherwise((n >= 9) & (n <= 15))


def _char_class(c: Column) -> Column:
    return F.when(F.length(c) == 0, 4.0).when(c.rlike(r"\s"), 0.0).when(c.rlike(r"[0-9]"), 2.0).when(c.rlike(r"\p{L}"), 1.0).otherwise(3.0)


def _words() -> Column:
    """The words next to a candidate, lower-case letters only, and the last run of letters and digits in it, marked by >."""
    before = F.filter(F.split(F.lower("tail"), r"[^\p{L}]+"), lambda w: w != "")
    after = F.filter(F.split(F.lower("head"), r"[^\p{L}]+"), lambda w: w != "")
    near = F.slice(F.reverse(before), F.lit(1), F.lit(WORDS_BEFORE))
    last = F.concat(F.lit(">"), F.regexp_extract(F.lower("match"), "([a-z]+)$", 1))
    return F.array_distinct(F.concat(near, F.slice(after, F.lit(1), F.lit(WORDS_AFTER)), F.array(last)))


def _features(rows: DataFrame, cues: dict[str, float]) -> DataFrame:
    """Adds FEATURES to rows(kind, gen, match, tail, head): what the span looks like and what stands around it."""
    digits, match = _digits(F.col("match")), F.col("match")
    runs = F.filter(F.split(match, r"[^0-9A-Za-z]+"), lambda x: x != "")
    table = F.create_map(*[x for k, v in sorted(cues.items()) for x in (F.lit(k), F.lit(v))]) if cues else F.create_map(F.lit(""), F.lit(0.0))
    said = F.transform(_words(), lambda w: F.coalesce(F.try_element_at(table, F.concat(F.col("kind"), F.lit(":"), w)), F.lit(0.0)))
    values = {
        "length": F.length(match), "digits": F.length(digits), "groups": F.size(runs), "luhn": _luhn(match), "octets": _octets(match), "cue": F.aggregate(said, F.lit(0.0), lambda a, x: a + x),
        "before": _char_class(F.right("tail", F.lit(1))), "after": _char_class(F.left("head", F.lit(1))), "brackets": match.rlike(r"[\[({<]"), "variety": F.size(F.array_distinct(F.split(digits, ""))),
        "zero": digits.startswith("0"), "letters": F.regexp_count("match", F.lit(r"[A-Za-z]")), "widest": F.coalesce(F.array_max(F.transform(runs, lambda x: F.length(x))), F.lit(0)), "doubled": F.contains(match, F.lit("::")),
    }
    values = {k: v.cast("double") for k, v in values.items()} | {"gen": F.col("gen").cast("double")}
    kept = [c for c in rows.columns if c != "gen"]
    # exploded, so that the optimiser does not put a feature's expression wherever a tree looks at it
    return rows.select(*kept, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_f")).select(*kept, "_f.*")


@dataclass
class Boosted:
    """Trees of depth two: (feature, cut, (feature, cut, low, high), (feature, cut, low, high)); thresholds by kind;
    cues: by kind:word, the log ratio of how often the word stands by, or ends, a candidate that is of the kind."""

    bias: float
    trees: list[tuple]
    thresholds: dict[str, float]
    cues: dict[str, float]

    def margin(self, row) -> float:
        m = self.bias
        for f, t, left, right in self.trees:
            g, u, low, high = left if row[f] <= t else right
            m += low if row[g] <= u else high
        return m

    def score(self) -> Column:
        m = F.lit(self.bias)
        for f, t, left, right in self.trees:
            arm = [F.when(F.col(FEATURES[g]) <= u, F.lit(low)).otherwise(F.lit(high)) for g, u, low, high in (left, right)]
            m = m + F.when(F.col(FEATURES[f]) <= t, arm[0]).otherwise(arm[1])
        return 1 / (1 + F.exp(-m))


class _Table:
    """Rows of features as codes of their distinct values, for splits by sums over codes."""

    def __init__(self, rows: list[tuple]):
        x = np.array(rows, np.float64).reshape(len(rows), len(FEATURES))
        self.values, self.codes = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(len(FEATURES))), strict=True)

    def split(self, at: np.ndarray, grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, int, float]:
        """The best (gain, feature, cut) of the rows `at`; gain 0 where no cut helps."""
        g0, h0, best = grad[at].sum(), hess[at].sum(), (0.0, 0, math.inf)
        for f, (values, codes) in enumerate(zip(self.values, self.codes, strict=True)):
            n = len(values)
            there = np.flatnonzero(np.bincount(codes[at], minlength=n))
            g = np.cumsum(np.bincount(codes[at], grad[at], n)[there])[:-1]
            h = np.cumsum(np.bincount(codes[at], hess[at], n)[there])[:-1]
            if len(g):
                gain = g * g / (h + ridge) + (g0 - g) ** 2 / (h0 - h + ridge) - g0 * g0 / (h0 + ridge)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), f, float(values[there[k]] + values[there[k + 1]]) / 2)
        return best

    def below(self, at: np.ndarray, f: int, cut: float) -> np.ndarray:
        return self.values[f][self.codes[f][at]] <= cut


def learn_cues(near: list[tuple[str, list[str], int]], least: int = 4) -> dict[str, float]:
    """near(kind, words, label) -> log ratios by kind:word of the words that stand by at least so many candidates."""
    counts = {0: Counter(), 1: Counter()}
    totals = {0: Counter(), 1: Counter()}
    for kind, words, label in near:
        totals[label][kind] += 1
        counts[label].update(f"{kind}:{w}" for w in words)
    every = counts[0] + counts[1]
    share = lambda key, label: (counts[label][key] + 1) / (totals[label][key.split(":")[0]] + 2)
    return {key: math.log(share(key, 1) / share(key, 0)) for key, n in every.items() if n >= least}


def fit_trees(rows: list[tuple], labels: list[int], rounds: int = 60, rate: float = 0.3) -> Boosted:
    """Logistic gradient boosting, without thresholds."""
    table, y, every = _Table(rows), np.array(labels, np.float64), np.arange(len(rows))
    p = (y.sum() + 1) / (len(rows) + 2)
    model = Boosted(math.log(p / (1 - p)), [], {}, {})
    margins = np.full(len(rows), model.bias)
    for _ in range(rounds):
        probs = 1 / (1 + np.exp(-margins))
        grad, hess = y - probs, probs * (1 - probs)
        gain, f, t = table.split(every, grad, hess)
        if gain <= 0:
            break
        arms, low = [], table.below(every, f, t)
        for side in (every[low], every[~low]):
            _, g, u = table.split(side, grad, hess)
            left = table.below(side, g, u)
            leaves = [rate * float(grad[x].sum() / (hess[x].sum() + 1.0)) for x in (side[left], side[~left])]
            margins[side[left]] += leaves[0]
            margins[side[~left]] += leaves[1]
            arms.append((g, u, *leaves))
        model.trees.append((f, t, *arms))
    return model


def calibrate(scored: list[tuple[str, float, int]], precision: float) -> dict[str, float]:
    """scored(kind, score, label) -> by kind, the lowest score from which on the wanted share of candidates is right.

    A kind for which no score gives that share is off: its threshold is infinite.
    """
    out = {}
    for kind in KINDS:
        held, hits, chosen = sorted(((s, y) for k, s, y in scored if k == kind), reverse=True), 0, math.inf
        for n, (s, y) in enumerate(held, 1):
            hits += y
            if hits / n >= precision and (n == len(held) or held[n][0] < s):
                chosen = s
        out[kind] = chosen
    return out


@lru_cache(maxsize=4)
def _fitted(n: int, seed: int, precision: float, application: str) -> Boosted:
    spark = SparkSession.getActiveSession()
    given = [(i, *e) for i, e in enumerate(examples(n, seed))]
    rows = spark.createDataFrame([(i, text) for i, _, text, *_ in given], "doc_id long, text string")
    found = _candidates(rows).filter(F.col("gen") >= BASE).withColumn("near", _words())
    found = found.select("_id", "kind", "gen", "start", "end", "match", "tail", "head", "near").collect()
    right = {i: (kind, start, end) for i, kind, _, start, end, good in given if good}
    label = [int(right.get(r["_id"]) == (r.kind, r.start, r.end)) for r in found]
    third = [r["_id"] % 3 for r in found]
    cues = learn_cues([(r.kind, r.near, y) for r, y, k in zip(found, label, third, strict=True) if k == 0])
    numbered = [(i, y, k, *r[:8]) for i, (r, y, k) in enumerate(zip(found, label, third, strict=True)) if k]
    table = spark.createDataFrame(numbered, "i long, label int, third int, _id long, kind string, gen int, start long, end long, match string, tail string, head string")
    seen = sorted(_features(table, cues).select("i", "kind", "label", "third", *FEATURES).collect(), key=lambda r: r.i)
    model = fit_trees([tuple(r[4:]) for r in seen if r.third == 1], [r.label for r in seen if r.third == 1])
    model.cues = cues
    model.thresholds = calibrate([(r.kind, 1 / (1 + math.exp(-model.margin(tuple(r[4:])))), r.label) for r in seen if r.third == 2], precision)
    return model


def train_pii(spark: SparkSession, n: int = 3000, seed: int = 5, precision: float = 0.9) -> Boosted:
    """What is learned from n generated examples: words from a third, trees from the next, thresholds from the last."""
    return _fitted(n, seed, precision, spark.sparkContext.applicationId)


def _candidates(docs: DataFrame) -> DataFrame:
    """_id, _hash, gen, kind, idx, start, match, tail, head of each match of each generator, by text.

    A text is parted by the matches; lengths of parts and matches add up to the places, in code points. Only the
    ends of the parts are kept, as context.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), text.alias("_body"))
    found = []
    for gen, (_, pattern, gate) in enumerate(GENERATORS):
        parts = F.zip_with(
            F.split("_body", pattern, -1),
            F.regexp_extract_all("_body", F.lit(pattern), F.lit(0)),
            lambda p, m: F.struct(F.length(p).alias("skip"), F.right(p, F.lit(48)).alias("tail"), F.left(p, F.lit(24)).alias("lead"), m.alias("match")),
        )
        found.append(F.when(F.col("_body").rlike(gate), F.struct(F.lit(gen).alias("gen"), parts.alias("parts"))))
    rows = rows.filter(F.col("_body").rlike("[0-9]|@|::|(?i)[\\[({< ]at[\\])}> ]"))
    rows = rows.select("_id", F.xxhash64("_body").alias("_hash"), F.explode(F.array_compact(F.array(*found))).alias("own")).select("_id", "_hash", "own.gen", F.posexplode("own.parts").alias("idx", "part"))
    rows = rows.filter((F.col("idx") > 0) | F.col("part.match").isNotNull()).select("_id", "_hash", "gen", "idx", "part.*")
    rows = rows.repartition("_id", "_hash").dropDuplicates(["_id", "_hash", "gen", "idx"])
    order = Window.partitionBy("_id", "_hash", "gen").orderBy("idx")
    length = F.coalesce(F.length("match"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("skip") + length).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("head", F.coalesce(F.lead("lead").over(order), F.lit("")))
    kinds = F.array(*[F.lit(k) for k, _, _ in GENERATORS])
    return rows.filter("match IS NOT NULL").select("_id", "_hash", "gen", kinds[F.col("gen")].alias("kind"), (F.col("end") - F.length("match")).alias("start"), "end", "match", "tail", "head")


def pii_spans(docs: DataFrame, model: Boosted) -> DataFrame:
    """docs(doc_id, text) -> _id, _hash, kind, start, end, base, match: the spans that are kept, by text.

    Extra spans that overlap, directly or through others, are an island; of one text, so an island is no larger than
    a row. There the span with the highest score is taken, the longer and then the earlier one of equal scores, then the
    next that meets none of those taken, and so on.
    """
    found = materialize(_candidates(docs), "pii")  # the texts are searched once
    base = found.filter(F.col("gen") < BASE).filter(_passes(F.col("kind"), F.col("match"))).withColumn("score", F.lit(1.0)).withColumn("base", F.lit(True))
    limit = F.create_map(*[x for k, t in model.thresholds.items() for x in (F.lit(k), F.lit(t))])
    extra = _features(found.filter(F.col("gen") >= BASE), model.cues).select(*[c for c in found.columns if c != "gen"], F.explode(F.array(model.score())).alias("score")).filter(F.col("score") >= F.element_at(limit, F.col("kind"))).withColumn("base", F.lit(False))
    columns = ["_id", "_hash", "kind", "start", "end", "base", "match", "score"]
    rows = base.select(*columns).unionByName(extra.select(*columns)).withColumn("rank", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")))
    doc = Window.partitionBy("_id", "_hash")
    order = doc.orderBy("start", F.desc("base"), "rank", F.desc("end"))
    up, down = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(up)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(down))
    touches = (F.coalesce(F.col("reach"), F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("next"), F.col("end")) < F.col("end"))
    rows = rows.filter(F.col("base") | ~touches)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.max(F.when(~F.col("base"), F.col("end"))).over(past) <= F.col("start"), F.lit(True))
    rows = rows.withColumn("fresh", F.when(F.col("base"), 0).otherwise(fresh.cast("int"))).withColumn("island", F.sum("fresh").over(up))
    plain = ["_id", "_hash", "kind", "rank", "start", "end", "base", "match"]
    span = F.struct((-F.col("score")).alias("cost"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "rank", "kind", "match")
    islands = rows.filter("NOT base").groupBy("_id", "_hash", "island").agg(F.array_sort(F.collect_set(span)).alias("spans"))

    def take(kept: Column, s: Column) -> Column:
        meets = F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(s)))

    chosen = F.when(F.size("spans") == 1, F.col("spans")).otherwise(F.aggregate("spans", F.slice("spans", F.lit(1), F.lit(0)), take))
    extra = islands.select("_id", "_hash", F.explode(chosen).alias("s")).select("_id", "_hash", "s.kind", "s.rank", "s.start", "s.end", F.lit(False).alias("base"), "s.match")
    return rows.filter("base").select(*plain).unionByName(extra)


def find_pii(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra, for every row.

    n_<kind> counts base spans only, n_extra the others, which are in spans as well. spans: kind:start:end of all spans by start, then kind, comma-joined, in code
    points, end exclusive; base_sha256: the SHA-256 of that string of the base spans alone. Null texts count as
    empty. Repeated rows give repeated results; rows of one doc_id with different texts are told apart; an empty
    table gives an empty result; other columns are not looked at.
    """
    model = model or train_pii(docs.sparkSession)
    spans = pii_spans(docs, model).withColumn("said", F.concat_ws(":", "kind", "start", "end"))
    place = F.struct("start", "rank", "end", "said")
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda s: s["said"]), ",")
    texts = spans.groupBy("_id", "_hash").agg(*counts, F.count_if(~F.col("base")).alias("n_extra"), joined(F.collect_list(F.when(F.col("base"), place))).alias("_base"), joined(F.collect_list(place)).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_own"))
    out = rows.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_extra", F.lit(0)).alias("n_extra"))


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with each kept span of text put as [EMAIL], [IP], [CARD] or [PHONE].

    Overlapping spans are put as one, named after the first. Null texts stay null; other columns stay as they are.
    """
    own = docs.columns
    spans = pii_spans(docs, model or train_pii(docs.sparkSession)).groupBy("_id", "_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_spans"))
    rows = docs.withColumn("_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def put(state: Column, s: Column) -> Column:
        text = F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] >= state["at"], text).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    state = F.aggregate("_spans", start, put, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    return rows.withColumn("text", F.when(F.col("text").isNull() | F.col("_spans").isNull(), F.col("text")).otherwise(state)).select(*own)
