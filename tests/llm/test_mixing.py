import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cragline.llm.mixing import leaf_budgets, mix


def pour(children, given):
    """children: (name, weight, cap). Gives by weight again and again, until nothing is left or all are full."""
    got = {n: 0.0 for n, *_ in children}
    while True:
        open_ = [(n, w, c) for n, w, c in children if w > 0 and c - got[n] > 1e-9]
        left = given - sum(got.values())
        if left < 1e-9 or not open_:
            return got
        total = sum(w for _, w, _ in open_)
        for n, w, c in open_:
            got[n] = min(c, got[n] + left * w / total)


def brute_budgets(leaves, budget, weights, epochs):
    tree = defaultdict(lambda: defaultdict(dict))
    for d, la, s, t in leaves:
        tree[d][la][s] = t * epochs
    w = lambda level, n: weights.get(level, {}).get(n, 1.0)
    out = {}
    top = pour([(d, w("domain", d), sum(sum(x.values()) for x in tree[d].values())) for d in tree], budget)
    for d in tree:
        mid = pour([(la, w("lang", la), sum(tree[d][la].values())) for la in tree[d]], top[d])
        for la in tree[d]:
            low = pour([(s, w("source", s), tree[d][la][s]) for s in tree[d][la]], mid[la])
            out |= {(d, la, s): x for s, x in low.items()}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_match_repeated_pouring(spark, seed):
    r = random.Random(seed)
    leaves = [(f"d{d}", f"l{la}", f"s{s}", r.choice([1, 5, 50, 400, 3000])) for d in range(3) for la in range(3) for s in range(4) if r.random() < 0.8]
    weights = {"domain": {"d0": 3.0, "d1": 0.5}, "lang": {"l0": 2.0, "l2": 0.0}, "source": {"s1": 7.0}}
    total = sum(x[3] for x in leaves)
    for budget in (0.1 * total, 0.9 * total, 2.5 * total, 9.0 * total):
        rows = leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), budget, weights, 2).collect()
        want = brute_budgets(leaves, budget, weights, 2)
        assert len(rows) == len(leaves)
        for x in rows:
            assert abs(x.budget - want[x.domain, x.lang, x.source]) < 1.001, (budget, x, want[x.domain, x.lang, x.source])


def place(i, text, epoch, seed=11):
    key = "|".join(x for x in (None if i is None else str(i), hashlib.md5(text.encode()).hexdigest()) if x is not None)
    return hashlib.md5(f"{seed}|{epoch}|{key}".encode()).hexdigest()


def brute_draw(rows, budgets):
    """tokens drawn by doc_id: token by token from each leaf's epochs, in order."""
    leaves = defaultdict(list)
    for i, t, la, s, _ in rows:
        leaves["d", la, s].append((i, t))
    taken = defaultdict(int)
    for k, docs in leaves.items():
        left, epoch = budgets[k], 0
        full = left // sum(len(t.split()) for _, t in docs)
        while left:
            # all whole epochs take every token, so their order does not matter; the partial one has the number of whole ones
            for i, t in sorted(docs, key=lambda x: place(*x, full)):
                n = min(left, len(t.split()))
                taken[i] += n
                left -= n
            epoch += 1
    return {i: n for i, n in taken.items() if n}


def test_leaves_give_their_budgets_to_the_token(spark):
    r = random.Random(9)
    # long documents among short ones, and a source of one document
    rows = [(i, " ".join(f"w{k}" for k in range(r.choice([1, 3, 30, 30, 400]))), r.choice(["en", "de"]), r.choice(["s0", "s0", "s0", "s1", "s2"]), 7) for i in range(700)]
    rows.append((700, "one very long\ttext\n\n " + "of many words " * 900, "en", "alone", 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int")
    weights = {"source": {"s1": 5.0, "alone": 0.5}}
    for share in (0.05, 0.6, 1.7):
        out = mix(docs, F.lit("d"), weights, budget_share=share, max_epochs=3)
        assert out.columns == ["doc_id", "text", "lang", "source", "tokens", "domain_name", "copies", "prefix_tokens", "tokens_taken", "prefix"]
        got = {x.doc_id: x for x in out.collect()}
        sizes = Counter()
        for _, t, la, s, _ in rows:
            sizes["d", la, s] += len(t.split())
        leaves = spark.createDataFrame([(*k, n) for k, n in sizes.items()], "domain string, lang string, source string, tokens long")
        budgets = {(x.domain, x.lang, x.source): x.budget for x in leaf_budgets(leaves, share * sum(sizes.values()), weights, 3).collect()}
        assert {i: x.tokens_taken for i, x in got.items()} == brute_draw(rows, budgets)
        drawn = Counter()
        for x in got.values():
            drawn["d", x.lang, x.source] += x.tokens_taken
            assert x.tokens_taken == x.copies * x.tokens + x.prefix_tokens and x.prefix_tokens < x.tokens
            assert (x.prefix or "").split() == x.text.split()[: x.prefix_tokens] and x.text.startswith(x.prefix or "")
        assert drawn == Counter({k: n for k, n in budgets.items() if n})
        assert abs(sum(drawn.values()) - min(share, 3) * sum(sizes.values())) <= len(sizes)


def test_draw_follows_the_target_weights():
    import duckdb

    from cragline.llm.queries import MIX_WEIGHTS, ORACLE_SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, repeat('tok ', 1 + i % 97) AS text, ['en', 'de', 'fr', 'es'][1 + i % 4] AS lang, 'src' || (i // 4 % 20) AS source FROM range(4000) t(i)")
    got = con.execute(f"SELECT domain_name, sum(tokens_taken) FROM ({ORACLE_SQL['op7_mixing']}) GROUP BY 1").fetchall()
    total = sum(n for _, n in got)
    assert all(abs(n / total - MIX_WEIGHTS["domain"][d] / 10) < 0.01 for d, n in got) and len(got) == 4


def test_mixing_edge_cases(spark):
    rows = [(1, "a b", "en", "x"), (1, "a b", "en", "x"), (2, None, "en", "x"), (3, "", "en", "x"), (4, "c d", None, None), (None, "e f g", "de", "y"), (5, "w " * 50_000, "de", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(docs, F.lit(None).cast("string"), budget_share=1.0).collect()
    assert {x.domain_name for x in got} == {"(none)"} and all(x.doc_id not in (2, 3) for x in got)
    assert len({(x.copies, x.prefix_tokens) for x in got if x.doc_id == 1}) <= 1  # repeated rows are drawn alike
    full = mix(docs, F.lit("d"), budget_share=9.0, max_epochs=2).collect()
    assert len(full) == 5 and all(x.copies == 2 and x.prefix is None for x in full)
    shuffled = mix(docs, F.lit("d"), budget_share=0.5, broadcast_leaves=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, mix(docs, F.lit("d"), budget_share=0.5).collect()))
    assert mix(docs.limit(0), F.lit("d")).count() == 0
