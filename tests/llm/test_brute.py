"""Whole queries whose result SQL cannot state, held against plain Python on small tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_exact import brute_alignment, brute_near, sentence
from test_mixing import brute_budgets, brute_draw

import corpus_pipeline
from cragline.llm import queries
from cragline.llm.line_dedup import dedup_lines
from cragline.llm.mixing import leaf_budgets
from cragline.llm.near_duplicates import near_duplicates
from cragline.llm.quality import WIDTH, _descend, indicators

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def crc(i):
    return zlib.crc32(str(i).encode())


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# ---- language


def brute_profile(text, dim=1024, seed=7):
    """The bundle of a text, one trigram at a time; None without a letter."""
    letters = "".join(c if c.isalpha() else " " for c in f" {text or ''} ".lower())
    if not letters.strip():
        return None
    letters = " " + " ".join(letters.split()) + " "
    vector = {c: np.random.Generator(np.random.PCG64([seed, ord(c)])).integers(0, 2, dim, np.int8).astype(np.int64) * 2 - 1 for c in set(letters)}
    out = np.zeros(dim, np.int64)
    for (a, b, c), n in Counter(zip(letters, letters[1:], letters[2:], strict=False)).items():
        out += n * np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
    return out


def test_language_query_matches_brute_force(spark, tmp_path):
    r = random.Random(13)
    words = {"en": ["the", "and", "things", "with", "house"], "de": ["der", "und", "hauses", "nicht", "über"], "ru": ["что", "это", "дом"]}
    docs = [(i, " ".join(r.choice(words[k] + words["en"][:2]) for _ in range(r.randint(1, 30))), k, "s", 0) for i, k in ((i, r.choice(list(words))) for i in range(150))]
    docs += [(200, None, "en", "s", 0), (201, "", "de", "s", 0), (202, "12 -- 3", None, "s", 0), (203, "Die UND der!", None, "s", 0), (204, "7 und,und;der 8\n\tx", "de", None, 0), (None, "house", "en", "s", 0)]
    docs += [docs[3], docs[3], (205, " ".join(r.choice(words["de"]) for _ in range(60_000)), "de", "s", 0)]
    # two languages learned from the same texts tie
    docs += [(i, "zug um zug", lang, "s", 0) for i, lang in zip([i for i in range(1000, 1100) if crc(i) % 5][:2], ("xb", "xa"), strict=True)]
    prototypes = defaultdict(lambda: np.zeros(1024))
    for i, t, lang, *_ in docs:
        if i is not None and crc(i) % 5 and lang and brute_profile(t) is not None:
            prototypes[lang] += brute_profile(t)
    want = []
    for i, t, *_ in docs:
        v = brute_profile(t)
        held = i is None or crc(i) % 5 == 0
        if v is None:
            want.append((str(i), held, "und", 0.0))
            continue
        near = {k: float(v @ p) / math.sqrt(float(v @ v) * float(p @ p)) for k, p in prototypes.items()}
        best = min(near, key=lambda k: (-round(near[k], 12), k))
        want.append((str(i), held, best, max(0.0, min(1.0, near[best]))))
    got = queries.op1_language_id(spark, tables(spark, tmp_path, documents=(docs, DOCUMENTS))).collect()
    got = sorted((str(x.doc_id), x.held_out, x.lang_pred, x.score) for x in got)
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert all(abs(a[3] - b[3]) < 1e-4 for a, b in zip(got, sorted(want), strict=True)) and {x[2] for x in got} == {"en", "de", "ru", "xa", "und"}


# ---- quality


def brute_slots(text):
    def spread(h):
        h &= 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16

    def renamed(w):
        first = list(dict.fromkeys(w))
        return tuple(first.index(x) for x in w)

    patterns = sorted(p for p in itertools.product(range(4), repeat=4) if renamed(p) == p)
    points, words = list(map(ord, text)), text.split()
    hashed = [zlib.crc32(w.encode()) for w in words]
    on = {spread(a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) for a, b, c in zip(points, points[1:], points[2:], strict=False)}
    on |= {65536 + spread(a * 0x9E3779B1 ^ b * 0x85EBCA77) for a, b in itertools.pairwise(hashed)}
    return sorted(on | {131072 + patterns.index(renamed(words[i : i + 4])) for i in range(len(words) - 3)})


def brute_hinge(x, y, cost):
    """The weights of the least 0.5 |w|^2 + cost * hinge losses, by projected gradients of the dual."""
    z = x * y[:, None]
    k = z @ z.T
    step, alpha, ahead, t = 1 / np.linalg.eigvalsh(k)[-1], np.zeros(len(y)), np.zeros(len(y)), 1.0
    for _ in range(20_000):
        new = np.clip(ahead + step * (1 - k @ ahead), 0, cost)
        if (1 - k @ ahead) @ (new - alpha) < 0:
            t = 1.0
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, alpha, t = new + (t - 1) / after * (new - alpha), new, after
    return alpha @ z


def brute_sigmoid(margins, y):
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    a, b, wide = 1.0, 0.0, 64.0
    while wide > 1e-7:
        grid = np.linspace(-wide, wide, 21)
        aa, bb = (g.ravel() for g in np.meshgrid(a + grid, b + grid))
        s = aa[:, None] * margins + bb[:, None]
        loss = (np.logaddexp(0, s) - t * s).sum(axis=1) + 0.5e-3 * ((aa - 1) ** 2 + bb**2)
        a, b, wide = aa[loss.argmin()], bb[loss.argmin()], wide * 0.7
    return max(a, 1e-3), b


def brute_quality(docs, labels):
    """Scores of docs [(doc_id, text)], learned from labels {doc_id: quality} of two thirds of the documents."""
    seen = sorted((i, t or "") for i, t in docs if i is not None and labels.get(i) is not None and crc(i) % 3 != 1)
    seen = [seen[k] for k in np.random.default_rng(3).permutation(len(seen))]
    y = np.array([1.0 if labels[i] == 1 else -1.0 for i, _ in seen])
    on = [brute_slots(t) for _, t in seen]
    fitted = np.array([k % 5 != 4 for k in range(len(seen))])
    counts = np.ones((2, WIDTH))
    for k in np.flatnonzero(fitted):
        counts[int(y[k] > 0), on[k]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    def row(slots):
        v = np.zeros(WIDTH + 1)
        v[slots] = ratio[slots]
        v /= np.linalg.norm(v) or 1.0
        v[-1] = 1
        return v

    x = np.array([row(s) for s in on])
    w = brute_hinge(x[fitted], y[fitted], 10.0)
    a, b = brute_sigmoid((x @ w)[~fitted], y[~fitted])
    return [1 / (1 + math.exp(-(a * float(row(brute_slots(t or "")) @ w) + b))) for _, t in docs]


def quality_rows(r, n):
    good = ["plain", "words", "about", "water", "light", "stone", "river", "under"]
    bad = ["click", "buy", "now", "water", "free", "words"]
    docs = []
    for i in range(n):
        kind = i % 5 > 1
        docs.append((i, " ".join(r.choice(good if kind or r.random() < 0.3 else bad) for _ in range(r.randint(4, 40))), kind))
    return docs


def test_indicators_match_plain_code():
    r = random.Random(1)
    for text in ["", "a", "abc", "a b", "a b a b", "ü ß 字 字 x", *(" ".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(60)), "long text " * 30_000]:
        assert indicators(text).tolist() == brute_slots(text)


def test_descent_reaches_the_primal_optimum():
    r = np.random.default_rng(4)
    x, y = r.normal(size=(40, 6)), np.where(r.random(40) < 0.5, 1.0, -1.0)
    rows = [(np.append(np.arange(5), WIDTH), v) for v in x]
    got = _descend(rows, y, 2.0, 4000, 1)[[0, 1, 2, 3, 4, WIDTH]]
    primal = lambda w: 0.5 * w @ w + 2.0 * np.maximum(0, 1 - y * (x @ w)).sum()
    best = primal(brute_hinge(x, y, 2.0))
    assert best - 1e-3 <= primal(got) <= best * 1.001 and all(primal(got + 0.05 * d) >= best - 1e-6 for d in r.normal(size=(300, 6)))


def test_quality_query_matches_brute_force(spark, tmp_path):
    rows = quality_rows(random.Random(17), 150)
    docs = [(i, t, "en", "s", 0) for i, t, _ in rows] + [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, "river " * 50_000, "en", "s", 0), rows[4][:2] + ("en", "s", 0), (None, "click now", "en", "s", 0)]
    labels = {i: int(k) for i, _, k in rows if i != 4 and i < 120}  # 4 has two rows
    got = queries.op3_quality(spark, tables(spark, tmp_path, documents=(docs, DOCUMENTS), labels=([*labels.items(), (7, 1 - labels[7]), (8, None)], "doc_id long, quality int"))).collect()
    del labels[7]  # contradictory
    want = sorted(zip((str(d[0]) for d in docs), brute_quality([d[:2] for d in docs], labels), strict=True))
    got = sorted((str(x.doc_id), x.score, x.predicted, x.held_out) for x in got)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert max(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) < 0.02
    assert all(x[2] == int(x[1] >= 0.5) and x[3] == (x[0] != "None" and crc(x[0]) % 3 == 1) for x in got)


# ---- lines


def brute_templates(docs, depth=3, min_docs=3, similarity=0.8, min_tokens=4, short_docs=16):
    """Texts by doc_id without recurring lines, the tree held in dictionaries. Tokens are parted by single blanks."""
    places = defaultdict(set)
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            words = line.split(" ")
            if line and len(words) < min_tokens:
                places["short", line].add((i, p))
            elif line:
                words = tuple("<*>" if any(c.isdigit() for c in w) else w for w in words)
                places[(len(words), *words[:depth]), words].add((i, p))
    n = {k: len({i for i, _ in s}) for k, s in places.items()}
    groups = defaultdict(list)
    for leaf, line in n:
        if leaf != "short":
            groups[leaf].append((leaf, line))
    template = {}
    while groups := {g: ks for g, ks in groups.items() if len(ks) > 1 and sum(n[k] for k in ks) >= min_docs}:
        after = defaultdict(list)
        for g, ks in groups.items():
            total, support = sum(n[k] for k in ks), Counter()
            for k in ks:
                support.update({(at, w): n[k] for at, w in enumerate(k[1]) if w != "<*>"})
            for k in ks:
                own = [(support[x], -x[0], x[1]) for x in enumerate(k[1]) if x[1] != "<*>" and support[x] >= min_docs]
                fixed = [s for s, *_ in own if 2 * s > total]
                need = math.ceil(len(k[1]) * similarity) - k[1].count("<*>")
                if not own or len(own) < need:
                    continue
                if len(fixed) >= need:
                    template[k] = ("group", g)
                elif len(fixed) < len(own):
                    after[g, max(x for x in own if 2 * x[0] <= total)].append(k)
        groups = after
    for k in n:
        if k not in template and n[k] >= (short_docs if k[0] == "short" else min_docs):
            template[k] = ("line", k)
    held = defaultdict(set)
    for k, name in template.items():
        held[name] |= places[k]
    gone = {x for s in held.values() if len({i for i, _ in s}) >= min_docs for x in s - {min(s)}}
    return {i: None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def template_docs(r, n):
    names, places_ = ["anna", "bert", "carl", "dora", "emil"], ["rome", "oslo", "bonn", "kiev"]
    kinds = [
        lambda: f"posted by user {r.choice(names)} on the board of {r.choice(places_)} today again",
        lambda: f"posted by user {r.choice(names)} in the {r.choice(places_)} hall of many new things",
        lambda: f"call {r.randint(1, 50)} for help now",
        lambda: f"page {r.randint(1, 9)} of {r.randint(1, 3)} in {r.choice(places_)}",
        lambda: r.choice(["Read more", "All rights reserved", "Share 1"]),
        lambda: sentence(r.choice([2, 5, 9]), r),
        lambda: " ".join(r.choice("ab") for _ in range(6)),
        lambda: "",
    ]
    return [(i, "\n".join(r.choice(kinds)() for _ in range(r.randint(1, 7)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_lines_with_fields_match_brute_force(spark, tmp_path, seed):
    r = random.Random(seed)
    docs = template_docs(r, r.choice([25, 90]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"depth": 1, "similarity": 0.6, "min_docs": 4}, {"min_tokens": 1}):
        assert {x.doc_id: x.text for x in dedup_lines(frame, **options).collect()} == brute_templates(docs, **options)
    folder = tables(spark, tmp_path, documents=([(i, t, "en", "s", 0) for i, t in docs], DOCUMENTS))
    got = {x.doc_id: (x.text, x.n_lines, x.n_dropped) for x in queries.op5_line_dedup(spark, folder).collect()}
    want = brute_templates(docs, short_docs=3)
    # a text all of whose lines are dropped is empty, as is a text of one empty line
    assert {i: x[0] for i, x in got.items()} == want and all(x[1] == t.count("\n") + 1 for (i, t) in docs for x in [got[i]])
    assert all(x[2] == x[1] - x[0].count("\n") - 1 or not x[0] for x in got.values()) and sum(x[2] for x in got.values()) > 20


# ---- near duplicates of long texts


def test_near_duplicates_of_very_long_texts(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    edited = list(words)
    for k in range(0, 60_000, 90):
        edited[k] = "edit"
    docs = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:30_000])), (4, " ".join(reversed(words))), (5, " ".join(words[:5]))]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == brute_near(docs) and {x.class_id for x in got} == {1, 3, 4, 5}


# ---- the pipeline


def test_pipeline_matches_brute_force_stage_by_stage(spark, tmp_path):
    r = random.Random(23)
    bench = [(k, sentence(20, r)) for k in range(3)]
    docs = []
    for i, text, good in quality_rows(r, 160):
        body = f"{text}\n{sentence(30, r)}" if good else text
        if good and i % 7 == 0:
            body += f" {bench[i % 3][1]} {sentence(4, r)}"
        if good and i % 4 == 0:
            body += f"\nposted by user {r.choice(['anna', 'bert', 'carl'])} on the board today\nRead more"
        docs.append((i, body, r.choice(["en", "en", "de", "fr", None]), f"s{r.randrange(6)}", 0))
    for i in range(160, 190):  # near and exact copies
        _, text, lang, source, _ = docs[(i - 160) // 3 * 5 + 2]
        docs.append((i, text if i % 2 else text + " end", lang, source, 0))
    docs += [(200, None, "en", "s0", 0), (201, "", "en", "s0", 0)]
    labels = {i: int(i % 5 > 1) for i in range(130)}
    folder = tables(spark, tmp_path / "in", documents=(docs, DOCUMENTS), labels=(list(labels.items()), "doc_id long, quality int"), benchmark=(bench, "item_id long, text string"))

    now, frames = {i: (t, lang, source) for i, t, lang, source, _ in docs}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, frames, folder).write.parquet(f"{tmp_path}/{name}")
        frames = spark.read.parquet(f"{tmp_path}/{name}")
        texts = [(i, x[0]) for i, x in now.items()]
        if name == "quality":
            keep = {i: t for (i, t), s in zip(texts, brute_quality(texts, labels), strict=True) if s >= 0.5}
        if name == "line_dedup":
            keep = brute_templates(texts, short_docs=3)
        if name == "near_duplicates":
            classes = brute_near(texts)
            keep = {i: t for i, t in texts if not (t or "").strip() or classes[i][0] == i}
        if name == "decontamination":
            keep = {i: t for i, t in texts if all(brute_alignment(x.split(), (t or "").split()) < 8 for _, x in bench)}
        got = frames.collect()
        assert {x.doc_id: x.text for x in got} == keep and len(got) == len(keep), name
        assert name == "line_dedup" or len(keep) < len(now), name
        now = {i: (t, *now[i][1:]) for i, t in keep.items()}

    domain = lambda s: f"d{ord(hashlib.md5(s.encode()).hexdigest()[0]) % 4}"
    leaves, sizes = defaultdict(list), Counter()
    for i, (t, lang, source) in now.items():
        if (t or "").split():
            k = domain(source), lang or "(none)", source
            leaves[k].append((i, t, k[1], source, 0))
            sizes[k] += len(t.split())
    budget = 0.5 * sum(sizes.values())
    given = leaf_budgets(spark.createDataFrame([(*k, n) for k, n in sizes.items()], "domain string, lang string, source string, tokens long"), budget, queries.MIX_WEIGHTS, 4).collect()
    wanted = brute_budgets([(*k, n) for k, n in sizes.items()], budget, queries.MIX_WEIGHTS, 4)
    assert all(abs(x.budget - wanted[x.domain, x.lang, x.source]) < 1.001 for x in given)
    want = {}
    for x in given:
        k = x.domain, x.lang, x.source
        want |= brute_draw(leaves[k], {("d", *k[1:]): x.budget})
    assert {x.doc_id: x.tokens_taken for x in corpus_pipeline.run(spark, folder).collect()} == want and len(want) > 20
