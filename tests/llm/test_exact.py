import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from cragline.llm import warc
from cragline.llm.decontaminate import alignment, clean_documents, contamination
from cragline.llm.license_texts import LICENSES
from cragline.llm.licenses import license_digests, scan_licenses
from cragline.llm.line_dedup import dedup_lines
from cragline.llm.near_duplicates import connected_components, least_matches, near_duplicates, one_of_each
from cragline.llm.topk import LOWEST, Search, quantise, top_k

rng = random.Random(4)


def sentence(n, r=rng):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


# ---- decontamination


def brute_alignment(item, window):
    h = [[0.0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, w in enumerate(item, 1):
        for j, x in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if w == x else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
    return max(map(max, h))


def test_alignment_matches_the_full_table():
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 12))] for _ in "ab")
        assert alignment(np.array(a), np.array(b))[0] == brute_alignment(a, b)


def test_contamination_finds_copies_and_edits(spark):
    items = [sentence(20) for _ in range(5)]
    edited = items[1].split()
    for k in (3, 9, 15):
        edited[k] = "zzz"
    docs = [(0, f"{sentence(30)} {items[0].upper()}, {sentence(30)}"), (1, f"{sentence(50)} {' '.join(edited)} {sentence(5)}"), (2, sentence(200)), (3, None), (4, ""), (5, items[2]), (5, items[2]), (None, items[3])]
    docs += [(100 + i, f"{sentence(10)} {items[4]}") for i in range(60)]
    bench = [(i, t) for i, t in enumerate(items)] + [(0, items[0]), (90, None), (91, ""), (92, "ab")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted([(0, 0), (1, 1), (5, 2), (5, 2), (-1, 3)] + [(100 + i, 4) for i in range(60)])
    for words in (1_000_000, 40):
        got = contamination(d, b, block_words=words).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == want
    spans = {r.doc_id: r for r in got}
    assert (spans[0].first_word, spans[0].last_word, spans[0].score) == (30, 50, 1.0) and 0.7 < spans[1].score < 1
    left = {r.doc_id for r in clean_documents(d, b).collect()}
    assert left == {2, 3, 4, None}
    assert contamination(d.limit(0), b).count() == 0 and contamination(d, b.limit(0)).count() == 0


def test_contamination_finds_hot_quotes_and_dense_edits(spark):
    r = random.Random(9)
    item, short = [f"w{k}" for k in range(50)], "alpha beta"
    thirds, spread = list(item), [x for k, w in enumerate(item) for x in (w, f"y{k}")]
    thirds[2::3] = ["zzz"] * len(thirds[2::3])
    quote = " ".join(item[:24])
    docs = [f"{sentence(20, r)} {quote} {sentence(20, r)}" for _ in range(300)] + [" ".join(item)] * 3
    docs += [" ".join(thirds), " ".join(spread), " ".join(item[::-1]), f"see alpha beta {sentence(5, r)}"]
    # documents of words of the item in random order, repeated and cut
    docs += [" ".join(" ".join(item[(a := r.randrange(48)) : a + r.randint(1, 9)] + [r.choice(item + ["q"])] * r.randint(0, 2)) for _ in range(r.randint(1, 14))) for _ in range(300)]
    got = contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item)), (1, short)], "item_id long, text string"))
    got = {(x.doc_id, x.item_id): x.score for x in got.collect()}
    place = {w: k for k, w in enumerate(item, 1)}
    best = {i: alignment(np.arange(1, 51), np.array([place.get(w, 0) for w in d.split()]))[0] / 50 for i, d in enumerate(docs)}
    assert {i: s for (i, k), s in got.items() if k == 0} == {i: s for i, s in best.items() if s >= 0.4}
    assert sum(s >= 0.4 for s in best.values()) >= 305 and min(best.values()) < 0.4
    assert {(i, s) for (i, k), s in got.items() if k == 1} == {(306, 1.0)}


def test_contamination_of_long_and_of_short_items(spark):
    r = random.Random(11)
    long = [f"w{k}" for k in range(200)]
    docs = [f"{sentence(9, r)} {' '.join(long[50:110])} {sentence(9, r)}", f"{sentence(9, r)} {' '.join(long[50:75])}", "Answer!", "the answer is here", "alpha beta", "alpha", "x " * 60_000 + " ".join(long), None]
    d = spark.createDataFrame([(i, t, 0, 0.0) for i, t in enumerate(docs)], "doc_id long, text string, item_id int, score double")
    b = spark.createDataFrame([(0, " ".join(long), 1), (1, "answer", 1), (2, "alpha beta", 1)], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id): (x.score, x.first_word, x.last_word) for x in contamination(d, b).collect()}
    assert got == {(0, 0): (0.3, 9, 69), (2, 1): (1.0, 0, 1), (4, 2): (1.0, 0, 2), (6, 0): (1.0, 60_000, 60_200)}
    left = clean_documents(d, b)
    assert left.columns == d.columns and sorted(x.doc_id for x in left.collect()) == [1, 3, 5, 7]


def test_contamination_matches_alignment_of_all_pairs(spark):
    """Seeds and windows lose nothing: every pair that the full table scores high enough is found, and no other."""
    r = random.Random(21)
    vocabulary = [f"v{k}" for k in range(40)]
    items = [[r.choice(vocabulary) for _ in range(r.choice([3, 5, 12, 40, 90]))] for _ in range(12)]

    def edited(words):
        out = []
        for w in words:
            x = r.random()
            out += [] if x < 0.1 else [r.choice(vocabulary)] if x < 0.25 else [w, "zz"] if x < 0.35 else [w]
        return out

    docs = [[r.choice(vocabulary) for _ in range(r.randint(0, 60))] + edited(r.choice(items)) + [r.choice(vocabulary) for _ in range(r.randint(0, 60))] for _ in range(60)]
    got = contamination(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    got = {(x.doc_id, x.item_id): round(x.score, 9) for x in got.collect()}
    want = {}
    for i, doc in enumerate(docs):
        for k, item in enumerate(items):
            score = brute_alignment(item, doc)
            if score >= min(0.4 * len(item), 30):
                want[i, k] = round(score / len(item), 9)
    tiny = {(i, k) for i, k in want if len(items[k]) < 5}  # one word alone would do there, and a seed has two
    assert {x: s for x, s in got.items() if x not in tiny} == {x: s for x, s in want.items() if x not in tiny}
    assert len(got) > 60 and set(got) <= set(want)


# ---- line deduplication


def brute_lines(docs, min_docs, min_tokens):
    """Lines that recur as they are, the first kept; for inputs without variable fields."""
    places = defaultdict(set)
    for i, t in docs:
        for p, line in enumerate(t.split("\n")):
            if len(line.split()) >= min_tokens:
                places[line].add((i, p))
    gone = {x for s in places.values() if len({i for i, _ in s}) >= min_docs for x in s - {min(s)}}
    return {i: "\n".join(line for p, line in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def test_recurring_lines_match_brute_force(spark):
    r = random.Random(2)
    pool = [sentence(r.randint(1, 9), r) for _ in range(25)]
    docs = [(i, "\n".join(r.choice(pool) if r.random() < 0.4 else sentence(8, r) for _ in range(r.randint(1, 12)))) for i in range(60)]
    got = {x.doc_id: x for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: x.text for i, x in got.items()} == brute_lines(docs, 3, 4)
    assert all(x.n_lines == len(t.split("\n")) and len(x.text.split("\n")) == max(1, x.n_lines - x.n_dropped) for (i, t) in docs for x in [got[i]])


def test_variable_fields_share_a_template(spark):
    lines = [f"posted by user {n} on the board" for n in ("anna", "bert", "carl", "dora")] + ["call 123 for help now", "call 77x for help now", "call 9 for help now", "some line that stands alone"]
    docs = spark.createDataFrame([(i, f"{line}\n{sentence(6)}") for i, line in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in dedup_lines(docs, depth=3, similarity=0.8).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1, 7: 0}


@pytest.mark.parametrize("copies", [1, 8])
def test_frequent_field_values_share_a_template(spark, copies):
    r = random.Random(7)
    # each pair of values is in one or two documents, each value in many of them once the table is large
    pairs = [(s, n) for s in range(4 * copies) for n in range(4 * copies)][: 16 * copies * copies]
    lines = [f"this article was first published in sec{'abcdefgh'[s % 8]}{'abcdefgh'[s // 8]} by our reporter nam{'abcdefgh'[n % 8]}{'abcdefgh'[n // 8]}" for s, n in pairs]
    # another template of the same leaf, with a number
    other = [f"this article was read by {i} people here in {'abcd'[i % 4]}town since may" for i in range(len(lines) // 2)]
    prose = [f"this article was {sentence(8, r)}" for _ in range(len(lines))]
    docs = [(i, f"{line}\n{sentence(6, r)}") for i, line in enumerate(lines + other + prose)]
    got = {x.doc_id: x.n_dropped for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {0, len(lines)}
    assert got == {i: int(i < len(lines + other) and i not in first) for i in got}


def test_short_lines_recur_as_they_are(spark):
    lines = ["Read more", "  All rights reserved. ", "\u7248\u6743\u6240\u6709", "Page 7"]
    docs = [(i, "\n".join(["", *lines, f"Page {100 + i}", f"only here{chr(97 + i)}"])) for i in range(5)]
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), short_docs=3).collect()}
    assert got == {0: docs[0][1]} | {i: f"\nPage {100 + i}\nonly here{chr(97 + i)}" for i in range(1, 5)}
    many = spark.createDataFrame([(i, "Share this") for i in range(40)], "doc_id long, text string")
    assert sum(x.n_dropped for x in dedup_lines(many).collect()) == 39


def test_line_dedup_edge_cases(spark):
    same = "one two three four five"
    rows = [(1, same, 9), (1, same, 9), (2, same, 9), (3, same, 9), (None, same, 9), (None, None, 9), (4, "", 9), (5, same + "\n" + "x " * 50_000, 9)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int"))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    got = Counter((r.doc_id, r.n_dropped) for r in out.collect())
    # a null doc_id comes first, so its line stays
    assert got == Counter({(1, 1): 2, (2, 1): 1, (3, 1): 1, (None, 0): 2, (4, 0): 1, (5, 1): 1})
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- licenses


def test_license_variants(spark):
    mit = LICENSES["MIT"]
    docs = [(0, mit), (1, "Copyright (c) 2001 Someone\n" + mit.upper().replace(",", " ;")), (2, mit.replace("sublicense", "sublicence")), (3, mit + " extra"), (4, None), (5, ""), (6, LICENSES["Zlib"].replace("acknowledgment", "acknowledgement")), (6, LICENSES["Zlib"]), (None, "Released under the MIT Licence.")]
    rows = scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), license_digests(spark)).collect()
    assert sorted((str(r.doc_id), str(r.license_id)) for r in rows) == sorted([("0", "MIT"), ("1", "MIT"), ("2", "MIT"), ("3", "None"), ("4", "None"), ("5", "None"), ("6", "Zlib"), ("6", "Zlib"), ("None", "MIT")])
    assert len({*(r.digest for r in rows if r.doc_id in (0, 1, 2))}) == 1
    assert scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), license_digests(spark), broadcast_rows=1).count() == 9


def test_license_sql_finds_the_same(spark):
    import duckdb

    from cragline.llm import queries
    from cragline.llm.license_texts import known_texts

    rows = [(i, t) for i, (_, t) in enumerate(known_texts())]
    rows += [(1000, "Copyright (c) 2001 A\n" + LICENSES["MIT"].replace("sublicense", "sub-licence").upper()), (1001, None), (1002, ""), (1003, "per cent and copyright owners of https programmes"), (1004, "word " * 100_000), (1005, LICENSES["ISC"] + " x"), (None, LICENSES["ISC"])]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, digest string, license_id int")
    got = sorted(tuple(map(str, r)) for r in scan_licenses(docs, license_digests(spark)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(tuple(map(str, r)) for r in con.execute(queries.ORACLE_SQL["op6_license_scan"]).fetchall())
    assert got == want and sum(x[2] != "None" for x in got) == len(known_texts()) + 2
    assert scan_licenses(docs.limit(0), license_digests(spark)).count() == 0


# ---- top-k


@pytest.mark.parametrize("scale", [1, 40_000])
def test_top_k_matches_brute_force(spark, scale):
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 12)) * r.exponential(size=(700, 1)) * scale
    x[100:160] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (3, x[3].tolist())]
    vectors = quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    z = np.floor(x * 1024).astype(np.int64)
    for block, first in ((4096, 4096), (3, 8)):
        got = defaultdict(list)
        for row in top_k(vectors, vectors.filter("vec_id % 100 = 0"), query_block=block, first=first).collect():
            got[row.query_id].append((row["rank"], row.vec_id, row.score))
        assert set(got) == set(range(0, 700, 100))
        for q, best in got.items():
            s = z @ z[q]
            order = sorted((i for i in range(700) if i != q), key=lambda i: (-int(s[i]), i))[:10]
            assert sorted(best) == [(n, i, int(s[i])) for n, i in enumerate(order, 1)]


@pytest.mark.parametrize("shape", ["lengths", "spectrum", "alike"])
def test_top_k_scores_few_pairs_exactly(shape):
    r = np.random.default_rng(5)
    x = r.normal(size=(6000, 64))
    if shape == "lengths":
        x *= r.exponential(size=(6000, 1)) ** 2
    if shape == "spectrum":
        x *= 0.85 ** np.arange(64)
    z = np.floor(x * 1024).astype(np.int64)
    order = np.argsort(-(z.astype(float) ** 2).sum(axis=1), kind="stable")
    rotation = np.linalg.eigh((z.T @ z).astype(float))[1][:, ::-1]
    s = Search(z[:50], np.arange(50), rotation, np.full(50, LOWEST), 10)
    for a in range(0, 6000, 1000):
        s.block(z[order[a : a + 1000]], order[a : a + 1000])
    product = z[:50] @ z.T
    for i in range(50):
        want = sorted((j for j in range(6000) if j != i), key=lambda j: (-int(product[i, j]), j))[:10]
        assert s.best.id[i].tolist() == want and s.best.score[i].tolist() == [int(product[i, j]) for j in want]
    # the first block has no bar to reach yet
    assert s.pairs == 50 * 6000 and s.scored - 50 * 1000 < 0.02 * s.pairs


def test_top_k_small_tables(spark):
    v = quantise(spark.createDataFrame([(0, [1.0, 2.0]), (100, [0.5])], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, top_k(v, v).collect())) == [(0, 1, 100, 1024 * 512), (100, 1, 0, 1024 * 512)]
    assert top_k(v.limit(0), v).count() == 0 and top_k(v, v.limit(0)).count() == 0


# ---- near duplicates


def shingle_set(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near(docs, threshold=0.8):
    groups = defaultdict(list)
    for i, t in docs:
        groups[shingle_set(t)].append(i)
    sets = list(groups)
    links, parent = Counter(), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    low = defaultdict(list)
    for k, s in enumerate(sets):
        low[root(k)].append(min(groups[s]))
    return {i: (min(low[root(k)]), links[k], min(groups[s]), len(groups[s])) for k, s in enumerate(sets) for i in groups[s]}


@pytest.mark.parametrize("chunk", [1024, 7])
def test_near_duplicates_match_brute_force(spark, chunk):
    r = random.Random(6)
    docs = []
    for _ in range(12):
        base = sentence(80, r).split()
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edit"
            docs.append(" ".join(w))
    docs = list(enumerate(docs + docs[:9] + ["", "   ", "one two", "One  two", "x"]))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), chunk_rows=chunk).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == brute_near(docs) and len(got) == len(docs)


def test_near_duplicates_edge_cases(spark):
    t = sentence(40)
    near = t.rsplit(" ", 1)[0] + " other"
    rows = [(None, t, 1), (None, t, 1), (3, near, 1), (3, near, 1), (7, None, 1), (8, None, 1), (9, "solo text here", 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = sorted(((r.doc_id or -1), r.class_id, r.n_links, r.text_copies) for r in near_duplicates(docs).collect())
    assert got == [(-1, 3, 1, 2), (-1, 3, 1, 2), (-1, 7, 0, 3), (3, 3, 1, 2), (3, 3, 1, 2), (7, 7, 0, 3), (8, 7, 0, 3), (9, 9, 0, 1)]
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(-1, t), (-1, t), (-1, ""), (3, near), (7, ""), (8, ""), (9, "solo text here")])
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_and_pruning(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    least = least_matches(0.8, 1e-9)
    assert (np.diff(least) > 0).all() and least[-1] < 0.7 * 128


# ---- archives


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(8)
    pages = [(i, f"http://h/{i}", f"<html>{sentence(60, r)}</html>") for i in range(300)]
    pages += [(300, "u", "same ü"), (301, "u\r\nX: y", "same ü"), (302, None, None), (303, "e", ""), (None, "n", "same ü"), (None, "only", "null id"), (300, "again", "same ü"), (304, "big", "z" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    got = warc.archive_round_trip(df, folder).collect()
    assert len(got) == len(pages) and all(x.intact for x in got)
    by_text = defaultdict(list)
    for i, _, t in pages:
        by_text[t or ""].append(i)
    want = Counter()
    for t, ids in by_text.items():
        first = min((i for i in ids if i is not None), default=None)
        body = t.encode()
        want.update((i, len(body), warc.base32_sha1(body), "response" if first is None or i == first else "revisit", None if first is None or i == first else first) for i in ids)
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == want
    files = list((tmp_path / "w").glob("*.warc.zst"))
    assert files and not list((tmp_path / "w").glob("*.part"))
    assert warc.archive_round_trip(df.limit(0), str(tmp_path / "none")).count() == 0


def test_null_urls_and_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, "<p>a</p>", 5, "x"), (2, "", "<p>b</p>", 5, "x"), (3, "u", "<p>a</p>", 5, "x")], "page_id long, url string, html string, first_id int, digest string")
    got = {r.page_id: (r.url, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages, str(tmp_path / "w")).collect()}
    assert got == {1: (None, "response", None), 2: ("", "response", None), 3: ("u", "revisit", 1)}


@pytest.mark.parametrize("records", [[b"WARC/1.1 only one"], [b"WARC/1.1 x", b"WARC/1.1 y"], [b"WARC/1.1 same"] * 40, [b"WARC/1.1 a", b"", b"WARC/1.1 b" * 50_000]])
def test_small_archives_have_a_dictionary_too(tmp_path, records):
    path = tmp_path / "a.zst"
    writer = warc.Writer(path.open("wb"))
    for x in records:
        writer.add(x)
    writer.close()
    raw = path.read_bytes()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME and int.from_bytes(raw[4:8], "little") > 0
    assert list(warc.read_records(path.open("rb"))) == records


def test_archive_has_a_leading_dictionary(tmp_path):
    records = [warc.record(i, "u", sentence(50).encode(), "D", None, False) for i in range(400)]
    path = tmp_path / "a.zst"
    writer = warc.Writer(path.open("wb"))
    for x in records:
        writer.add(x)
    writer.close()
    raw = path.read_bytes()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME
    size = int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(raw[8 + size :])
    assert one == records[0] and list(warc.read_records(path.open("rb"))) == records
    with pytest.raises(Exception):
        list(warc.read_records(__import__("io").BytesIO(raw[:-3])))
