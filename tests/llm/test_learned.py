import random

import numpy as np

from cragline.llm.language_id import Encoder, identify_language, train_prototypes
from cragline.llm.quality import fit_rows, indicators, score_quality, train_quality

WORDS = {"a": ["the", "and", "thing", "with", "on"], "b": ["der", "und", "ein", "nicht", "auch"], "c": ["что", "это", "как", "мир", "дом"]}


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(3, 60))), k) for i, k in ((i, "abc"[i % 3]) for i in range(n))]


def test_bundle_is_the_sum_of_bound_trigrams():
    encoder = Encoder(64, 7)
    letters = {c: encoder._vectors(np.array([ord(c)]))[0].astype(int) for c in " abz"}
    want = np.zeros(64, int)
    for x, y, z in (" ab", "aba", "ba ", "a z", " z "):
        want += np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z]
    got = {i: v for part, vectors in encoder.bundles(["", "AB A 7z" .replace(" A", "A"), "x"]) for i, v in zip(range(part.start, part.stop), vectors, strict=True)}
    assert (got[1] == want).all() and not got[0].any() and got[2].any()


def test_many_letters_take_the_other_path():
    text = "".join(chr(0x4E00 + i) for i in range(400))
    parts = list(Encoder(32, 1).bundles([text, text]))
    assert all((v[0] == v[-1]).all() and v.any() for _, v in parts)


def test_language_held_out_and_edge_cases(spark):
    rows = spark.createDataFrame(texts(90, 1), "doc_id long, text string, lang string")
    prototypes = train_prototypes(rows, dim=512)
    odd = [(1000, None, 1), (1001, "", 1), (1002, "12 34 !", 1), (None, "the and thing", 1), (None, "the and thing", 1)]
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in texts(60, 2)] + odd, "doc_id long, text string, lang_pred int")
    got = identify_language(docs, prototypes, dim=512).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "abc"[r.doc_id % 3] for r in got if r.doc_id is not None and r.doc_id < 60)
    assert sorted((r.doc_id or -1, r.lang_pred, r.score > 0) for r in got if r.doc_id is None or r.doc_id >= 1000) == [(-1, "a", True)] * 2 + [(1000 + i, "und", False) for i in range(3)]
    assert {r.lang_pred for r in identify_language(docs, train_prototypes(rows.limit(0)), dim=512).collect()} == {"und"}
    assert identify_language(docs.limit(0), prototypes, dim=512).count() == 0


def test_indicators_are_a_set():
    assert len(indicators("")) == 0 and len(indicators("aaaaaaa")) == 1
    assert (indicators("abcabcabc") == np.unique(indicators("abcabcabc"))).all()
    assert len(set(indicators("x x x x x x")) - set(indicators("x y x y x y"))) > 0


def test_hinge_model_reaches_the_optimum():
    found = [np.array(x) for x in ([0, 1], [0, 2], [1, 3], [4, 5], [4, 6], [5, 7])] * 5
    model = fit_rows(found, [1, 1, 1, 0, 0, 0] * 5)
    good, bad = (float(model.weights[x].sum()) + model.bias for x in (found[0], found[3]))
    assert good > 0 > bad
    constant = fit_rows(found[:3], [1, 1, 1])
    assert constant.score("anything") > 0.5 and fit_rows([], []).score("") == 0.5


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        words = [rng.choice(WORDS["a"]) for _ in range(rng.randint(10, 40))]
        rows.append((i, " ".join(words) if i % 3 else " ".join(w + "###" for w in words), i))
    docs = spark.createDataFrame(rows + [(None, None, 1), (500, "", 1), (500, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)] + [(0, 0), (1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = train_quality(docs, labels)
    got = score_quality(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    got = got.collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and 120 <= r.doc_id < 240)
    assert score_quality(docs.limit(0), model).count() == 0
