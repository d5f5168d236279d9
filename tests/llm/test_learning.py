import random
import zlib

import numpy as np
import pytest

from weftline.llm import quality_knn as K
from weftline.llm import toxicity as T

INSULTS = ["idiot", "moron", "scum", "pathetic"]


def words(rng, n):
    return [rng.choice(["an", "the", "tion", "er", "in", "re", "st", "ou"]) + rng.choice(["an", "le", "con", "ment", "ra", "es", ""]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(900):
        w, toxic, good = words(rng, rng.choice([15, 60, 300])), int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        text = " ".join(w).capitalize() + "." if good else rng.choice([" | ".join(w), "%%% ".join(w), " ".join(x.upper() + "!!" for x in w)])
        out.append((i, text, good, toxic))
    return out


def tables(spark, docs_of, rows):
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (5, None, None), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    return docs_of([r[:2] for r in rows]), labels


def split(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def check(got, want, least):
    assert {r.doc_id for r in got} == set(want)
    assert all(r.held_out == split(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.predicted == want[r.doc_id] for r in held) / len(held) > least


def test_toxicity_on_held_out_rows(spark, docs_of, rows):
    docs, labels = tables(spark, docs_of, rows)
    check(T.toxicity(docs, labels).collect(), {r[0]: r[3] for r in rows}, 0.97)


def test_quality_on_held_out_rows(spark, docs_of, rows):
    docs, labels = tables(spark, docs_of, rows)
    check(K.quality(docs, labels).collect(), {r[0]: r[2] for r in rows}, 0.97)


@pytest.mark.parametrize("operator", [T.toxicity, K.quality])
def test_labels_of_held_out_rows_are_not_learnt(spark, docs_of, rows, operator):
    docs, labels = tables(spark, docs_of, rows)
    turned = spark.createDataFrame([(i, 1 - q if split(i) else q, 1 - t if split(i) else t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    first, second = ({r.doc_id: r.score for r in operator(docs, x).collect()} for x in (labels, turned))
    assert first == pytest.approx(second)


@pytest.mark.parametrize("operator", [T.toxicity, K.quality])
def test_odd_rows(spark, clashing, odd_rows, docs_of, operator):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        got = operator(clashing, labels).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
        assert not any(r.held_out for r in got if r.doc_id is None)
    assert operator(docs_of([]), some).count() == 0


def plain_score(v, vector):
    """The vote, by sorting all voters: similarity first, then doc_id."""
    cos = [sum(float(a) * float(b) for a, b in zip(x, vector, strict=True)) for x in v.vectors]
    near = sorted(range(len(cos)), key=lambda i: (-round(cos[i] * K.EXACT), i))[: K.NEIGHBOURS]
    weights = [max(cos[i], 0.0) ** 8 + 1e-6 for i in near]
    return sum(w * v.labels[i] for w, i in zip(weights, near, strict=True)) / sum(weights)


def test_exact_neighbours():
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, 30)) + rng.choice([".", "!!", "| |", "%%"]), i % 2) for i in range(300)]
    v = K.Voters(rows)
    texts = [t for _, t, _ in rows[:20]] + ["", "other words. entirely", " ".join(words(rng, 500))]
    for t, s in zip(texts, v.scores(texts), strict=True):
        assert s == pytest.approx(plain_score(v, v.vector(*K.terms(t))), abs=1e-6)
    alone = [v.scores([t])[0] for t in texts]
    assert v.scores(texts) == pytest.approx(alone, abs=1e-9)


def test_ties_go_by_doc_id():
    same = [(i, "the very same words stand here.", int(i < 20)) for i in range(60)]
    rng = random.Random(2)
    for _ in range(3):
        rng.shuffle(same)
        assert K.Voters(same).scores([same[0][1]]) == pytest.approx([1.0])
    turned = [(i, t, 1 - y) for i, t, y in same]
    assert K.Voters(turned).scores([same[0][1]]) == pytest.approx([0.0])


def test_words_are_in_the_vectors():
    rng = random.Random(9)
    kinds = (["cold", "moss", "dune", "fern"], ["lamp", "desk", "door", "fork"])
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(20)) + ".", i % 2) for i in range(200)]
    v = K.Voters(rows)
    assert K.shape(rows[0][1]).tolist() == K.shape(rows[1][1]).tolist()
    assert v.scores(["fern dune moss cold cold fern dune moss.", "door desk lamp fork door fork desk lamp."]) == pytest.approx([0.0, 1.0], abs=1e-3)


def plain_toxic(text, model):
    """The score by a loop over n-grams, each present one once."""
    import math

    t = " " + " ".join(text.lower().split()) + " "
    seen = {int(T.hashed(np.array([ord(c) for c in t[i : i + n]], np.uint32), n)[0]) for n in T.ORDERS for i in range(len(t) - n + 1)}
    z = sum(float(model["table"][f]) for f in seen) + model["bias"]
    return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def test_toxicity_scores_equal_brute_force(rows):
    model = T.fit([(t, x) for _, t, _, x in rows[:300]])
    for _, t, *_ in rows[300:340]:
        assert T.score(t, model) == pytest.approx(plain_toxic(t, model), abs=1e-6)
    assert T.score("", model) == pytest.approx(plain_toxic("", model), abs=1e-6)


def test_non_toxic_rows_keep_their_columns(spark, docs_of, rows, clashing, odd_rows):
    docs, labels = tables(spark, docs_of, rows)
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in T.toxicity(docs, labels).collect() if not r.predicted}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < len(rows)
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    assert T.without_toxic(clashing, some).columns == clashing.columns and T.without_toxic(docs_of([]), some).count() == 0
