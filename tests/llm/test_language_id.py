import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import language_id as L

SOUNDS = {"en": ["the", "ing", "ould", "ea", "wh"], "de": ["sch", "ung", "ei", "ä", "zu"], "fr": ["eau", "tion", "é", "ou", "que"], "es": ["ción", "ñ", "lla", "que", "ar"], "xx": ["qq", "zx", "kk"]}


def documents(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        words = ["".join(rng.choices(SOUNDS[lang] + ["a", "n", "r"], k=rng.randint(1, 3))) for _ in range(rng.randint(15, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


def test_held_out_accuracy_and_undetermined(spark):
    rows = [*documents(700), (9000, None, "en"), (9001, "", "en"), (9002, "12 !? 34", "de"), (9003, "the " * 40_000, None), (9004, "ß", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, per_language=80)
    found = {r.doc_id: r for r in L.identify(docs, model).withColumn("out", L.held_out(F.col("doc_id"))).collect()}
    held = [(found[i].lang_pred, lang) for i, _, lang in documents(700) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(700))
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert [found[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and found[9000].score == 0
    assert found[9003].lang_pred == "en" and all(0 <= r.score <= 1 for r in found.values())
    # labels, ids and order are nothing to a prediction
    other = L.identify(docs.withColumns({"lang": F.lit("zz"), "doc_id": -F.col("doc_id")}).repartition(5), model).collect()
    assert {-r.doc_id: (r.lang_pred, r.score) for r in other} == {i: (r.lang_pred, r.score) for i, r in found.items()}


def test_learns_only_from_rows_that_are_not_held_out(spark):
    rows = documents(300)
    spoiled = [(i, t, "de" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    a, b = (L.fit(spark.createDataFrame(r, "doc_id long, text string, lang string"), per_language=1000) for r in (rows, spoiled))
    assert a.families.classes == b.families.classes and np.array_equal(a.families.weights, b.families.weights)


def test_families_come_first():
    rows = documents(200)
    x = np.stack([L.text_features(t) for _, t, _ in rows])
    model = L.Model.fit(x, np.array([lang for _, _, lang in rows], object))
    assert model.families.classes == ("germanic", "other", "romance")
    assert model.languages["romance"].classes == ("es", "fr") and model.languages["other"].weights.shape[0] == 0


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)], [(1, None, "en")]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert all(r.lang_pred == "und" and r.score == 0 for r in L.identify(docs, model).collect())


def test_one_language_and_clashing_columns(spark):
    docs = spark.createDataFrame([(0, "abc", "en", 1), (2, "def", "en", 2), (3, "ghi", "en", 3)], "doc_id long, text string, lang string, score int")
    found = L.identify(docs, L.fit(docs)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("en", 1.0)}


def test_features_against_their_definition():
    for text in ("Aé b!", "x", "..ab..", "ÄÖ  ü\n1z", "日本 語"):
        run = " " + re.sub(r"[^\W\d_]+", lambda m: m[0], "".join(c if c.isalpha() else " " for c in text.lower())) + " "
        run = re.sub(" +", " ", run)
        counts, m = Counter(), 2**32
        for i in range(len(run) - 1):
            two = (ord(run[i]) * 0x9E3779B1 + ord(run[i + 1]) * 0x85EBCA6B) % m
            counts[two * 0x165667B1 % m >> 20] += 1
            if i + 2 < len(run):
                counts[(two * 0x27D4EB2F + ord(run[i + 2]) * 0xC2B2AE35) % m >> 20] += 1
        want = np.zeros(L.BINS)
        for k, n in counts.items():
            want[k] = n**0.5
        assert np.allclose(L.text_features(text), want / np.linalg.norm(want), atol=1e-6)


def test_svm_reaches_the_least_of_its_objective():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0.3, 1.0, -1.0)
    w = L.train_svm(x, y, epochs=3000, penalty=2.0)
    size = np.array([2.0 * len(y) / (2 * (y == s).sum()) for s in y])
    own = np.hstack([x, np.ones((60, 1))])
    gradient = w - 2 * (own * (size * np.maximum(0, 1 - y * (own @ w)) * y)[:, None]).sum(0)
    assert np.abs(gradient).max() < 1e-6 * np.abs(w).max() * 1e3


def test_choice_against_a_plain_one():
    rows = documents(120, 5)
    x = np.stack([L.text_features(t) for _, t, _ in rows])
    model = L.OneVersusOne.fit(x, np.array([lang for _, _, lang in rows], object))
    best, score = model.choose(x)
    for i, row in enumerate(x.astype(np.float64)):
        votes, sums, least = Counter(), Counter(), {}
        for (a, b), w in zip(itertools.combinations(model.classes, 2), model.weights.astype(np.float64), strict=True):
            m = row @ w[:-1] + w[-1]
            votes[a if m > 0 else b] += 1
            for c, own in ((a, m), (b, -m)):
                sums[c] += np.tanh(own)
                least[c] = min(least.get(c, np.inf), own)
        winner = max(model.classes, key=lambda c: (votes[c] + sums[c] / (2 * len(model.classes)), -model.classes.index(c)))
        assert model.classes[best[i]] == winner and abs(score[i] - 1 / (1 + np.exp(-L.STEEPNESS * least[winner]))) < 1e-4


def test_many_labels_and_repeated_ids_bound_the_sample(spark):
    rows = [(None if i % 2 else 5, f"{lang} {'a' * (i % 7 + 1)} {i % 40}", f"l{lang:03d}") for i in range(60) for lang in range(30)] + [(9, "common text", "zz")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.fit(docs, most_languages=12, sample_rows=60)
    learned = {c for m in model.languages.values() for c in m.classes}
    assert len(learned) <= 12 and learned <= {"zz", *(f"l{i:03d}" for i in range(11))}
    assert {r.lang_pred for r in L.identify(docs, model).collect()} <= learned
