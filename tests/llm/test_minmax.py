import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.llm import components as C
from quillmark.llm import minmax_dedup as M
from quillmark.llm.shingles import MinMax, Shingler

import numpy as np


def sets(rows, width):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(rows, width, percent):
    """By key: set size, least key reached, kept; all pairs are tried."""
    s, parent = sets(rows, width), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b, key=lambda x: rows[x][0])] = min(a, b, key=lambda x: rows[x][0])
    return {rows[i][0]: (len(s[i]), rows[root(i)][0], root(i) == i) for i in range(len(rows))}


def mutated(text, rng, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"new{rng.randint(0, 999)}"
    return " ".join(w)


@pytest.fixture
def rows(prose):
    rng = random.Random(5)
    texts = [prose(i, 60) for i in range(25)]
    base = prose(99, 80)
    texts += [mutated(base, rng, 0.04) for _ in range(70)]  # one large group
    for i in range(8):
        texts += [mutated(texts[i], rng, 0.02), texts[i].upper(), texts[i]]
    chain = prose(77, 100).split()  # neighbours are alike, the ends are not
    texts += [" ".join(chain[i : i + 70]) for i in range(0, 30, 4)]
    texts += [None, "", " \t\n", "one", "ONE", "two words", "two  words", "two words more", "é É", "x " * 30_000, "x y " * 3]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("width,small", [(2, False), (2, True), (5, True)])
def test_against_brute_force(spark, rows, width, small):
    limits = {"block_rows": 4, "run_rows": 3, "edge_block": 5, "broadcast_ids": 1} if small else {}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = M.near_groups(docs, width=width, percent=80, **limits).collect()
    want = brute(rows, width, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == want


def test_repeats_nulls_clashing_columns_and_empty_tables(spark, prose):
    a, b = prose(1, 30), prose(2, 30)
    rows = [(3, a, "k"), (3, a, "k"), (5, a, "k"), (7, b, None), (None, a, "k"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_groups(docs).collect()), key=str)
    assert found == sorted([(3, 3, True), (3, 3, True), (5, 3, False), (7, 7, True), (None, None, True), (None, None, True)], key=str)
    kept = M.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 7, None, None], key=str)
    assert M.near_groups(docs.limit(0)).count() == 0 and M.deduplicated(docs.limit(0)).count() == 0


def test_rows_of_one_key_and_different_texts_take_part_each(spark, prose):
    a, b, c = prose(1, 30), prose(2, 30), prose(3, 30)
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, c), (4, c + " more"), (5, None), (5, ""), (6, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r.doc_id, r.component_id, r.kept) for r in M.near_groups(docs).collect())
    assert found == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True), (6, 4, False)])
    assert sorted(r.doc_id for r in M.deduplicated(docs).collect()) == [1, 4, 5, 5]


def test_clashing_columns_come_back(spark, prose):
    names = ["_stays", "_times", "_body", "_nth", "_kept", "_rows", "kept", "id", "text_hash", "component_id"]
    rows = [(i, prose(i // 2, 20), *names) for i in range(8)] + [(0, prose(0, 20), *names)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    out = M.deduplicated(docs)
    kept = out.collect()
    assert out.columns == docs.columns and sorted(r.doc_id for r in kept) == [0, 2, 4, 6] and all(r[n] == n for r in kept for n in names)


def test_components_of_a_long_path_a_star_and_rings(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + i, 5000 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    for block in (1_000_000, 20):
        groups = {}
        for r in C.components(df, block=block).collect():
            groups.setdefault(r.comp, set()).add(r.node)
        assert sorted(map(min, groups.values())) == [0, 1000, 5000] and sorted(map(len, groups.values())) == [9, 200, 301]
    assert C.components(df.limit(0)).count() == 0


def test_signatures_estimate_without_bias():
    rng = np.random.default_rng(0)
    hashing, errors = MinMax(100), []
    for _ in range(60):
        both, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        a, b = (np.frombuffer(hashing.signature(np.unique(np.concatenate([both, x]))), "<u2") for x in (one, two))
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.035


def test_words_are_split_and_lowered_as_ascii():
    s = Shingler(2)
    assert len(s.words("A\x0bb\x0cC\td\re\n f\x1cg\u00a0h")) == 6
    assert (s.set_of("Aa BB") == s.set_of("aA bb")).all() and len(s.set_of("É x")) == 1 and (s.set_of("É x") != s.set_of("é x")).all()
    assert F is not None
