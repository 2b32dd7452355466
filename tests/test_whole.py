"""Queries over all rows, against brute force."""

import itertools
import random
from collections import Counter

from oracle import SMALL

from quillmark.functions.unicode import edit_distance
from quillmark.operators import alignment as A
from quillmark.operators import links as L
from quillmark.operators import sequences as S
from quillmark.plans import QUERIES


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components_are_those_of_all_lines(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, 5), (51, 2, 5), (7, 2, 6), (50, 3, 7), (9, 4, 7), (11, 5, 997 + 8)], "l_orderkey long, l_suppkey long, l_partkey long")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for folder in (str(tmp_path), SMALL):
        rows = spark.read.parquet(f"{folder}/lineitem.parquet").collect()
        found = {r.node: r.component for r in QUERIES["q_connected_components"](spark, folder).collect()}
        assert found == union_find([(r.l_suppkey, 100000 + r.l_partkey % 997) for r in rows])


def test_crosswalk_links_every_order_and_key(spark):
    orders, customers = (spark.read.parquet(f"{SMALL}/{n}.parquet").collect() for n in ("orders", "customer"))
    ids = {(o.o_orderkey, o.o_custkey) for o in orders}
    near = {}
    for c in customers:
        if c.c_mktsegment == "BUILDING":
            near.setdefault(c.c_custkey // 8, []).append(c.c_custkey)
    keys = {(o.o_orderkey, c) for o in orders for c in near.get(o.o_custkey // 8, [])} - ids
    found = {(r.record, r.work, r.method) for r in QUERIES["q_two_method_crosswalk"](spark, SMALL).collect()}
    assert found == {(*p, "id") for p in ids} | {(*p, "key") for p in keys}


def greedy(pairs):
    taken, out = set(), set()
    for score, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in taken and b not in taken:
            taken |= {a, b}
            out.add((a, b, -score))
    return out


def test_band_pairs_are_those_of_the_whole_block(spark, tmp_path):
    prices = [10.0, 1034.0, 1035.0, 10.0, 5_000_000.0, 5_005_005.0, 5_005_006.0, *(20_000.0 + 2000 * i for i in range(12)), 20_500.0]
    rows = [(i, "1", "F", p) for i, p in enumerate(prices)] + [(100, "2", "F", 10.0), (101, "1", None, 10.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    for folder in (str(tmp_path), SMALL):
        orders = spark.read.parquet(f"{folder}/orders.parquet").collect()
        block = [(a, b) for a in orders for b in orders if a.o_orderkey < b.o_orderkey and None not in (a.o_orderstatus, b.o_orderstatus) and (a.o_orderpriority, a.o_orderstatus) == (b.o_orderpriority, b.o_orderstatus)]
        apart = lambda a, b: abs(a.o_totalprice - b.o_totalprice)
        found = [(r.one, r.other) for r in QUERIES["q_band_pairs"](spark, folder).collect()]
        assert sorted(found) == sorted((a.o_orderkey, b.o_orderkey) for a, b in block if apart(a, b) <= max(1024, 0.001 * max(a.o_totalprice, b.o_totalprice)))
        matched = {(r.one, r.other, r.score) for r in QUERIES["q_band_pairs_greedy"](spark, folder).collect()}
        assert matched == greedy([(a.o_orderkey, b.o_orderkey, -apart(a, b)) for a, b in block if apart(a, b) <= 1024])


def test_matching_in_rounds_is_the_matching_in_order(spark):
    rng = random.Random(2)
    pairs = [(*sorted(rng.sample(range(60), 2)), float(rng.randint(0, 9))) for _ in range(400)]
    pairs = sorted(set(pairs))
    df = spark.createDataFrame(pairs, "a long, b long, s double")
    for rest in (0, 50, 10_000):
        assert {tuple(r) for r in L.greedy_matching(df, "a", "b", "s", rest=rest).collect()} == greedy(pairs)


def test_closest_pairs_are_matched_without_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    chain = [(i, "c", 3000.0 - i * i / 10) for i in range(60)]
    rows = chain + [(1000 + i, rng.choice("ab"), rng.choice([rng.randint(0, 40) / 4, rng.randint(0, 90) * 1.0, 5.0])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (9000, "a", None), (9001, None, 5.0), (9002, "a", float("nan"))], "k long, g string, v double")
    twice = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 2.0), (3, "b", 1.5), (1, "a", 1.75)], "k long, g string, v double")
    how = {"on": ["g"], "key": "k", "value": "v", "least": 5.0}
    pairs = {(*sorted((a[0], b[0])), -abs(a[2] - b[2])) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and abs(a[2] - b[2]) <= 5}
    assert {tuple(r) for r in L.closest_matching(twice, **how).collect()} == {(1, 2, -0.25)}
    monkeypatch.setattr(L, "within_tolerance", None)
    for stretch in (7, 50, 100_000):
        assert {tuple(r) for r in L.closest_matching(df, **how, stretch=stretch).collect()} == greedy(pairs)


def test_whole_texts_and_other_scripts_count(spark, tmp_path):
    rng = random.Random(4)
    words = ["tür", "naïve", "plain", "日本", "word", "😀"]
    turns = [(c, t, ("user", "bot")[t % 2], " ".join(rng.choices(words, k=n)) if n else "") for c in range(3) for t, n in enumerate((150, 140, 3, 0, 120))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, x[3]) for i, x in enumerate(turns)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = [(a[2], a[3], b[3], edit_distance(a[3], b[3])) for a, b in itertools.pairwise(turns) if a[0] == b[0]]
    mix = {r.role: r for r in QUERIES["q_edit_mix"](spark, str(tmp_path)).collect()}
    rates = {r.role: r for r in QUERIES["q_cer_micro_macro"](spark, str(tmp_path)).collect()}
    for role in ("user", "bot"):
        own = [p[1:] for p in pairs if p[0] == role]
        edits, chars = sum(e for _, _, e in own), sum(len(r) for r, _, _ in own)
        assert mix[role].subs + mix[role].inss + mix[role].dels == edits and mix[role].inss - mix[role].dels == sum(len(h) - len(r) for r, h, _ in own)
        assert (rates[role].edits, rates[role].chars, rates[role].lines, rates[role].micro_cer) == (edits, chars, len(own), round(edits / chars, 6))
    found = sorted((r.one, r.other, r.edits) for r in QUERIES["q_levenshtein_pairs"](spark, str(tmp_path)).collect())
    assert found == [(i, i + 1, edit_distance(a[3], b[3])) for i, (a, b) in enumerate(itertools.pairwise(turns))]


def test_scripts_beyond_the_cell_guard_cost_the_edit_distance():
    rng = random.Random(5)
    for most in (4, 30, 200, A.MOST_CELLS):
        for _ in range(30):
            a, b = ("".join(rng.choices("abé ", k=rng.randint(0, 40))) for _ in range(2))
            ops = A.least_script(a, b, most)
            assert sum(k != A.MATCH for k, _, _ in ops) == edit_distance(a, b)
            assert [i for _, i, _ in ops if i >= 0] == list(range(len(a))) and [j for _, _, j in ops if j >= 0] == list(range(len(b)))
            assert all((a[i] == b[j]) == (k == A.MATCH) for k, i, j in ops if i >= 0 and j >= 0)


def test_a_passage_in_many_documents_keeps_its_anchors(spark, tmp_path):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choices("abcdefghij klmé", k=n))
    passages = [make(60), make(50), "x" * 40, make(10)]
    docs = [make(30) + passages[0] + make(i) for i in range(12)] + [passages[1] * 10, passages[1][:25] + make(20), "x" * 90, "", None, passages[0][:22]]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, a in enumerate(passages):
        for j, b in enumerate(docs):
            x, y = (Counter(t[p : p + 20] for p in range(len(t) - 19)) for t in (a, b or ""))
            n = sum(x[g] * y[g] for g in x if y[g] and (x if len(a) <= len(b or "") else y)[g] <= 8)
            want |= {(i, j): n} if n else {}
    assert sum(i == 0 for i, _ in want) == 13 and (1, 12) in want and (2, 14) not in want
    assert {(r.item_id, r.doc_id): r.n for r in QUERIES["q_kgram_anchors"](spark, str(tmp_path)).collect()} == want
    b, d = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("benchmark", "documents"))
    beyond = S.anchors_by_text(b, d, a_key="item_id", b_key="doc_id", text="text", k=20, most=8, few=0)
    assert {(r.item_id, r.doc_id): r.n for r in beyond.collect()} == want
    places = {(r.item_id, r.doc_id): r.edits for r in QUERIES["q_infix_distance"](spark, str(tmp_path)).collect()}
    assert set(places) == set(want) and all(places[0, j] == 0 for j in range(12)) and places[1, 12] == 0


def test_a_text_that_is_its_lines_fills_no_cells(monkeypatch):
    lines = ["Die tür, naïve &", "", "plain 日本 wörd -", "... ", "ſo q; end"] * 40
    found = A.project(lines, " ".join(lines))
    near = A.project(lines[:5], " ".join(lines[:5]) + " x")
    assert [r["confidence"] for r in near] == [1.0, 0.0, 1.0, 0.0, 1.0]
    monkeypatch.setattr(A, "anchored", None)
    assert A.project(lines, " ".join(lines)) == found
    assert [r["text"] for r in found[:5]] == ["Die tür, naïve &", "", "plain 日本 wörd", "", "- ... ſo q; end"] and found[0]["accepted"]
