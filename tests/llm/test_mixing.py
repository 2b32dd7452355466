import random
import re
from collections import defaultdict

import pytest

from quillmark.llm import mixing as M


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over


def highest_quotients(votes, seats):
    """Seats one by one."""
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def make(n, seed=1, hot=0.4):
    rng = random.Random(seed)
    sources = ["b", "a", "é", None, "z", "B"]
    return [(i, "a" if rng.random() < hot else rng.choice(sources), " ".join(["w"] * rng.choice([0, 1, 5, 40, 200, 900]))) for i in range(n)]


def test_quotas_are_sainte_lagues(spark):
    rng = random.Random(2)
    for votes, seats in (([rng.randint(0, 1000) for _ in range(30)], 700), ([1, 1, 1], 2), ([10**6, 3, 3, 3, 3, 3, 3], 40), ([0, 0], 0), ([5], 9), ([7, 7, 7, 7], 1)):
        parties = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "place int, votes double, seats long")
        found = {r.place: r.quota for r in M.sainte_lague(parties, [], "votes", "seats", "place").collect()}
        assert [found[i] for i in range(len(votes))] == highest_quotients(votes, seats)


@pytest.mark.parametrize("shard_words", [M.SHARD_WORDS, 3000])
def test_mix_comes_near_its_targets(spark, shard_words):
    rows = [*make(400), (1000, None, None), (1001, "new", ""), (1002, "a", "\x0b \t"), (1003, "é", "one\x0btwo three")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    found = M.mix(docs, shard_words=shard_words).collect()
    again = M.mix(docs.repartition(7), shard_words=shard_words).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str) and len(found) == len(rows)
    text = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, s, _ in rows:
        sizes[s] += text[d]
    want = targets(sizes)
    for r in found:
        assert r.size == text[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2 * M.BLOCK_WORDS


def test_mixed_documents_are_what_is_taken(spark):
    rows = [*make(200, 4), (5, "a", "x y z"), (5, "a", "x y z"), (6, "b", None)]
    docs = spark.createDataFrame([(*r, len(r[2] or ""), "k") for r in rows], "doc_id long, source string, text string, n_chars long, size string").repartition(3)
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    got, want = defaultdict(int), defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.size == "k"
    for r in M.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_repeats_empty_tables_and_no_words(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, None, None)], "doc_id long, source string, text string")
    assert sorted(r.taken for r in M.mix(docs).collect()) in ([0, 3, 3], [0, 2, 4])
    assert M.mix(docs.limit(0)).count() == 0 and M.mixed_documents(docs.limit(0)).count() == 0
    assert [tuple(r) for r in M.mix(docs.where("doc_id is null")).collect()] == [(None, None, 0, 0, 0.0, 0)]


def test_clashing_columns_come_back(spark):
    names = ["_plans", "_key", "_size", "_nth", "_text", "_row", "_word", "_place", "row", "taken", "order", "tie", "full"]
    docs = spark.createDataFrame([(*r, *names) for r in make(60, 3)], f"doc_id long, source string, text string, {', '.join(f'{n} string' for n in names)}")
    out = M.mixed_documents(docs)
    rows = out.collect()
    assert out.columns == docs.columns and rows and all(r[n] == n for r in rows for n in names)
    plain = M.mixed_documents(docs.select("doc_id", "source", "text")).collect()
    assert sorted(map(tuple, plain)) == sorted((r.doc_id, r.source, r.text) for r in rows)


def test_reruns_agree_where_ids_repeat(spark):
    rows = [(i % 7, "a", f"w{i} " * (20 + i % 3)) for i in range(200)] + [(None, "b", f"n{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one, two = (sorted(map(str, M.mixed_documents(docs.repartition(n)).collect())) for n in (2, 5))
    assert one == two
