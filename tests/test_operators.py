import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import geometry as G
from quillmark.functions.unicode import edit_distance
from quillmark.operators import alignment as A
from quillmark.operators import decoding as D
from quillmark.operators import evaluation as E
from quillmark.operators import links as L
from quillmark.operators import sampling as Q
from quillmark.operators import sequences as S
from quillmark.operators import versions as V


def test_current_rows_follow_precedence_and_as_of(spark):
    runs = spark.createDataFrame([(1, "recognize", None), (2, "recognize", "scope"), (3, "recognize", None), (4, "crowd", None)], "run_id long, stage string, scope string")
    lines = [(1, 1, 1, "a"), (2, 1, 2, "b"), (3, 1, 3, "c"), (4, 2, 1, "d"), (5, 2, 4, ""), (6, 3, None, "e"), (7, 3, None, "f")]
    facts = V.ranked(spark.createDataFrame(lines, "id long, line long, run_id long, text string"), runs)
    order = [F.col("_prec").desc(), F.coalesce("run_id", F.lit(0)).desc(), F.col("id").desc()]
    current = lambda **k: {r.line: r.text for r in V.current_rows(facts, ["line"], order, **k).collect()}
    assert current() == {1: "b", 2: "", 3: "f"}
    assert current(as_of=F.col("run_id") <= 1) == {1: "a", 2: "d"}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, v string, c double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "z", 0.5)], "k long, v string, c double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(V.upsert_coalesce(old, new, ["k"])) == [(1, "a", 1.0), (2, "b", 5.0), (3, "z", 0.5)]
    assert rows(V.upsert_coalesce(old, new, ["k"], keep=["c"])) == [(1, "a", 1.0), (2, "b", 2.0), (3, "z", 0.5)]
    assert rows(V.upsert_overwrite(old, new, ["k"])) == [(1, "a", 1.0), (2, None, 5.0), (3, "z", 0.5)]
    assert rows(V.upsert_if_higher(old, new.withColumn("c", F.lit(2.0)), ["k"], "c")) == [(1, "a", 1.0), (2, "b", 2.0), (3, "z", 2.0)]
    assert V.with_missing_columns(old, {"v": "string", "w": "int"}).columns == ["k", "v", "c", "w"]


def test_quotas():
    assert Q.equal_quotas({"a": 2, "b": 10, "c": 10}, 12) == {"a": 2, "b": 5, "c": 5}
    assert Q.weighted_quotas({"a": 100, "b": 100}, 10, {"a": 2, "b": 1}) == {"a": 7, "b": 3}
    assert Q.weighted_quotas({"a": 3, "b": 100}, 10, {"a": 9, "b": 1}, floor=1) == {"a": 3, "b": 7}
    assert sum(Q.equal_quotas({"a": 1}, 9).values()) == 1


@pytest.mark.parametrize("seed", range(6))
def test_scripts_cost_the_edit_distance(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 60))) for _ in range(2))
    for ops in (A.script(a, b), A.anchored(a, b, k=3, chunk=10)):
        assert [i for _, i, _ in ops if i >= 0] == list(range(len(a))) and [j for _, _, j in ops if j >= 0] == list(range(len(b)))
        assert all((a[i] == b[j]) == (k == A.MATCH) for k, i, j in ops if i >= 0 and j >= 0)
    assert sum(k != A.MATCH for k, _, _ in A.script(a, b)) == edit_distance(a, b)
    assert sum(k != A.MATCH for k, _, _ in A.script(a, b, band=80)) == edit_distance(a, b)


def test_infix_and_chain():
    assert A.infix_distance("needle", "hay needle hay") == (0, 4, 10)
    text, pattern = "xxabdxabc", "abc"
    assert A.infix_distance(pattern, text)[0] == 0 and A.infix_distance("", "abc") == (0, 0, 0)
    best = min(edit_distance("aXc", text[i:j]) for i in range(10) for j in range(i, 10))
    assert A.infix_distance("aXc", text)[0] == best
    assert A.chain([(1, 5), (2, 1), (3, 2), (4, 9), (5, 3)]) == [(2, 1), (3, 2), (5, 3)]


def test_projection_gives_lines_their_text():
    lines = ["Gallia est omnis diuisa", "in partes tres quarum vnam", "zzzz qqqq"]
    out = A.project(lines, "Gallia est omnis divisa, in partes tres: quarum unam incolunt")
    assert out[0]["text"].startswith("Gallia est omnis divisa") and out[0]["accepted"] and out[1]["accepted"] and not out[2]["accepted"]
    assert A.project([], "a") == [] and A.project([""], "")[0]["accepted"] is False


def test_decoding():
    frames = np.array([[0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]])
    assert [p[0] for p in D.greedy(frames)] == [1, 1, 2]
    assert D.prefix_beam(frames)[0] == (1, 1, 2)
    # by sums over paths a sequence can beat the best path
    two = np.array([[0.4, 0.6], [0.6, 0.4]])
    assert [p[0] for p in D.greedy(two)] == [1] and D.prefix_beam(np.array([[0.6, 0.4], [0.6, 0.4]]))[0] == (1,)
    assert D.forced_path(frames, [1, 1, 2]) == [0, 0, -1, 1, 2]
    lm = D.ArpaModel("\\data\\\n\\1-grams:\n-1\ta\t-0.5\n-2\tb\n\\2-grams:\n-0.1\ta a\n\\end\\")
    assert lm.score(("a",), "a") == -0.1 and lm.score(("a",), "b") == -2.5 and lm.score((), "zz") == -99


def test_quantiles_bins_and_intervals(spark):
    values = [float(x * x % 97) for x in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = {r.p: r.v for r in E.nearest_rank(df, "v", [0.5, 0.95, 1.0]).collect()}
    assert ranks == {p: sorted(values)[max(0, -(-int(p * 100) * 50 // 100) - 1)] for p in ranks}
    band = E.quantile_band(df, [], "v", (0.25, 0.5, 0.75)).first()
    assert (band.low, band.mid, band.high) == tuple(statistics.quantiles(values, n=4, method="inclusive"))
    pairs = spark.createDataFrame([(1.0, 2.0)] * 40 + [(0.0, 2.0)] * 60, "x double, y double")
    got = E.bootstrap(pairs, [], "x", "y", resamples=300).first()
    assert got.rate == 0.2 and 0.1 < got.low < 0.2 < got.high < 0.3
    k = spark.range(1).select(*(v.alias(n) for n, v in E.wilson(F.lit(8), F.lit(10)).items())).first()
    assert (k.low, k.high) == (pytest.approx(0.4902, abs=1e-3), pytest.approx(0.9433, abs=1e-3))


def test_range_and_overlap_joins(spark):
    rng = random.Random(1)
    spans = [(rng.randint(0, 2), i, lo := rng.randint(-50, 300), lo + rng.randint(0, 90)) for i in range(80)]
    points = [(rng.randint(0, 2), i, rng.randint(-60, 400)) for i in range(120)]
    s = spark.createDataFrame(spans, "g int, s int, lo int, hi int")
    p = spark.createDataFrame(points, "g int, p int, at int")
    found = {(r.p, r.s) for r in L.in_range(p, s, on=["g"], at="at", lo="lo", hi="hi", width=16).collect()}
    assert found == {(i, j) for g, i, at in points for h, j, lo, hi in spans if g == h and lo <= at <= hi}
    t = s.select("g", F.col("s").alias("t"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = [(r.s, r.t) for r in L.overlapping(s, t, on=["g"], a_span=("lo", "hi"), b_span=("lo2", "hi2"), width=16).collect()]
    assert sorted(pairs) == sorted((i, j) for g, i, a, b in spans for h, j, c, d in spans if g == h and a <= d and c <= b)


def test_sequences(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 7), (1, 8), (2, 5)], "g int, at int")
    assert sorted(tuple(r) for r in S.islands(rows, ["g"], "at").collect()) == [(1, 1, 3, 3), (1, 7, 8, 2), (2, 5, 5, 1)]
    lines = spark.createDataFrame([(1, 1, "Haus-"), (1, 2, "tür auf"), (1, 3, "Ost-"), (1, 4, "West")], "g int, n int, t string")
    assert S.joined_lines(lines, ["g"], "n", "t").first().text == "Haustür auf Ost- West"
    mode = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (1, 2, "x"), (1, 4, "y"), (2, 1, None)], "g int, n int, v string")
    assert [tuple(r) for r in S.first_mode(mode, ["g"], "v", "n").collect()] == [(1, "y", 2)]
    assert [r[0] for r in spark.sql("select 'aé😀b' t union all select 'a'").select(S.shingles(F.col("t"), 2)).collect()] == [["aé", "é😀", "😀b"], []]


def test_geometry(spark):
    df = spark.sql("select '0,0 4,0 4,3 0,3' p, '0,0' q")
    r = df.select(G.polygon_area(G.parse_points(F.col("p"))).alias("a"), G.bbox(G.parse_points(F.col("p"))).alias("b"), G.polyline_length(G.parse_points(F.col("p"))).alias("l"), G.polygon_area(G.parse_points(F.col("q"))).alias("z")).first()
    assert (r.a, tuple(r.b), r.l, r.z) == (12.0, (0.0, 0.0, 4.0, 3.0), 11.0, 0.0)
    same = df.select(G.box_iou(G.bbox(G.parse_points(F.col("p"))), G.bbox(G.parse_points(F.lit("2,0 6,3"))))).first()[0]
    assert same == pytest.approx(6 / 18)
    assert df.select(G.distinct_pixels(G.parse_points(F.lit("0,0 0.2,0 1,1")))).first()[0] == [[0.0, 0.0], [1.0, 1.0]]


def test_greedy_pairs_and_exclusive(spark):
    pairs = spark.createDataFrame([(0, 1, 5, 0.9), (0, 1, 6, 0.8), (0, 2, 5, 0.7), (0, 2, 6, 0.6)], "g int, a int, b int, s double")
    assert sorted((r.a, r.b) for r in L.exclusive_pairs(pairs, block=["g"], a="a", b="b", score="s").collect()) == [(1, 5), (2, 6)]
