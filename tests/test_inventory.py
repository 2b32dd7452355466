"""Inventory, crops, harvests, shapes and corrections against what they should be."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import crops, labels, shapes
from quillmark.operators import alignment, corrections, inventory
from quillmark.operators import twins as T
from quillmark.sources import harvest


def test_a_store_opens_empty_and_grows_columns(spark, tmp_path):
    schemas = {"works": "work_id string, title string, set_name string", "pages": "page_id string"}
    assert inventory.opened_store(spark, f"file://{tmp_path}", schemas)["works"].count() == 0
    spark.createDataFrame([("w",)], "work_id string").write.parquet(f"{tmp_path}/works")
    for _ in range(2):
        found = inventory.opened_store(spark, f"file://{tmp_path}", schemas)
        assert [tuple(r) for r in found["works"].collect()] == [("w", None, None)] and found["pages"].columns == ["page_id"]


def test_targets_files_and_images(spark):
    pages = spark.createDataFrame([("p1", "w1", "u", "s1", "f1", 10, 2000, 1000), ("p2", "w1", "u", None, "f2", None, None, None), ("p3", "w2", None, None, "f3", None, None, None), ("p4", "w2", "u", "s4", "f4", 5, 1000, 500)], "page_id string, work_id string, image_url string, sha256 string, path string, n_bytes long, width int, height int")
    works = spark.createDataFrame([("w1", "a"), ("w2", "b")], "work_id string, set_name string")
    ids = lambda df: sorted(r.page_id for r in df.collect())
    assert ids(inventory.fetch_targets(pages, works)) == ["p2"] and ids(inventory.fetch_targets(pages, works, only_unfetched=False, set_name="b")) == ["p4"] and ids(inventory.fetch_targets(pages, works, only_unfetched=False, work_ids=["w1"])) == ["p1", "p2"]
    files = spark.createDataFrame([("f1", 10, "other"), ("f4", 6, "s4")], "path string, bytes long, digest string")
    assert {r.page_id: r.state for r in inventory.verified_files(pages, files).collect()} == {"p1": "ok", "p2": "unfetched", "p3": "unfetched", "p4": "size"}
    assert {r.page_id: r.state for r in inventory.verified_files(pages, files, deep=True).collect()}["p1"] == "checksum"
    assert {r.set_name: (r.targets, r.fetched, r.bytes, r.mean_bytes) for r in inventory.image_stats(pages, works).collect()} == {"a": (2, 1, 10, 10.0), "b": (1, 1, 5, 5.0), None: (3, 2, 15, 7.5)}
    assert {r["size"]: r.n for r in inventory.size_histogram(pages).collect()} == {"1-3": 1, "0-1": 1}
    twins = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p3"), (2, "p4")], "group_id int, page_id string")
    assert inventory.scans_once(pages, twins).first().scans == 2
    stats = spark.createDataFrame([(10, 0.5, 0.1, 1, 0), (20, 0.7, 0.3, 0, 0)], "n_lines int, region_coverage double, line_height_cv double, n_overlaps int, n_short_lines int")
    assert tuple(inventory.segment_summary(stats).first()) == (2, 15.0, 0.6, 0.2, 0.5, 0.0, 50.0, 0.0) and inventory.segment_summary(stats.limit(0)).first().pct_with_short == 0
    zones = spark.createDataFrame([("p1", "m", 0.5), ("p1", "m", 0.7), ("p2", "n", None)], "page_id string, class string, confidence double")
    assert {r["class"]: (r.total, r.pages_with, r.per_page) for r in inventory.zone_report(zones, pages).collect()} == {"m": (2, 1, 0.5), "n": (1, 1, 0.25)}


def test_volumes_and_letters_in_order(spark):
    volumes = spark.createDataFrame([(2, "1", "1926", 1926), (2, "1", "2006", 2006), (1, "10", None, 1979), (1, "9", None, 1975), (1, "S", None, 2016), (1, "3", None, 1938)], "series int, volume string, edition string, year int")
    today, term = F.lit("2026-06-01").cast("date"), F.lit(70)
    assert [(r.series, r.volume, r.edition) for r in inventory.upcoming(volumes, today, term=term).collect()] == [(1, "9", None), (1, "10", None), (2, "1", "2006"), (1, "S", None)]
    assert [r.volume for r in volumes.where("series = 1").orderBy(*inventory.volume_order(F.col("series"), F.col("volume"), F.col("edition"))).collect()] == ["3", "9", "10", "S"]
    sources = spark.createDataFrame([(1, "3", None), (1, "9", None), (2, "1", None), (2, "1", "1926"), (2, "1", "2006"), (7, "7", None)], "series int, volume string, edition string")
    assert {tuple(r)[:3]: r.free for r in inventory.free_copies(sources, volumes, today, term=term).collect()} == {(1, "3", None): True, (1, "9", None): False, (2, "1", None): False, (2, "1", "1926"): True, (2, "1", "2006"): False, (7, "7", None): False}
    letters = spark.createDataFrame([("16.10", 1680, "1680-01", None), ("16.9", 1680, "1680-01", None), ("2", None, None, None), ("9", 1670, None, "1670")], "letter string, year int, at string, not_before string")
    assert [r.letter for r in inventory.letters_in_order(letters).collect()] == ["9", "16.9", "16.10", "2"]


def test_readings_are_compared(spark):
    lines = spark.createDataFrame([("abcdefghij", "abcdefghij", "abcdefghij"), ("abcdefghij", "abcdefghix", "abcdefghij"), ("a", "abcd", "xyzw"), ("a", "b", ""), ("a", None, "c"), ("a", " ", None)], "m string, a string, b string")
    marked = inventory.buckets(lines, F.col("a"), F.col("b"))
    assert [r.bucket for r in marked.collect()] == ["both_same", "both_same", "both_different", "ours_only", "theirs_only", "neither"]
    assert tuple(inventory.witness_counts(lines.limit(3), F.col("m"), F.col("a"), F.col("b")).first()) == (1, 1, 1)
    pages = spark.createDataFrame([("abcdefghij", "abcdefghij"), ("abcdefghij", "abcdefgxyz"), ("", "x"), ("", " ")], "p string, c string")
    q = inventory.extraction_quality(pages, "p", "c").first()
    assert (q.sampled, q.flagged, q.empty_disagreements, round(q.mean_cer, 4)) == (4, 2, 1, 0.325)
    verdicts = spark.createDataFrame([("1", "correct", "a  b"), ("2", "Wrong", "x"), ("3", "wrong", "x"), ("4", "boundary", "x"), ("5", "unreadable", "x"), ("6", "?", "x"), ("7", "correct", "old"), ("8", "correct", "x"), ("9", "correct", "x")], "ref string, verdict string, shown string")
    rows = spark.createDataFrame([("1", "a b"), ("2", "y"), ("3", "y"), ("4", "y"), ("7", "new"), ("9", "x"), ("9", "x")], "ref string, text string")
    plan = inventory.verified_plan(verdicts, rows, spark.createDataFrame([("2", "fixed")], "ref string, corrected string"))
    assert {r.ref: (r.action, r.text) for r in plan.collect()} == {"1": ("confirm", "a b"), "2": ("correct", "fixed"), "3": ("wrong without a text", None), "4": ("boundary without a text", None), "5": ("unreadable", None), "6": ("unjudged", None), "7": ("text has changed", None), "8": ("no row", None), "9": ("several rows", None)}
    sheet = inventory.verdicts_from_sheet(spark.createDataFrame([("1", "OK "), ("2", "other text"), ("3", None)], "ref string, said string"), rows.withColumn("stratum", F.lit("s")).where("ref < '4'"), {"ok": "correct"})
    assert {r.ref: r.verdict for r in sheet.collect()} == {"1": "correct", "2": "wrong", "3": ""}
    kept, out = inventory.corpora(spark.createDataFrame([("1", "de", ["a", "b"]), ("2", "la", ["c"]), ("3", "de", ["d"])], "record_id string, `group` string, lines array<string>"), spark.createDataFrame([("3",)], "record_id string"), ["de"])
    assert [r.line for r in kept.collect()] == ["a", "b"] and {r.reason: r.records for r in out.collect()} == {"held_out": 1, "other_language": 1}
    who = spark.createDataFrame([(3, 5, True), (0, 5, True), (3, 5, False), (6, 5, False), (0, 0, False)], "a int, b int, s boolean").select(inventory.winner(F.col("a"), F.col("b"), F.col("s")).alias("w"))
    assert [r.w for r in who.collect()] == ["ours", "stored", "stored", "ours", "none"]
    rates = inventory.type_rates(spark.createDataFrame([("f", "mẽ¬", "me-"), ("r", "ab", "ax")], "k string, r string, h string"), "k", "r", "h")
    assert {r.k: (r.lines, r.rate) for r in rates.collect()} == {"f": (1, 0.0), "r": (1, 0.5), None: (2, 0.2)}


def test_twins_are_confirmed_by_their_boxes(spark):
    found = spark.createDataFrame([("w", 0, "a", 0), ("w", 0, "b", 1), ("w", 2, "c", 2), ("w", 2, "d", 3)], "work_id string, `group` int, page_id string, seq int")
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), map(float, v), strict=True))
    boxes = spark.createDataFrame([("a", box(0, 0, 9, 9)), ("b", box(0, 0, 9, 9)), ("c", box(0, 0, 9, 9)), ("d", box(50, 50, 60, 60))], "page_id string, box struct<x0: double, y0: double, x1: double, y1: double>")
    assert sorted(r.page_id for r in inventory.confirmed_twins(found, boxes, T.agreement).collect()) == ["a", "b"]


def test_greedy_twins_against_the_rule(spark):
    rng = random.Random(8)
    rows = [("w", 10, 20, f"p{i}", i, rng.randint(0, 9000), f"{i + 1}{rng.choice('rv')}") for i in range(30)]
    pages = spark.createDataFrame(rows, "work_id string, width int, height int, page_id string, seq int, n_bytes int, label string")
    close = lambda a, b: abs(a - b) <= max(1024, 0.001 * max(a, b))
    members = sorted(((b, s, lab[-1]) for _, _, _, _, s, b, lab in rows))
    pairs = sorted((y[0] - x[0], x[1], y[1]) for i, x in enumerate(members) for y in members[i + 1 :] if close(x[0], y[0]) and x[2] != y[2])
    size, taken, groups = {s: b for b, s, _ in members}, set(), []
    for _, a, b in pairs:
        if not {a, b} & taken:
            groups.append([a, b])
            taken |= {a, b}
    for _, s, _ in members:
        if s not in taken:
            for g in groups:
                if len(g) < 3 and all(close(size[s], size[x]) for x in g):
                    g.append(s)
                    break
    found = {}
    for r in T.candidates(pages).collect():
        found.setdefault(r.group, set()).add(r.seq)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))


def test_crops_and_pixels(spark):
    assert crops.drop_reason([[0, 0], [2, 0]], [[0, 0]], 10, 10) == "short_baseline" and crops.drop_reason([[0, 0], [9, 0]], [], 10, 10) is None
    assert crops.crop_size(np.array([[0, 0], [30, 40]], float), np.array([[0, 0], [30, 0], [30, 40]], float)) == (52, 52)
    bent, around = np.array([[0, 0], [10, 0], [10, 10]], float), np.array([[0, -2], [12, -2], [12, 10], [8, 10], [8, 2], [0, 2]], float)
    xs, ys = [], []
    for px, py in around:  # each point along the segment it overshoots least
        over = []
        for k, ((ax, ay), (bx, by)) in enumerate(itertools.pairwise(bent)):
            n = math.hypot(bx - ax, by - ay)
            along = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n
            beside = ((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / n
            over.append((max(-along, along - n), k, along + 10 * k, beside))
        xs.append(min(over)[2]), ys.append(min(over)[3])
    assert crops.crop_size(bent, around) == (int(max(xs)) - int(min(xs)) + 1, int(max(ys)) - int(min(ys)) + 1)
    assert crops.crop_size(np.array([[0, 0], [0, 0], [1, 1]], float), around) is None
    assert crops.drop_reason([[0, 0], [9000, 0], [0, 1]], [[0, -5000], [9000, -5000], [9000, 5000]], 10, 10).startswith("oversize_crop:")
    rows = spark.createDataFrame([("[[0,0],[2,0]]", None, None, None), (None, None, 1, 1)], "b string, p string, w int, h int").select(crops.crop_reason("b", "p", "w", "h").alias("r")).collect()
    assert [r.r for r in rows] == ["short_baseline", "short_baseline"]
    square = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n]]
    assert crops.overlap(square(0, 0, 10), square(5, 5, 10)) == (25, 100, 100) and crops.polygon_iou(square(0, 0, 10), square(5, 5, 10)) == 25 / 175 and crops.polygon_iou([], []) == 0
    star = [[0, 0], [10, 0], [10, 10], [5, 5], [0, 10]]
    assert int(crops.mask(star, 0, 0, 10, 10).sum()) == pytest.approx(75, abs=6)
    assert crops.zone_shares(square(0, 0, 10), {"main": [square(0, 0, 5), square(0, 5, 5)], "other": [square(100, 100, 5)]}) == {"main": 0.5, "other": 0.0}
    got = spark.createDataFrame([(square(0, 0, 4), square(2, 0, 4))], "a array<array<int>>, b array<array<int>>").select(crops.iou_of("a", "b").alias("i")).first().i
    assert got == 8 / 24


def plan(name):
    return f"https://h/{name}/0", lambda data: json.loads(data).get("next")


def fetch(url):
    head, _, n = url.rpartition("/")
    return json.dumps({"at": url, "next": f"{head}/{int(n) + 1}" if int(n) < 2 else None}).encode()


def test_harvests_wait_retry_cache_and_go_on(spark, tmp_path):
    now, calls = [0.0], []

    def flaky(url):
        calls.append((url, now[0]))
        if len(calls) == 1:
            raise OSError("once")
        return b"ok"

    client = harvest.PoliteClient(flaky, interval=2.0, pause=5.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert client.get("https://a/1") == b"ok" and client.get("https://a/2") == b"ok" and client.get("https://b/1") == b"ok"
    assert [t for _, t in calls] == [0.0, 5.0, 7.0, 7.0]
    cache = harvest.Cache(str(tmp_path / "cache"))
    first, following = plan("s")
    assert len(list(harvest.answers(first, following, cache, fetch, most=2))) == 2
    asked = []
    assert len(list(harvest.answers(first, following, cache, lambda u: asked.append(u) or fetch(u)))) == 3 and asked == ["https://h/s/2"]
    assert len(list(harvest.answers(first, following, cache, None))) == 3
    spark.dataSource.register(harvest.HarvestSource)
    options = {"sets": '["s", "t"]', "plan": "tests_harvest_plan:plan", "cache": str(tmp_path / "cache")}
    (tmp_path / "tests_harvest_plan.py").write_text("import json\ndef plan(name):\n    return f'https://h/{name}/0', lambda data: json.loads(data).get('next')\n")
    spark.sparkContext.addPyFile(str(tmp_path / "tests_harvest_plan.py"))
    rows = spark.read.format("harvest").options(**options).load().collect()
    assert sorted((r.set, r.number) for r in rows) == [("s", 0), ("s", 1), ("s", 2)]
    records = spark.createDataFrame([("x", "b", 1), ("x", "a", 2), ("y", "b", 3)], "id string, set string, v int")
    assert {r.id: r.v for r in harvest.owned_by_first(records, ["a", "b"], "id").collect()} == {"x": 2, "y": 3}
    assert harvest.deepened(lambda s: (s[1] - s[0] + 1) * 10, (1670, 1679), 30) == [(1670, 1671), (1672, 1672), (1673, 1674), (1675, 1676), (1677, 1677), (1678, 1679)]


def test_shapes():
    schema = {"type": "object", "required": ["id", "tags"], "additionalProperties": False, "properties": {"id": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "minItems": 1, "items": {"$ref": "#/defs/tag"}}, "n": {"type": ["number", "null"]}}, "defs": {"tag": {"enum": ["a", "b"]}}}
    assert shapes.faults({"id": 2, "tags": ["a"], "n": None}, schema) == []
    assert shapes.faults({"id": 0, "tags": ["c"], "x": 1}, schema) == ["$.id: under 1", '$.tags[0]: must be one of ["a", "b"]', "$: x is not known"]
    assert shapes.faults({"id": True, "tags": []}, schema) == ["$.id: expected integer", "$.tags: fewer items than 1"] and shapes.faults([], schema) == ["$: expected object"]
    assert shapes.faults(1, {"const": True}) and shapes.faults(math.inf, {"type": "number"}) == ["$: not finite"] and not shapes.faults(1.0, {"type": "integer"})


def test_notes_give_edits_and_edits_lines(spark):
    assert corrections.edits_in('“alpha” instead of "alpa"; missing "x" before "y"; added "," after "inter se"') == [("replace", "alpa", "alpha", ""), ("insert", "", "x", "before:y"), ("delete", ",", "", "after:inter se")]
    assert corrections.edits_in('it reads "the line".') == [("line", "", "the line", "")] and corrections.edits_in(None) == [] and corrections.edits_in('"a" -> "b"') == [("replace", "a", "b", "")]
    c = corrections.corrected
    assert c("the alpa is", "replace", "alpa", "alpha", "") == "the alpha is" and c("a a", "replace", "a", "b", "") is None and c("l’on dit", "replace", "l'on", "on", "") == "on dit"
    assert c("one three", "insert", "", "two", "before:three") == "one two three" and c("one three", "insert", "", "two", "after:one") == "one two three" and c("one", "insert", "", "two", "end") == "one two" and c("Ro", "insert", "", "y", "end") == "Roy"
    assert c("inter se, quod", "delete", ",", "", "after:inter se") == "inter se quod" and c("one two,", "delete", "two", "", "end") == "one" and c("one two", "delete", "one", "", "start") == "two" and c("one two one", "delete", "one", "", "") is None
    row = spark.createDataFrame([('"b" instead of "a"', "x a"), ("nothing", "x")], "n string, t string").select(corrections.with_edits("t", corrections.note_edits("n")).alias("r")).collect()
    assert [r.r for r in row] == ["x b", None]


def test_heads_names_tokens_bands_and_hyphens(spark):
    assert [labels.head_pieces(t) for t in ("N. 13. 14", "N. II", "N. 9 I. HAUS", "N. 1 1", "none")] == [["13", "14"], ["11"], ["9"], ["11"], []]
    assert labels.written_names("Brand,H. (KorrespDB) (GND)?(GND)u.a.") == ["Brand, H. ?", "u.a."] and labels.model_char("É") == "e" and labels.model_char("&") is None and labels.model_char(" ") == " "
    assert labels.patch_tokens(280, 56) == 20 and labels.patch_tokens(10_000, 10_000) <= 4784 and labels.engine_query(["a"], [["b", "c"]], [["d"], ["e", "f"]]) == '-d -"e f" "b c" a'
    assert spark.range(1).select(labels.work_ids(F.lit("http://x/resolve?id=00068371&y resolve?id=00068371"))).first()[0] == ["00068371"]
    assert list(alignment.band_path(4, 8, [])) == [0, 2, 4, 6, 8] and list(alignment.band_path(6, 9, [(2, 3), (4, 7)])) == [1, 2, 3, 5, 7, 8, 9]
    assert alignment.kept_hyphens(["quod po-", "test esse -", "x"], "quod potest esse x", {0: (0, 7), 1: (7, 17), 2: (17, 18)}) == {0: "-"}
