"""Readers, engines, chains, noise and pools against what they should be."""

import itertools
import json
import random

import oracle
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import chains, engines, lookup, noise, pools
from quillmark.operators.sequences import running
from quillmark.plans import QUERIES, SQL
from quillmark.sources import export, markup
from quillmark.streaming import operators as stream


def documents(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, value string")


def test_letters_of_tei(spark):
    xml = """<TEI xmlns="u"><correspDesc key="16.2"><correspAction type="sent"><persName> Leopold  I. </persName><orgName>Hof</orgName><placeName>Wien</placeName><date when="1680-01-02">2 Jan</date></correspAction>
    <correspAction type="received"><persName>A</persName><placeName/></correspAction></correspDesc><correspDesc key=" "/></TEI>"""
    (r,) = markup.tei_letters(documents(spark, xml, None)).collect()
    assert (r.letter, r.senders, r.addressees, r.place, r.to_place, r.at, r.date_text, r.convolute, r.year) == ("16.2", ["Leopold I.", "Hof"], ["A"], "Wien", None, "1680-01-02", "2 Jan", "LBr 16", 1680)


def test_lines_of_hocr(spark):
    html = """<div class="ocr_page" title="image x; bbox 0 0 100 200; ppageno 3"><span class="ocr_line" title="bbox 1 2 3 4; x_size 11.5"><span class="ocrx_word" title="bbox 1 2 2 4">a</span> <span class="ocrx_word">b&amp;c</span></span>
    <span class="ocr_header" title="bbox 5 6 7 8">head</span><span class="ocr_line" title="bbox 1 1 1 1"> </span></div>"""
    rows = [tuple(r)[1:] for r in markup.hocr_lines(documents(spark, html)).collect()]
    assert rows == [(3, 100.0, 200.0, 1.0, 2.0, 3.0, 4.0, 11.5, "a b&c"), (3, 100.0, 200.0, 5.0, 6.0, 7.0, 8.0, 0.0, "head")]


def test_images_of_mets_and_detections(spark):
    xml = """<mets xmlns="m" xmlns:x="l"><identifier type="iiif"/><fileGrp USE="DEFAULT"><file ID="f1"><FLocat x:href="u1"/></file></fileGrp><fileGrp USE="THUMBS"><file ID="t1"><FLocat x:href="v1"/></file></fileGrp>
    <structMap TYPE="PHYSICAL"><div><div TYPE="page" ORDER="2" ORDERLABEL="1r"><fptr FILEID="f1"/><fptr FILEID="t1"/></div><div TYPE="page"/></div></structMap></mets>"""
    images = markup.with_default_urls(markup.mets_images(documents(spark, xml, "<mets/>")), F.lit("o"), "b")
    assert [tuple(r)[1:] for r in images.orderBy("seq", "label").collect()] == [(2, None, "b/o/jpgs/default/00000002.jpg", "b/o/jpgs/thumbs/00000002.jpg", True), (2, "1r", "u1", "v1", True)]
    found = json.dumps({"image": {"width": 9, "height": 8}, "predictions": [{"class": " Main ", "confidence": 0.5, "points": [{"x": 1.9, "y": 2}, {"x": 3, "y": 4}]}, {"x": 10, "y": 20, "width": 4, "height": 6}, {}]})
    rows = markup.detections(documents(spark, found)).orderBy("zone").collect()
    assert [(r.width, r.zone, r["class"], r.confidence, r.polygon) for r in rows] == [(9, "p0", "Main", 0.5, [[1, 2], [3, 4]]), (9, "p1", None, None, [[8, 17], [12, 17], [12, 23], [8, 23]]), (9, "p2", None, None, [])]
    coco = documents(spark, json.dumps({"images": [{"id": 1, "file_name": "a", "width": 2, "height": 3}, {"id": 2, "file_name": "b", "width": 2, "height": 3}], "annotations": [{"image_id": 1}, {"image_id": 1}], "categories": [{"id": 5, "name": "c"}]}))
    assert {(r.file_name, r.n_annotations) for r in markup.coco_images(coco).collect()} == {("a", 2), ("b", 0)} and markup.coco_categories(coco).first().name == "c"


def test_provenance_and_references(spark):
    row = spark.range(1).select(X.provenance(F.lit("AA I,9 N.12"), F.lit("4711"), F.lit("ia"), F.lit(None).cast("string")).alias("s"))
    assert row.first().s == "AA I,9 N.12 (§70-expired AA reading text; channel ia; katalog 4711)"
    s = F.lit("I,9 (text; channel ia+gwlb; reader k-1; verified me 2026; katalog 4711)")
    r = spark.range(1).select(X.record_of(s), X.reader_of(s), X.verified_by(s), X.channels(s), X.page_of(F.lit("w:0001:003")), X.page_of(F.lit("w:0001#xywh=1,2")), X.page_of(F.lit("w"))).first()
    assert list(r) == ["4711", "k-1", "me 2026", ["ia", "gwlb"], "w:0001", "w:0001", None]


def test_engines_are_made_once_a_task_and_failures_are_rows(spark):
    pairs = spark.createDataFrame([(i, bytes([i]), "x" * (i % 3), "ab"[i % 2]) for i in range(40)], "id int, image binary, text string, g string").coalesce(2)

    def factory():
        made = [0]

        def read(images):
            made[0] += 1
            if any(x[0] == 7 for x in images):
                raise ValueError("seven")
            return [("x" * (x[0] % 3), 0.5) for x in images]

        return read

    rows = {r.id: r for r in engines.transcribed(pairs, factory, key="id").collect()}
    assert len(rows) == 40 and "seven" in rows[7].error and rows[7].text is None and all(rows[i].text == "x" * (i % 3) and rows[i].error is None for i in rows if i != 7)
    found = {r.g: r for r in engines.evaluated(pairs, factory, ["g"], key="id", resamples=50).collect()}
    assert (found["a"].lines, found["a"].exact, found["a"].edits) == (20, 20, 0) and (found["b"].edits, found["b"].exact, found["b"].chars) == (1, 19, sum(i % 3 for i in range(1, 40, 2)))
    assert engines.unread(pairs, pairs.where("id < 30"), ["id"]).count() == 10 and engines.unread(pairs, pairs.where("id < 30"), ["id"], redo=F.col("g") == "a").count() == 25
    speed = engines.rates(engines.transcribed(pairs, factory, key="id"), []).first()
    assert (speed.lines, speed.failed) == (40, 1)


def test_pages_are_segmented_and_their_lines_read(spark):
    pages = spark.createDataFrame([("a", b"\x02"), ("b", b"\x00"), ("c", b"\x09")], "page_id string, image binary")

    def segmenter():
        def lines(image):
            if image[0] == 9:
                raise RuntimeError("broken")
            return [{"baseline": [[0, i], [9, i]], "polygon": None} for i in range(image[0])]

        return lines

    cut = {r.page_id: r for r in engines.segmented(pages, segmenter).collect()}
    assert len(cut["a"].lines) == 2 and json.loads(cut["a"].lines[1].baseline) == [[0, 1], [9, 1]] and cut["b"].skip_reason == "too few lines" and "broken" in cut["c"].skip_reason

    def cropper():
        return lambda image, line: (_ for _ in ()).throw(ValueError("thin")) if line["line_seq"] == 1 else image + bytes([line["line_seq"]])

    read = engines.recognized(pages.join(engines.segmented(pages, segmenter), "page_id"), cropper, lambda: lambda crops: [(c.hex(), 1.0) for c in crops])
    assert [(r.page_id, r.line_seq, r.text, bool(r.error)) for r in read.orderBy("page_id", "line_seq").collect()] == [("a", 0, "0200", False), ("a", 1, None, True)]


def test_the_heaviest_chain_is_the_heaviest():
    rng = random.Random(3)
    for _ in range(150):
        options = [[(rng.choice("abcd"), rng.choice([1.0, 1.5, 2.0])) for _ in range(rng.randint(0, 2))] for _ in range(rng.randint(0, 6))]
        best = 0.0
        for pick in itertools.product(*([None, *o] for o in options)):
            keys = [p[0] for p in pick if p]
            if keys == sorted(keys):
                best = max(best, sum(p[1] for p in pick if p))
        chosen = chains.heaviest_chain(options)
        keys = [k for k in chosen if k]
        weight = sum(max(w for k, w in o if k == c) for o, c in zip(options, chosen, strict=True) if c)
        assert keys == sorted(keys) and weight == pytest.approx(best)


def test_names_in_order_and_rescued(spark):
    rows = [("f", 1, "Arnauld", "arnauld", 2, 0), ("f", 1, "Ernst", "ernst", 5, 1), ("f", 2, "Bernoulli", "bernoulli", 1, 0), ("f", 3, "Krafft", "krafft", 9, 0), ("f", 3, "Cato", "cato", 1, 1), ("f", 4, "Dee", "dee", 1, 0), ("f", 5, "Anton", "anton", 2, 0)]
    df = spark.createDataFrame(rows, "fam string, at int, name string, key string, n int, mention int")
    named = {r.at: r.name for r in chains.names_in_order(df, family="fam", order="at", rescue=4).collect()}
    assert named == {1: "Arnauld", 2: "Bernoulli", 3: "Krafft", 4: "Dee", 5: None}


def test_paths_collapse(spark):
    rows = [([0, 1, 1, 0, 1, 2, 2], [0.9, 0.5, 0.6, 0.9, 0.2, 0.3, 0.1]), ([0, 0], [1.0, 1.0]), ([], [])]
    got = [[tuple(x) for x in r.p] for r in spark.createDataFrame(rows, "path array<int>, s array<double>").select(chains.path_labels(F.col("path"), F.col("s")).alias("p")).collect()]
    assert got == [[(1, 1, 2, 0.6), (1, 4, 4, 0.2), (2, 5, 6, 0.3)], [], []]


def test_noise_is_nested_and_met(spark):
    text = "the quick brown fox jumps over the lazy dog " * 8
    assert noise.corrupted(text, 0.0, "s") == text and noise.corrupted(text, 0.2, "s") == noise.corrupted(text, 0.2, "s") != noise.corrupted(text, 0.2, "t")
    lines = spark.createDataFrame([(i, text[i : i + 60]) for i in range(0, 240, 12)], "id int, t string").withColumns({"piece": F.lit(1), "h": F.col("t")})
    share, rate = noise.calibrated(lines, 0.10, key="id", reference="t", hypothesis="h", seed="s", rounds=10)
    assert abs(rate - 0.10) < 0.02 and 0 < share < 1
    prose = spark.createDataFrame([(i // 10, i, " ".join(random.Random(i).choices("alpha beta gamma delta zeta theta kappa sigma".split(), k=8))) for i in range(30)], "piece int, n int, t string")
    held = {r.level: r for r in noise.held_up(prose, [0.0, 0.3], piece="piece", order="n", text="t", seed="s", threshold=0.5).collect()}
    assert held[0.0].correct == 30 and held[0.0]["yield"] == 1.0 and held[0.3].correct <= 30 and held[0.3].lines == 30


def test_files_are_placed_by_folio(spark):
    pages = spark.createDataFrame([("w1", "p1", 0, "3r"), ("w1", "p2", 1, "3v"), ("w2", "p3", 0, "9")], "work_id string, page_id string, seq int, label string")
    works = spark.createDataFrame([("k1", "w1"), ("k2", "w2")], "key string, work_id string")
    rows = [("a", ["k2", "k1"], [(3, "v"), (9, "r")]), ("b", ["zz"], [(1, "")]), ("c", ["k1"], [(77, "")]), ("d", [], [])]
    files = spark.createDataFrame(rows, "name string, keys array<string>, folios array<struct<num: int, side: string>>")
    assert {r.name: (r.status, r.page_ids) for r in pools.pages_of_folios(files, works, pages).collect()} == {"a": ("matched", ["p2", "p3"]), "b": ("no_work", []), "c": ("no_page", []), "d": ("unparsed", [])}


def test_lines_are_flagged_and_told_apart(spark):
    lines = spark.createDataFrame([("1", "a[b"), ("2", "plain"), (None, "x")], "record_id string, text string")
    hands = spark.createDataFrame([("1", "h", True)], "record_id string, hand string, own boolean")
    assert [(r.hand, r.group) for r in pools.with_hands(lines, hands).orderBy("text").collect()] == [("h", "own"), ("none", "other"), ("none", "other")]
    flagged = pools.excluded(lines, F.array_compact(F.array(F.when(F.col("text").contains("["), "bracket"), F.when(F.length("text") < 2, "short"))), ["short", "bracket"])
    assert {r.text: r.reason for r in flagged.collect()} == {"a[b": "bracket", "plain": None, "x": "short"}
    kept, why = pools.eligible(lines, {"record": F.col("record_id").isNotNull(), "bracket": ~F.col("text").contains("[")})
    assert [r.text for r in kept.collect()] == ["plain"] and {r.reason: r.n for r in why.collect()} == {"record": 1, "bracket": 1}


def test_decisions_must_be_candidates(spark):
    kind = "line_id int, decided_at string, retirement string, cand_id string, text string"
    rows = [(1, "a", "converged", "c1", "x"), (2, "a", "converged", "zz", "x"), (3, "a", "converged", "c3", "other"), (4, "a", "converged", "c4", "x"), (1, "a", "both_rejected", "n", None), (1, "a", "both_rejected", "n", None)]
    decided = spark.createDataFrame(rows, kind)
    candidates = spark.createDataFrame([(i, f"c{i}", "x") for i in (1, 2, 3)], "line_id int, cand_id string, cand_text string")
    plan = pools.decision_plan(decided, decided.select("line_id"), decided.limit(0), candidates).collect()
    assert sorted((r.line_id, r.action) for r in plan) == [(1, "insert"), (1, "queue"), (1, "queued_already"), (2, "winner_not_a_candidate"), (3, "winner_text_differs"), (4, "not_in_fragment_pack")]


def test_running_sums_of_groups_of_any_size(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(7)
    want, sums = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        sums[g] = (sums.get(g, (0, 0))[0] + 1, sums.get(g, (0, 0))[1] + v)
        want[k] = sums[g]
    got = running(running(df, ["g"], ["k"]), ["g"], ["k"], value="v", name="s")
    assert {r.k: (r.n, r.s) for r in got.collect()} == want
    assert [r.n for r in running(df, [], ["k"]).orderBy("k").collect()] == list(range(1, 501)) and running(df.limit(0), ["g"], ["k"]).count() == 0


def test_a_snapshot_rewrites_only_what_a_batch_has(spark, tmp_path):
    path, order = f"file://{tmp_path}/snap", [F.col("at").desc()]
    write = stream.snapshot_writer(path, ["k"], order, buckets=8)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k int, at int, v string")
    write(batch(*((k, 0, "a") for k in range(40))), 0)
    write(batch((3, 1, "b"), (4, -1, "late")), 1)
    write(batch((3, 1, "b"), (4, -1, "late")), 1)  # again after a failure
    write(batch((50, 0, "c")), 5)
    rows = {r.k: r.v for r in stream.snapshot(spark, path).collect()}
    assert rows == {k: "b" if k == 3 else "a" for k in range(40)} | {50: "c"}
    assert {r.k: r.v for r in stream.snapshot(spark, path, below=1).collect()} == dict.fromkeys(range(40), "a")
    assert len(list((tmp_path / "snap" / "version-1").glob("_bucket=*"))) <= 2


def test_a_streamed_bucket_answers_as_the_batch(spark, tmp_path):
    rows = [(i % 3, i * 40 + (i % 7) * 11) for i in range(90)]
    events = spark.createDataFrame(rows, "user int, s long").select("user", F.timestamp_seconds(F.col("s") + 86400).alias("ts"))
    events.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    want = sorted((r.user, r.ts, r.allowed) for r in stream.token_bucket_batch(events, "user", "ts", rate=1 / 300, burst=2.0).collect())
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    made = stream.drain(stream.token_bucket(source, "user", "ts", rate=1 / 300, burst=2.0), "bucket_test", "append", f"{tmp_path}/cp")
    assert sorted((r.user, r.ts, r.allowed) for r in made.collect()) == want and 0 < sum(x[2] for x in want) < len(want)


def test_a_pack_keeps_its_order(spark, tmp_path):
    rows = spark.createDataFrame([(3, "c"), (1, "z"), (2, "a")], "n int, v string")
    head = spark.createDataFrame([("pack",)], "kind string")
    export.jsonl_pack(head, rows, f"{tmp_path}/by", order="n")
    export.jsonl_pack(head, rows.coalesce(1), f"{tmp_path}/as_is")
    lines = lambda name: [json.loads(x) for p in sorted((tmp_path / name).glob("part-*")) for x in p.read_text().splitlines()]
    assert lines("by") == [{"kind": "pack"}, {"v": "z"}, {"v": "a"}, {"v": "c"}]
    assert lines("as_is") == [{"kind": "pack"}, {"n": 3, "v": "c"}, {"n": 1, "v": "z"}, {"n": 2, "v": "a"}]


@pytest.mark.parametrize("name", ["q_placed_letters", "q_citations"])
def test_tables_that_explode_are_not_broadcast(spark, name):
    """By its files a table of sixteen rows a work looks small enough, at any size."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("name", ["q_lookup_shelfmark", "q_lookup_prefix"])
@pytest.mark.parametrize("few", [lookup.FEW_WORKS, 0])
def test_lookups_broadcast_nothing(spark, monkeypatch, name, few):
    """Pages of few works are asked for by id, those of more meet them by a shuffle, and nothing is broadcast; both find the same."""
    monkeypatch.setattr(lookup, "FEW_WORKS", few)
    found = QUERIES[name](spark, SMALL)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    leaves = name == "q_lookup_shelfmark"
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == leaves * (1 if few else 3)
    assert oracle.difference(found, oracle.tables(SMALL), SQL[name]) == ""


@pytest.mark.parametrize("most, exact, found", [(3, (), "abc"), (9, (), "abcdefgh"), (3, "h", "h"), (3, "hgfe", "efg"), (0, (), "")])
def test_works_under_a_shelfmark_are_read_once(spark, monkeypatch, most, exact, found):
    """The first targets, the nearest before others, come of one reading of the works, however many there are."""
    monkeypatch.setattr(lookup, "FEW_WORKS", 3)
    rows = [(w, "LH 4,1,2") for w in "hgfedcba"] + [(w, "LH 4,1") for w in exact] + [("z", "LH 4,10")]
    marks = spark.createDataFrame(rows, "work_id string, key string")
    pages = spark.createDataFrame([], "work_id string, page_id string, seq int, label string")
    unused = marks.limit(0)
    targets = lookup.lookup("LH IV, 1", works=marks, pages=pages, shelfmarks=marks, editions=unused, links=unused, placed=unused, most=most)
    assert "".join(r.work_id for r in targets.collect()) == found
    plan = targets._jdf.queryExecution().sparkPlan().toString()
    assert ("Aggregate" in plan) == (most > lookup.FEW_WORKS)
