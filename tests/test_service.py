"""Bookkeeping, datasets, served texts, draws and labels against what they should be."""

import hashlib
import json
import math
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.functions import labels as B
from quillmark.operators import draws, ledger, lookup, postings, reports, serving
from quillmark.sources import datasets

RUNS = ledger.RUN


def test_a_run_is_opened_finished_and_found_again(spark):
    runs = spark.createDataFrame([], RUNS)
    runs, one = ledger.opened(runs, "recognize", at="2026-01-01", model="m", params={"a": 1}, scope="de")
    runs, two = ledger.recorded(runs, "crowd", at="2026-01-02", n_input=3, n_ok=2, n_failed=1)
    assert (one, two) == (1, 2)
    assert ledger.open_run(runs, stage="recognize", model="m", scope="de").first().run_id == 1
    assert ledger.open_run(runs, stage="recognize", model="m", scope=None).count() == 0
    runs = ledger.finished(runs, 1, at="2026-01-03", n_ok=5)
    rows = {r.run_id: r for r in runs.collect()}
    assert rows[1].n_ok == 5 and rows[1].n_failed is None and json.loads(rows[1].params) == {"a": 1} and rows[2].n_failed == 1
    assert ledger.open_run(runs, stage="recognize", model="m", scope="de").count() == 0


def test_lines_are_replaced_by_run_and_states_set(spark):
    kind = "page_id string, line_seq int, run_id long, text string"
    lines = spark.createDataFrame([("p", 1, 1, "a"), ("p", 1, 2, "b"), ("p", 2, 1, "c")], kind)
    put = ledger.lines_put(lines, spark.createDataFrame([("p", 1, 2, "B"), ("q", 1, 1, "d")], kind))
    assert {tuple(r) for r in put.collect()} == {("p", 1, 1, "a"), ("p", 1, 2, "B"), ("p", 2, 1, "c"), ("q", 1, 1, "d")}
    pages = spark.createDataFrame([("p", "new", None), ("q", "new", None)], "page_id string, status string, skip_reason string")
    done = ledger.states_set(pages, spark.createDataFrame([("q", "skipped", "blank")], "page_id string, status string, skip_reason string"))
    assert {tuple(r) for r in done.collect()} == {("p", "new", None), ("q", "skipped", "blank")}
    owned = ledger.with_owner(spark.createDataFrame([(None, "I,3 N. 4 (text; channel ia; katalog 77)"), ("5", "katalog=6"), (None, "x")], "record_id string, source string"))
    assert [r.record_id for r in owned.collect()] == ["77", "5", None]


def test_rules_are_enforced_and_references_kept(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, conf double")
    rules = {"share": F.col("conf").between(0, 1), "id": F.col("id") > 0}
    assert {tuple(r) for r in ledger.violations(rows, rules).collect()} == {("share", 2)}
    assert ledger.checked(rows.where("id = 1"), rules).count() == 1
    with pytest.raises(Exception, match="broken rule: share"):
        ledger.checked(rows, rules).collect()
    old, new, used = (spark.createDataFrame([(x,) for x in ids], "id int") for ids in ([1, 2, 3], [1, 3, 4], [1, 3, 9]))
    assert ledger.replaced_wholesale(old, new, used, "id").count() == 3
    with pytest.raises(ValueError, match="2"):
        ledger.replaced_wholesale(old, new, old, "id")
    decided = ledger.decided(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, at string"), spark.createDataFrame([(2, "b")], "id int, at string"), ["id", "at"])
    assert [r.id for r in decided.collect()] == [1]


def test_a_dataset_is_typed_counted_and_checked(spark, tmp_path):
    terms = {"ia": "open", "gwlb": "nc"}
    rows = [(1, "a\n b", "channel=ia", "open"), (2, "c", "channel=ia+gwlb", "open"), (3, "d", "channel ia; katalog 1", "nc"), (4, "e", None, "open"), (5, "f", "channel=zz", "open")]
    tables = {"gt_lines": spark.createDataFrame(rows, "id long, text string, source string, license_bucket string")}
    tally = {"chars": F.sum(F.length("text"))}
    specs = {name: [datasets.TableSpec("gt_lines", "id long, text string, extra string", datasets.ground_truth(name, terms), tally)] for name in ("open", "nc")}
    found = datasets.write_all(specs, tables, str(tmp_path))
    assert found == {"open": {"gt_lines": {"rows": 2, "chars": 4}}, "nc": {"gt_lines": {"rows": 1, "chars": 1}}}
    back = spark.read.parquet(f"{tmp_path}/open/gt_lines")
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(1, "a b", None), (4, "e", None)]
    for r in datasets.checksums(spark, specs["nc"], f"{tmp_path}/nc").collect():
        data = (tmp_path / "nc" / "gt_lines" / r.file).read_bytes()
        assert r.bytes == len(data) and r.sha256 == hashlib.sha256(data).hexdigest()
    census = {(r.deposit, r.channel): r.n for r in datasets.deposit_census(tables["gt_lines"], terms).collect()}
    assert census == {("open", "ia"): 1, ("nc", "ia+gwlb"): 1, ("none", "ia"): 1, ("open", "(not recorded)"): 1, ("none", "zz"): 1}


def test_served_texts_manifests_and_trees(spark):
    pages = spark.createDataFrame([("w", 0, "w:0000", "1r", "u0", 10, 20), ("w", 1, "w:0001", None, "u1", 10, 20)], "work_id string, seq int, page_id string, label string, image_url string, width int, height int")
    lines = spark.createDataFrame([("w:0000", 2, 0.5, "b\tc", [[1, 2], [4, 9]]), ("w:0000", 1, None, "a", None), ("w:0000", 3, 0.1, "", None)], "page_id string, line_seq int, conf double, text string, polygon array<array<int>>").withColumn("baseline", F.lit(None).cast("array<array<int>>"))
    assert [(r.n_lines, r.mean_conf, r.text) for r in serving.page_texts(lines).collect()] == [(2, 0.5, "a\nb\tc")]
    assert serving.page_texts(lines, fmt="tsv").first().text == "line\tconfidence\ttext\n1\t\ta\n2\t0.5000\tb c"
    texts = serving.page_texts(lines)
    blocks = [r.block for r in serving.page_blocks(pages, texts).orderBy("seq").collect()]
    assert blocks == ["## fol. 1r — w:0000\na\nb\tc\n", "## canvas 1 — w:0001\n# No recognised text on this page.\n"]
    head = serving.work_headers(pages, texts).first()
    assert (head.pages, head.with_text, head.n_lines, head.mean_conf) == (2, 1, 2, 0.5)
    works = spark.createDataFrame([("w", "T", "LH", 3, "LH 3", "s", 1)], "work_id string, title string, family string, section int, shelfmark string, set_name string, place int")
    made = json.loads(serving.manifests(works, pages, "https://x").first().manifest)
    assert [c["id"] for c in made["items"]] == ["https://x/canvas/w:0000", "https://x/canvas/w:0001"] and made["label"] == {"none": ["T"]}
    assert made["items"][0]["items"][0]["items"][0]["body"] == {"id": "u0", "type": "Image", "width": 10, "height": 20}
    boxed = lines.withColumn("box", serving.line_box())
    notes = json.loads(serving.annotation_pages(boxed, "https://x").first().annotations)["items"]
    assert [n["target"] for n in notes] == ["https://x/canvas/w:0000", "https://x/canvas/w:0000#xywh=1,2,3,7"] and notes[1]["body"]["value"] == "b\tc"
    assert json.loads(serving.tree(works).first().json) == [{"section": 3, "entries": [{"work_id": "w", "shelfmark": "LH 3", "title": "T"}]}]
    assert serving.tree(works, set_name="other").count() == 0
    records = spark.createDataFrame([("r", "w", "LH 3 Bl. 1"), ("q", "w", "LH 3")], "record_id string, work_id string, shelfmark string")
    assert [(r.record_id, r.page_id, r.text) for r in serving.record_texts(records, pages, texts).collect()] == [("r", "w:0000", "a\nb\tc")]
    placed = serving.records_in_order(spark.createDataFrame([("w", "b", None), ("w", "a", None), ("w", "z", 1)], "work_id string, record_id string, first_seq int"))
    assert [r.record_id for r in placed.orderBy("place").collect()] == ["z", "a", "b"]


def test_gold_and_minority_quotas():
    for rows, truth, wrong, rate, share in ((100, 50, 20, 0.1, 0.3), (100, 2, 20, 0.1, 0.3), (7, 9, 9, 0.5, 1.0), (10, 0, 0, 0.5, 0.5), (100, 0, 9, 0.2, 0.25)):
        best = max(((t + b, b, t) for t in range(truth + 1) for b in range(wrong + 1) if t + b <= math.floor(rate * rows + 1e-9) and b <= math.floor(share * (t + b) + 1e-9)), default=(0, 0, 0))
        assert draws.gold_counts(rows, truth, wrong, rate, share) == (best[2], best[1])
    assert draws.minority_quotas({"a": 5, "b": 5}, {"a": 4, "b": 1}, {"a": 8, "b": 10}, 5) == {"a": 4, "b": 1}
    assert draws.minority_quotas({"a": 5}, {}, {"a": 8}, 3) == {"a": 0}


def test_rows_are_drawn_around_gold(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 5 == 0) for i in range(200)], "id int, stratum string, own boolean")
    gold = spark.createDataFrame([(i,) for i in (0, 1, 2)], "id int")
    drawn = draws.with_gold(rows, stratum="stratum", key="id", minority="own", gold=gold, quotas={"a": 12, "b": 6}, minority_quota={"a": 4, "b": 2}, seed=1).collect()
    assert Counter(r.stratum for r in drawn) == {"a": 12, "b": 6} and {0, 1, 2} <= {r.id for r in drawn if r.gold}
    assert Counter((r.stratum, r.own) for r in drawn if not r.gold) == {("a", True): 4, ("a", False): 6, ("b", True): 2, ("b", False): 3}
    few = rows.where("own or id < 10")
    scarce = draws.with_gold(few, stratum="stratum", key="id", minority="own", gold=gold, quotas={"a": 14}, minority_quota={"a": 1}, seed=1).where("stratum = 'a'").collect()
    assert len(scarce) == 14 and sum(not r.own for r in scarce) == few.where("stratum = 'a' and not own").count()


def test_quartiles_are_the_exclusive_ones(spark):
    groups = {"a": [3.0, 1.0, 8.0, 5.5, 2.0, 9.0, 9.0], "b": [4.0, 1.0], "c": [7.0], "d": [1.0, 2.0, 4.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for r in reports.quartiles(rows, ["g"], "v").collect():
        want = statistics.quantiles(groups[r.g], n=4) if len(groups[r.g]) > 1 else groups[r.g] * 3
        assert [r.q1, r.q2, r.q3] == pytest.approx(want) and r.n == len(groups[r.g])


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("13 b. VON DER Kunst zu FINDEN", ("13", "b")), ("i. HAUS BRAUNSCHWEIG", ("1", "")), ("1. Que la raison", None), ("", None)])
def test_headings(spark, text, want):
    found = one(spark, B.heading(F.col("t")), t=text)
    assert (found and tuple(found)) == want


def test_names_and_titles(spark):
    assert one(spark, B.convolute(F.col("k")), k="16.2") == "LBr 16" and one(spark, B.convolute(F.col("k")), k="I.6.1") == "LBr f,6" and one(spark, B.convolute(F.col("k")), k="x") is None
    assert one(spark, B.section_phrase(F.col("t")), t="Handschriften LH 3") == "Handschriften" and one(spark, B.section_phrase(F.col("t")), t="zur Mathematik LH 35, 3 A") == "Mathematik" and one(spark, B.section_phrase(F.col("t")), t="nothing") is None
    assert one(spark, B.truncated(F.col("t"), 10), t="one two, three") == "one two…" and one(spark, B.truncated(F.col("t"), 10), t="x" * 20) == "x" * 10 + "…" and one(spark, B.truncated(F.col("t"), 10), t=" a  b ") == "a b"
    assert one(spark, B.cell_names(F.col("c")), c="Brand,H. (KorrespDB) (GND)Ilgen ? (GND)?") == ["Brand, H.", "Ilgen"]
    assert one(spark, B.catalogue_spelling(F.col("m")), m="LH IV, 6, 18 Bl. 3") == "LH 4, 6, 18" and one(spark, B.catalogue_spelling(F.col("m")), m="LBr. F 20") == "LBrF 20" and one(spark, B.catalogue_spelling(F.col("m")), m="Ms 4") is None
    shown = B.display_title(F.col("t"), F.lit("LBr"), F.lit("LBr. 16"), F.lit("Arnauld"), ["the papers"])
    assert one(spark, shown, t="The  Papers") == "LBr. 16 · Arnauld" and one(spark, shown, t="Own title") is None
    assert one(spark, B.record_title(F.col("m")), m='{"titel": " a\\n b "}') == "a b" and one(spark, B.best_family(F.array(F.lit("Ms"), F.lit("LH 3"), F.lit("LBr 4")))) == "LBr"


def test_folds_of_names_print_and_model(spark):
    assert B.name_fold("Düßé") == "dusse" and B.print_fold("mẽ¬ x’") == "me- x'" and B.model_line("a  b\x07") == "a b"
    assert B.corpus_line("a é") == "a <space> é" and B.model_token(" ") == "<U+00A0>" and B.model_token("<unk>").startswith("<U+")
    assert B.clean_print("U¨ber (cid:104)x(cid:105)(cid:9)") == "Über ⟨x⟩"
    assert B.without_brackets("salutare[s] couvents[,] Ludolf [Georg [x] y] ⟨Hand:⟩ r]") == ("salutares couvents, Ludolf r", 2, 2, 1, 1)
    rows = spark.createDataFrame([("a[b]",), (None,)], "t string").select(B.resolve_brackets("t").alias("r"), B.fold_names("t").alias("f")).collect()
    assert rows[0].r.text == "ab" and rows[0].r.attached == 1 and rows[1].r.text is None and rows[1].f is None


def test_small_rules(spark):
    assert one(spark, B.stop_kind(F.col("r"), {"end": ["stop", "end_turn"], "length": ["max_tokens"]}), r=" STOP ") == "end"
    assert one(spark, B.stop_kind(F.col("r"), {"end": ["stop"]}), r="odd") == "other:odd"
    assert one(spark, B.reply_status(F.lit("length"), F.lit(""))) == "runaway" and one(spark, B.reply_status(F.lit("end"), F.lit(" "))) == "empty"
    assert one(spark, B.heavy_layout(F.lit(10), F.lit(2), F.lit(0))) is True and one(spark, B.heavy_layout(F.lit(0), F.lit(2), F.lit(0))) is False
    gate = B.text_gate(F.array(F.lit("IV,3")), F.array(F.lit("IV,3")), F.col("d"))
    assert one(spark, gate, d="open") is None and one(spark, gate, d="nc") == "nc_channel" and one(spark, B.text_gate(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit("open"))) == "no_volume"
    assert one(spark, B.zone_group(F.col("z"), {"MainZone": "main"}), z="MainZone") == "main" and one(spark, B.zone_group(F.col("z"), {}), z="MathZone") == "formula"
    assert one(spark, B.mean_token_probability(F.array(F.lit(1), F.lit(2)), F.array(F.lit(0.0), F.lit(-1.0)), [2])) == 1.0
    assert one(spark, B.first_of(F.array(F.lit("b"), F.lit("a")), ["a", "b"])) == "a" and tuple(one(spark, B.split_ref(F.lit("w:0003:012")))) == ("w:0003", 12)
    assert one(spark, serving.own_half(F.lit(3.0), F.lit(5.0), F.lit("v"))) is True


def test_an_index_reads_only_the_cells_of_a_query(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma delta" + " alpha" * (i % 2)) for i in range(30)], "id int, t string").withColumn("w", F.split("t", " "))
    index = postings.build(docs, str(tmp_path), key="id", fields={"t": (F.col("w"), 1.0)})
    plan = postings.scored(index, spark, "alph")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    assert postings.scored(index, spark, "").count() == 0 and postings.scored(index, spark, '-alpha').count() == 0
    assert {r.id for r in postings.scored(index, spark, '"alpha beta1" -"delta alpha"').collect()} == {i for i in range(30) if i % 3 == 1 and i % 2 == 0}
    assert {r.id for r in postings.scored(index, spark, "beta1 beta2", any_word=True).collect()} == {i for i in range(30) if i % 3}


def test_places_of_folios_and_records(spark):
    pages = spark.createDataFrame([("w", "p1", 1, "3v"), ("w", "p0", 0, "3r"), ("w", "p2", 2, None)], "work_id string, page_id string, seq int, label string")
    assert [(r.num, r.pages) for r in lookup.pages_by_folio(pages).collect()] == [(3, ["p0", "p1"])]
    links = spark.createDataFrame([("r1", "w", 0.7, "key"), ("r2", "w", 1.0, "id")], "record_id string, work_id string, confidence double, method string")
    records = spark.createDataFrame([("r1", "t1"), ("r2", "t2")], "record_id string, title string")
    assert [[x.title for x in r.records] for r in lookup.records_of_works(links, records).collect()] == [["t2", "t1"]]
