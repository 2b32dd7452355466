import datetime

from pyspark.sql import functions as F

from quillmark.functions import catalog as C
from quillmark.operators import corpus, twins


def rows(spark, data, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + schema)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("i").select(*columns).collect()]


def test_cells(spark):
    dates = [("17000202", "123"), ("17000000", None), ("17000200", "000100"), ("um 1700", ""), (None, "000123")]
    assert rows(spark, dates, "a string, b string", C.date_cell(F.col("a"), F.col("b"))) == ["1700-02-02 (00-01-23)", "1700", "1700-02 (00-01)", "um 1700", ""]
    assert rows(spark, [("KA", "12", "b"), ("", "7", ""), ("KA", "", "x")], "a string, b string, c string", C.number_cell(F.col("a"), F.col("b"), F.col("c"))) == ["KA 12/b", "7", ""]
    assert rows(spark, [("4", "6.20"), ("0", "1"), ("16", "0"), (None, "ca. 3"), ("8", "")], "a string, b string", C.extent_cell(F.col("a"), F.col("b"))) == ["4°, 6.2 Seiten/Spalten", "1 Seite/Spalte", "16°", "ca. 3", "8°"]
    cells = [("III", "2", "45", "a", "2"), ("VI", "", "", "", ""), ("", "1", "1", "", ""), ("I", "3", "12b", "", ""), ("I", "3", "1234", "", "")]
    assert rows(spark, cells, "a string, b string, c string, d string, e string", C.edition_cell(*map(F.col, "abcde"))) == ["III | 2.045 / a Aufl. 2", "VI", "", "I | 3.12b", "I | 3.1234"]


def test_hands_and_names(spark):
    kinds = ["eigh. Konz.", "eigh.", "Abschr., eigh. Korr.", "Abschr.", "", None, "Konz.; eigh. Reinschr. u. a."]
    assert rows(spark, [(k,) for k in kinds], "a string", C.hand(F.col("a"))) == ["own", "own", "partial", "other", "none", "none", "own"]
    forms = ["Doe, Jane"]
    assert rows(spark, [("Doe,  Jane (GND)",), ("doe, jane, (KorrespDB) (GND)",), ("Doe, John",), (None,)], "a string", C.is_person(F.col("a"), forms)) == [True, True, False, False]


def test_strata_and_deposits(spark):
    pages = [(0, 0, 0, 0.0), (3, 0, 0, 0.9), (20, 0, 1, 0.1), (20, 5, 8, 0.1), (20, 11, 0, 0.1), (20, 2, 1, 0.1)]
    assert rows(spark, pages, "n int, o int, s int, c double", C.stratum_of_page(*map(F.col, "nosc"))) == ["unknown", "scrap", "fair_copy", "heavy_revision", "heavy_revision", "light_revision"]
    both = [("fair_copy", "heavy_revision"), ("heavy_revision", "heavy_revision"), (None, "scrap"), ("scrap", "fair_copy"), (None, None), ("light_revision", "fair_copy")]
    assert rows(spark, both, "a string, b string", C.stratum_of_piece(F.col("a"), F.col("b"))) == ["light_revision", "heavy_revision", "scrap", "scrap", "unknown", "light_revision"]
    assert rows(spark, [("Reinschrift",), ("Notiz",), ("Brief",), (None,)], "a string", C.stratum_of_kind(F.col("a"))) == ["fair_copy", "scrap", None, None]
    registry = {"a": "open", "x": "nc", "z": None}
    of = [(["a"], "open"), (["a", "x"], "open"), (["q"], "open"), (["z", "x"], "nc"), ([], "open"), ([], "nc"), (None, "open"), (["a"], "nc")]
    assert rows(spark, of, "c array<string>, b string", C.deposit(F.col("c"), F.col("b"), registry)) == ["open", "nc", None, None, "open", None, "open", None]
    day = F.lit(datetime.date(2026, 1, 1))
    assert rows(spark, [(2000, 26), (2000, 27)], "y int, t int", C.expired(F.col("y"), F.col("t"), day)) == [True, False]


def test_guards(spark):
    assert rows(spark, [("12r",), ("1r-2v",), ("3 v",), ("p. 4",), (None,)], "a string", C.leaf_side(F.col("a"))) == ["r", None, "v", None, None]
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    assert rows(spark, [(png(900, 1),), (png(90, 30),), (b"jpg",)], "a binary", C.sliver_reason(F.col("a"))) == ["sliver_crop:900x1", None, None]
    assert rows(spark, [(100, 100), (1024, 1024), (2048, 4096)], "w int, h int", C.tiles_of_512(F.col("w"), F.col("h"))) == [255, 765, 1105]
    assert rows(spark, [("abc-1",), ("abd",), ("x",)], "a string", C.price(F.col("a"), {"ab": 1.0, "abc": 2.0})) == [2.0, 1.0, None]


def test_twins(spark):
    pages = [("w", 10, 10, f"p{i}", i, n, label) for i, (n, label) in enumerate([(100_000, "1r"), (100_500, "1v"), (100_900, "2v"), (500_000, "3r"), (900_000, "3v"), (100_100, None)])]
    df = spark.createDataFrame(pages, "work_id string, width int, height int, page_id string, seq int, n_bytes int, label string")
    assert [(r.group, r.page_id) for r in twins.candidates(df).orderBy("group", "seq").collect()] == [(0, "p0"), (0, "p1"), (0, "p2")]
    box = "struct(0.0D x0, 0.0D y0, 10.0D x1, {}D y1)"
    boxes = spark.sql("select 'a' page_id, " + box.format("10.0") + " box union all select 'b', " + box.format("9.0") + " union all select 'b', " + box.format("2.0"))
    got = twins.agreement(spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"), boxes)
    assert {r.b: r.agreement for r in got.collect()} == {"b": 1.0, "c": 0.0}
    assert twins.find_fold([(0, 45), (55, 45)], 100) == 49 and twins.find_fold([], 0) == 0 and twins.find_fold([(0, 100)] * 2, 100) == 50


def test_assembly(spark):
    works = spark.createDataFrame([("w1", ["LH XXXV, 3"]), ("w2", ["LBr 57"])], "work_id string, shelfmarks array<string>")
    records = spark.createDataFrame([("r1", ["w1"], ["LH 35, 3 Bl. 1v-2r"]), ("r2", ["w9"], ["LBr. 57 Bl. 9"]), ("r3", [], ["Paris"])], "record_id string, work_refs array<string>, shelfmarks array<string>")
    found, lost = corpus.crosswalk(records, works)
    assert sorted((r.record_id, r.work_id, r.method) for r in found.collect()) == [("r1", "w1", "id"), ("r2", "w2", "key")]
    assert [tuple(r) for r in lost.collect()] == [("r2", "w9")] or [(r.record_id, r.work_id) for r in lost.collect()] == [("r2", "w9")]
    pages = spark.createDataFrame([("w1", f"p{i}", i, label) for i, label in enumerate(["1r", "1v", "2r", "2v", "cover", "2"])], "work_id string, page_id string, seq int, label string")
    assert sorted(r.page_id for r in corpus.placed_records(records, found, pages).collect()) == ["p1", "p2", "p5"]
    refs = spark.createDataFrame([("r1", 1, 6, "4", "12a"), ("r1", 0, 6, "4", "3"), ("r2", 0, 1, "1", "9")], "record_id string, pos int, series int, volume string, piece string")
    texts = spark.createDataFrame([(6, "4", "12", "zwölf"), (6, "4", "3", "drei")], "series int, volume string, piece string, text string")
    assert [tuple(r) for r in corpus.edition_texts(refs, texts).collect()] == [("r1", "drei\nzwölf")]
    runs = spark.createDataFrame([(1, "recognize", "s"), (2, "recognize", None)], "run_id long, stage string, scope string")
    lines = spark.createDataFrame([(1, "p0", 1, 1, "erste", 0.5, "de"), (2, "p0", 1, 2, "x", 0.9, "la"), (3, "p0", 2, 2, "zweite", 0.7, "de"), (4, "p1", 1, 2, "", 0.1, None)], "id long, page_id string, line_seq int, run_id long, text string, conf double, lang string")
    lang = spark.createDataFrame([("p0", "fr")], "page_id string, lang string")
    stats = spark.createDataFrame([("p0", "fair_copy")], "page_id string, stratum string")
    doc = corpus.page_documents(works, pages, lines, runs, lang, stats).collect()
    assert [(r.page_id, r.text, r.n_lines, r.mean_conf, r.lang, r.stratum) for r in doc] == [("p0", "erste\nzweite", 2, 0.6, "de", "fair_copy")]
    twin = spark.createDataFrame([(1, "p0", 0, "1r"), (1, "p1", 1, "1v")], "group_id int, page_id string, seq int, label string")
    kept = corpus.folded_twins(pages, twin).where("page_id in ('p0', 'p1')").collect()
    assert [(r.page_id, r.also) for r in kept] == [("p0", ["1v"])]
