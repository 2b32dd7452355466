from pyspark.sql import functions as F

from quillmark.sources import export, readers
from quillmark.streaming import operators as stream


def test_manifests_of_both_versions(spark):
    two = '{"@id":"m2","sequences":[{"canvases":[{"@id":"c1","label":"1r","width":10,"height":20,"images":[{"resource":{"@id":"i1"}}]},{"@id":"c2","label":"1v","width":1,"height":2,"images":[]}]}]}'
    three = '{"id":"m3","items":[{"id":"d1","label":{"none":["2r"]},"width":5,"height":6,"items":[{"items":[{"body":{"id":"j1"}}]}]}]}'
    rows = readers.manifest_canvases(spark.createDataFrame([(two,), (three,)], "value string")).orderBy("canvas_id").collect()
    assert [tuple(r) for r in rows] == [("m2", 1, "c1", "1r", 10, 20, "i1"), ("m2", 2, "c2", "1v", 1, 2, None), ("m3", 1, "d1", "2r", 5, 6, "j1")]


def test_page_xml_and_oai(spark):
    xml = '<P xmlns="u"><TextRegion id="r1"><TextLine id="l1"><Coords points="0,0 4,0 4,3"/><TextEquiv conf="0.5"><Unicode>abc</Unicode></TextEquiv></TextLine><TextLine id="l2"/></TextRegion></P>'
    rows = readers.page_xml_lines(spark.createDataFrame([("p", xml), ("q", None)], "page_id string, value string")).collect()
    assert [(r.page_id, r.seq, r.line_id, r.region, r.text, r.conf) for r in rows] == [("p", 1, "l1", "r1", "abc", 0.5), ("p", 2, "l2", "r1", None, None)]
    assert rows[0].polygon == [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0]] and rows[1].polygon is None
    oai = '<O><record><header><identifier>x</identifier><setSpec>a</setSpec><setSpec>b</setSpec></header><title>T</title><shelfLocator>LH 1</shelfLocator></record><record><header status="deleted"><identifier>y</identifier></header></record><resumptionToken>t</resumptionToken></O>'
    got = readers.oai_records(spark.createDataFrame([(oai,)], "value string")).collect()
    assert [(r.identifier, r.deleted, r.sets, r.title, r.shelfmarks, r.token) for r in got] == [("x", False, ["a", "b"], "T", ["LH 1"], "t"), ("y", True, [], None, [], "t")]


def test_html_tables_jsonl_and_csv(spark, tmp_path):
    html = "<table><tr><th>A <b>x</b></th><th>B</th></tr><tr><td> 1 </td><td></td></tr></table>"
    assert [(r.row, r.cells) for r in readers.html_tables(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()] == [(1, ["A x", "B"]), (2, ["1", ""])]
    (tmp_path / "a.jsonl").write_text('{"k":"x","v":1}\nbroken\n{"k":"x","v":2}\n')
    rows = readers.numbered_lines(spark, str(tmp_path / "a.jsonl")).select("ordinal", F.from_json("value", "k string, v int").alias("r")).select("ordinal", "r.*").where("k is not null")
    assert [tuple(r) for r in readers.last_per_key(rows, ["k"]).select("k", "v").collect()] == [("x", 2)]
    assert readers.jsonl(spark, str(tmp_path / "a.jsonl"), "k string, v int").count() == 2
    (tmp_path / "a.csv").write_text('a,b\n1,"two\nlines ""q"""\n')
    assert readers.csv_table(spark, str(tmp_path / "a.csv"), ("a", "b")).first().b == 'two\nlines "q"'
    assert readers.optional_csv(spark, str(tmp_path / "none.csv"), "a string").count() == 0


def test_export_and_manifest(spark, tmp_path):
    docs = spark.range(100).withColumn("g", F.col("id") % 2)
    for fmt in ("parquet", "jsonl"):
        tally = export.export(docs, str(tmp_path / fmt), fmt=fmt, rows_per_file=10, tallies={"odd": F.count_if(F.col("g") == 1)})
        assert tally == {"rows": 100, "odd": 50}
        files = export.manifest(spark, str(tmp_path / fmt)).collect()
        assert len(files) >= 10 and all(len(r.sha256) == 64 and r.bytes > 0 for r in files)
    assert export.publish(docs, str(tmp_path / "live"), "live").count() == spark.table("live").count() == 100
    assert {(r.field, r.value): r.n for r in export.tally(docs, ["g"]).collect()} == {("g", "0"): 50, ("g", "1"): 50}


def test_streams_mean_their_batches(spark, tmp_path):
    events = spark.range(60).select((F.col("id") % 3).alias("user"), F.timestamp_seconds(F.col("id") * 70).alias("ts"), F.col("id").cast("double").alias("value"), F.col("id"))
    events.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    made = stream.drain(stream.tumbling(source(), "ts", "10 minutes", ["user"]), "tumbled")
    assert rows(made) == rows(stream.tumbling(events, "ts", "10 minutes", ["user"]))
    made = stream.drain(stream.once(source(), ["user"], "ts", "2 hours"), "onced", "append")
    assert made.count() == 3
    writer = stream.snapshot_writer(str(tmp_path / "snap"), ["user"], [F.col("id").desc()])
    query = source().writeStream.foreachBatch(writer).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(stream.snapshot(spark, str(tmp_path / "snap")).select("user", "id")) == [(0, 57), (1, 58), (2, 59)]
    allowed = stream.token_bucket_batch(events, "user", "ts", rate=1 / 420, burst=2.0).groupBy("user").agg(F.count_if("allowed").alias("n"))
    assert {r.user: r.n for r in allowed.collect()} == {0: 11, 1: 11, 2: 11}
