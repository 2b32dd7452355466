import corpus_pipeline
from quillmark.llm import minmax_dedup, shared


def test_texts_with_letters_stay_where_nothing_is_labelled(spark):
    rows = [(1, "clean words", None), (2, None, None), (3, "12 !?", None), (4, "ß", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()} == {1, 4}


def test_what_was_written_is_cleared(spark):
    docs = spark.createDataFrame([(i, f"a b c d e {i}") for i in range(5)], "doc_id long, text string")
    kept = minmax_dedup.deduplicated(docs).count()
    written = [path for _, path in shared._STASHED]
    assert kept == 5 and written and shared.clear_stash(spark) >= 1 and shared.clear_stash(spark) == 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(written[-1])
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
