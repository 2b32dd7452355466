"""Assembly of documents, pieces and their texts from lines, pages, works and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import collapse, folio, signature_key, signature_parts, folio_span, span_includes
from quillmark.operators.links import best_link, two_method_links
from quillmark.operators.sequences import first_mode
from quillmark.operators.versions import current_rows, ranked


def page_documents(works: DataFrame, pages: DataFrame, lines: DataFrame, runs: DataFrame, page_lang: DataFrame, stats: DataFrame) -> DataFrame:
    """One row a page: its work, ordered current text, mean confidence, language and stratum.

    Small dimensions are left to the planner to broadcast; lines are ranked once and
    aggregated by page. Rows without text are dropped after ranking.
    """
    order = [F.col("_prec").desc(), F.coalesce("run_id", F.lit(0)).desc(), F.col("id").desc()]
    current = current_rows(ranked(lines, runs), ["page_id", "line_seq"], order).where(F.coalesce("text", F.lit("")) != "")
    texts = current.groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_seq", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("n_lines"),
        F.bround(F.avg("conf"), 4).alias("mean_conf"),
    )
    majority = first_mode(current, ["page_id"], "lang", "line_seq").select("page_id", F.col("lang").alias("line_lang"))
    joined = pages.join(works, "work_id").join(texts, "page_id").join(majority, "page_id", "left").join(page_lang.select("page_id", F.col("lang").alias("page_lang")), "page_id", "left").join(stats.select("page_id", "stratum"), "page_id", "left")
    return joined.withColumn("lang", F.coalesce("line_lang", "page_lang")).drop("line_lang", "page_lang")


def crosswalk(records: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, unresolved): records (record_id, work_refs, shelfmarks) to works (work_id, shelfmarks), by id, then by key."""
    cited = records.select("record_id", F.explode("work_refs").alias("work_id"))
    by_id = cited.join(works.select("work_id"), "work_id")
    keys = lambda df, key: df.select(key, F.explode("shelfmarks").alias("s")).select(key, signature_key(F.col("s")).alias("key")).where("key is not null").distinct()
    by_key = keys(records, "record_id").join(keys(works, "work_id"), "key")
    return two_method_links(by_id, by_key, "record_id", "work_id"), cited.join(works.select("work_id"), "work_id", "left_anti")


def placed_records(records: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_id, work_id, page_id, seq): pages whose folio lies in a span of the record's first shelfmark that has one."""
    spans = records.select("record_id", F.posexplode("shelfmarks").alias("at", "s")).withColumn("span", folio_span(signature_parts(F.col("s"))["leaf"])).where("span is not null")
    first = current_rows(spans, ["record_id"], [F.col("at")]).select("record_id", "span")
    linked = best_link(links, "record_id", "work_id").select("record_id", "work_id").join(first, "record_id")
    leaves = pages.withColumn("ref", folio(F.col("label"))).where("ref is not null").withColumn("num", F.col("ref.num"))
    # folios of a span are listed, so the range join is an equi-join on work and folio
    listed = linked.withColumn("num", F.explode(F.sequence("span.lo", "span.hi")))
    found = leaves.join(listed, ["work_id", "num"]).where(span_includes(F.col("span"), F.col("ref")))
    return found.select("record_id", "work_id", "page_id", "seq")


def edition_texts(refs: DataFrame, texts: DataFrame, *, least_chars: int = 0) -> DataFrame:
    """(record_id, text): texts (series, volume, piece, text) of a record's ordered refs, of a piece without its letter where there is none."""
    parent = F.regexp_replace("piece", r"\s*[a-z]+$", "")
    exact = texts.select("series", "volume", "piece", F.col("text").alias("t1"))
    coarse = texts.select("series", "volume", F.col("piece").alias("parent"), F.col("text").alias("t2"))
    joined = refs.join(exact, ["series", "volume", "piece"], "left").withColumn("parent", parent).join(coarse, ["series", "volume", "parent"], "left")
    parts = joined.withColumn("t", F.coalesce("t1", "t2")).where("t is not null").groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("p"))
    return parts.select("record_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text")).where(F.length("text") >= least_chars)


def minted(projected: DataFrame, *, stratum: Column, bucket: Column) -> DataFrame:
    """Accepted lines of a projection with collapsed text, rounded confidence and the invariants of what may be kept."""
    rows = projected.where(F.col("accepted") & (collapse(F.col("projected")) != ""))
    return rows.withColumns({"text": collapse(F.col("projected")), "align_conf": F.bround("confidence", 4), "stratum": stratum, "license_bucket": bucket})


def folded_twins(documents: DataFrame, twins: DataFrame) -> DataFrame:
    """Documents without second registrations; a first one keeps the labels of the others in ``also``."""
    firsts = twins.groupBy("group_id").agg(F.min_by("page_id", "seq").alias("keep"), F.sort_array(F.collect_list(F.struct("seq", "page_id", "label"))).alias("m"))
    also = firsts.select(F.col("keep").alias("page_id"), F.transform(F.filter("m", lambda x: x["page_id"] != F.col("keep")), lambda x: x["label"]).alias("also"))
    gone = twins.join(firsts, "group_id").where("page_id <> keep").select("page_id")
    return documents.join(gone, "page_id", "left_anti").join(also, "page_id", "left").withColumn("also", F.coalesce("also", F.array().cast("array<string>")))
