"""What a reader is shown: texts of pages, works and records, citations, trees and manifests, each one DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.labels import section_phrase
from quillmark.functions.text import folio, folio_span, signature_parts, span_includes
from quillmark.operators.links import shuffled

COLUMNS = ("line", "confidence", "text")


def _line(fmt: str) -> Column:
    conf = F.when(F.col("conf").isNotNull(), F.format_string("%.4f", "conf")).otherwise("")
    return F.concat_ws("\t", F.col("line_seq").cast("string"), conf, F.regexp_replace("text", r"\s+", " ")) if fmt == "tsv" else F.col("text")


def page_texts(lines: DataFrame, *, fmt: str = "plain") -> DataFrame:
    """(page_id, n_lines, mean_conf, text): a page's current lines in order, plain or tab-separated; a page has few lines."""
    made = lines.where(F.coalesce("text", F.lit("")) != "").select("page_id", "line_seq", "conf", _line(fmt).alias("shown"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_seq", "shown"))), lambda x: x["shown"])
    head = "\t".join(COLUMNS) + "\n" if fmt == "tsv" else ""
    return made.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.bround(F.avg("conf"), 4).alias("mean_conf"), F.concat(F.lit(head), F.array_join(ordered, "\n")).alias("text"))


def folio_name(label: Column, seq: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("fol. "), label)).otherwise(F.concat(F.lit("canvas "), seq.cast("string")))


def page_blocks(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(work_id, seq, page_id, block): each page of a work as a headed block, a page without text saying so; written in order, a work is never one value."""
    head = F.concat(F.lit("## "), folio_name(F.col("label"), F.col("seq")), F.lit(" — "), F.col("page_id"), F.lit("\n"))
    body = F.coalesce(F.col("text"), F.lit("# No recognised text on this page."))
    return pages.join(texts.select("page_id", "text"), "page_id", "left").select("work_id", "seq", "page_id", F.concat(head, body, F.lit("\n")).alias("block"))


def work_headers(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(work_id, pages, with_text, n_lines, mean_conf): what stands above a work's text; the mean is by lines."""
    joined = pages.join(texts.select("page_id", "n_lines", "mean_conf"), "page_id", "left")
    known = F.when(F.col("mean_conf").isNotNull(), F.col("n_lines"))
    return joined.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count("n_lines").alias("with_text"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), (F.sum(F.col("mean_conf") * known) / F.sum(known)).alias("mean_conf")
    )


def record_texts(records: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(record_id, work_id, seq, page_id, text): the pages of a record's leaves (``records``: record_id, work_id, shelfmark) with their text."""
    spans = records.select("record_id", "work_id", folio_span(signature_parts(F.col("shelfmark"))["leaf"]).alias("span")).where("span is not null")
    listed = spans.withColumn("num", F.explode(F.sequence("span.lo", "span.hi")))
    leaves = pages.withColumn("ref", folio(F.col("label"))).where("ref is not null").withColumn("num", F.col("ref.num"))
    found = leaves.join(listed, ["work_id", "num"]).where(span_includes(F.col("span"), F.col("ref")))
    return found.join(texts.select("page_id", "text"), "page_id", "left").select("record_id", "work_id", "seq", "page_id", "text")


def citations(pages: DataFrame, works: DataFrame, runs_of_pages: DataFrame, site: str) -> DataFrame:
    """(page_id, permalink, citation): a page as read by its latest run (``runs_of_pages``: page_id, run_id, model), pinned to it."""
    joined = pages.join(shuffled(works.select("work_id", "title")), "work_id", "left").join(shuffled(runs_of_pages), "page_id", "left")
    link = F.concat(F.lit(f"{site}/page/"), F.col("page_id"), F.coalesce(F.concat(F.lit("?run="), F.col("run_id").cast("string")), F.lit("")))
    made = F.concat_ws(", ", F.concat(F.lit("model "), F.col("model")), F.concat(F.lit("run "), F.col("run_id").cast("string")))
    cited = F.concat(F.coalesce("title", "work_id"), F.lit(", "), folio_name(F.col("label"), F.col("seq")), F.when(made != "", F.concat(F.lit(" ("), made, F.lit(")"))).otherwise(""), F.lit(". "), link)
    return joined.select("page_id", link.alias("permalink"), cited.alias("citation"))


def records_in_order(records: DataFrame, work: str = "work_id") -> DataFrame:
    """Records of works with their place in them: placed ones by their first page, then the others by id."""
    w = Window.partitionBy(work).orderBy(F.col("first_seq").asc_nulls_last(), "record_id")
    return records.withColumn("place", F.row_number().over(w))


def sections(works: DataFrame, *, share: float = 0.5) -> DataFrame:
    """(family, section, label, n): a section's works, named by the phrase that more than ``share`` of their titles have, else by its number."""
    phrased = works.withColumn("_p", section_phrase(F.col("title")))
    counted = phrased.groupBy("family", "section", "_p").agg(F.count(F.lit(1)).alias("_n"))
    size = F.sum("_n").over(Window.partitionBy("family", "section"))
    best = F.row_number().over(Window.partitionBy("family", "section").orderBy(F.col("_p").isNull(), F.col("_n").desc(), "_p"))
    top = counted.withColumns({"n": size, "_b": best}).where("_b = 1")
    named = F.when(F.col("_p").isNotNull() & (F.col("_n") > share * F.col("n")), F.col("_p")).otherwise(F.concat_ws(" ", "family", F.col("section").cast("string")))
    return top.select("family", "section", named.alias("label"), "n")


def tree(works: DataFrame, *, family: str | None = None, set_name: str | None = None) -> DataFrame:
    """(family, json): sections and their entries as JSON, narrowed by set or family; what is emptied is not there."""
    rows = works if family is None else works.where(F.col("family") == family)
    rows = rows if set_name is None else rows.where(F.col("set_name") == set_name)
    entry = F.struct(F.col("place"), F.struct("work_id", "shelfmark", "title").alias("e"))
    by_section = rows.groupBy("family", "section").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    return by_section.groupBy("family").agg(F.to_json(F.sort_array(F.collect_list(F.struct("section", "entries")))).alias("json"))


def manifests(works: DataFrame, pages: DataFrame, base: str) -> DataFrame:
    """(work_id, manifest): a IIIF 3 manifest of each work as JSON, its canvases in order; a work has at most some thousand pages."""
    url = lambda *parts: F.concat(F.lit(base), *parts)
    label = F.struct(F.array(folio_name(F.col("label"), F.col("seq"))).alias("none"))
    image = F.struct(F.col("image_url").alias("id"), F.lit("Image").alias("type"), F.col("width").alias("width"), F.col("height").alias("height"))
    canvas_id = url(F.lit("/canvas/"), F.col("page_id"))
    body = F.struct(F.concat(canvas_id, F.lit("/image")).alias("id"), F.lit("Annotation").alias("type"), F.lit("painting").alias("motivation"), image.alias("body"), canvas_id.alias("target"))
    page = F.struct(F.concat(canvas_id, F.lit("/page")).alias("id"), F.lit("AnnotationPage").alias("type"), F.array(body).alias("items"))
    canvas = F.struct(canvas_id.alias("id"), F.lit("Canvas").alias("type"), label.alias("label"), F.col("width").alias("width"), F.col("height").alias("height"), F.array(page).alias("items"))
    items = pages.groupBy("work_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.to_json(canvas).alias("c")))), lambda x: x["c"]).alias("items"))
    title = F.to_json(F.struct(F.array(F.coalesce("title", "work_id")).alias("none")))
    made = F.concat(F.lit('{"@context":"http://iiif.io/api/presentation/3/context.json","id":"'), url(F.lit("/manifest/"), F.col("work_id")), F.lit('","type":"Manifest","label":'), title, F.lit(',"items":['), F.array_join("items", ","), F.lit("]}"))
    return works.join(items, "work_id").select("work_id", made.alias("manifest"))


def annotation_pages(lines: DataFrame, base: str) -> DataFrame:
    """(page_id, annotations): a page's lines as a IIIF 3 annotation page, one text a line on its box (x, y, w, h)."""
    canvas = F.concat(F.lit(f"{base}/canvas/"), F.col("page_id"))
    box = F.concat_ws(",", *(F.col(f"box.{k}").cast("string") for k in ("x", "y", "w", "h")))
    body = F.struct(F.lit("TextualBody").alias("type"), F.col("text").alias("value"), F.lit("text/plain").alias("format"))
    note = F.struct(F.concat(canvas, F.lit("/line/"), F.col("line_seq").cast("string")).alias("id"), F.lit("Annotation").alias("type"), F.lit("supplementing").alias("motivation"), body.alias("body"), F.concat(canvas, F.when(F.col("box").isNotNull(), F.concat(F.lit("#xywh="), box)).otherwise("")).alias("target"))
    rows = lines.where(F.coalesce("text", F.lit("")) != "")
    items = rows.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_seq", F.to_json(note).alias("n")))), lambda x: x["n"]).alias("items"))
    head = F.concat(F.lit('{"@context":"http://iiif.io/api/presentation/3/context.json","id":"'), canvas, F.lit('/annotations","type":"AnnotationPage","items":['))
    return items.select("page_id", F.concat(head, F.array_join("items", ","), F.lit("]}")).alias("annotations"))


def line_box(points: Sequence[str] = ("polygon", "baseline")) -> Column:
    """struct(x, y, w, h) around the first of some arrays of (x, y) that has points; null if none has."""

    def around(p: Column) -> Column:
        at = lambda i: F.transform(p, lambda q: F.get(q, i))
        x, y = at(0), at(1)
        return F.when(F.size(p) > 0, F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x)).alias("w"), (F.array_max(y) - F.array_min(y)).alias("h")))

    return F.coalesce(*(around(F.col(c)) for c in points))


def own_half(center: Column, fold: Column, side: Column) -> Column:
    """Whether a line of a spread belongs to a page of a side: the verso's lie left of the fold, the recto's right of it or on it."""
    return F.when(side == "v", center < fold).otherwise(center >= fold)
