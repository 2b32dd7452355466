"""Which lines and letters enter a pool: placement, the text they were aligned on, flags, eligibility, imports of decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.labels import first_of
from quillmark.functions.text import collapse, folio, span_includes
from quillmark.operators.links import shuffled
from quillmark.operators.versions import current_rows


def text_pieces(pieces: DataFrame, refs: DataFrame) -> DataFrame:
    """One piece a record: of its ``pieces`` (record_id, pos, series, volume, piece) the one its text came from, with the text's channels.

    ``refs`` (record_id, pos, series, volume, piece, channel) say where the text came from, in order. A
    record without refs keeps its first piece; one whose first ref is none of its pieces has none.
    """
    first = current_rows(refs, ["record_id"], [F.col("pos")]).select("record_id", "series", "volume", F.col("piece").alias("_piece"))
    channels = refs.groupBy("record_id").agg(F.array_join(F.sort_array(F.collect_set(F.nullif("channel", F.lit("")))), "+").alias("_channel"))
    found = pieces.join(first, ["record_id", "series", "volume"]).join(channels, "record_id")
    matched = current_rows(found, ["record_id"], [F.col("pos")]).select("record_id", "series", "volume", F.coalesce(F.nullif("_piece", F.lit("")), "piece").alias("piece"), F.nullif("_channel", F.lit("")).alias("channel"))
    alone = current_rows(pieces.join(refs.select("record_id").distinct(), "record_id", "left_anti"), ["record_id"], [F.col("pos")])
    return matched.unionByName(alone.select("record_id", "series", "volume", "piece", F.lit(None).cast("string").alias("channel")))


def same_size(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Pairs of an image (name, width, height, thumb) and a page (page_id, width, height, thumb) of one size."""
    return images.join(pages.withColumnRenamed("thumb", "page_thumb"), ["width", "height"])


def nearest_image(pairs: DataFrame, name: str, page: str, distance: Column, most: float) -> DataFrame:
    """(name, page, distance): the nearest page of each image, if near enough; the first page on ties."""
    best = pairs.withColumn("_d", distance).groupBy(name).agg(F.min(F.struct("_d", page)).alias("b"))
    return best.select(name, F.col(f"b.{page}").alias(page), F.col("b._d").alias("distance")).where(F.col("distance") <= most)


def pages_of_folios(files: DataFrame, works: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, status, page_ids) of ``files`` (name, keys in order, folios: array<struct(num, side)>): the first work by key that has a page for a folio gives it.

    ``works``: (key, work_id). A folio's side counts only where a page has it. Statuses: unparsed, no_work, no_page, matched.
    """
    keyed = files.select("name", F.posexplode_outer("keys").alias("at", "key")).join(works, "key", "left").where("work_id is not null")
    known = keyed.groupBy("name", "work_id").agg(F.min(F.struct("at", "work_id")).alias("first"))
    wanted = files.select("name", F.posexplode("folios").alias("n", "f")).join(known, "name")
    leaves = pages.select("work_id", "page_id", "seq", folio(F.col("label")).alias("ref")).where("ref is not null")
    met = wanted.join(leaves, [wanted["work_id"] == leaves["work_id"], F.col("f.num") == F.col("ref.num")]).drop(leaves["work_id"])
    other_side = F.when(F.coalesce(F.col("f.side"), F.lit("")) == "", 0).when(F.col("f.side") == F.col("ref.side"), 0).otherwise(1)
    chosen = current_rows(met, ["name", "n"], [F.col("first.at"), F.col("first.work_id"), other_side, F.col("seq")])
    found = chosen.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "page_id"))), lambda x: x["page_id"]).alias("page_ids"))
    has_work = known.select("name").distinct().withColumn("_w", F.lit(True))
    joined = files.select("name", (F.size("folios") > 0).alias("_parsed")).join(has_work, "name", "left").join(found, "name", "left")
    status = F.when(~F.coalesce("_parsed", F.lit(False)), "unparsed").when(F.col("_w").isNull(), "no_work").when(F.col("page_ids").isNull(), "no_page").otherwise("matched")
    return joined.select("name", status.alias("status"), F.coalesce("page_ids", F.array().cast("array<string>")).alias("page_ids"))


def placed_letters(letters: DataFrame, works: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(letter_id, reason, work_id, n_pages, n_lines) of ``letters`` (letter_id, key, span, shared): the first reason that holds of no_work, no_canvas, no_lines, shared, else placed.

    ``works``: (key, work_id); ``lines``: (page_id, n_lines). Of several works the first whose folios lie in the span counts.
    """
    keyed = letters.join(shuffled(works), "key", "left")
    leaves = pages.select(F.col("work_id").alias("_w"), "page_id", folio(F.col("label")).alias("ref")).where("ref is not null")
    inside = keyed.where("span is not null").join(shuffled(leaves), F.col("work_id") == F.col("_w")).where(span_includes(F.col("span"), F.col("ref")))
    counted = inside.join(shuffled(lines), "page_id", "left").groupBy("letter_id", "work_id").agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"))
    first = current_rows(counted, ["letter_id"], [F.col("work_id")])
    has_work = keyed.groupBy("letter_id").agg(F.count("work_id").alias("_works"))
    joined = letters.join(shuffled(has_work), "letter_id", "left").join(shuffled(first), "letter_id", "left")
    reason = F.when(F.col("_works") == 0, "no_work").when(F.col("n_pages").isNull(), "no_canvas").when(F.col("n_lines") == 0, "no_lines").when(F.col("shared"), "shared").otherwise("placed")
    return joined.select("letter_id", reason.alias("reason"), "work_id", "n_pages", "n_lines")


def with_machine_text(lines: DataFrame, stored: DataFrame, readings: DataFrame) -> DataFrame:
    """``lines`` (ref, reader, text) with the text each was aligned on, stored (ref, text) or a reader's (ref, reader, text), and their ratio of lengths."""
    own = stored.select("ref", F.col("text").alias("_stored"))
    read = readings.select("ref", "reader", F.col("text").alias("_read"))
    joined = lines.join(own, "ref", "left").join(read, ["ref", "reader"], "left")
    machine = F.when(F.col("reader").isNull(), F.col("_stored")).otherwise(F.col("_read"))
    length = lambda c: F.length(collapse(c))
    shown = joined.withColumn("machine_text", machine)
    return shown.withColumn("ratio", F.when(length(F.col("machine_text")) > 0, length(F.col("text")) / length(F.col("machine_text")))).select(*lines.columns, "machine_text", "ratio")


def with_hands(lines: DataFrame, hands: DataFrame) -> DataFrame:
    """``lines`` with the hand of their record (``hands``: record_id, hand, own), ``none`` if unknown, and own or other."""
    joined = lines.join(hands.select("record_id", F.col("hand").alias("_h"), F.col("own").alias("_o")), "record_id", "left")
    return joined.select(*lines.columns, F.coalesce("_h", F.lit("none")).alias("hand"), F.when(F.coalesce("_o", F.lit(False)), "own").otherwise("other").alias("group"))


def excluded(lines: DataFrame, flags: Column, order: Sequence[str]) -> DataFrame:
    """``lines`` with flags and ``reason``: the first of ``order`` among them, null of a line that may be used."""
    flagged = lines.withColumn("flags", flags)
    return flagged.withColumn("reason", first_of(F.col("flags"), order))


def eligible(lines: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(lines that pass every rule, (reason, n) of the others by the first they fail)."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    marked = lines.withColumn("_reason", reason)
    return marked.where("_reason is null").drop("_reason"), marked.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def decision_plan(decisions: DataFrame, machine: DataFrame, imported: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``decisions`` (line_id, decided_at, retirement, cand_id, text) with ``action``: insert, queue, or why one is skipped.

    What has not converged is queued, once. Of a line's converged decisions the latest counts; others are
    superseded_in_pack, or duplicate_in_pack at the same time. It needs a machine row (``machine``:
    line_id), must not be imported yet (``imported``: line_id, decided_at), and must be a
    candidate (``candidates``: line_id, cand_id, cand_text) where those are given.
    """
    own = ["line_id", "decided_at"]
    done = imported.select(*own).distinct().withColumn("_done", F.lit(True))
    has = machine.select("line_id").distinct().withColumn("_has", F.lit(True))
    converged = F.col("retirement") == "converged"
    latest = Window.partitionBy("line_id", converged)
    rank = F.row_number().over(latest.orderBy(F.col("decided_at").desc(), "cand_id"))
    again = F.row_number().over(Window.partitionBy("line_id", "decided_at", converged).orderBy("cand_id"))
    joined = decisions.withColumns({"_top": F.max("decided_at").over(latest), "_rank": rank, "_again": again}).join(has, "line_id", "left").join(done, own, "left")
    action = F.when(~converged, F.when(F.col("_again") == 1, "queue").otherwise("queued_already"))
    action = action.when(F.col("_rank") > 1, F.when(F.col("decided_at") == F.col("_top"), "duplicate_in_pack").otherwise("superseded_in_pack"))
    action = action.when(F.col("_has").isNull(), "no_machine_row").when(F.col("_done").isNotNull(), "already_imported")
    if candidates is not None:
        of_pack = candidates.select("line_id").distinct().withColumn("_pack", F.lit(True))
        joined = joined.join(of_pack, "line_id", "left").join(candidates.select("line_id", "cand_id", "cand_text"), ["line_id", "cand_id"], "left")
        action = action.when(F.col("_pack").isNull(), "not_in_fragment_pack").when(F.col("cand_text").isNull(), "winner_not_a_candidate").when(F.col("cand_text") != F.col("text"), "winner_text_differs")
    return joined.select(*decisions.columns, action.otherwise("insert").alias("action"))


def chunked(lines: DataFrame, on: Sequence[str], order: str, size: int = 25) -> DataFrame:
    """``lines`` with ``piece``: runs of ``size`` lines of each group, from 0."""
    from quillmark.operators.sequences import running

    numbered = running(lines, on, [order], name="_n")
    return numbered.withColumn("piece", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")
