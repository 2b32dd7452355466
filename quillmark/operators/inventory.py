"""The store's tables as a whole: what is there, what is missing, how two readings of the same lines compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.functions.catalog import expired
from quillmark.functions.labels import fold_print
from quillmark.functions.text import natural_key, similarity
from quillmark.operators.evaluation import rate
from quillmark.operators.links import compare_tables
from quillmark.operators.versions import current_rows, with_missing_columns


def opened_store(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables of a store: each as it is, with columns that came later as nulls; an empty one where there is none yet. Repeats change nothing."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = {}
    for name, ddl in schemas.items():
        schema = StructType.fromDDL(ddl)
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, name)):
            tables[name] = with_missing_columns(spark.read.parquet(f"{path}/{name}"), {f.name: f.dataType.simpleString() for f in schema})
        else:
            tables[name] = spark.createDataFrame([], schema)
    return tables


def fetch_targets(pages: DataFrame, works: DataFrame, *, set_name: str | None = None, work_ids: Sequence[str] | None = None, only_unfetched: bool = True) -> DataFrame:
    """Pages with an address, of a set or of some works, by default those not fetched yet."""
    rows = pages.where(F.col("image_url").isNotNull())
    if only_unfetched:
        rows = rows.where(F.col("sha256").isNull())
    if set_name is not None:
        rows = rows.join(works.where(F.col("set_name") == set_name).select("work_id"), "work_id", "left_semi")
    return rows.where(F.col("work_id").isin(*work_ids)) if work_ids else rows


def verified_files(pages: DataFrame, files: DataFrame, *, deep: bool = False) -> DataFrame:
    """(page_id, state) of pages (page_id, path, n_bytes, sha256) against files (path, bytes, digest): unfetched, missing, size, checksum or ok."""
    joined = pages.join(files, "path", "left")
    state = F.when(F.col("sha256").isNull(), "unfetched").when(F.col("bytes").isNull(), "missing").when(F.col("bytes") != F.col("n_bytes"), "size")
    if deep:
        state = state.when(F.col("digest") != F.col("sha256"), "checksum")
    return joined.select("page_id", state.otherwise("ok").alias("state"))


#: Sizes in millions of pixels that images are counted by; fixed values.
MEGAPIXELS = ((0, 1), (1, 3), (3, 5), (5, 8), (8, 12), (12, None))


def image_stats(pages: DataFrame, works: DataFrame) -> DataFrame:
    """(set_name, targets, fetched, bytes, mean_bytes): by set of works, one pass; set_name null is all of them."""
    joined = pages.join(works.select("work_id", "set_name"), "work_id")
    done = F.col("sha256").isNotNull()
    sums = joined.rollup("set_name").agg(F.count_if(F.col("image_url").isNotNull()).alias("targets"), F.count_if(done).alias("fetched"), F.coalesce(F.sum(F.when(done, F.col("n_bytes"))), F.lit(0)).alias("bytes"))
    return sums.withColumn("mean_bytes", rate(F.col("bytes"), F.col("fetched")))


def size_histogram(pages: DataFrame) -> DataFrame:
    """(size, n): fetched images with known dimensions by millions of pixels."""
    pixels = F.col("width") * F.col("height") / 1e6
    label = None
    for low, high in MEGAPIXELS:
        test = pixels >= low if high is None else (pixels >= low) & (pixels < high)
        name = f">= {low}" if high is None else f"{low}-{high}"
        label = F.when(test, name) if label is None else label.when(test, name)
    return pages.where(F.col("sha256").isNotNull() & pixels.isNotNull()).groupBy(label.alias("size")).agg(F.count(F.lit(1)).alias("n"))


def segment_summary(stats: DataFrame) -> DataFrame:
    """One row: pages, means of their measures, and the percentages with overlapping and with short lines; 0 of nothing."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    share = lambda c: rate(F.count_if(F.col(c) > 0) * 100.0, F.count(F.lit(1)))
    means = {"mean_lines": "n_lines", "mean_coverage": "region_coverage", "mean_cv": "line_height_cv", "mean_overlaps": "n_overlaps", "mean_short": "n_short_lines"}
    return stats.agg(F.count(F.lit(1)).alias("n_pages"), *(mean(c).alias(n) for n, c in means.items()), share("n_overlaps").alias("pct_with_overlap"), share("n_short_lines").alias("pct_with_short"))


def scans_once(pages: DataFrame, twins: DataFrame) -> DataFrame:
    """One row: pages, groups, registrations, second registrations, and scans counted once (``twins``: group_id, page_id)."""
    found = twins.agg(F.count_distinct("group_id").alias("groups"), F.count(F.lit(1)).alias("registrations"))
    both = pages.agg(F.count(F.lit(1)).alias("pages")).crossJoin(found)  # one row each
    return both.withColumn("second_registrations", F.col("registrations") - F.col("groups")).withColumn("scans", F.col("pages") - F.col("second_registrations"))


def zone_report(zones: DataFrame, pages: DataFrame) -> DataFrame:
    """(class, total, per_page, pages_with, mean_confidence) of the zones (page_id, class, confidence) of all pages, also those without any."""
    n = pages.agg(F.count(F.lit(1)).alias("_pages"))  # one row
    per = zones.groupBy("class").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("page_id").alias("pages_with"), F.avg("confidence").alias("mean_confidence"))
    return per.crossJoin(F.broadcast(n)).withColumn("per_page", F.col("total") / F.col("_pages")).drop("_pages")


def shares_by(rows: DataFrame, on: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    """(on, n, the share of rows that pass each test); null tests do not pass."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *((F.count_if(t) / F.count(F.lit(1))).alias(name) for name, t in tests.items()))


def winner(ours: Column, stored: Column, same_reader: Column) -> Column:
    """ours, stored or none: which minting of a piece stays. The same reader's again always replaces; another's only with more lines."""
    better = (same_reader & (ours > 0)) | (~same_reader & (ours > stored))
    return F.when(better, "ours").when(stored > 0, "stored").otherwise("none")


def placements_compared(one: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(field, kind, n): how two placements of the same pieces agree."""
    return compare_tables(one, other, keys, columns)


# --- volumes and letters in order -------------------------------------------------------------------------------------


def volume_order(series: Column, volume: Column, edition: Column) -> list[Column]:
    """Sort columns of volumes: by series, numbered ones before named ones, then edition."""
    number = volume.try_cast("int")
    return [series.asc(), number.isNull().asc(), F.coalesce(number, F.lit(0)).asc(), volume.asc(), F.coalesce(edition, F.lit("")).asc()]


def upcoming(volumes: DataFrame, today: Column, *, term: Column) -> DataFrame:
    """Volumes (series, volume, edition, year) still protected, soonest to be free first, with ``free_from``."""
    rows = volumes.where(~expired(F.col("year"), term, today)).withColumn("free_from", F.make_date(F.col("year") + term, F.lit(1), F.lit(1)))
    return rows.orderBy("free_from", *volume_order(F.col("series"), F.col("volume"), F.col("edition")))


def free_copies(sources: DataFrame, volumes: DataFrame, today: Column, *, term: Column) -> DataFrame:
    """``sources`` (series, volume, edition, …) with ``free``: the one edition of its volume is expired, or the one it names of several is.

    A copy of a volume with several editions that names none is not free, nor one of an unknown volume.
    """
    known = volumes.select("series", "volume", F.col("edition").alias("_e"), expired(F.col("year"), term, today).alias("_free"))
    per = known.groupBy("series", "volume").agg(F.count(F.lit(1)).alias("_n"), F.bool_and(F.col("_e").isNull()).alias("_plain"), F.bool_and("_free").alias("_all"))
    named = known.where("_e is not null").groupBy("series", "volume", F.col("_e").alias("edition")).agg(F.bool_or("_free").alias("_own"))
    joined = sources.join(per, ["series", "volume"], "left").join(named, ["series", "volume", "edition"], "left")
    free = F.when(F.col("_n").isNull(), False).when((F.col("_n") == 1) & F.col("_plain"), F.col("_all")).otherwise(F.coalesce("_own", F.lit(False)))
    return joined.select(*sources.columns, free.alias("free"))


def letters_in_order(letters: DataFrame) -> DataFrame:
    """Letters by date, undated ones last, then by number with its parts as numbers."""
    return letters.orderBy(F.col("year").isNull(), "year", F.coalesce("at", "not_before", F.lit("")), natural_key(F.col("letter")))


def corrections_in_order(corrections: DataFrame, pattern: str, before: str, after: str) -> DataFrame:
    """(pattern, before, after, n, edits): distinct corrections of each pattern, the commonest first, then the longest edits."""
    counted = corrections.groupBy(pattern, before, after).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("edits", F.levenshtein(before, after)).orderBy(pattern, F.col("n").desc(), F.col("edits").desc(), before, after)


# --- two readings of the same lines ----------------------------------------------------------------------------------


def buckets(lines: DataFrame, ours: Column, theirs: Column, *, same: float = 0.9, near: float | None = None) -> DataFrame:
    """``lines`` with ``like`` and ``bucket``: both_same or both_different (with ``near`` also both_near), ours_only, theirs_only, neither."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    shown = lines.withColumn("like", F.when(has(ours) & has(theirs), similarity(ours, theirs)))
    both = F.when(F.col("like") >= same, "both_same")
    if near is not None:
        both = both.when(F.col("like") >= near, "both_near")
    chain = F.when(F.col("like").isNotNull(), both.otherwise("both_different")).when(has(ours), "ours_only").when(has(theirs), "theirs_only")
    return shown.withColumn("bucket", chain.otherwise("neither"))


def witness_counts(lines: DataFrame, machine: Column, ours: Column, theirs: Column) -> DataFrame:
    """(ours, theirs, tie): of the lines given, to which reading the machine's is closer."""
    a, b = similarity(machine, ours), similarity(machine, theirs)
    tie = F.abs(a - b) < 1e-9
    return lines.agg(F.count_if(~tie & (a > b)).alias("ours"), F.count_if(~tie & (a < b)).alias("theirs"), F.count_if(tie).alias("tie"))


def extraction_quality(pages: DataFrame, production: str, control: str, *, flag: float = 0.10) -> DataFrame:
    """(sampled, flagged, empty_disagreements, mean_cer) of two extractions of the same pages; one empty and the other not is all wrong."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    one = empty(production) != empty(control)
    cer = F.when(one, 1.0).when(empty(production), 0.0).otherwise(rate(F.levenshtein(control, production), F.length(control)))
    made = pages.select(cer.alias("cer"), one.alias("one"))
    return made.agg(F.count(F.lit(1)).alias("sampled"), F.count_if((F.col("cer") > flag) | F.col("one")).alias("flagged"), F.count_if("one").alias("empty_disagreements"), F.coalesce(F.avg("cer"), F.lit(0.0)).alias("mean_cer"))


def verified_plan(verdicts: DataFrame, rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """(ref, action, text): what a judge's verdicts (ref, verdict, shown) do to rows (ref, text), with corrected texts (ref, corrected).

    A row is confirmed where it was called correct and still has the text that was shown, corrected where the
    judge gave a text; else the action says why nothing is done.
    """
    per = rows.groupBy("ref").agg(F.count(F.lit(1)).alias("_n"), F.first("text").alias("_text"))
    joined = verdicts.join(corrections, "ref", "left").join(per, "ref", "left")
    said, given = F.lower(F.trim("verdict")), F.col("corrected").isNotNull()
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    action = (
        F.when(~F.coalesce(said.isin("correct", "boundary", "wrong", "unreadable"), F.lit(False)), "unjudged").when(said == "unreadable", "unreadable")
        .when(~given & (said == "wrong"), "wrong without a text").when(~given & (said == "boundary"), "boundary without a text")
        .when(F.col("_n").isNull(), "no row").when(F.col("_n") > 1, "several rows")
        .when(given, "correct").when(squeeze(F.col("_text")) != squeeze(F.col("shown")), "text has changed").otherwise("confirm")
    )
    return joined.select("ref", action.alias("action"), F.when(action == "correct", F.col("corrected")).when(action == "confirm", F.col("_text")).alias("text"))


def verdicts_from_sheet(sheet: DataFrame, lines: DataFrame, words: Mapping[str, str]) -> DataFrame:
    """(ref, verdict, stratum, shown): the words of a returned sheet (ref, said) as verdicts; a said text that is none of them is a correction, so the line was wrong."""
    known = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    said = F.lower(F.trim("said"))
    verdict = F.when(F.coalesce(said, F.lit("")) == "", "").otherwise(F.coalesce(F.try_element_at(known, said), F.lit("wrong")))
    return sheet.join(lines.select("ref", "stratum", F.col("text").alias("shown")), "ref", "left").select("ref", verdict.alias("verdict"), "stratum", "shown")


def corpora(pieces: DataFrame, held: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((group, record_id, line), (reason, records)): lines (record_id, group, lines) of the groups outside the hold-out, and what stayed out."""
    marked = pieces.join(held.select("record_id").distinct().withColumn("_held", F.lit(True)), "record_id", "left")
    reason = F.when(F.col("_held"), "held_out").when(~F.coalesce(F.col("group").isin(*groups), F.lit(False)), "other_language")
    kept = marked.where(reason.isNull()).select("group", "record_id", F.explode("lines").alias("line"))
    return kept, marked.where(reason.isNotNull()).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("records"))


def confirmed_twins(candidates: DataFrame, boxes: DataFrame, agreement, least: float = 0.5) -> DataFrame:
    """Candidate groups (work_id, group, page_id, seq) whose first page agrees with another by ``agreement(pairs, boxes)``; boxes are read of candidates alone."""
    first = current_rows(candidates, ["work_id", "group"], [F.col("seq")]).select("work_id", "group", F.col("page_id").alias("a"))
    pairs = candidates.join(first, ["work_id", "group"]).where("page_id <> a").select("work_id", "group", "a", F.col("page_id").alias("b"))
    near = boxes.join(candidates.select("page_id"), "page_id", "left_semi")
    good = agreement(pairs, near).where(F.col("agreement") >= least)
    members = good.select("work_id", "group", F.explode(F.array("a", "b")).alias("page_id")).distinct()
    return candidates.join(members, ["work_id", "group", "page_id"], "left_semi")


def type_rates(lines: DataFrame, on: str, reference: str, hypothesis: str) -> DataFrame:
    """(on, lines, rate): error rates by type of print and in all (null) after the fold of print marks."""
    folded = lines.select(on, fold_print(reference).alias("r"), fold_print(hypothesis).alias("h"))
    return folded.rollup(on).agg(F.count(F.lit(1)).alias("lines"), rate(F.sum(F.levenshtein("r", "h")), F.sum(F.length("r"))).alias("rate"))


def distinct_ids(rows: DataFrame, column: str, *, where: Column | None = None) -> DataFrame:
    """The distinct ids of a table read from any source, without nulls and blanks."""
    kept = rows if where is None else rows.where(where)
    return kept.select(F.trim(F.col(column).cast("string")).alias(column)).where(F.col(column) != "").distinct()
