"""Line dedup by site-relative frequency.

A line is boilerplate of its site if it stands on more than ``ratio`` of the
site's pages (and on ``least_pages`` at least). Pages that hold a line are
counted by (site, 128-bit hash of the line), pre-aggregated before the shuffle,
so a site with a third of all pages is many small keys and no text is shuffled.
A site has at most (mean lines a page) / ratio such lines; the table of them is
broadcast if its checked size allows, else lines' hashes are joined.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.shared import stash, unused

RATIO = 0.08
LEAST_PAGES = 4
#: Lines in the broadcast table at most; a line is two numbers.
BROADCAST_LINES = 500_000
#: Keys that a line is spread over where it is looked up by a join.
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _blank(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^[\x20\x09-\x0D]*$"))


def boilerplate(docs: DataFrame, *, site: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, h1, h2, pages, share) of the lines over the ratio; null is a site, blank lines never count."""
    pages = docs.select(F.col(site).alias("site"), F.col(text).alias("text"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    each = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _hash))
    counted = (
        pages.where(F.col("text").isNotNull())
        .select("site", F.explode(each).alias("line"))
        .groupBy("site", F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= least_pages)
    )
    totals = totals.withColumnRenamed("site", "_site")
    joined = counted.join(totals, F.col("site").eqNullSafe(F.col("_site"))).withColumn("share", F.col("pages") / F.col("total"))
    return joined.where(F.col("share") > ratio).select("site", "h1", "h2", "pages", "share")


def dedup_lines(docs: DataFrame, *, site: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = BROADCAST_LINES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines dropped, and n_lines and n_dropped (long; or other names in ``counts``; replaced if there).

    The order of what stays is kept, also repeats within a page, which count
    once; blank lines stay. A null text stays null with no lines; an empty one is one
    line. A page whose lines are all dropped keeps its row with an empty text. All
    other columns come back as they were.
    """
    found = stash(boilerplate(docs, site=site, text=text, ratio=ratio, least_pages=least_pages), "lines")
    gone, left = unused("_gone", docs.columns), unused("_left", docs.columns)
    lines = _lines(F.col(text))
    if found.limit(broadcast_lines + 1).count() <= broadcast_lines:
        joined = _with_lines_of_site(docs, found, site, gone)
        kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col(gone), _hash(x)))
    else:
        joined = _with_places(docs, found, site, text, gone)
        kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i))
    joined = joined.withColumn(left, F.when(F.col(gone).isNull(), lines).otherwise(kept))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    dropped = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(left)).cast("long")
    made = {text.lower(): F.when(dropped > 0, F.array_join(left, "\n")).otherwise(F.col(text)), counts[0].lower(): n, counts[1].lower(): dropped}
    names = [*docs.columns, *(c for c in counts if c.lower() not in {x.lower() for x in docs.columns})]
    return joined.select(*(made.get(c.lower(), F.col(f"`{c}`")).alias(c) for c in names))


def _with_lines_of_site(docs: DataFrame, found: DataFrame, site: str, gone: str) -> DataFrame:
    """``docs`` with the hashes of the lines that go from each page's site; null if none."""
    own = unused("_site", docs.columns)
    by_site = found.groupBy(F.col("site").alias(own)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    return docs.join(F.broadcast(by_site), F.col(site).eqNullSafe(F.col(own)), "left")


def _with_places(docs: DataFrame, found: DataFrame, site: str, text: str, gone: str) -> DataFrame:
    """For more lines than can be broadcast: ``docs`` with the places of the lines that go from each page; null if none.

    Lines are looked up by hash, without their text. A line that most pages have is
    spread over SALTS keys.
    """
    row = unused("_row", docs.columns)
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "lines-rows")
    each = rows.select(F.col(row).alias("row"), F.col(site).alias("site"), F.posexplode(_lines(F.col(text))).alias("at", "line")).where(~_blank(F.col("line")))
    each = each.select("row", "at", "site", _hash(F.col("line")).alias("h"), F.pmod("row", F.lit(SALTS)).alias("salt"))
    drop = found.select(F.col("site").alias("of"), "h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt2"))
    same = F.col("site").eqNullSafe(F.col("of")) & (F.col("h.h1") == F.col("h1")) & (F.col("h.h2") == F.col("h2")) & (F.col("salt") == F.col("salt2"))
    places = each.join(drop, same).groupBy(F.col("row").alias(unused("_of", rows.columns))).agg(F.collect_list("at").alias(gone))
    return rows.join(places, F.col(row) == F.col(places.columns[0]), "left")
