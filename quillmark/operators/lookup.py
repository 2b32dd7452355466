"""Citations to places: indexes of shelfmarks and edition references, and what a query points to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import edition_reference, folio, folio_span, signature_key, signature_parts, span_includes
from quillmark.operators.links import shuffled
from quillmark.operators.versions import current_rows

MOST_TARGETS = 100
#: Works whose pages are asked for by id; more meet their pages by a shuffle.
FEW_WORKS = 1_000
#: What the id of a work or page looks like.
ID = r"[A-Za-z]?\d+(:\d+)?"


def reference_key(series: Column, volume: Column, piece: Column) -> Column:
    """struct(series, volume, piece): a number, a volume without leading zeros, a piece in lower case; null if one is missing."""
    number = F.regexp_replace(F.trim(volume.cast("string")), r"^0+(?=.)", "")
    name = F.lower(F.trim(piece.cast("string")))
    whole = series.cast("string").cast("int")
    return F.when(whole.isNotNull() & (number != "") & (name != ""), F.struct(whole.alias("series"), number.alias("volume"), name.alias("piece")))


def edition_index(records: DataFrame) -> DataFrame:
    """(series, volume, piece, record_id): a row for each reference of each record; no list grows with a key."""
    refs = records.select("record_id", F.explode("aa_refs").alias("r"))
    return refs.select("record_id", reference_key(F.col("r.series"), F.col("r.volume"), F.col("r.piece")).alias("k")).where("k is not null").select("k.*", "record_id").distinct()


def shelfmark_index(works: DataFrame) -> DataFrame:
    """(key, work_id): a row for each shelfmark of each work."""
    return works.select("work_id", F.explode("shelfmarks").alias("s")).select(signature_key(F.col("s")).alias("key"), "work_id").where("key is not null").distinct()


def reference_label(series: Column, volume: Column, piece: Column) -> Column:
    """``AA VI,4 N. 109``; without a piece it ends after the volume, null without series or volume."""
    numerals = F.create_map(*(F.lit(x) for kv in zip(map(str, range(1, 9)), ("I", "II", "III", "IV", "V", "VI", "VII", "VIII"), strict=True) for x in kv))
    roman = F.coalesce(F.try_element_at(numerals, series.cast("string")), series.cast("string"))
    tail = F.when(F.coalesce(piece.cast("string"), F.lit("")) != "", F.concat(F.lit(" N. "), piece.cast("string"))).otherwise("")
    return F.concat(F.lit("AA "), roman, F.lit(","), volume.cast("string"), tail)


def by_shelfmark(query: str, shelfmarks: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """Targets of a shelfmark: works that carry it, else works whose marks it begins; with leaves, the pages that have them.

    A work none of whose pages carries such a folio is a target itself. Targets past the first ``most`` by work may be left out.
    """
    span = folio_span(signature_parts(F.lit(query))["leaf"])
    spark = shelfmarks.sparkSession
    asked = spark.range(1).select(signature_key(F.lit(query)).alias("q"), span.isNotNull().alias("leaves")).first()
    # one reading of the key, as an expression that is read again for each mention
    begun = F.startswith(F.concat("key", F.lit(",")), F.concat(F.lit(asked["q"]).cast("string"), F.lit(",")))
    both = shelfmarks.where(begun).select("work_id", F.when(F.col("key") == asked["q"], 0).otherwise(1).alias("far"))
    # a work is one target where no leaves are asked for: the first of them answer, and works are not read again
    wanted = FEW_WORKS + 1 if asked["leaves"] or most is None else min(most, FEW_WORKS + 1)
    nearest_first = both.distinct().orderBy("far", "work_id").limit(wanted).collect()
    nearest = [r["work_id"] for r in nearest_first if r["far"] == nearest_first[0]["far"]]
    few = len(nearest) <= FEW_WORKS
    far = nearest_first[0]["far"] if nearest_first else 0
    works = spark.createDataFrame([(w,) for w in nearest], both.select("work_id").schema) if few else both.where(F.col("far") == far).select("work_id").distinct()
    rest = F.lit("work").alias("kind"), "work_id", F.lit(None).cast("string").alias("page_id")
    if not asked["leaves"]:
        return works.select(*rest)
    # labels are read of the pages of these works alone
    own = pages.select("work_id", "page_id", "seq", "label")
    near = (own.where(F.col("work_id").isin([w for w in nearest if w is not None])) if few else own.join(shuffled(works), "work_id")).withColumn("ref", folio(F.col("label")))
    inside = near.where(F.col("ref").isNotNull() & span_includes(span, F.col("ref")))
    first = current_rows(inside, ["work_id"], [F.col("seq")]).select(F.lit("page").alias("kind"), "work_id", "page_id")
    return first.unionByName(works.join(shuffled(first.select("work_id")), "work_id", "left_anti").select(*rest))


def by_reference(query: str, editions: DataFrame, links: DataFrame, placed: DataFrame) -> DataFrame:
    """Targets of an edition reference: the first page of each record that cites it, else the work it is linked to."""
    spark = editions.sparkSession
    asked = spark.range(1).select(edition_reference(F.lit(query)).alias("q")).where("q.piece is not null").select("q.*")
    records = editions.join(F.broadcast(asked), ["series", "volume", "piece"]).select("record_id")
    first = current_rows(placed.join(records, "record_id"), ["record_id"], [F.col("seq")]).select("record_id", "work_id", "page_id")
    work = current_rows(links.join(records, "record_id"), ["record_id"], [F.col("confidence").desc(), F.col("work_id")]).join(first.select("record_id"), "record_id", "left_anti")
    return first.select(F.lit("page").alias("kind"), "work_id", "page_id").unionByName(work.select(F.lit("work").alias("kind"), "work_id", F.lit(None).cast("string").alias("page_id")))


def by_id(query: str, works: DataFrame, pages: DataFrame) -> DataFrame:
    """The page or work of an id."""
    page = pages.where(F.col("page_id") == query).select(F.lit("page").alias("kind"), "work_id", "page_id")
    return page.unionByName(works.where(F.col("work_id") == query).select(F.lit("work").alias("kind"), "work_id", F.lit(None).cast("string").alias("page_id")))


def lookup(query: str, *, works: DataFrame, pages: DataFrame, shelfmarks: DataFrame, editions: DataFrame, links: DataFrame, placed: DataFrame, most: int = MOST_TARGETS) -> DataFrame:
    """(kind, work_id, page_id): where a citation points, at most ``most`` targets by work.

    An edition reference goes first, then an id, then a shelfmark in any letter case.
    """
    text = " ".join((query or "").split())
    spark = works.sparkSession
    if spark.range(1).select(edition_reference(F.lit(text)).isNotNull()).first()[0]:
        found = by_reference(text, editions, links, placed)
    else:
        found = by_id(text, works, pages) if re.fullmatch(ID, text) else None
        if found is None or found.isEmpty():
            # families as they are written; fixed values
            spelled = re.sub(r"(?i)^(lh|lbr|lk|marg)\b", lambda m: {"lh": "LH", "lbr": "LBr", "lk": "LK", "marg": "Marg"}[m[1].lower()], text)
            found = by_shelfmark(spelled, shelfmarks, pages, most)
    return found.orderBy("work_id", "page_id").limit(most)


def records_of_works(links: DataFrame, records: DataFrame) -> DataFrame:
    """(work_id, records): the linked records of a work, best links first; a work has few."""
    joined = links.join(records, "record_id")
    about = F.struct((-F.col("confidence")).alias("o"), "record_id", "method", *(c for c in records.columns if c != "record_id"))
    return joined.groupBy("work_id").agg(F.transform(F.sort_array(F.collect_list(about)), lambda x: x.dropFields("o")).alias("records"))


def pages_by_folio(pages: DataFrame) -> DataFrame:
    """(work_id, num, pages): the pages of a folio, recto before verso; a folio has few."""
    side = F.when(F.col("ref.side") == "r", 1).when(F.col("ref.side") == "v", 2).otherwise(0)
    known = pages.withColumn("ref", folio(F.col("label"))).where("ref is not null")
    return known.groupBy("work_id", F.col("ref.num").alias("num")).agg(F.transform(F.sort_array(F.collect_list(F.struct(side.alias("side"), "seq", "page_id"))), lambda x: x["page_id"]).alias("pages"))


def pieces_of_volumes(records: DataFrame, links: DataFrame, volumes: DataFrame) -> DataFrame:
    """(record_id, work_id, series, volume, piece): each record's first reference to each expired volume (``volumes``: series, volume), with its best link."""
    refs = records.select("record_id", F.posexplode("aa_refs").alias("pos", "r")).select("record_id", "pos", reference_key(F.col("r.series"), F.col("r.volume"), F.col("r.piece")).alias("k")).where("k is not null")
    inside = refs.select("record_id", "pos", "k.*").join(volumes.select("series", "volume").distinct(), ["series", "volume"], "left_semi")
    first = current_rows(inside, ["record_id", "series", "volume"], [F.col("pos")]).drop("pos")
    best = current_rows(links, ["record_id"], [F.col("confidence").desc(), F.col("work_id")]).select("record_id", "work_id")
    return first.join(best, "record_id", "left").select("record_id", "work_id", "series", "volume", "piece")
