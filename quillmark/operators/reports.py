"""Reports: counts and rates by one key or several, in one pass each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.evaluation import rate


def views(rows: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """(key, value, measures): the measures for each value of each key, and for all rows (key ``all``, value null).

    One pass by grouping sets; keys are compared as text. A null value of a key is
    a value of its own.
    """
    sets = [*((k,) for k in keys), ()]
    made = rows.groupingSets(sets, *keys).agg(F.grouping_id(*keys).alias("_g"), *(m.alias(n) for n, m in measures.items()))
    bit = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    full = (1 << len(keys)) - 1
    of = [(F.col("_g") == full - bit[k], k) for k in keys]
    key, value = F.lit("all"), F.lit(None).cast("string")
    for test, k in of:
        key, value = F.when(test, F.lit(k)).otherwise(key), F.when(test, F.col(k).cast("string")).otherwise(value)
    return made.select(key.alias("key"), value.alias("value"), *measures)


def ranked_counts(rows: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """(on, name, n, place): counts of names, the commonest first, then by name; nulls do not count."""
    counted = rows.where(F.col(name).isNotNull()).groupBy(*on, name).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(*on).orderBy(F.col("n").desc(), name)))


def ranked_lists(rows: DataFrame, on: str, name: str, most: int) -> DataFrame:
    """(on, names): the ``most`` commonest names of each group in order, cut before they are collected."""
    best = ranked_counts(rows, [on], name).where(F.col("place") <= most)
    entry = F.struct("place", F.struct(F.col(name).alias("name"), "n").alias("e"))
    return best.groupBy(on).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("names"))


def name_weights(mentions: DataFrame, on: str) -> DataFrame:
    """(on, name, n) of ``mentions`` (on, names, n): each name once a row; a bare surname counts for the one fuller form of it in its group."""
    each = mentions.select(on, "n", F.explode(F.array_distinct("names")).alias("name")).groupBy(on, "name").agg(F.sum("n").alias("n"))
    fuller = each.where(F.contains("name", F.lit(", "))).select(on, F.substring_index("name", ", ", 1).alias("bare"), F.col("name").alias("full"))
    only = fuller.groupBy(on, "bare").agg(F.count(F.lit(1)).alias("forms"), F.first("full").alias("full")).where("forms = 1").select(on, F.col("bare").alias("name"), "full")
    return each.join(only, [on, "name"], "left").groupBy(on, F.coalesce("full", "name").alias("name")).agg(F.sum("n").alias("n"))


#: What a judge may say of a line; fixed values.
VERDICTS = ("correct", "boundary", "wrong", "unreadable")


def verdict_measures(verdict: Column) -> dict[str, Column]:
    """Counts of each verdict, of what was judged, and two precisions: as written, and usable; unreadable lines are in no denominator."""
    said = F.lower(F.trim(verdict))
    n = {v: F.count_if(said == v) for v in VERDICTS}
    judged = F.count_if(said.isin(*VERDICTS))
    scored = F.nullif(judged - n["unreadable"], F.lit(0).cast("long"))
    return n | {"judged": judged, "unjudged": F.count(F.lit(1)) - judged, "precision": n["correct"] / scored, "usable": (n["correct"] + n["boundary"]) / scored}


def weighted_precision(by_stratum: DataFrame, weights: DataFrame, stratum: str) -> DataFrame:
    """(weighted): precisions of strata weighted by their sizes (``weights``: stratum, size), strata without one left out."""
    joined = by_stratum.join(weights, stratum).where("precision is not null")
    return joined.agg((F.sum(F.col("size") * F.col("precision")) / F.sum("size")).alias("weighted"))


def flag_counts(rows: DataFrame, on: Sequence[str], flags: str, names: Sequence[str]) -> DataFrame:
    """(on, n, a count and a share of each flag)."""
    count = {f: F.count_if(F.array_contains(flags, f)) for f in names}
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *(c.alias(f) for f, c in count.items()), *((c / F.count(F.lit(1))).alias(f"{f}_share") for f, c in count.items()))


def quartiles(rows: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """(on, n, q1, q2, q3, least, most): quartiles at ranks (n + 1) i / 4 with interpolation; of one value it is that value."""
    w = Window.partitionBy(*on)
    ranked = rows.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count(F.lit(1)).over(w)})

    def at(i: int) -> Column:
        low = F.greatest(F.lit(1), F.least(F.floor((F.col("_n") + 1) * i / 4), F.col("_n") - 1))
        share = F.when(F.col("_n") == 1, 0.0).otherwise((F.col("_n") + 1) * (i / 4) - low)
        weight = F.when(F.col("_r") == low, 1 - share).when(F.col("_r") == low + 1, share)
        return F.sum(weight * F.col(value)).alias(f"q{i}")

    return ranked.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *(at(i) for i in (1, 2, 3)), F.min(value).alias("least"), F.max(value).alias("most"))


def charged(scores: DataFrame, ok: Column) -> DataFrame:
    """``scores`` once with all rows (mode ``charged``) and once without the failed ones (``omitted``)."""
    modes = F.when(ok, F.array(F.lit("charged"), F.lit("omitted"))).otherwise(F.array(F.lit("charged")))
    return scores.withColumn("mode", F.explode(modes))


def pooled(scores: DataFrame, on: Sequence[str], *, edits: str = "edits", chars: str = "chars") -> DataFrame:
    """(on, rows, edits, chars, cer, mean_cer): the rate over all characters and the mean of the rows' rates."""
    own = rate(F.col(edits), F.col(chars))
    return scores.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"), F.sum(edits).alias("edits"), F.sum(chars).alias("chars"), rate(F.sum(edits), F.sum(chars)).alias("cer"), F.avg(own).alias("mean_cer"))


def common_to_all(scores: DataFrame, reader: str, unit: str) -> DataFrame:
    """Rows of the units that every reader has."""
    readers = scores.agg(F.count_distinct(reader).alias("_all"))  # one row
    full = scores.groupBy(unit).agg(F.count_distinct(reader).alias("_n")).crossJoin(F.broadcast(readers)).where("_n = _all").select(unit)
    return scores.join(full, unit, "left_semi")


def disagreements(rows: DataFrame, reference: Column, a: Column, b: Column) -> DataFrame:
    """(lines, disagree, a_exact, b_exact, either_exact, either_share): where two readings differ, how often one is right."""
    differ = ~a.eqNullSafe(b)
    ra, rb = differ & (a == reference), differ & (b == reference)
    n = F.count_if(differ)
    return rows.agg(F.count(F.lit(1)).alias("lines"), n.alias("disagree"), F.count_if(ra).alias("a_exact"), F.count_if(rb).alias("b_exact"), F.count_if(ra | rb).alias("either_exact"), (F.count_if(ra | rb) / F.nullif(n, F.lit(0).cast("long"))).alias("either_share"))


def fold_tax(pairs: DataFrame, reference: str, hypothesis: str, fold) -> DataFrame:
    """(cer, cer_folded, tax, lines): what the error rate loses when both sides are folded; one pass."""
    made = pairs.select(reference, hypothesis, fold(F.col(reference)).alias("_fr"), fold(F.col(hypothesis)).alias("_fh"))
    cer = lambda r, h: rate(F.sum(F.levenshtein(r, h)), F.sum(F.length(r)))
    both = made.agg(cer(reference, hypothesis).alias("cer"), cer("_fr", "_fh").alias("cer_folded"), F.count(F.lit(1)).alias("lines"))
    return both.withColumn("tax", F.col("cer") - F.col("cer_folded"))


def break_even(levels: DataFrame, on: Sequence[str], level: str, measure: str, floor: float) -> DataFrame:
    """(on, level): the first level at which the measure is under ``floor``; null if none is."""
    return levels.groupBy(*on).agg(F.min(F.when(F.col(measure) < floor, F.col(level))).alias(level))


def attempts(readings: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, which, status, n): final and first statuses, and how many were retried (which ``retried``, status null)."""
    first = F.coalesce("first_status", "status")
    each = F.array(
        F.struct(F.lit("final").alias("which"), F.coalesce("status", F.lit("?")).alias("status")),
        F.struct(F.lit("first").alias("which"), F.coalesce(first, F.lit("?")).alias("status")),
        F.when(F.coalesce("attempts", F.lit(1)) > 1, F.struct(F.lit("retried").alias("which"), F.lit(None).cast("string").alias("status"))),
    )
    return readings.select(*on, F.explode(F.array_compact(each)).alias("e")).groupBy(*on, "e.which", "e.status").agg(F.count(F.lit(1)).alias("n"))


def totals(rows: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(on, n, and sum, least and most of each column); sums of nothing are 0."""
    made = [f(c) for c in columns for f in (lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum"), lambda c: F.min(c).alias(f"{c}_min"), lambda c: F.max(c).alias(f"{c}_max"))]
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *made)


def labels_of_pages(placed: DataFrame, page: str, group: str) -> DataFrame:
    """(page, group): the group of a page's pieces, ``both`` where de and la_fr meet, else the one of least name; few pieces share a page."""
    found = placed.groupBy(page).agg(F.sort_array(F.collect_set(group)).alias("g"))
    both = F.array_contains("g", "de") & F.array_contains("g", "la_fr")
    one = F.coalesce(*(F.when(F.array_contains("g", k), F.lit(k)) for k in ("de", "la_fr", "other")))
    return found.select(page, F.when(both, "both").otherwise(one).alias(group))


def held_out(records: DataFrame, on_page: DataFrame, pages: DataFrame, audited: DataFrame) -> DataFrame:
    """(record_id, reasons): records to hold out, for a set of their own (``records``: record_id, reason), a page (``pages``: page_id, reason; ``on_page``: record_id, page_id) or an audited line (``audited``: record_id)."""
    by_page = on_page.join(pages, "page_id").select("record_id", "reason")
    each = records.select("record_id", "reason").unionByName(by_page).unionByName(audited.select("record_id", F.lit("audit").alias("reason"))).where("record_id is not null")
    return each.groupBy("record_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))  # a few names of sets


def reasons(rows: DataFrame, cascade: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``reason``: the first rule of a cascade that a row fails, null if it fails none."""
    return rows.withColumn("reason", F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in cascade.items())))


def modes(rows: DataFrame, on: Sequence[str], value: Column, weight: Column = None) -> DataFrame:  # noqa: RUF013
    """(on, value, n): the value of the greatest weight (rows by default), the least value on ties."""
    counted = rows.withColumns({"_v": value, "_w": F.lit(1) if weight is None else weight}).where("_v is not null").groupBy(*on, "_v").agg(F.sum("_w").alias("n"))
    best = F.max(F.struct("n", (-F.col("_v")).alias("o"))).alias("b")
    return counted.groupBy(*on).agg(best).select(*on, (-F.col("b.o")).alias("value"), F.col("b.n").alias("n"))
