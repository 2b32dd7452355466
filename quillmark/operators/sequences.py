"""Ordered rows: islands, carried values, joined lines, anchors, chains, modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import let
from quillmark.session import shared_folder


def islands(rows: DataFrame, on: Sequence[str], at: str, gap: int = 1) -> DataFrame:
    """(on, first, last, n) of runs whose neighbours are at most ``gap`` apart."""
    w = Window.partitionBy(*on).orderBy(at)
    begins = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    marked = rows.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(w))
    return marked.groupBy(*on, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def carried(rows: DataFrame, on: Sequence[str], order: str, value: Column) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def joined_lines(rows: DataFrame, on: Sequence[str], order: str, text: str) -> DataFrame:
    """(on, text): ordered lines as one text; a hyphen at a line's end is closed up if the next begins in lower case."""
    w = Window.partitionBy(*on).orderBy(order)
    nxt = F.lead(text).over(w)
    split = F.rlike(F.col(text), F.lit(r"\p{L}[-¬=]\s*$")) & F.rlike(F.trim(nxt), F.lit(r"^\p{Ll}"))
    piece = F.when(split, F.regexp_replace(F.rtrim(F.col(text)), r"[-¬=]\s*$", "")).when(nxt.isNull(), F.trim(text)).otherwise(F.concat(F.trim(text), F.lit(" ")))
    parts = rows.select(*on, order, piece.alias("_piece"))
    ordered = F.sort_array(F.collect_list(F.struct(order, "_piece")))
    return parts.groupBy(*on).agg(F.array_join(F.transform(ordered, lambda p: p["_piece"]), "").alias("text"))


def first_mode(rows: DataFrame, on: Sequence[str], value: str, order: str) -> DataFrame:
    """(on, value, n): the commonest value, the one seen first on ties; nulls do not count."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = F.max(F.struct("n", (-F.col("_first")).alias("_first"), F.col(value).alias("v"))).alias("_best")
    return counted.groupBy(*on).agg(best).select(*on, F.col("_best.v").alias(value), F.col("_best.n").alias("n"))


def shingles(text: Column, k: int) -> Column:
    """All substrings of k characters, in order; linear in the text, unlike substrings by position."""
    last = F.length(text) - k + 1
    grams = lambda chars: F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, F.lit(k)), ""))
    return F.when(last >= 1, let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), grams)).otherwise(F.array().cast("array<string>"))


def anchors_by_text(a: DataFrame, b: DataFrame, *, a_key: str, b_key: str, text: str, k: int = 8, most: int = 8, few: int = 200_000, parts: int = 16) -> DataFrame:
    """(a_key, b_key, n, first_a, first_b): shared k-grams that occur ``most`` times or fewer in the shorter text of the pair (``a``'s on ties).

    ``n`` counts pairs of places; a gram counts however many texts have it. Keys
    are unique and not null. ``a`` is the smaller table: up to ``few`` grams of it, counted first, are broadcast, so
    grams of ``b`` that ``a`` lacks are never dealt out; beyond that each stands in the join
    ``parts`` times and a text of ``b`` meets one of them, so a frequent gram is dealt over ``parts`` keys.
    """

    def grams(t, key, side):
        return t.select(F.col(key), F.length(text).alias(f"_len_{side}"), F.posexplode(shingles(F.col(text), k)).alias(f"_at_{side}", "gram"))

    ours = grams(a, a_key, "a").groupBy(a_key, "_len_a", "gram").agg(F.count(F.lit(1)).alias("_n_a"), F.min("_at_a").alias("_at_a"))
    theirs = grams(b, b_key, "b")
    if ours.limit(few + 1).count() <= few:
        met = theirs.join(F.broadcast(ours), "gram")
    else:
        dealt = ours.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = theirs.withColumn("_part", F.pmod(F.xxhash64(b_key), F.lit(parts)).cast("int")).join(dealt, ["gram", "_part"])
    each = met.groupBy(a_key, b_key, "gram", "_len_a", "_len_b", "_n_a", "_at_a").agg(F.count(F.lit(1)).alias("_n_b"), F.min("_at_b").alias("_at_b"))
    each = each.where(F.when(F.col("_len_a") <= F.col("_len_b"), F.col("_n_a")).otherwise(F.col("_n_b")) <= most)
    return each.groupBy(a_key, b_key).agg(F.sum(F.col("_n_a") * F.col("_n_b")).alias("n"), F.min("_at_a").alias("first_a"), F.min("_at_b").alias("first_b"))


def sessions(rows: DataFrame, on: Sequence[str], at: str, gap: str) -> DataFrame:
    """Session windows by a gap of event time."""
    return rows.groupBy(*on, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*on, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def label_spread(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (a, b) reach, by repeated minima until nothing changes.

    Pre-aggregated: a node's neighbours are never collected, only their least label is kept. A
    label is followed to its own label each round, so chains shorten by half or more. Needs a checkpoint folder.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")).checkpoint()
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        found = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("before"), F.least("component", F.coalesce("least", "component")).alias("component"))
        # a label is itself a node: its own label is at least as small
        jump = found.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        moved = found.join(jump, found["component"] == jump["_n"]).select("node", "before", F.least("component", "_c").alias("component")).checkpoint()
        labels = moved.select("node", "component")
        if moved.where("component <> before").isEmpty():
            return labels


def running(rows: DataFrame, on: Sequence[str], order: Sequence[Column | str], *, value: str | None = None, name: str = "n") -> DataFrame:
    """``rows`` with ``name``: the running sum of ``value`` in its group's order, or without one the row's number from 1.

    Rows are dealt by ranges of (on, order) and written; a range's sums are a row for
    each of its groups, and what stands before a range is added to the sums within it. So a group of
    any size is shared by many tasks, as a window over it would not be.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    own = F.lit(1).cast("long") if value is None else F.col(value)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_own", own).repartitionByRange(parts, *on, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*on, "_range").agg(F.sum("_own").alias("_s")).withColumn("_base", F.sum("_s").over(before))
    bases = sums.where("_base is not null").select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_b_{k}") for k in on), "_base")
    within = Window.partitionBy("_range", *on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col("_range") == F.col("_r"), *(F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in on)]
    summed = dealt.withColumn("_sum", F.sum("_own").over(within)).join(bases, same, "left")
    return summed.select(*rows.columns, (F.col("_sum") + F.coalesce("_base", F.lit(0))).alias(name))
