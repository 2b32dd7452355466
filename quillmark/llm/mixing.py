"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

1. A document's size is its number of words. Sources, by code point and null
   last, weigh 5, 2, 1, repeating, and share ``share`` (150 %) of all words; no
   target exceeds ``most`` (2) times its source, what is over goes to the others
   by weight (water filling by one pass over sorted sources).
2. The total is cut into blocks of ``block_words``. Sources get blocks by highest
   quotients target / (2s + 1); a source's blocks go to its shards likewise, by
   the shards' words. Shards split a source by a hash of the document, so that a
   source with a third of all rows is many small groups.
3. A shard's documents, in an order drawn by ``seed``, are one stream of words in
   blocks. Every block is taken quota // blocks times, and a run of the rest
   starts at a block drawn by the seed. So all but two documents of a shard are
   taken the same number of times throughout.

Nothing but totals of sources and shards meets in one task. The draw is by
sha-256, so reruns agree, also in other engines. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.shared import stash, unused

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST = 2
SEED = "mix-1"
BLOCK_WORDS = 64
#: Smaller blocks where the corpus has fewer than this many.
LEAST_BLOCKS = 4096
SHARD_WORDS = 1_000_000
#: Shards grow instead beyond this many, so totals by shard stay a small table.
MOST_SHARDS = 100_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, *, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """``totals`` (source, source_size) with place, weight and target."""
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    placed = totals.withColumn("place", F.row_number().over(order) - 1)
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1))
    everything = Window.partitionBy()
    # from the source that fills first; integers throughout, so one division makes the level
    filling = Window.partitionBy().orderBy(F.col("source_size") / F.col("weight"), "place")
    so_far = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * most
    left = F.expr(f"{share_percent} * everything") - F.col("capped") * 100
    level = left / (F.col("weights_on") * 100)
    return (
        weighed.withColumn("everything", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum(cap).over(so_far), F.lit(0)))
        .withColumn("weights_on", F.sum("weight").over(onward))
        .withColumn("own_level", level)
        .withColumn("open", F.col("own_level") * F.col("weight") < cap)
        # the first open source in filling order has the least size / weight among the open ones
        .withColumn("level", F.min(F.when(F.col("open"), F.struct((F.col("source_size") / F.col("weight")).alias("fills"), "place", F.col("own_level").alias("at")))).over(everything)["at"])
        .withColumn("target", F.when(F.col("open"), F.least(F.col("level") * F.col("weight"), cap.cast("double"))).otherwise(cap.cast("double")))
        .select("source", "source_size", "place", "weight", "everything", "target")
    )


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, tie: str) -> DataFrame:
    """``parties`` with quota: ``seats`` of each group by highest quotients votes / (2s + 1).

    Seats that every party surely gets are dealt at once: with n parties the
    common divisor moves no party's share by more than (n + 1) / 2 times its part
    of the votes, plus one for rounding. Only the quotients within that reach are
    listed and ranked, which are a few for each party, whatever the seats.
    """
    everyone, key = Window.partitionBy(*group), [*group, tie]
    v = F.col("_all_votes")
    share = F.when(v > 0, F.col(votes) / v).otherwise(F.lit(0.0))
    ranked = Window.partitionBy(*group).orderBy(F.col("_quotient").desc(), F.col(tie))
    sure = (
        parties.withColumn("_all_votes", F.sum(votes).over(everyone))
        .withColumn("_n", F.count(F.lit(1)).over(everyone))
        .withColumn("_reach", F.ceil(share * (F.col("_n") + 1) / 2) + 1)
        .withColumn("_base", F.greatest(F.lit(0), F.floor(share * F.col(seats)) - F.col("_reach")))
        .withColumn("_rest", F.col(seats) - F.sum("_base").over(everyone))
    )
    listed = sure.withColumn("_s", F.explode(F.expr("sequence(_base, _base + 2 * _reach + 1)"))).withColumn(
        "_quotient", F.col(votes) / (2 * F.col("_s") + 1)
    )
    won = (
        listed.withColumn("_rank", F.row_number().over(ranked))
        .groupBy(*key)
        .agg(F.sum(F.when((F.col("_rank") <= F.col("_rest")) & (F.col("_quotient") > 0), 1).otherwise(0)).alias("_won"), F.first("_base").alias("_sure"))
        .select(*(F.col(k).alias(f"_k_{k}") for k in key), (F.col("_won") + F.col("_sure")).cast("long").alias("quota"))
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    return parties.join(won, same, "left").drop(*(f"_k_{k}" for k in key)).fillna(0, ["quota"])


def draw(*parts: Column) -> Column:
    """63 bits of the sha-256 of the parts joined by ``:``."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def mix_sizes(
    sizes: DataFrame, *, seed: str = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST
) -> DataFrame:
    """The mix for ``sizes`` (doc_id, source, size, and tie to order rows of one id): per row target, taken and the span taken once more.

    Adds source_size, target, taken, ``full`` (times all of it is taken) and up to
    two extra spans of its words: [a1, e1) and [a2, e2).
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights=weights, share_percent=share_percent, most=most)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("everything") / LEAST_BLOCKS)))
    shard_of = F.greatest(F.lit(shard_words), F.ceil(F.col("everything") / MOST_SHARDS))
    targets = targets.withColumns(
        {
            "block": block,
            "shards": F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_of),
        }
    ).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / F.col("block")).cast("long"))
    targets = stash(sainte_lague(targets, [], "target", "blocks", "place").withColumnRenamed("quota", "source_blocks"), "mix-sources", 0)

    source = F.broadcast(targets.withColumnRenamed("source", "_source")) if _small(targets) else targets.withColumnRenamed("source", "_source")
    order = draw(F.lit(seed), F.col("doc_id"))
    dealt = (
        sizes.join(source, F.col("source").eqNullSafe(F.col("_source")), "left")
        .drop("_source")
        .withColumn("order", order)
        .withColumn("shard", F.pmod(F.col("order"), F.col("shards")))
    )
    shards = dealt.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"), F.first("block").alias("block"))
    shards = shards.withColumn("_votes", F.col("shard_size").cast("double"))
    shards = sainte_lague(shards, ["place"], "_votes", "source_blocks", "shard").withColumn(
        "shard_blocks", F.ceil(F.col("shard_size") / F.col("block"))
    )
    shards = (
        shards.withColumn("quota", F.least("quota", F.col("shard_blocks") * most))
        .withColumn("full", F.when(F.col("shard_blocks") > 0, F.expr("quota div shard_blocks")).otherwise(F.lit(0)))
        .withColumn("more", F.col("quota") - F.col("full") * F.col("shard_blocks"))
        .withColumn("first", F.when(F.col("shard_blocks") > 0, F.pmod(draw(F.lit(seed), F.lit("start"), F.col("place"), F.col("shard")), F.col("shard_blocks"))).otherwise(F.lit(0)))
        .withColumn("b1", F.col("first") * F.col("block"))
        .withColumn("b2", F.least(F.col("shard_size"), (F.col("first") + F.col("more")) * F.col("block")))
        .withColumn("b3", F.greatest(F.lit(0), F.col("first") + F.col("more") - F.col("shard_blocks")) * F.col("block"))
        .select("place", "shard", "full", "b1", "b2", "b3")
    )
    shards = stash(shards, "mix-shards", MOST_SHARDS * 64)
    within = Window.partitionBy("place", "shard").orderBy("order", "doc_id", "size", *(c for c in ("tie",) if c in sizes.columns))
    end = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    span = lambda lo, hi: (F.greatest(lo, F.col("start")) - F.col("start"), F.greatest(F.least(hi, F.col("end")), F.greatest(lo, F.col("start"))) - F.col("start"))
    (a1, e1), (a2, e2) = span(F.lit(0), F.col("b3")), span(F.col("b1"), F.col("b2"))
    taken = F.col("full") * F.col("size") + (F.col("e1") - F.col("a1")) + (F.col("e2") - F.col("a2"))
    return (
        placed.join(shards, ["place", "shard"])
        .withColumns({"a1": a1, "e1": e1, "a2": a2, "e2": e2})
        .withColumn("taken", taken.cast("long"))
    )


def _small(table: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table of a few numbers a row has few enough of them to broadcast."""
    return table.limit(rows + 1).count() <= rows


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (long).

    Null texts and texts without words have size 0 and nothing taken; a null
    source is a source; repeated rows each count. An empty table gives no rows.
    """
    sizes = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix_sizes(sizes, **parameters).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each time a document is taken.

    Whole copies are unchanged. A part is the words taken, joined by spaces, with
    n_chars (where there is such a column) of its own. Documents without words
    are not taken. Rows of one doc_id, source and size are taken in the order of their
    texts' hashes; equal rows share their fate in any order. All other columns come back as they were.
    """
    size, row, word, place = (unused(c, docs.columns) for c in ("_size", "_row", "_word", "_place"))
    # rows are numbered once, in a written table, so each meets its own plan, however many share an id
    rows = stash(docs.withColumn(size, word_count(F.col("text"))).withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = mix_sizes(rows.select("doc_id", "source", F.col(size).alias("size"), F.col(row).alias("row"), F.xxhash64("text").alias("tie")), **parameters)
    plan = plan.where("taken > 0").select(F.col("row").alias(word), F.struct("full", "a1", "e1", "a2", "e2").alias(place))
    joined = rows.join(plan, F.col(row) == F.col(word))
    full, a1, e1, a2, e2 = (F.col(place)[k] for k in ("full", "a1", "e1", "a2", "e2"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def part(a: Column, e: Column) -> Column:
        cut = F.array_join(F.slice(words, (a + 1).cast("int"), (e - a).cast("int")), " ")
        nothing = F.array().cast("array<string>")
        return F.when(e - a >= F.col(size), F.array("text")).when(e > a, F.array(cut)).otherwise(nothing)

    texts = F.concat(F.array_repeat("text", full.cast("int")), part(a1, e1), part(a2, e2))
    out = joined.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"), F.explode(texts).alias("text"))
    lengths = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*(lengths.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
