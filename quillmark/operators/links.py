"""Links between record sets: by id, by key, by range, and what is left over."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.sequences import running
from quillmark.operators.versions import current_rows


def shuffled(rows: DataFrame) -> DataFrame:
    """One side of a join of two tables of any size: neither is broadcast, however small the planner takes it for.

    It reckons rows by the size of the files they come from: exploded rows count as none, and a well packed file as few.
    """
    return rows.hint("shuffle_merge")


def two_method_links(by_id: DataFrame, by_key: DataFrame, left: str, right: str, *, id_confidence: float = 1.0, key_confidence: float = 0.7) -> DataFrame:
    """(left, right, method, confidence): explicit ids first, keys only for pairs that have no link."""
    one = by_id.select(left, right).distinct().withColumns({"method": F.lit("id"), "confidence": F.lit(id_confidence)})
    two = by_key.select(left, right).distinct().withColumns({"method": F.lit("key"), "confidence": F.lit(key_confidence)})
    return current_rows(one.unionByName(two), [left, right], [F.col("confidence").desc()])


def best_link(links: DataFrame, left: str, right: str) -> DataFrame:
    """The link of highest confidence for each left id, the first right id on ties."""
    return current_rows(links, [left], [F.col("confidence").desc(), F.col(right)])


def unresolved(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """References whose target is not there."""
    return references.join(targets.select(key).distinct(), key, "left_anti")


def in_range(points: DataFrame, spans: DataFrame, *, on: Sequence[str], at: str, lo: str, hi: str, width: int = 64, extra: Column | None = None) -> DataFrame:
    """Points within spans of the same ``on``: a range join as an equi-join on cells of ``width``.

    A span is listed once for each cell it touches, a point lies in one cell, so
    the pairs met are near the pairs found, whatever the lengths of the groups.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    cells = spans.withColumn("_cell", F.explode(F.sequence(cell(lo), cell(hi))))
    found = points.withColumn("_cell", cell(at)).join(cells, [*on, "_cell"])
    found = found.where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))
    return (found if extra is None else found.where(extra)).drop("_cell")


def overlapping(a: DataFrame, b: DataFrame, *, on: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of overlapping spans, each met once: in the cell where the later of the two begins."""
    cell = lambda c: F.floor(F.col(c) / width)
    left = a.withColumn("_cell", F.explode(F.sequence(cell(a_span[0]), cell(a_span[1]))))
    right = b.withColumn("_cell", F.explode(F.sequence(cell(b_span[0]), cell(b_span[1]))))
    found = left.join(right, [*on, "_cell"]).where((F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1])))
    return found.where(F.col("_cell") == F.floor(F.greatest(a_span[0], b_span[0]) / width)).drop("_cell")


def nearest_before(left: DataFrame, right: DataFrame, *, on: Sequence[str], left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """As-of join: for each left row the values of the last right row at or before it, by one window over the union."""
    held = F.struct(F.col(right_at).alias("_at"), *values)
    a = left.withColumns({"_when": F.col(left_at), "_side": F.lit(1), "_held": F.lit(None).cast(right.select(held).schema[0].dataType)})
    b = right.select(*on, F.col(right_at).alias("_when"), F.lit(0).alias("_side"), held.alias("_held"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("_when", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_held", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Counts by column of values that are equal, changed, and only in one of the two tables."""
    left = a.select(*keys, F.struct(*columns).alias("_a"))
    right = b.select(*keys, F.struct(*columns).alias("_b"))
    joined = left.join(right, list(keys), "full_outer")
    kinds = [
        F.struct(
            F.lit(c).alias("field"),
            F.when(F.col("_a").isNull(), "only_new").when(F.col("_b").isNull(), "only_old").when(F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), "equal").otherwise("changed").alias("kind"),
        )
        for c in columns
    ]
    return joined.select(F.inline(F.array(*kinds))).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


def inverted(table: DataFrame, keys: Column, value: str) -> DataFrame:
    """(key, value): the postings of an inverted index from an array of keys, each once; no row grows with a key."""
    return table.select(F.explode(keys).alias("key"), value).where("key is not null").distinct()


def exclusive_pairs(pairs: DataFrame, *, block: Sequence[str], a: str, b: str, score: str) -> DataFrame:
    """Greedy one-to-one pairs in each block, best score first (ties by a, then b)."""

    def greedy(pdf):
        taken_a, taken_b, keep = set(), set(), []
        for i, (x, y) in enumerate(zip(pdf[a], pdf[b], strict=True)):
            if x not in taken_a and y not in taken_b:
                taken_a.add(x), taken_b.add(y), keep.append(i)
        return pdf.iloc[keep]

    def run(pdf):
        return greedy(pdf.sort_values([score, a, b], ascending=[False, True, True], kind="stable"))

    return pairs.groupBy(*block).applyInPandas(run, pairs.schema)


def greedy_matching(pairs: DataFrame, a: str, b: str, score: str, *, rest: int = 50_000) -> DataFrame:
    """(a, b, score): greedy one-to-one pairs of one set, best score first (ties by a, then b); an id stands in one pair, on either side.

    A pair that is the best of both its ids is one that the greedy order takes, so
    all such pairs are taken at once, their ids leave, and the rest goes on until
    no pair is left: the same pairs as one by one, without a block in one task. The last
    ``rest`` pairs, counted first, are matched in order in one task. Needs a checkpoint folder.
    """
    live = pairs.select(a, b, score).where(F.col(a) != F.col(b)).checkpoint()
    kept = []
    edge = F.struct(F.col(score).alias("s"), (-F.col(a)).alias("x"), (-F.col(b)).alias("y"))
    while (left := live.count()) > rest:
        ends = live.select(F.explode(F.array(a, b)).alias("_id"), edge.alias("_edge"))
        best = ends.groupBy("_id").agg(F.max("_edge").alias("_edge"))
        won = best.groupBy("_edge").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2")
        won = won.select((-F.col("_edge.x")).alias(a), (-F.col("_edge.y")).alias(b), F.col("_edge.s").alias(score)).checkpoint()
        gone = won.select(F.explode(F.array(a, b)).alias("_id"))
        live = live.join(gone, F.col(a) == F.col("_id"), "left_anti").join(gone, F.col(b) == F.col("_id"), "left_anti").checkpoint()
        kept.append(won)

    def in_order(pdf):
        taken, keep = set(), []
        pdf = pdf.sort_values([score, a, b], ascending=[False, True, True], kind="stable")
        for i, (x, y) in enumerate(zip(pdf[a], pdf[b], strict=True)):
            if x not in taken and y not in taken:
                taken.update((x, y)), keep.append(i)
        return pdf.iloc[keep]

    out = live.groupBy().applyInPandas(in_order, live.schema) if left else live
    for won in kept:
        out = out.unionAll(won)
    return out


def within_tolerance(rows: DataFrame, *, on: Sequence[str], key: str, value: str, least: float, share: float = 0.0) -> DataFrame:
    """(one, other, apart): all pairs of a group, one < other, whose values differ by ``least`` or ``share`` of the greater at most.

    A range join on cells of ``least`` width, so the pairs met are near the pairs found.
    """
    reach = F.greatest(F.col(value) + least, F.col(value) / (1 - share)) + 1
    low = rows.select(*on, F.col(key).alias("_k1"), F.col(value).alias("_v1"), reach.alias("_reach"))
    high = rows.select(*on, F.col(key).alias("_k2"), F.col(value).alias("_v2"))
    near = F.abs(F.col("_v1") - F.col("_v2")) <= F.greatest(F.lit(least), F.greatest("_v1", "_v2") * share)
    once = (F.col("_v1") < F.col("_v2")) | (F.col("_k1") < F.col("_k2"))
    found = in_range(high, low, on=on, at="_v2", lo="_v1", hi="_reach", width=least, extra=near & once)
    return found.select(F.least("_k1", "_k2").alias("one"), F.greatest("_k1", "_k2").alias("other"), F.abs(F.col("_v1") - F.col("_v2")).alias("apart"))


def _closest_first(at: list[float], keys: list, least: float, unknown: set[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Greedy pairs of rising, different values, closest first (ties by the lesser key, then the greater), and the places left open.

    The closest pair of what is left stands side by side, so neighbours are all that is looked at. Nothing is known of
    what is beside the ``unknown`` places; they stay open, and so does what would next be paired with an open place.
    """
    n = len(at)
    left, right, state = list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(n)  # state: 1 paired, 2 open
    for i in unknown:
        state[i] = 2
    edge = lambda i, j: (at[j] - at[i], min(keys[i], keys[j]), max(keys[i], keys[j]), i, j)
    queue = [edge(i, i + 1) for i in range(n - 1) if at[i + 1] - at[i] <= least]
    heapq.heapify(queue)
    pairs = []
    while queue:
        *_, i, j = heapq.heappop(queue)
        if state[i] == 1 or state[j] == 1:
            continue
        if state[i] or state[j]:
            state[i] = state[j] = 2
            continue
        state[i] = state[j] = 1
        pairs.append((i, j))
        before, after = left[i], right[j]
        if before >= 0:
            right[before] = after
        if after < n:
            left[after] = before
        if before >= 0 and after < n and at[after] - at[before] <= least:
            heapq.heappush(queue, edge(before, after))
    return pairs, [i for i in range(n) if state[i] == 2]


def closest_matching(rows: DataFrame, *, on: Sequence[str], key: str, value: str, least: float, stretch: int = 100_000) -> DataFrame:
    """(one, other, score): ``greedy_matching`` of all pairs of a group whose values differ by ``least`` at most, score less the difference, without the pairs.

    Rows of one value are paired in the order of their keys. Of different values the closest two stand side by side, so ranges of the
    rows are matched in a task each; what depends on a range beside it stays open, and is matched in half as many ranges or fewer, to one.
    Ids that stand in several rows are matched by the pairs. Needs a checkpoint folder.
    """
    known = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    points = rows.where(known).dropna(subset=[*on, key]).select(*on, F.col(key).alias("_k"), F.col(value).alias("_v")).distinct().checkpoint()
    if not points.groupBy("_k").count().where("count > 1").isEmpty():
        pairs = within_tolerance(rows, on=on, key=key, value=value, least=least)
        return greedy_matching(pairs.select("one", "other", (-F.col("apart")).alias("score")), "one", "other", "score")
    two = running(points, [*on, "_v"], ["_k"], name="_at").groupBy(*on, "_v", F.floor((F.col("_at") - 1) / 2).alias("_two"))
    made = two.agg(F.min("_k").alias("_k"), F.max("_k").alias("_o"), F.count(F.lit(1)).alias("_n"))
    made = made.select(*on, "_k", "_v", F.when(F.col("_n") == 2, F.col("_o")).alias("_o"), F.when(F.col("_n") == 2, F.lit(-0.0)).alias("_s")).checkpoint()
    kept, live, parts, columns = [made.where("_o is not null")], made.where("_o is null"), None, made.columns
    # differences of values farther apart than this are never rounded to one another
    fine = 4 * float(np.spacing(least))

    def matched(alone: bool):
        def run(batches):
            pdf = pd.concat(list(batches) or [pd.DataFrame(columns=columns)], ignore_index=True)
            if pdf.empty:
                return
            fresh = (pdf[list(on)] != pdf[list(on)].shift()).any(axis=1).to_numpy()
            starts = [*np.flatnonzero(fresh), len(pdf)]
            at, keys = pdf["_v"].tolist(), pdf["_k"].tolist()
            place, other, score = [], [], []
            for lo, hi in zip(starts, starts[1:], strict=False):
                unknown = set() if alone else {i for i, edge in ((0, lo == 0), (hi - lo - 1, hi == len(pdf))) if edge}
                if not alone and (np.diff(at[lo:hi]) <= fine).any():
                    unknown = set(range(hi - lo))
                pairs, left = _closest_first(at[lo:hi], keys[lo:hi], least, unknown)
                for i, j in pairs:
                    a, b = sorted((lo + i, lo + j), key=keys.__getitem__)
                    place.append(a), other.append(keys[b]), score.append(-abs(at[a] - at[b]))
                place += [lo + i for i in left]
                other += [None] * len(left)
                score += [None] * len(left)
            out = pdf.iloc[place].copy()
            out["_o"], out["_s"] = pd.array(other, dtype=pd.Int64Dtype() if isinstance(keys[0], int) else object), pd.array(score, dtype="Float64")
            yield out[columns]

        return run

    while parts != 1 and (left := live.count()):
        parts = min(-(-left // stretch), max(parts // 2, 1) if parts else left)
        dealt = live.repartitionByRange(parts, *on, "_v", "_k").sortWithinPartitions(*on, "_v", "_k")
        done = dealt.mapInPandas(matched(parts == 1), made.schema).checkpoint()
        kept.append(done.where("_o is not null"))
        live = done.where("_o is null")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionAll(more)
    return out.select(F.col("_k").alias("one"), F.col("_o").alias("other"), F.col("_s").alias("score"))


def near_in_sequence(rows: DataFrame, *, on: Sequence[str], order: str, within: int, condition, stretch: int = 10_000) -> DataFrame:
    """Pairs of a row and one of the next ``within`` rows of its group that ``condition(a, b)`` holds for.

    A row carries those after it by a window, so there is no self-join and no pairs of a whole
    group. Groups are cut into stretches of rows, each with copies of the first rows of the
    next, so a group of any size is shared by many tasks.
    """
    row = F.struct(*rows.columns)
    placed = running(rows, on, [order], name="_at").withColumn("_cell", F.floor((F.col("_at") - 1) / stretch))
    early = (F.col("_cell") > 0) & ((F.col("_at") - 1) % stretch < within)
    cells = F.when(early, F.array(F.col("_cell"), F.col("_cell") - 1)).otherwise(F.array("_cell"))
    dealt = placed.withColumn("_in", F.explode(cells))
    w = Window.partitionBy(*on, "_in").orderBy("_at").rowsBetween(1, within)
    paired = dealt.select(row.alias("a"), (F.col("_in") == F.col("_cell")).alias("_own"), F.collect_list(row).over(w).alias("_next")).where("_own")
    return paired.select("a", F.explode("_next").alias("b")).where(condition(F.col("a"), F.col("b")))
