"""Seeded samples, quotas and splits; draws are by sha-256, so they can be repeated anywhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import seeded_order
from quillmark.operators.sequences import running


def equal_quotas(available: Mapping[str, int], n: int) -> dict[str, int]:
    """n split evenly over strata, capped by supply; what a stratum cannot give goes to the others."""
    quota = dict.fromkeys(available, 0)
    left = min(n, sum(available.values()))
    while left:
        open_ = [k for k in sorted(available) if quota[k] < available[k]]
        share, extra = divmod(left, len(open_))
        for i, k in enumerate(open_):
            give = min(available[k] - quota[k], share + (i < extra))
            quota[k] += give
            left -= give
    return quota


def weighted_quotas(available: Mapping[str, int], n: int, weights: Mapping[str, int], floor: int = 0) -> dict[str, int]:
    """Largest remainders of n by exact weights, each at least ``floor`` and at most its supply."""
    quota = {k: min(floor, v) for k, v in available.items()}
    left = max(0, min(n, sum(available.values())) - sum(quota.values()))
    while left:
        open_ = {k: Fraction(weights.get(k, 0)) for k in available if quota[k] < available[k] and weights.get(k, 0) > 0}
        if not open_:
            break
        total = sum(open_.values())
        ideal = {k: left * w / total for k, w in open_.items()}
        give = {k: min(int(x), available[k] - quota[k]) for k, x in ideal.items()}
        if not any(give.values()):
            for k in sorted(open_, key=lambda k: (-(ideal[k] - int(ideal[k])), k))[:left]:
                give[k] = 1
        for k, g in give.items():
            quota[k] += g
            left -= g
    return quota


def proportional_quotas(cells: DataFrame, cell: Sequence[str], size: str, n: int) -> DataFrame:
    """``cells`` with quota: n by largest remainders of their sizes, ties by cell."""
    everything = Window.partitionBy()
    exact = F.lit(n) * F.col(size) / F.sum(size).over(everything)
    based = cells.withColumn("_exact", exact).withColumn("quota", F.floor("_exact"))
    rest = based.withColumn("_rest", F.lit(n) - F.sum("quota").over(everything))
    place = F.row_number().over(Window.orderBy((F.col("_exact") - F.col("quota")).desc(), *cell))
    return rest.withColumn("_place", place).withColumn("quota", (F.col("quota") + F.when(F.col("_place") <= F.col("_rest"), 1).otherwise(0)).cast("long")).drop("_exact", "_rest", "_place")


def stratified(rows: DataFrame, stratum: Sequence[str], key: str, quota: Column | int, *, seed: int | str) -> DataFrame:
    """The first ``quota`` rows of each stratum in seeded order."""
    w = Window.partitionBy(*stratum).orderBy(seeded_order(seed, F.col(key)), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")


def round_robin(rows: DataFrame, group: str, key: str, n: int, *, seed: int | str) -> DataFrame:
    """n rows, one of each group a round, groups and rows in seeded order."""
    w = Window.partitionBy(group).orderBy(seeded_order(seed, F.col(key)), key)
    # no group gives more than n
    dealt = rows.withColumn("_round", F.row_number().over(w)).where(F.col("_round") <= n).withColumn("_group", seeded_order(seed, F.col(group)))
    return dealt.orderBy("_round", "_group", group).limit(n).drop("_round", "_group")


def whole_groups(rows: DataFrame, group: str, key: str, share: float, *, seed: int | str, cell: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``split``: whole groups to validation until it holds ``share`` of each cell's rows.

    Running sums are over group totals, not rows.
    """
    groups = rows.groupBy(*cell, group).agg(F.count(key).alias("_n"))
    w = Window.partitionBy(*cell).orderBy(seeded_order(seed, F.col(group)), group)
    before = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    total = F.sum("_n").over(Window.partitionBy(*cell))
    chosen = groups.withColumn("split", F.when(before + F.col("_n") <= total * share, "validation").otherwise("training")).drop("_n")
    return rows.join(chosen, [*cell, group])


def halves(rows: DataFrame, cell: Sequence[str], key: str, *, seed: int | str) -> DataFrame:
    """``rows`` with half a or b, dealt in turn within each cell."""
    numbered = running(rows.withColumn("_order", seeded_order(seed, F.col(key))), cell, ["_order", key], name="_n")
    return numbered.withColumn("half", F.when(F.pmod("_n", F.lit(2)) == 1, "a").otherwise("b")).drop("_order", "_n")


def coin(seed: int | str, key: Column) -> Column:
    """A row's own seeded coin."""
    return F.pmod(F.conv(F.substring(seeded_order(seed, key), 1, 8), 16, 10).cast("long"), F.lit(2)) == 1
