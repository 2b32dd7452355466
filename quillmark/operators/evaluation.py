"""Scores: error rates, intervals, thresholds, agreement, histograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.sequences import running


def rate(edits: Column, length: Column) -> Column:
    """edits / length; 0 for 0 of 0, 1 for any edits of 0."""
    return F.when(length > 0, edits / length).when(edits > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def error_rates(pairs: DataFrame, groups: Sequence[str], reference: str, hypothesis: str) -> DataFrame:
    """Micro and macro character error rates of each group."""
    edits = F.levenshtein(reference, hypothesis)
    scored = pairs.withColumns({"_e": edits, "_n": F.length(reference)})
    return scored.groupBy(*groups).agg(
        rate(F.sum("_e"), F.sum("_n")).alias("micro_cer"),
        F.avg(rate(F.col("_e"), F.col("_n"))).alias("macro_cer"),
        F.sum("_e").alias("edits"),
        F.sum("_n").alias("chars"),
        F.count(F.lit(1)).alias("lines"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> dict[str, Column]:
    """Bounds of the score interval; nulls without trials."""
    p, zz = k / F.when(n > 0, n), z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return {"low": (mid - half) / (1 + zz / n), "high": (mid + half) / (1 + zz / n)}


def confusion(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """tp, fp, fn and tn of boolean columns in one pass."""
    count = lambda c: F.count_if(c)
    return rows.agg(count(truth & said).alias("tp"), count(~truth & said).alias("fp"), count(truth & ~said).alias("fn"), count(~truth & ~said).alias("tn"))


def sweep(rows: DataFrame, truth: Column, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision and recall at each threshold: rows are bucketed once, cumulative sums give the rest.

    The rows are not multiplied by the thresholds.
    """
    grid = F.array(*map(F.lit, sorted(thresholds)))
    passed = F.size(F.filter(grid, lambda t: F.col(score) >= t))
    buckets = rows.groupBy(passed.alias("passed")).agg(F.count_if(truth).alias("good"), F.count(F.lit(1)).alias("n"))
    above = F.array(*(F.struct(F.lit(i + 1).alias("level"), F.lit(t).alias("threshold")) for i, t in enumerate(sorted(thresholds))))
    each = buckets.select("good", "n", F.col("passed"), F.inline(above))
    summed = each.groupBy("threshold").agg(
        F.sum(F.when(F.col("passed") >= F.col("level"), F.col("good")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("passed") >= F.col("level"), F.col("n")).otherwise(0)).alias("said"),
        F.sum("good").alias("positives"),
    )
    return summed.withColumns({"precision": F.when(F.col("said") > 0, F.col("tp") / F.col("said")), "recall": F.when(F.col("positives") > 0, F.col("tp") / F.col("positives"))})


def pick_threshold(measures: DataFrame, least_precision: float) -> DataFrame:
    """The row of highest recall with enough precision; the lowest threshold on ties."""
    return measures.where(F.col("precision") >= least_precision).orderBy(F.col("recall").desc(), "threshold").limit(1)


def agreement(a: DataFrame, b: DataFrame, key: str, verdict: str) -> DataFrame:
    """(verdict_a, verdict_b, n) over common keys."""
    joined = a.select(key, F.col(verdict).alias("verdict_a")).join(b.select(key, F.col(verdict).alias("verdict_b")), key)
    return joined.groupBy("verdict_a", "verdict_b").agg(F.count(F.lit(1)).alias("n"))


def _ranges(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, _from, _to, _all): the ranks from 0 that each distinct value of a group takes; no group's values meet in one task."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counted, groups, [value], value="_n", name="_to").withColumn("_from", F.col("_to") - F.col("_n"))
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*(F.col(g).alias(f"_s_{g}") for g in groups)).agg(F.count(F.lit(1)).alias("_all"))
    if not groups:
        return ranked.crossJoin(F.broadcast(sizes))  # one row
    return ranked.join(sizes, [F.col(g).eqNullSafe(F.col(f"_s_{g}")) for g in groups])


def quantile_band(rows: DataFrame, groups: Sequence[str], value: str, at: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Interpolated quantiles of each group as low, mid and high, from counts of distinct values."""
    ranked = _ranges(rows, groups, value)

    def quantile(p: float) -> Column:
        place = (F.col("_all") - 1) * p
        low = F.floor(place)
        has = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_to"))
        below, above = (F.max(F.when(has(rank), F.col(value).cast("double"))) for rank in (low, F.ceil(place)))
        share = F.max(place - low)
        return below + (above - below) * share

    return ranked.groupBy(*groups).agg(*(quantile(p).alias(n) for p, n in zip(at, ("low", "mid", "high"), strict=True)))


def nearest_rank(rows: DataFrame, value: str, at: Sequence[float]) -> DataFrame:
    """(p, value): the value at rank ceil(p n), from counts of distinct values."""
    wanted = _ranges(rows, [], value).withColumn("p", F.explode(F.array(*map(F.lit, at)))).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("_all"))))
    return wanted.where((F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to"))).select("p", value)


def bootstrap(rows: DataFrame, groups: Sequence[str], numerator: str, denominator: str, *, resamples: int = 1000, confidence: float = 0.95, seed: int = 0, chunks: int = 64, key: str | None = None) -> DataFrame:
    """Percentile intervals of sum(numerator) / sum(denominator) by the Poisson bootstrap.

    Each chunk of rows makes its ``resamples`` sums by itself (a row's weights are
    drawn from its chunk's seed), and chunks are added: no group meets in one task. Rows are
    dealt to chunks by ``key``; without one by all their columns, so equal rows share a chunk.
    """
    spread = F.pmod(F.xxhash64(*([key] if key else rows.columns)), F.lit(chunks))
    numbered = rows.select(*groups, F.col(numerator).cast("double").alias("_x"), F.col(denominator).cast("double").alias("_y"), spread.alias("_chunk"))

    def sums(pdf):
        rng = np.random.default_rng([seed, int(pdf["_chunk"].iloc[0])])
        pdf = pdf.sort_values(["_x", "_y"], kind="stable")
        x, y = np.zeros(resamples), np.zeros(resamples)
        for i in range(0, len(pdf), 1000):  # bounds memory
            part = pdf.iloc[i : i + 1000]
            weights = rng.poisson(1, (resamples, len(part)))
            x += weights @ part["_x"].to_numpy()
            y += weights @ part["_y"].to_numpy()
        out = pd.DataFrame({"_i": np.arange(resamples), "_sx": x, "_sy": y})
        for g in groups:
            out[g] = pdf[g].iloc[0]
        return out

    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    made = numbered.groupBy(*groups, "_chunk").applyInPandas(sums, f"_i long, _sx double, _sy double{', ' if kinds else ''}{kinds}")
    totals = made.groupBy(*groups, "_i").agg(F.sum("_sx").alias("x"), F.sum("_sy").alias("y")).withColumn("_r", rate(F.col("x"), F.col("y")))
    tail = (1 - confidence) / 2
    bounds = totals.groupBy(*groups).agg(F.percentile("_r", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    point = rows.groupBy(*groups).agg(rate(F.sum(numerator), F.sum(denominator)).alias("rate"))
    cut = bounds.select(*groups, F.get("_q", 0).alias("low"), F.get("_q", 1).alias("high"))
    return point.join(cut, list(groups)) if groups else point.crossJoin(cut)  # one row each


def closed_bins(value: Column, edges: Sequence[tuple[int, int | None]]) -> Column:
    """The label of the closed range a value is in."""
    out = None
    for lo, hi in edges:
        label = f"{lo}+" if hi is None else str(lo) if lo == hi else f"{lo}-{hi}"
        test = value >= lo if hi is None else value.between(lo, hi)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def fixed_bins(value: Column, lo: float, hi: float, width: float) -> Column:
    """The lower edge of a value's bin; the last bin is closed, values outside are clamped."""
    last = int(np.ceil((hi - lo) / width)) - 1
    return F.lit(lo) + F.least(F.greatest(F.floor((value - lo) / width), F.lit(0)), F.lit(last)) * width
