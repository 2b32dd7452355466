"""A noise channel for texts, and how alignment holds up under it."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.text import collapse, seeded_order, similarity
from quillmark.operators.alignment import project_groups
from quillmark.operators.evaluation import rate
from quillmark.operators.pools import chunked

#: Shares of substitutions, deletions, doublings and merges among the edits of a letter; the rest splits words. Fixed values.
SHARES = (0.55, 0.20, 0.12, 0.08)
#: Letters that are read for others, and pairs read as one; a parameter everywhere.
CONFUSIONS = {"n": "u", "u": "n", "m": "ni", "e": "c", "c": "e", "s": "f", "f": "s", "t": "l", "l": "t", "i": "r", "r": "i", "a": "o", "o": "a", "h": "b", "b": "h", "d": "cl", "g": "q", "q": "g", "v": "n", "p": "y", "x": "r", "z": "r", "y": "p", "j": "i", "k": "h", "w": "vv"}
MERGES = {"rn": "m", "ni": "m", "in": "m", "cl": "d", "vv": "w", "ii": "u"}


def draws(seed: str, n: int):
    """n rows of three numbers in [0, 1) from a seed, the same for any rate."""
    import numpy as np

    return np.random.default_rng(list(hashlib.sha256(seed.encode()).digest())).random((n, 3))


def corrupted(text: str, share: float, seed: str, confusions: Mapping[str, str] = CONFUSIONS, merges: Mapping[str, str] = MERGES) -> str:
    """The text with about ``share`` of its characters misread; what a lower share misreads, a higher one misreads alike."""
    out, at = [], 0
    numbers = draws(seed, len(text))
    while at < len(text):
        char, (fires, kind, pick) = text[at], numbers[at]
        at += 1
        if fires >= share:
            out.append(char)
            continue
        instead = confusions.get(char.lower())
        if char == " " or instead is None:
            continue  # a lost space, mark or stray sign
        swap = instead[min(int(pick * len(instead)), len(instead) - 1)] if len(instead) > 1 and pick >= 0.5 else instead
        bounds = [sum(SHARES[: i + 1]) for i in range(4)]
        if kind < bounds[0]:
            out.append(swap)
        elif kind < bounds[1]:
            continue
        elif kind < bounds[2]:
            out.append(char * 2)
        elif kind < bounds[3] and text[at - 1 : at + 1] in merges:
            out.append(merges[text[at - 1 : at + 1]])
            at += 1
        elif kind >= bounds[3] and out and out[-1] != " " and text[at : at + 1] not in ("", " "):
            out.append(" " + char)
        else:
            out.append(swap)
    return "".join(out)


def noisy(text: Column, key: Column, share: Column, seed: str) -> Column:
    """An Arrow column: each text misread from a seed of its own."""

    @F.pandas_udf(T.StringType())
    def run(t: pd.Series, k: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else corrupted(x, float(p), f"{seed}:{y}") for x, y, p in zip(t, k, s, strict=True)])

    return run(text, key.cast("string"), share)


def calibrated(lines: DataFrame, target: float, *, key: str, reference: str, hypothesis: str, seed: str, tolerance: float = 0.0005, rounds: int = 16) -> tuple[float, float]:
    """(share, rate): the share at which the lines' error rate is nearest ``target``, by halving; each round is one aggregate."""

    def measure(share: float) -> float:
        made = lines.select(reference, noisy(F.col(hypothesis), F.col(key), F.lit(share), seed).alias("_h"))
        return made.agg(rate(F.sum(F.levenshtein(reference, "_h")), F.sum(F.length(reference)))).first()[0]

    low, high, base = 0.0, 1.0, measure(0.0)
    if base >= target:
        return 0.0, base
    best = (1.0, measure(1.0))
    for _ in range(rounds):
        if best[1] <= target and best[0] == 1.0 or abs(best[1] - target) <= tolerance:
            break
        middle = (low + high) / 2
        found = measure(middle)
        if abs(found - target) < abs(best[1] - target):
            best = (middle, found)
        low, high = (middle, high) if found < target else (low, middle)
    return best


def thinned(lines: DataFrame, key: str, drop_share: float, seed: int | str) -> DataFrame:
    """``lines`` with ``kept``: a seeded share is left out of the reference, as an edition leaves lines out."""
    drawn = F.conv(F.substring(seeded_order(seed, F.col(key)), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return lines.withColumn("kept", drawn >= drop_share)


def references(lines: DataFrame, on: Sequence[str], order: str, text: str) -> DataFrame:
    """(on, text): the kept lines of each piece, joined by spaces."""
    rows = lines.where("kept").groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("_t")))).alias("_l"))
    return rows.select(*on, F.array_join(F.transform("_l", lambda x: x["_t"]), " ").alias("text"))


def graded(projected: DataFrame, truth: DataFrame, key: Sequence[str], text: str, *, least_similarity: float = 0.9) -> DataFrame:
    """``projected`` with ``correct``: a kept line's projection is like its true text, a line left out got none."""
    joined = projected.join(truth.select(*key, "kept", F.col(text).alias("_true")), list(key))
    like = similarity(collapse(F.lower(F.coalesce("projected", F.lit("")))), collapse(F.lower("_true")))
    empty = F.trim(F.coalesce("projected", F.lit(""))) == ""
    return joined.withColumns({"similarity": F.when(F.col("kept"), like).otherwise(F.when(empty, 1.0).otherwise(0.0)), "correct": F.when(F.col("kept"), like >= least_similarity).otherwise(empty)}).drop("_true")


def held_up(lines: DataFrame, levels: Sequence[float], *, piece: str, order: str, text: str, seed: str, threshold: float, drop_share: float = 0.0) -> DataFrame:
    """(level, lines, accepted, correct, yield, precision): the alignment of misread lines to their text, at each share of misreading.

    ``lines`` are of pieces; (piece, order) names one. Each level is a copy of the lines (levels are a few), all levels run in one job.
    """
    shares = lines.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    name = F.concat_ws(":", F.col(piece).cast("string"), F.col(order).cast("string"))
    read = thinned(shares.withColumn("_id", name), "_id", drop_share, seed).withColumns({"_group": F.concat_ws("|", F.col(piece).cast("string"), F.col("level").cast("string")), "_read": noisy(F.col(text), name, F.col("level"), seed)})
    whole = references(read, ["_group"], order, text)
    made = project_groups(read, whole, on="_group", order=order, line="_read", text="text", threshold=threshold)
    marked = graded(made, read.select("_group", order, "kept", F.col(text), "level"), ["_group", order], text)
    marked = marked.join(read.select("_group", order, "level"), ["_group", order])
    good = F.count_if(F.col("accepted") & F.col("correct"))
    accepted = F.count_if("accepted")
    return marked.groupBy("level").agg(F.count(F.lit(1)).alias("lines"), accepted.alias("accepted"), good.alias("correct"), (good / F.count_if("kept")).alias("yield"), (good / F.nullif(accepted, F.lit(0).cast("long"))).alias("precision"))


__all__ = ["calibrated", "chunked", "corrupted", "graded", "held_up", "noisy", "references", "thinned"]
