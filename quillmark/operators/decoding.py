"""Decoding of frames by labels: best path, prefix beam, forced path; back-off n-gram models."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLANK = 0


def greedy(frames: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(label, first frame, last frame, greatest posterior) of the best path, repeats and blanks collapsed."""
    out, last = [], BLANK
    for t, label in enumerate(frames.argmax(1)):
        p = float(frames[t, label])
        if label != BLANK and label == last:
            name, first, _, best = out[-1]
            out[-1] = (name, first, t, max(best, p))
        elif label != BLANK:
            out.append((int(label), t, t, p))
        last = label
    return out


def prefix_beam(frames: np.ndarray, *, beam: int = 10, least: float = 1e-4, model=None, weight: float = 0.0) -> tuple[tuple[int, ...], float]:
    """The likeliest label sequence over all its paths, with an optional score for each new label."""
    beams = {(): (1.0, 0.0)}  # ends in a blank, ends in its last label
    for row in frames:
        grown: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for prefix, (pb, pl) in beams.items():
            grown[prefix][0] += (pb + pl) * row[BLANK]
            if prefix:
                grown[prefix][1] += pl * row[prefix[-1]]
            for label in np.flatnonzero(row >= least):
                if label == BLANK:
                    continue
                new = (*prefix, int(label))
                bonus = math.exp(weight * model(prefix, int(label))) if model else 1.0
                grown[new][1] += (pb if prefix and prefix[-1] == label else pb + pl) * row[label] * bonus
        kept = sorted(grown.items(), key=lambda x: (-sum(x[1]), x[0]))[:beam]
        norm = sum(map(sum, (v for _, v in kept))) or 1.0
        beams = {k: (v[0] / norm, v[1] / norm) for k, v in kept}
    best = min(beams, key=lambda k: (-sum(beams[k]), k))
    return best, sum(beams[best])


def forced_path(frames: np.ndarray, labels: list[int]) -> list[int]:
    """The likeliest path of frames that spells ``labels``: indices into them, -1 for blanks."""
    states = [BLANK]
    for label in labels:
        states += [label, BLANK]
    logs = np.log(np.maximum(frames, 1e-30))
    score = np.full((len(frames), len(states)), -np.inf)
    back = np.zeros((len(frames), len(states)), int)
    score[0, :2] = logs[0, states[:2]]
    for t in range(1, len(frames)):
        for s, label in enumerate(states):
            options = [s, s - 1] if s else [s]
            if s > 1 and label != BLANK and label != states[s - 2]:
                options.append(s - 2)
            best = max(options, key=lambda o: score[t - 1, o])
            score[t, s], back[t, s] = score[t - 1, best] + logs[t, label], best
    s = len(states) - 1 if len(states) == 1 or score[-1, -1] >= score[-1, -2] else len(states) - 2
    out = []
    for t in range(len(frames) - 1, -1, -1):
        out.append((s - 1) // 2 if s % 2 else -1)
        s = back[t, s]
    return out[::-1]


def softmax(rows: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    e = np.exp((rows - rows.max(1, keepdims=True)) / temperature)
    return e / e.sum(1, keepdims=True)


def decoder(labels: int, *, beam: int | None = None, temperature: float = 1.0):
    """An Arrow function from a flat array of scores, ``labels`` a frame, to labels and a confidence."""

    @F.pandas_udf("labels array<int>, confidence double")
    def run(scores: pd.Series) -> pd.DataFrame:
        rows = []
        for flat in scores:
            frames = softmax(np.asarray(flat, float)[: len(flat) // labels * labels].reshape(-1, labels), temperature)
            path = greedy(frames)
            best = list(prefix_beam(frames, beam=beam)[0]) if beam else [p[0] for p in path]
            rows.append((best, float(np.mean([p[3] for p in path])) if path else 0.0))
        return pd.DataFrame(rows, columns=["labels", "confidence"])

    return run


def _grams(tokens: str, n: int):
    last = F.size(tokens) - n + 1
    one = lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, F.lit(n)), " ").alias("gram"))
    found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), one)
    return F.when(last >= 1, found).otherwise(F.array().cast("array<struct<n: int, gram: string>>"))


def ngram_counts(rows: DataFrame, tokens: str, order: int) -> DataFrame:
    """(n, gram, count) for n up to ``order``; exploded within rows, pre-aggregated before the shuffle."""
    parts = []
    for n in range(1, order + 1):
        parts.append(_grams(tokens, n))
    return rows.select(F.inline(F.concat(*parts))).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("count"))


def conditional(counts: DataFrame) -> DataFrame:
    """(n, gram, history, log10p): maximum-likelihood conditional probabilities of n-grams."""
    history = F.when(F.col("n") > 1, F.regexp_replace("gram", r" \S+$", "")).otherwise(F.lit(""))
    w = Window.partitionBy("n", "history")
    return counts.withColumn("history", history).withColumn("log10p", F.log10(F.col("count") / F.sum("count").over(w))).drop("count")


class ArpaModel:
    """A back-off model read from ARPA text."""

    def __init__(self, text: str):
        self.grams: dict[tuple[str, ...], tuple[float, float]] = {}
        order = 0
        for line in text.splitlines():
            if line.startswith("\\") and line.endswith("-grams:"):
                order = int(line[1:].split("-")[0])
            elif order and line and not line.startswith("\\"):
                p, *rest = line.split("\t")
                back = float(rest[1]) if len(rest) > 1 else 0.0
                self.grams[tuple(rest[0].split(" "))] = (float(p), back)
        self.order = order

    def score(self, context: tuple[str, ...], word: str) -> float:
        """log10 of the word after its context, backing off to shorter ones."""
        context, back = context[-(self.order - 1) :] if self.order > 1 else (), 0.0
        while True:
            if (*context, word) in self.grams:
                return back + self.grams[(*context, word)][0]
            if not context:
                return back + self.grams.get(("<unk>",), (-99.0, 0.0))[0]
            back += self.grams.get(context, (0.0, 0.0))[1]
            context = context[1:]
