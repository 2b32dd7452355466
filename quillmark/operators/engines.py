"""Work of models over rows: an engine is made once a task, rows come in batches, failures are rows too.

An engine is what ``factory()`` returns: a function from a list of inputs to a list
of results. A task makes it once, whatever its rows. No model is in this library.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.evaluation import bootstrap, rate

#: images (bytes) to texts; images to (text, confidence); an image to lines (dicts); (image, line) to an image's bytes.
Engine = Callable[[list[bytes]], list[str]]
Recognizer = Callable[[list[bytes]], list[tuple[str, float]]]
Segmenter = Callable[[bytes], list[dict]]
Cropper = Callable[[bytes, dict], bytes]


def _each(work, inputs: list) -> list[tuple]:
    """(result, error) of each input: all at once, or one by one where that fails."""
    try:
        return [(r, None) for r in work(inputs)]
    except Exception as whole:
        if len(inputs) == 1:
            return [(None, f"{type(whole).__name__}: {whole}"[:500])]
        return [pair for x in inputs for pair in _each(work, [x])]


def transcribed(rows: DataFrame, factory: Callable[[], Recognizer], *, key: str, image: str = "image", batch: int = 16) -> DataFrame:
    """(key, text, conf, seconds, error): each image read; an image that the engine fails on has an error and no text."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import time

        import pyarrow as pa

        engine = factory()
        for table in batches:
            keys, images = (table.column(i).to_pylist() for i in (0, 1))
            for at in range(0, len(keys), batch):
                began = time.perf_counter()
                found = _each(engine, images[at : at + batch])
                took = (time.perf_counter() - began) / len(found)
                pairs = [(r if isinstance(r, tuple) else (r, None)) if r is not None else (None, None) for r, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at : at + batch], table.column(0).type), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64()), pa.array([took] * len(found), pa.float64()), pa.array([e for _, e in found], pa.string())],
                    names=[key, "text", "conf", "seconds", "error"],
                )

    return rows.select(key, image).mapInArrow(run, f"`{key}` {kind}, text string, conf double, seconds double, error string")


LINE = "line_seq int, baseline string, polygon string"


def segmented(pages: DataFrame, factory: Callable[[], Segmenter], *, key: str = "page_id", image: str = "image", least_lines: int = 1) -> DataFrame:
    """(key, lines, skip_reason): the lines of each page, or why it has none: ``error: …`` or ``too few lines``."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        import json

        import pyarrow as pa

        engine = factory()
        of_line = pa.struct([("line_seq", pa.int32()), ("baseline", pa.string()), ("polygon", pa.string())])
        for table in batches:
            for k, data in zip(*(table.column(i).to_pylist() for i in (0, 1)), strict=True):
                ((found, error),) = _each(lambda xs: [engine(x) for x in xs], [data])
                lines = [{"line_seq": i, "baseline": json.dumps(x.get("baseline")), "polygon": json.dumps(x.get("polygon"))} for i, x in enumerate(found or [])]
                reason = f"error: {error}" if error else "too few lines" if len(lines) < least_lines else None
                yield pa.RecordBatch.from_arrays([pa.array([k], table.column(0).type), pa.array([[] if reason else lines], pa.list_(of_line)), pa.array([reason], pa.string())], names=[key, "lines", "skip_reason"])

    return pages.select(key, image).mapInArrow(run, f"`{key}` {kind}, lines array<struct<{LINE.replace(' ', ': ').replace(',:', ',')}>>, skip_reason string")


def recognized(pages: DataFrame, crop: Callable[[], Cropper], read: Callable[[], Recognizer], *, key: str = "page_id", image: str = "image", lines: str = "lines", batch: int = 16) -> DataFrame:
    """(key, line_seq, text, conf, error): each line of each page cropped and read; a line whose crop or reading fails has an error, the others are not lost."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        cropper, recognizer = crop(), read()
        for table in batches:
            for k, data, found in zip(*(table.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                rows = []
                crops = [(line["line_seq"], *_each(lambda xs, d=data: [cropper(d, x) for x in xs], [line])[0]) for line in found or []]
                good = [(n, c) for n, c, e in crops if e is None]
                for at in range(0, len(good), batch):
                    part = good[at : at + batch]
                    rows += [(n, *(r or (None, None)), e) for (n, _), (r, e) in zip(part, _each(recognizer, [c for _, c in part]), strict=True)]
                rows += [(n, None, None, e) for n, _, e in crops if e is not None]
                columns = list(zip(*sorted(rows, key=lambda r: r[0]), strict=True)) if rows else [[]] * 4
                kinds = [pa.int32(), pa.string(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), table.column(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[key, "line_seq", "text", "conf", "error"])

    return pages.select(key, image, lines).mapInArrow(run, f"`{key}` {kind}, line_seq int, text string, conf double, error string")


def unread(rows: DataFrame, done: DataFrame, key: Sequence[str], *, redo: Column | None = None) -> DataFrame:
    """Rows without a reading in ``done``, or whose reading ``redo`` asks to make again."""
    kept = done if redo is None else done.where(~F.coalesce(redo, F.lit(False)))
    return rows.join(kept.select(*key).distinct(), list(key), "left_anti")


def scored(pairs: DataFrame, readings: DataFrame, groups: Sequence[str], *, key: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """(groups, lines, exact, edits, chars, rate, low, high): readings (key, text) against references (key, text), a missing one read as empty."""
    joined = pairs.select(key, *groups, F.col("text").alias("r")).join(readings.select(key, F.coalesce("text", F.lit("")).alias("h")), key, "left").withColumn("h", F.coalesce("h", F.lit("")))
    rows = joined.select(key, *groups, F.levenshtein("r", "h").alias("edits"), F.length("r").alias("chars"), (F.col("r") == F.col("h")).alias("exact"))
    sums = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("lines"), F.count_if("exact").alias("exact"), F.sum("edits").alias("edits"), F.sum("chars").alias("chars"))
    bounds = bootstrap(rows, groups, "edits", "chars", resamples=resamples, seed=seed, key=key)
    return sums.join(bounds, list(groups)) if groups else sums.crossJoin(bounds)  # one row each


def evaluated(pairs: DataFrame, factory: Callable[[], Recognizer], groups: Sequence[str], *, key: str, batch: int = 16, **how) -> DataFrame:
    """``scored`` of what an engine reads of ``pairs`` (key, image, text)."""
    return scored(pairs, transcribed(pairs, factory, key=key, batch=batch), groups, key=key, **how)


def read_plan(pages: DataFrame, on: Sequence[str], *, input_tokens: Column, output_tokens: int, input_price: float, output_price: float) -> DataFrame:
    """(on, pages, input_tokens, output_tokens, cost): what reading would take, prices a million tokens, without a call."""
    n = F.count(F.lit(1))
    sums = pages.groupBy(*on).agg(n.alias("pages"), F.sum(input_tokens).alias("input_tokens"), (n * output_tokens).alias("output_tokens"))
    return sums.withColumn("cost", F.col("input_tokens") * input_price / 1e6 + F.col("output_tokens") * output_price / 1e6)


def within_budget(rows: DataFrame, order: Sequence[str], cost: str, most: float) -> DataFrame:
    """The first rows in order whose costs together stay under ``most``; running sums by ranges, no task holds all rows."""
    from quillmark.operators.sequences import running

    return running(rows, [], order, value=cost, name="_upto").where(F.col("_upto") <= most).drop("_upto")


def rates(readings: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, lines, failed, seconds, per_hour): counts and speed of readings."""
    seconds = F.sum("seconds")
    return readings.groupBy(*on).agg(F.count(F.lit(1)).alias("lines"), F.count("error").alias("failed"), seconds.alias("seconds"), rate(F.count(F.lit(1)) * 3600, seconds).alias("per_hour"))
