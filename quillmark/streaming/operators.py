"""Structured Streaming: windows with watermarks, idempotent input, snapshots and rate limits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.versions import current_rows


def tumbling(events: DataFrame, at: str, width: str, keys: Sequence[str] = (), *, late: str | None = None, value: str = "value") -> DataFrame:
    return sliding(events, at, width, width, keys, late=late, value=value)


def sliding(events: DataFrame, at: str, width: str, step: str, keys: Sequence[str] = (), *, late: str | None = None, value: str = "value") -> DataFrame:
    """(start, keys, n, total) of windows; sums are exact decimals."""
    rows = events.withWatermark(at, late) if late else events
    grouped = rows.groupBy(F.window(at, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: Sequence[str], *, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """The first event of each key, of a stream within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


SNAPSHOT_BUCKETS = 64


def _newest(spark: SparkSession, path: str, below: int) -> dict[int, int]:
    """The newest version under ``below`` of each bucket of a snapshot; its folders are listed, no rows are read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, int] = {}
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*/_bucket=*")) or []:
        place = status.getPath()
        version, bucket = int(place.getParent().getName().removeprefix("version-")), int(place.getName().removeprefix("_bucket="))
        # a version without its mark is one whose writing did not end
        if version < below and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), "_SUCCESS")):
            found[bucket] = max(version, found.get(bucket, -1))
    return found


def snapshot(spark: SparkSession, path: str, below: int = 1 << 62) -> DataFrame:
    """The current rows of a snapshot: the newest version of each bucket that a batch before ``below`` wrote."""
    found = _newest(spark, path, below)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(*(f"{path}/version-{v}/_bucket={b}" for b, v in found.items()))


def snapshot_writer(path: str, keys: Sequence[str], order, *, buckets: int = SNAPSHOT_BUCKETS):
    """A foreachBatch function that keeps the current row of each key under ``path``; ``snapshot`` reads it.

    Late corrections may outrank earlier rows, so a batch is merged, not appended. Keys are dealt
    to buckets, and a batch rewrites only those that it has rows of, from the newest version
    of each; a batch that is repeated after a failure writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # ``buckets`` at most
        known = _newest(spark, path, number)
        old = [f"{path}/version-{known[b]}/_bucket={b}" for b in touched if b in known]
        rows = spark.read.parquet(*old).unionByName(batch) if old else batch
        if touched:
            current_rows(rows, keys, order).withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/version-{number}")

    return write


def token_bucket(events: DataFrame, key: str, at: str, *, rate: float, burst: float, late: str = "10 minutes") -> DataFrame:
    """(key, at, allowed): a bucket a key that refills by ``rate`` a second up to ``burst``.

    For streams; for tables ``token_bucket_batch`` gives the same answers if no event is later than
    the watermark and events of a key come in order. A key is forgotten when the
    watermark is so far past its last event that the bucket is full again, which changes no answer.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()

    def step(name, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (burst, None)
        for pdf in batches:
            pdf, level, last = _spend(pdf.sort_values(at, kind="stable"), at, level, last, rate, burst)
            yield pd.DataFrame({key: [name[0]] * len(pdf), at: pdf[at], "allowed": pdf["allowed"]})
        if last is not None:
            state.update((level, last))
            state.setTimeoutTimestamp(max(int((last + burst / rate) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark(at, late)
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{at}` timestamp, allowed boolean", "level double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def _spend(pdf: pd.DataFrame, at: str, level: float, last: float | None, rate: float, burst: float):
    allowed = []
    for moment in pdf[at].astype("int64") / 10 ** (9 if str(pdf[at].dtype).startswith("datetime64[ns") else 6):
        level = min(burst, level + (0.0 if last is None else max(0.0, moment - last)) * rate)
        last = moment if last is None else max(last, moment)
        allowed.append(level >= 1)
        level -= 1 if allowed[-1] else 0
    return pdf.assign(allowed=allowed), level, last


def token_bucket_batch(events: DataFrame, key: str, at: str, *, rate: float, burst: float) -> DataFrame:
    """The batch form, one key's events in order."""
    schema = f"`{key}` {events.schema[key].dataType.simpleString()}, `{at}` timestamp, allowed boolean"

    def run(pdf):
        out, _, _ = _spend(pdf.sort_values(at, kind="stable"), at, burst, None, rate, burst)
        return out[[key, at, "allowed"]]

    return events.select(key, at).groupBy(key).applyInPandas(run, schema)


def drain(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what its source has and returns the table it made in memory; for tests and small jobs."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
