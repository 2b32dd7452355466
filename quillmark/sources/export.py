"""Exports: typed files in chunks, a manifest of them with checksums, and tallies made in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def export(table: DataFrame, path: str, *, fmt: str = "parquet", rows_per_file: int = 1_000_000, tallies: dict[str, Column] | None = None) -> dict:
    """Writes ``table`` and returns its tallies; an empty table still writes its schema."""
    observed = Observation()
    out = table.observe(observed, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in (tallies or {}).items()))
    writer = out.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "jsonl":
        writer.option("compression", "gzip").json(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return observed.get


def manifest(spark, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files of an export, read in chunks where they lie, whatever their size."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", F.col("length").alias("bytes"))

    def digest(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for place, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(place if "://" in place else place.replace("file:/", "file:///", 1))
                found = hashlib.sha256()
                with store.open_input_stream(inner) as f:
                    while chunk := f.read(1 << 20):
                        found.update(chunk)
                yield pa.RecordBatch.from_pydict({"file": [place.rsplit("/", 1)[-1]], "bytes": pa.array([size], pa.int64()), "sha256": [found.hexdigest()]})

    return listed.mapInArrow(digest, "file string, bytes long, sha256 string")


def publish(table: DataFrame, path: str, view: str) -> DataFrame:
    """Writes beside what is live and repoints the view when all is there."""
    table.write.parquet(path)
    fresh = table.sparkSession.read.parquet(path)
    fresh.createOrReplaceTempView(view)
    return fresh


def jsonl_pack(header: DataFrame, rows: DataFrame, path: str, *, order: str | None = None) -> None:
    """One header row and the rows as JSON lines in one file, by ``order`` or as they come; for packs of a reviewed size."""
    place = F.monotonically_increasing_id() if order is None else F.col(order)
    kept = [c for c in rows.columns if c != order] if order else rows.columns
    first = header.select(F.lit(0).alias("_o"), F.lit(None).cast(rows.select(place.alias("p")).schema[0].dataType).alias("_p"), F.to_json(F.struct(*header.columns)).alias("value"))
    both = first.unionAll(rows.select(F.lit(1).alias("_o"), place.alias("_p"), F.to_json(F.struct(*kept)).alias("value")))
    both.coalesce(1).sortWithinPartitions("_o", "_p").select("value").write.text(path)


def tally(table: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): counts by each column's values in one pass over the table."""
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return table.select(each).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
