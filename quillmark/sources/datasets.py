"""Datasets: named, typed tables with tallies, written with checksums; which rows go to which deposit."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.functions.catalog import deposit
from quillmark.functions.text import channels, collapse
from quillmark.operators.versions import current_rows, ranked
from quillmark.sources.export import export, manifest


@dataclass(frozen=True)
class TableSpec:
    """A table of a dataset: its name, its DDL schema, how its rows are made, and what is counted as they are written."""

    name: str
    schema: str
    rows: Callable[[Mapping[str, DataFrame]], DataFrame]
    tallies: Mapping[str, Column] = field(default_factory=dict)

    def typed(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """The rows with the schema's columns, in order and cast; a missing column is null."""
        made = self.rows(tables)
        return made.select(*((F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.schema)))


def transcriptions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Current lines with their page and work: rows with text and outside the NC bucket compete; the highest rank is kept.

    ``tables``: lines, runs, pages, works. One exchange on the line's key; works and runs are left to the planner.
    """
    open_lines = tables["lines"].where((F.coalesce("text", F.lit("")) != "") & (F.lower(F.coalesce("license_bucket", F.lit(""))) != "nc"))
    order = [F.col("_prec").desc(), F.coalesce("run_id", F.lit(0)).desc(), F.col("id").desc()]
    current = current_rows(ranked(open_lines, tables["runs"]), ["page_id", "line_seq"], order).drop("_prec")
    at = tables["runs"].select("run_id", F.coalesce("finished_at", "started_at").alias("run_at"))
    pages = tables["pages"].select("page_id", "work_id", F.coalesce("image_service_url", "image_url").alias("image_uri"), "canvas_id")
    works = tables["works"].select("work_id", F.col("set_name").alias("set"))
    return current.join(pages, "page_id").join(works, "work_id").join(at, "run_id", "left")


def deposit_of(source: Column, bucket: Column, terms: Mapping[str, str]) -> Column:
    """The deposit that takes a row, from the channels in its provenance and its bucket."""
    return deposit(channels(source), bucket, terms)


def ground_truth(of: str, terms: Mapping[str, str]) -> Callable[[Mapping[str, DataFrame]], DataFrame]:
    """The rows of one deposit, each text on one line."""

    def rows(tables: Mapping[str, DataFrame]) -> DataFrame:
        lines = tables["gt_lines"]
        return lines.where(deposit_of(F.col("source"), F.col("license_bucket"), terms).eqNullSafe(F.lit(of))).withColumn("text", collapse(F.coalesce("text", F.lit(""))))

    return rows


def deposit_census(lines: DataFrame, terms: Mapping[str, str]) -> DataFrame:
    """(deposit, channel, n) of all rows in one pass; deposit ``none`` where no deposit takes a row."""
    label = F.array_join(F.coalesce(channels(F.col("source")), F.array().cast("array<string>")), "+")
    made = lines.select(F.coalesce(deposit_of(F.col("source"), F.col("license_bucket"), terms), F.lit("none")).alias("deposit"), F.when(label == "", "(not recorded)").otherwise(label).alias("channel"))
    return made.groupBy("deposit", "channel").agg(F.count(F.lit(1)).alias("n"))


def write_dataset(specs: Sequence[TableSpec], tables: Mapping[str, DataFrame], path: str, *, fmt: str = "parquet", rows_per_file: int = 1_000_000) -> dict[str, dict]:
    """Writes each table of a dataset under ``path`` and returns its tallies, made in the pass that writes it."""
    return {s.name: export(s.typed(tables), f"{path}/{s.name}", fmt=fmt, rows_per_file=rows_per_file, tallies=dict(s.tallies)) for s in specs}


def write_all(datasets: Mapping[str, Sequence[TableSpec]], tables: Mapping[str, DataFrame], path: str, **how) -> dict[str, dict[str, dict]]:
    """Writes every dataset, each in a folder of its own."""
    return {name: write_dataset(specs, tables, f"{path}/{name}", **how) for name, specs in datasets.items()}


def checksums(spark: SparkSession, specs: Sequence[TableSpec], path: str) -> DataFrame:
    """(table, file, bytes, sha256) of a written dataset."""
    parts = [manifest(spark, f"{path}/{s.name}").select(F.lit(s.name).alias("table"), "*") for s in specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def store_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(works, pages, pages_recognized, pages_skipped, records, gt_lines): one row of small counts, without a pass over lines."""
    count = lambda name: tables[name].agg(F.count(F.lit(1)).alias(name))
    pages = tables["pages"].agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "recognized").alias("pages_recognized"), F.count_if(F.col("status") == "skipped").alias("pages_skipped"))
    return count("works").crossJoin(pages).crossJoin(count("records")).crossJoin(count("gt_lines"))  # one row each
