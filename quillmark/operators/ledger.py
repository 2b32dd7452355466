"""Runs and the rows they write: a ledger of runs, lines by run, states of pages, and resumption."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.text import source_field
from quillmark.operators.versions import current_rows, upsert_overwrite

RUN = "run_id long, stage string, model string, params string, git_sha string, scope string, started_at timestamp, finished_at timestamp, n_input long, n_ok long, n_failed long"


def next_run_id(runs: DataFrame) -> int:
    """One more than the greatest id: one row comes to the driver."""
    return (runs.agg(F.max("run_id")).first()[0] or 0) + 1


def opened(runs: DataFrame, stage: str, *, at: str, model: str | None = None, params: Mapping | None = None, git_sha: str | None = None, scope: str | None = None) -> tuple[DataFrame, int]:
    """(``runs`` with a run that has begun, its id)."""
    spark: SparkSession = runs.sparkSession
    number = next_run_id(runs)
    row = spark.range(1).select(
        F.lit(number).cast("long").alias("run_id"), F.lit(stage).alias("stage"), F.lit(model).cast("string").alias("model"), F.lit(json.dumps(params) if params else None).cast("string").alias("params"),
        F.lit(git_sha).cast("string").alias("git_sha"), F.lit(scope).cast("string").alias("scope"), F.lit(at).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
        *(F.lit(None).cast("long").alias(c) for c in ("n_input", "n_ok", "n_failed")),
    )
    return runs.unionByName(row), number


def finished(runs: DataFrame, run_id: int, *, at: str, n_input: int | None = None, n_ok: int | None = None, n_failed: int | None = None) -> DataFrame:
    """``runs`` with the counts and end of a run; of another run nothing changes."""
    mine = F.col("run_id") == run_id
    stamp = {"finished_at": F.lit(at).cast("timestamp"), "n_input": F.lit(n_input).cast("long"), "n_ok": F.lit(n_ok).cast("long"), "n_failed": F.lit(n_failed).cast("long")}
    return runs.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in stamp.items()})


def recorded(runs: DataFrame, stage: str, *, at: str, n_input: int | None = None, n_ok: int | None = None, n_failed: int | None = None, **about) -> tuple[DataFrame, int]:
    """A run that begins and ends at once, for a write that is all or nothing."""
    table, number = opened(runs, stage, at=at, **about)
    return finished(table, number, at=at, n_input=n_input, n_ok=n_ok, n_failed=n_failed), number


def open_run(runs: DataFrame, *, stage: str, model: str, scope: str | None) -> DataFrame:
    """The latest run of a stage, model and scope that has not ended: where a stopped import goes on."""
    same = (F.col("stage") == stage) & F.col("model").eqNullSafe(F.lit(model)) & F.col("scope").eqNullSafe(F.lit(scope))
    return runs.where(same & F.col("finished_at").isNull()).orderBy(F.col("run_id").desc()).limit(1)


def still_to_do(pages: DataFrame, lines: DataFrame, run_id: int, *, page: str = "page_id") -> DataFrame:
    """Pages without a row of the run."""
    return pages.join(lines.where(F.col("run_id") == run_id).select(page).distinct(), page, "left_anti")


def lines_put(lines: DataFrame, new: DataFrame, keys: Sequence[str] = ("page_id", "line_seq", "run_id")) -> DataFrame:
    """``lines`` with ``new`` ones; one of the same page, place and run is replaced."""
    return upsert_overwrite(lines, new, list(keys))


def recognised(lines: DataFrame, readings: DataFrame, *, run_id: int | Column, model: str | Column, keys: Sequence[str] = ("page_id", "line_seq")) -> DataFrame:
    """``lines`` with readings (text, conf, lang, source) of a run in place; a null language or source keeps what was there."""
    given = readings.select(*keys, F.struct("text", "conf", "lang", "source").alias("_new"))
    joined = lines.join(given, list(keys), "left")
    took = F.col("_new").isNotNull()
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    put = {"text": F.col("_new.text"), "conf": F.col("_new.conf"), "model": lit(model), "run_id": lit(run_id), "lang": F.coalesce("_new.lang", "lang"), "source": F.coalesce("_new.source", "source")}
    return joined.withColumns({c: F.when(took, v).otherwise(F.col(c)) for c, v in put.items()}).select(*lines.columns)


def states_set(pages: DataFrame, results: DataFrame, *, page: str = "page_id") -> DataFrame:
    """``pages`` with the status and skip reason of ``results`` (page, status, skip_reason) where they have one."""
    given = results.select(page, F.struct("status", "skip_reason").alias("_new"))
    took = F.col("_new").isNotNull()
    joined = pages.join(given, page, "left")
    return joined.withColumns({c: F.when(took, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("status", "skip_reason")}).select(*pages.columns)


def with_owner(pairs: DataFrame, *, owner: str = "record_id", source: str = "source", field: str = "katalog") -> DataFrame:
    """``pairs`` whose missing owners are read out of their provenance."""
    return pairs.withColumn(owner, F.coalesce(F.col(owner), source_field(F.col(source), field)))


def checked(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rows``, failing the job at the first that breaks a rule, with the rule's name; a null result breaks it too."""
    broken = F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return rows.where(F.when(broken.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("broken rule: "), broken)).cast("boolean")))


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule, for those that any breaks."""
    each = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return rows.select(F.explode(each).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def newest_texts(lines: DataFrame, keys: Sequence[str], run: str = "run_id", *, text: str = "text", scoped: bool = False) -> DataFrame:
    """The newest run's row of each line, whatever its scope; with ``scoped`` only rows that have a text compete."""
    rows = lines.where(F.col(text).isNotNull()) if scoped else lines
    return current_rows(rows, keys, [F.coalesce(F.col(run), F.lit(0)).desc()])


def machine_rows(lines: DataFrame, keys: Sequence[str], human: Column, order: Sequence[Column]) -> DataFrame:
    """The best row of each line among those that no human made."""
    return current_rows(lines.where(~human), keys, order)


def replaced_wholesale(old: DataFrame, new: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """``new`` in the place of ``old``, refused (the job fails) if an id that something refers to would vanish."""
    gone = referenced.select(key).distinct().join(old.select(key), key, "left_semi").join(new.select(key), key, "left_anti")
    lost = gone.limit(5).collect()
    if lost:
        raise ValueError("referenced ids would vanish: " + ", ".join(sorted(str(r[0]) for r in lost)))
    return new


def decided(decisions: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decisions not imported yet, each once."""
    return decisions.dropDuplicates(list(keys)).join(done.select(*keys).distinct(), list(keys), "left_anti")


def epochs(checkpoints: DataFrame, on: Sequence[str], at: str) -> DataFrame:
    """``checkpoints`` with the seconds since the one before."""
    w = Window.partitionBy(*on).orderBy(at)
    return checkpoints.withColumn("seconds", F.unix_micros(at) / 1e6 - F.lag(F.unix_micros(at) / 1e6).over(w))
