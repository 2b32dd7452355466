"""Versioned facts: which row of a key is current, also as of a run; merges of new rows into old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precedence(stage: Column, scope: Column) -> Column:
    """2 for corrections (stage ``crowd``), 1 for scoped runs, 0 for others."""
    return F.when(stage == "crowd", 2).when(scope.isNotNull(), 1).otherwise(0)


def ranked(facts: DataFrame, runs: DataFrame | None, *, run: str = "run_id") -> DataFrame:
    """``facts`` with _prec, from ``runs`` (run, stage, scope); a null or unknown run ranks as run 0 of precedence 0."""
    if runs is None:
        return facts.withColumn("_prec", F.lit(0))
    of_run = runs.select(F.col(run).alias("_run"), precedence(F.col("stage"), F.col("scope")).alias("_prec"))
    return facts.join(of_run, facts[run] == F.col("_run"), "left").drop("_run").withColumn("_prec", F.coalesce("_prec", F.lit(0)))


def current_rows(facts: DataFrame, keys: Sequence[str], order: Sequence[Column], *, as_of: Column | None = None) -> DataFrame:
    """One row a key: the first by ``order``; ``as_of`` filters before ranking.

    One exchange on the keys; a key's versions are few, so no partition is large.
    """
    rows = facts if as_of is None else facts.where(as_of)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def current_by_antijoin(facts: DataFrame, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """The same by an anti join: no other row of the key ranks higher (ties keep all)."""
    other = facts.select(*(F.col(k).alias(f"_o_{k}") for k in keys), F.struct(*rank).alias("_o_rank"))
    same = [F.col(k) == F.col(f"_o_{k}") for k in keys]
    return facts.join(other, [*same, F.col("_o_rank") > F.struct(*rank)], "left_anti")


def superseded(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(total, current, superseded) counts in one pass with pre-aggregation."""
    per_key = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("current")).withColumn("superseded", F.col("total") - F.col("current"))


# --- merges: each takes old and new rows by key and returns the table after them -------------------------------------


def upsert_overwrite(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str], *, keep: Sequence[str] = ()) -> DataFrame:
    """New values replace old ones unless null; columns ``keep`` stay as they were."""
    n = new.select(*(F.col(c).alias(f"_n_{c}") for c in new.columns))
    joined = old.join(n, [F.col(k) == F.col(f"_n_{k}") for k in keys], "full_outer")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_n_{c}")) if c in keep else F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in new.columns else F.col(c)
    return joined.select(*(pick(c).alias(c) for c in old.columns))


def upsert_if_higher(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A new row replaces the old one only where its value is higher; ties keep the old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return current_rows(both, keys, [F.col(value).desc_nulls_last(), F.col("_new")]).drop("_new")


def replace_owned(pairs: DataFrame, *, line: str, confidence: str, owner: str, ties: Sequence[str] = ()) -> DataFrame:
    """Of contesting owners of a line the higher confidence wins, then the lesser owner as text; order of arrival is nothing."""
    return current_rows(pairs, [line], [F.col(confidence).desc(), F.col(owner).cast("string"), *map(F.col, ties)])


def delete_keys(table: DataFrame, keys_gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(keys_gone.select(*keys).distinct(), list(keys), "left_anti")


def with_missing_columns(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive migration: columns that are not there yet, as nulls of their types."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def latest_decisions(decisions: DataFrame, keys: Sequence[str], at: str) -> tuple[DataFrame, DataFrame]:
    """(the latest row of each key, counts of duplicates at the same time and of superseded rows)."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    marked = decisions.withColumn("_rank", F.row_number().over(w)).withColumn("_top", F.max(at).over(Window.partitionBy(*keys)))
    kind = F.when(F.col("_rank") == 1, "kept").when(F.col(at) == F.col("_top"), "duplicate").otherwise("superseded")
    return marked.where("_rank = 1").drop("_rank", "_top"), marked.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
