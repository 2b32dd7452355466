"""Connected components of an edge table.

While there are more than ``block`` edges, each vertex joins the neighbour (or
itself) whose hash is least in that round, and edges go between what is left: a
constant factor of the vertices disappears a round, whatever the graph's
shape. The rest, of a bounded size, is solved by union-find in one task.
Every round is written to the shared folder. Edges never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.shared import stash

BLOCK = 1_000_000


def _union_find(batches):
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(edges: DataFrame, *, block: int = BLOCK, most_bytes: int | None = None) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b; long; of ``most_bytes``); comp is one node of its component."""
    left = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges", most_bytes)
    rounds: list[DataFrame] = []
    while left.count() > block:
        salt = F.lit(len(rounds))
        ranked = lambda c, salt=salt: F.struct(F.xxhash64(salt, F.col(c)).alias("h"), F.col(c).alias("v"))
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("near"))
        joins = stash(least.select("node", F.least("near", ranked("node"))["v"].alias("to")), "cc-round", most_bytes)
        rounds.append(joins)
        moved = left.join(joins.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(joins.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        left = stash(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a < b").distinct(), "cc-edges", most_bytes)
    found = left.coalesce(1).mapInArrow(_union_find, "node long, comp long")  # at most ``block`` edges
    for joins in reversed(rounds):
        known = stash(found, "cc-found", most_bytes).select(F.col("node").alias("to"), "comp")
        found = joins.join(known, "to", "left").select("node", F.coalesce("comp", "to").alias("comp"))
    return found
