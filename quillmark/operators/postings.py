"""A written index: postings dealt by the beginnings of tokens, and searches that read only what a query can meet.

Words of three letters or more are found by their beginnings, so a token's cell is
drawn from its first three letters: a query reads a cell for each of its words, and within
it the row groups whose tokens can match. Nothing else of the corpus is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.search import LEAST_PREFIX, Query, filtered, page_bounds, parse

CELLS = 256
#: Fixed values of the ranking: k1, b, and the least idf (of words that most documents have).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def cell_of(token: Column) -> Column:
    return F.pmod(F.crc32(F.substring(token, 1, LEAST_PREFIX)), F.lit(CELLS)).cast("int")


_OPEN: dict[tuple[str, str], DataFrame] = {}


def _open(spark: SparkSession, path: str) -> DataFrame:
    """A written table, its files listed once a session; an index never changes."""
    at = (spark.sparkContext.applicationId, path)
    if at not in _OPEN:
        _OPEN[at] = spark.read.parquet(path)
    return _OPEN[at]


@dataclass(frozen=True)
class Index:
    """The paths of an index, its key and the weights of its fields."""

    path: str
    key: str
    weights: Mapping[str, float]

    def postings(self, spark: SparkSession) -> DataFrame:
        return _open(spark, f"{self.path}/postings")

    def documents(self, spark: SparkSession) -> DataFrame:
        return _open(spark, f"{self.path}/documents")

    def meta(self, spark: SparkSession) -> DataFrame:
        """(documents, a mean length of each field): one row."""
        return _open(spark, f"{self.path}/meta")

    def terms(self, spark: SparkSession) -> DataFrame:
        """(field, token, documents): the vocabulary."""
        return _open(spark, f"{self.path}/terms")

    def length(self, fields: Sequence[str]) -> Column:
        return sum((F.col(f"len_{f}") for f in fields), F.lit(0))

    def mean_length(self, fields: Sequence[str]) -> Column:
        return sum((F.col(f"mean_{f}") for f in fields), F.lit(0.0))


def build(docs: DataFrame, path: str, *, key: str, fields: Mapping[str, tuple[Column, float]], keep: Sequence[str] = ()) -> Index:
    """Writes an index of token arrays: postings (cell, token, field, key, positions), terms, documents (key, lengths, ``keep``) and meta.

    The text is exploded once; a document's places of a token are one row. It is written
    beside what is live, so readers of an older path are not disturbed.
    """
    arrays = [F.struct(F.lit(name).alias("field"), tokens.alias("tokens")) for name, (tokens, _) in fields.items()]
    each = docs.select(F.col(key).alias("key"), F.explode(F.array(*arrays)).alias("f")).select("key", F.col("f.field").alias("field"), F.posexplode("f.tokens").alias("at", "token"))
    placed = each.groupBy("token", "field", "key").agg(F.sort_array(F.collect_list("at")).alias("positions"))
    dealt = placed.withColumn("cell", cell_of(F.col("token"))).repartition("cell").sortWithinPartitions("cell", "token", "key")
    dealt.write.partitionBy("cell").parquet(f"{path}/postings")
    spark = docs.sparkSession
    made = Index(path, key, {name: w for name, (_, w) in fields.items()})
    made.postings(spark).groupBy("field", "token").agg(F.count(F.lit(1)).alias("documents")).write.parquet(f"{path}/terms")
    lengths = [F.coalesce(F.size(tokens), F.lit(0)).cast("long").alias(f"len_{name}") for name, (tokens, _) in fields.items()]
    docs.select(F.col(key).alias("key"), *lengths, *keep).write.parquet(f"{path}/documents")
    means = [F.avg(f"len_{name}").alias(f"mean_{name}") for name in fields]
    made.documents(spark).agg(F.count(F.lit(1)).alias("documents"), *means).write.parquet(f"{path}/meta")
    return made


def cells(tokens: Sequence[str]) -> list[int]:
    """The cells of a query's words, as ``cell_of`` deals them."""
    return sorted({zlib.crc32(w[:LEAST_PREFIX].encode()) % CELLS for w in tokens})


def _found(index: Index, spark: SparkSession, query: Query, fields: Sequence[str]) -> tuple[DataFrame, list[Column], list[Column]]:
    """(a row a document that any clause meets, with the clauses' weighted counts), the counts of what is wanted and of what is excluded."""
    runs = [*query.phrases, *query.excluded]
    token = F.col("token")
    meets = {w: F.startswith(token, F.lit(w)) if len(w) >= LEAST_PREFIX else token == w for w in query.words}
    exact = sorted({t for run in runs for t in run})
    rows = index.postings(spark).where(F.col("cell").isin(cells([*query.words, *exact])))
    if len(fields) < len(index.weights):
        rows = rows.where(F.col("field").isin(*fields))
    test = token.isin(exact) if exact else F.lit(False)
    for condition in meets.values():
        test = test | condition
    counts = [F.sum(F.when(c, F.size("positions")).otherwise(0)).alias(f"w{i}") for i, c in enumerate(meets.values())]
    places = [F.first(F.when(token == t, F.col("positions")), ignorenulls=True).alias(f"t{i}") for i, t in enumerate(exact)]
    by_field = rows.where(test).groupBy("key", "field").agg(*counts, *places, F.count(F.lit(1)).alias("rows"))

    def run_count(run: Sequence[str]) -> Column:
        at = [F.col(f"t{exact.index(t)}") for t in run]
        follows = lambda p: F.forall(F.array(*(F.array_contains(x, p + k) for k, x in enumerate(at))), lambda ok: F.coalesce(ok, F.lit(False)))
        return F.when(at[0].isNull(), 0).otherwise(F.size(F.filter(at[0], follows)))

    weight = F.element_at(F.create_map(*(F.lit(x) for kv in index.weights.items() for x in kv)), F.col("field"))
    clauses = [*(F.col(f"w{i}") for i in range(len(meets))), *(run_count(r) for r in runs)]
    summed = by_field.groupBy("key").agg(*(F.sum(weight * c).alias(f"c{i}") for i, c in enumerate(clauses)))
    wanted = len(meets) + len(query.phrases)
    return summed, [F.col(f"c{i}") for i in range(wanted)], [F.col(f"c{i}") for i in range(wanted, len(clauses))]


def scored(index: Index, spark: SparkSession, text: str | Query, *, any_word: bool = False, equal: Mapping[str, object] = {}, least: Mapping[str, float] = {}, fields: Sequence[str] | None = None) -> DataFrame:  # noqa: B006
    """(key, score) of the documents that a query finds; a clause's idf counts the documents that have it, by beginning or run."""
    query = parse(text) if isinstance(text, str) else text
    documents = index.documents(spark)
    if not query.searchable:
        return documents.limit(0).select(F.col("key").alias(index.key), F.lit(0.0).alias("score"))
    fields = list(fields or index.weights)
    found, wanted, excluded = _found(index, spark, query, fields)
    having = found.agg(*(F.count_if(c > 0).alias(f"n{i}") for i, c in enumerate(wanted)))
    one_row = having.crossJoin(index.meta(spark))  # one row each
    test = wanted[0] > 0
    for c in wanted[1:]:
        test = (test | (c > 0)) if any_word else (test & (c > 0))
    for c in excluded:
        test = test & (c == 0)
    hits = found.where(test).join(filtered(documents, equal, least), "key").crossJoin(F.broadcast(one_row))
    score = F.lit(0.0)
    for i, c in enumerate(wanted):
        idf = F.greatest(F.log((F.col("documents") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * c * (K1 + 1) / (c + K1 * (1 - B + B * index.length(fields) / index.mean_length(fields)))
    return hits.select(F.col("key").alias(index.key), score.alias("score"))


def search(index: Index, spark: SparkSession, text: str, *, page: int = 1, limit: int = 20, **how) -> tuple[DataFrame, DataFrame]:
    """(a page of hits by score, the total); scores are rounded to six digits, ties go by key."""
    rows, offset = page_bounds(page, limit)
    hits = scored(index, spark, text, **how).withColumn("score", F.round("score", 6))
    return hits.orderBy(F.col("score").desc(), index.key).offset(offset).limit(rows), hits.agg(F.count(F.lit(1)).alias("total"))


def tokens_like(index: Index, spark: SparkSession, prefix: str) -> DataFrame:
    """(token, documents): the vocabulary under a beginning of three letters or more."""
    rows = index.postings(spark).where(F.col("cell").isin(cells([prefix])) & F.startswith("token", F.lit(prefix)))
    return rows.groupBy("token").agg(F.count_distinct("key").alias("documents"))


def bm25(index: Index, spark: SparkSession, terms: Sequence[str], field: str, *, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the documents that have one of ``terms`` in a field, as ``search.bm25`` scores them."""
    rows = index.postings(spark).where(F.col("cell").isin(cells(terms)) & (F.col("field") == field) & F.col("token").isin(*terms))
    known = index.terms(spark).where((F.col("field") == field) & F.col("token").isin(*terms)).select("token", F.col("documents").alias("df"))  # a row a term
    tf = F.size("positions")
    scored = rows.join(F.broadcast(known), "token").join(index.documents(spark).select("key", F.col(f"len_{field}").alias("len")), "key").crossJoin(F.broadcast(index.meta(spark)))
    idf = F.log((F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col(f"mean_{field}")))
    # parts are added in the order of the terms, so sums are the same wherever rows come from
    place = F.array_position(F.array(*map(F.lit, terms)), F.col("token"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(place.alias("i"), part.alias("s")))), lambda x: x["s"])
    return scored.groupBy("key").agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("score")).select(F.col("key").alias(index.key), "score")
