"""The registry of queries: name, function of (spark, folder), and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import words
from quillmark.operators import postings
from quillmark.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


_INDEXES: dict[tuple[str, str], postings.Index] = {}


def written_index(spark: SparkSession, folder: str) -> postings.Index:
    """The index of a folder's documents, written to the shared folder once a session."""
    at = (spark.sparkContext.applicationId, folder)
    if at not in _INDEXES:
        docs = Tables(spark, folder).documents
        fields = {"text": (words(F.col("text")), 1.0), "source": (words(F.col("source")), 3.0)}
        _INDEXES[at] = postings.build(docs, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", key="doc_id", fields=fields, keep=["lang", "source", "n_chars"])
    return _INDEXES[at]
