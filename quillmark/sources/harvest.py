"""Harvests: pages of answers, from a cache or a fetcher that is given, rate-limited by host, resumable.

No address is known here and nothing is fetched unless a function to fetch with is passed in.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PoliteClient:
    """Fetches with at least ``interval`` seconds between calls to one host, and tries again ``tries`` times, waiting longer each time."""

    def __init__(self, fetch: Callable[[str], bytes], *, interval: float = 1.0, tries: int = 4, pause: float = 1.0, clock=time.monotonic, sleep=time.sleep):
        self._fetch, self._interval, self._tries, self._pause, self._clock, self._sleep = fetch, interval, tries, pause, clock, sleep
        self._last: dict[str, float] = {}

    def wait(self, host: str) -> None:
        left = self._last.get(host, -self._interval) + self._interval - self._clock()
        if left > 0:
            self._sleep(left)
        self._last[host] = self._clock()

    def get(self, url: str) -> bytes:
        for n in range(self._tries):
            self.wait(urlsplit(url).netloc)
            try:
                return self._fetch(url)
            except OSError:
                if n + 1 == self._tries:
                    raise
                self._sleep(self._pause * 2**n)
        raise ValueError("no tries")


class Cache:
    """Answers by address in a folder; a file is there whole or not at all."""

    def __init__(self, folder: str):
        self.folder = folder

    def path(self, url: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(url.encode()).hexdigest())

    def get(self, url: str, fetch: Callable[[str], bytes] | None, force: bool = False) -> bytes | None:
        at = self.path(url)
        if not force and os.path.exists(at):
            with open(at, "rb") as f:
                return f.read()
        if fetch is None:
            return None
        data = fetch(url)
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{at}.{os.getpid()}.part", "wb") as f:
            f.write(data)
        os.replace(f.name, at)
        return data


def answers(first: str, following: Callable[[bytes], str | None], cache: Cache, fetch: Callable[[str], bytes] | None = None, *, most: int | None = None, force: bool = False) -> Iterator[tuple[int, str, bytes]]:
    """(number, address, answer) of a chain of pages, each naming the next; what is cached is not fetched, so a stopped harvest goes on."""
    url, n = first, 0
    while url and (most is None or n < most):
        data = cache.get(url, fetch, force)
        if data is None:
            return
        yield n, url, data
        url, n = following(data), n + 1


class HarvestSource(DataSource):
    """``spark.read.format("harvest")``: a partition for each set, named by ``plan``.

    Options are JSON and import paths, so tasks make their own fetchers: ``sets`` (a list of names), ``plan``
    ("module:function" from a set to its (first address, following)), ``fetch`` ("module:function", or none to
    read the cache alone), ``cache`` (a folder that all tasks see), ``interval``.
    """

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return "set string, number int, url string, answer binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _load(path: str):
    import importlib

    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        import json

        return [InputPartition(s) for s in json.loads(self.options["sets"])]

    def read(self, partition):
        first, following = _load(self.options["plan"])(partition.value)
        fetch = self.options.get("fetch")
        client = PoliteClient(_load(fetch), interval=float(self.options.get("interval", "1"))) if fetch else None
        for n, url, data in answers(first, following, Cache(self.options["cache"]), client.get if client else None):
            yield partition.value, n, url, data


def owned_by_first(records: DataFrame, sets: list[str], key: str, set_column: str = "set") -> DataFrame:
    """One row a record: that of the first set, in order, that has it."""
    place = F.array_position(F.array(*map(F.lit, sets)), F.col(set_column))
    best = records.withColumn("_p", place).groupBy(key).agg(F.min_by(F.struct(*records.columns), "_p").alias("r"))
    return best.select("r.*")


def deepened(ask: Callable[[tuple[int, int]], int], span: tuple[int, int], cap: int) -> list[tuple[int, int]]:
    """Spans of years under the cap of an answer: one that reaches it is halved, down to a year."""
    low, high = span
    if low == high or ask(span) < cap:
        return [span]
    middle = (low + high) // 2
    return deepened(ask, (low, middle), cap) + deepened(ask, (middle + 1, high), cap)
