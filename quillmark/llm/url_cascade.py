"""URL filter: rules first, then exact blocklist membership by a cascade of Bloom filters.

The cascade holds, in turn, the listed keys, the corpus's keys that the first
filter takes for listed ones, the listed keys that the second takes for those,
and so on until a filter errs on no key. Over the corpus's whole key universe
the answer is therefore exact, and asking it needs no join: the filters are
words of 64 bits in literals, tested by expressions inside code generation.

Only DataFrame functions are used. Building collects the filters (each bounded by
``max_filter_bytes``, checked before) and never the keys. Where a filter would be
larger, keys are dealt by hash to parts, each with a cascade of its own, and
pages are asked part by part: one more pass over the pages for each part, and still exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.shared import ascii_lower, stash, unused

# The rules of the production list (verdict, host, path).
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Listed names; each is listed under every one of LISTED_ZONES.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ZONES = ("example.com", "example.net", "example.org")
LISTED_KEYS = tuple(f"{n}.{z}" for n in LISTED_NAMES for z in LISTED_ZONES)

#: The most levels; each has hashes of its own, so the rest shrinks by half or more a level.
MAX_LEVELS = 64


def url_host(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more (or the host alone)."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, host first, then path; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` bits in 64-bit words, ``hashes`` probes, a salt of its own."""

    bits: int
    hashes: int
    salt: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return probe(key, self.bits, self.hashes, self.salt)

    def has(self, key: Column) -> Column:
        # one string literal, folded to an array once, however many words there are
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for at in self.positions(key):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            found = found & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return found


def probe(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    first, second = F.xxhash64(F.lit(salt), key), F.xxhash64(F.lit(-1 - salt), key)
    step = second.bitwiseOR(F.lit(1))
    # shifted right so that sums of a few steps stay within 64 bits
    return [F.pmod(F.shiftrightunsigned(first, 8) + F.lit(i) * F.shiftrightunsigned(step, 8), F.lit(bits)) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    """Filters whose even levels hold listed keys and whose odd ones hold false positives."""

    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(bool(len(self.levels) % 2))  # what passes all is held by the last
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(level.has(key), answer).otherwise(F.lit(bool(i % 2)))
        return answer


class TooLarge(Exception):
    """A filter would be larger than allowed."""


def _level(keys: DataFrame, n: int, bits_per_key: int, hashes: int, salt: int, max_filter_bytes: int) -> Level:
    bits = max(64, 64 * math.ceil(n * bits_per_key / 64))
    if bits // 8 > max(8, max_filter_bytes):
        raise TooLarge
    at = keys.select(F.explode(F.array(*probe(F.col("key"), bits, hashes, salt))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("held")
    )
    held = {r["word"]: r["held"] for r in words.collect()}  # bounded by max_filter_bytes
    return Level(bits, hashes, salt, tuple(held.get(i, 0) for i in range(bits // 64)))


def build_cascade(known: DataFrame, *, max_filter_bytes: int) -> Cascade:
    """A cascade for ``known`` (key, listed), exact on its keys; raises TooLarge."""
    inside, outside = known.where("listed").select("key"), known.where(~F.col("listed")).select("key")
    levels: list[Level] = []
    while len(levels) < MAX_LEVELS:
        n = inside.count()
        if not n:
            break
        # the first filter is the sharpest: it meets all other keys, later ones meet what is left
        level = _level(inside, n, *((12, 6) if not levels else (4, 2)), len(levels), max_filter_bytes)
        levels.append(level)
        wrong = stash(outside.where(level.has(F.col("key"))), "url-level")
        inside, outside = wrong, inside
    else:
        raise RuntimeError("the cascade did not end")
    return Cascade(tuple(levels))


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def _is_of_part(part: int, parts: int, key: Column) -> Column:
    return part_of(key, parts) == part


def build_cascades(universe: DataFrame, listed: DataFrame, *, max_filter_bytes: int = 16 << 20) -> list[Cascade]:
    """Cascades for the keys ``listed.key`` that are exact on ``universe.key``, one for each part of the keys.

    Listed keys outside the universe are ignored; null keys are never listed. An empty
    list or universe gives a cascade that lists nothing. There is one part unless a
    filter would be over ``max_filter_bytes``; then there are twice as many, until none is.
    """
    keys = universe.select("key").where(F.col("key").isNotNull()).distinct()
    marks = listed.select("key").distinct().withColumn("mark", F.lit(True))
    known = stash(keys.join(marks, "key", "left").select("key", F.coalesce("mark", F.lit(False)).alias("listed")), "url-keys")
    parts = 1
    while True:
        try:
            return [build_cascade(known.where(part_of(F.col("key"), parts) == i) if parts > 1 else known, max_filter_bytes=max_filter_bytes) for i in range(parts)]
        except TooLarge:
            parts *= 2


def filter_urls(
    pages: DataFrame,
    *,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    listed: DataFrame | Sequence[str] = LISTED_KEYS,
    max_filter_bytes: int = 16 << 20,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    The longest fitting rule decides. Where none fits, a url is blocked if its
    host or a parent domain of it is listed, which the cascade answers exactly.
    A null url or one without ``://`` has an empty host and path, no rule, and
    is allowed. Columns of ``pages`` named like the four results are replaced;
    repeated rows are judged alike; an empty table gives an empty result.
    """
    spark: SparkSession = pages.sparkSession
    if not isinstance(listed, DataFrame):
        listed = spark.range(1).select(F.explode(F.array(*map(F.lit, listed)).cast("array<string>")).alias("key"))
    host, path = url_host(F.col(url)), url_path(F.col(url))
    hosts = pages.select(host.alias("host")).distinct()
    universe = hosts.select(F.explode(host_suffixes(F.col("host"))).alias("key"))
    cascades = build_cascades(universe, listed, max_filter_bytes=max_filter_bytes)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = pages.withColumns({"host": host, "path": path})
    suffixes, found = host_suffixes(F.col("host")), unused("_listed", judged.columns)
    if len(cascades) == 1:
        listed_here = F.exists(suffixes, cascades[0].listed)
    else:
        judged = judged.withColumn(found, F.lit(False))
        for i, cascade in enumerate(cascades):
            mine = F.filter(suffixes, partial(_is_of_part, i, len(cascades)))
            judged = stash(judged.withColumn(found, F.col(found) | F.exists(mine, cascade.listed)), "url-part")
        listed_here = F.col(found)
    by_list = F.when(listed_here, F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_list)}).drop(found)
