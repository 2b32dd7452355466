"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k least distinct 48-bit hashes of a text's shingles of 8 code
points (a shorter text is one shingle, an empty one none). The sketch of a
union is the bottom k of the sketches' union, so sketches of parts merge into the
whole's. From two sketches follow resemblance, containment and distinct counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.shared import slices

K = 128
SHINGLE = 8  # a power of two
BITS = 48
_DIGITS = BITS // 4
_TOP = float(1 << BITS)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer with full avalanche, then the top BITS bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(64 - BITS)


def shingle_hashes(text: str) -> np.ndarray:
    """A hash for each shingle, by doubling: two halves' hashes make the whole's."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if not len(h):
        return h
    multiplier, width = 0x9E3779B97F4A7C15, 1
    if len(h) < SHINGLE:
        h = np.append(h, np.zeros(SHINGLE - len(h), np.uint64))
    while width < SHINGLE:
        h = h[:-width] * np.uint64(multiplier) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        multiplier, width = (multiplier * multiplier + 2 * width) % (1 << 64), 2 * width
    return _mixed(h)


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k least distinct shingle hashes, ascending."""
    h = shingle_hashes(text or "")
    if len(h) > 8 * k:  # nearly always enough of them are under this
        low = np.unique(h[h < np.uint64(_TOP * 3 * k / len(h))])
        if len(low) >= k:
            return low[:k]
    return np.unique(h)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what the sketches are of."""
    return np.unique(np.concatenate(sketches))[:k]


def distinct(s: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles; exact for fewer than k."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[-1]) + 1) / _TOP)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection / union; 1 for two empty ones, 0 for an empty and another one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k=k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k=k), k)
    return min(1.0, shared / distinct(a, k))


def to_text(s: np.ndarray) -> str:
    """Hexadecimal, 12 digits a hash."""
    raw = s.astype(">u8").tobytes().hex()
    return "".join(raw[i + 16 - _DIGITS : i + 16] for i in range(0, len(raw), 16))


def from_text(text: str) -> np.ndarray:
    return np.array([int(text[i : i + _DIGITS], 16) for i in range(0, len(text), _DIGITS)], np.uint64)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bucket_of(keys: np.ndarray, hashes: np.ndarray, null: np.ndarray, cuts: np.ndarray, nulls: int) -> np.ndarray:
    """The bucket of each row in the order of (key, hash), null keys last.

    ``cuts`` are ascending keys where buckets begin. One that stands there m times has
    so many rows that these are split into m buckets by even ranges of the hash.
    Null keys have ``nulls`` buckets at the end.
    """

    def part(h: np.ndarray, m: int) -> np.ndarray:
        from_zero = h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        return (from_zero // np.uint64(-(-(1 << 64) // m))).astype(np.int64) if m > 1 else np.zeros(len(h), np.int64)

    low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
    found = np.where(high - low > 1, low + 1, high)
    for i in np.unique(low[(high - low > 1) & ~null]):
        mine = (low == i) & (high - low > 1)
        found[mine] += part(hashes[mine], int(high[mine][0] - i))
    found[null] = len(cuts) + 1 + part(hashes[null], nulls)
    return found.astype(np.int32)


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(key, text, bucket, copied), in partitions of whole buckets sorted by (bucket, copied, key, hash of the text), null keys last.

    Buckets are ranges of that order with about as many rows each, also where
    many rows share a key. After a bucket's rows follows a copy of the next bucket's
    first row (after the last bucket the first's), so the next document of each is the
    next row. One shuffle of texts; the driver sees a key or two of each bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.col(key).alias("key"), "text", F.xxhash64("text").alias("h"))
    n = buckets or 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [i / n for i in range(1, n)] or [0.5]
    seen = rows.agg(F.percentile_approx("key", at, 10 * n).alias("cuts"), F.count_if(F.col("key").isNull()).alias("nulls"), F.count(F.lit(1)).alias("all")).first()
    cuts = np.array(seen["cuts"] or [], np.int64)
    nulls = max(1, -(-n * seen["nulls"] // max(1, seen["all"])))

    # a null key comes as 0 with a flag, since pandas would turn the column into doubles
    position = (F.coalesce("key", F.lit(0)), "h", F.col("key").isNull())

    def place(k: pd.Series, h: pd.Series, null: pd.Series) -> np.ndarray:
        return bucket_of(k.to_numpy(np.int64), h.to_numpy(np.int64), null.to_numpy(bool), cuts, nulls)

    @F.pandas_udf("int")
    def own_bucket(k: pd.Series, h: pd.Series, null: pd.Series) -> pd.Series:
        return pd.Series(place(k, h, null))

    least = F.min(F.struct(F.col("key").isNull().alias("null"), "key", "h"))
    firsts = {r["b"]: (r["least"]["key"], r["least"]["h"]) for r in rows.groupBy(own_bucket(*position).alias("b")).agg(least.alias("least")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: order[i - 1] for i, b in enumerate(order)}  # the bucket that needs this row's copy

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series, h: pd.Series, null: pd.Series) -> pd.Series:
        rows = zip(k.tolist(), h.tolist(), null.tolist(), place(k, h, null).tolist(), strict=True)
        return pd.Series([[b, before[x]] if (x := (None if z else a, y)) in before else [b] for a, y, z, b in rows])

    dealt = rows.select(F.col("key").alias(key), "text", "h", F.posexplode(targets(*position)).alias("copied", "bucket"))
    return dealt.repartition(max(1, n // 4), "bucket").sortWithinPartitions("bucket", "copied", F.col(key).asc_nulls_last(), "h")


OUT = (
    "n_chars long, edited_text string, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_in_edited double, n_shingles double"
)


def fingerprint_with_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, buckets: int | None = None, edited_text: bool = True) -> DataFrame:
    """Fingerprints of every text and of its edited form (see ``edited``), and likenesses.

    Null texts are empty. A single document is its own next one. Rows that share
    a key follow each other by their texts' hashes; rows with null keys come after all
    others, in that order too. Empty tables give no rows. Other columns are ignored.
    """
    dealt = with_next(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), key="key", buckets=buckets)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = None  # the last row, until the next is seen
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in slices(pc.binary_length(whole.column(1)).to_pylist())):
            out = []
            for doc, body, copied, bucket in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if copied and held and held[3] == bucket and held[4]:
                    continue  # a further copy of a repeated first row
                mine = sketch(body, k)
                if held and held[3] == bucket and not held[4]:
                    out.append(_row(held, body, mine, k, edited_text))
                held = (doc, body, mine, bucket, bool(copied))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=wanted(pa))

    def wanted(pa):
        names = [key, *(f.split()[0] for f in OUT.split(", "))]
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return pa.schema(list(zip(names, [pa.int64(), *(kinds[f.split()[1]] for f in OUT.split(", "))], strict=True)))

    def _row(held, following, its, k, with_text):
        doc, body, mine, _, _ = held
        changed = edited(body, following)
        theirs = sketch(changed, k)
        values = [doc, len(body), changed if with_text else None, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()]
        values += [to_text(mine), to_text(theirs), resemblance(mine, theirs, k), resemblance(mine, its, k), containment(mine, theirs, k), distinct(mine, k)]
        return dict(zip([key, *(f.split()[0] for f in OUT.split(", "))], values, strict=True))

    return dealt.select("key", "text", "copied", "bucket").mapInArrow(run, f"`{key}` long, {OUT}")
