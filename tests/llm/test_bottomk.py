import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import bottomk as B


def shingle_set(text):
    return {text[i : i + B.SHINGLE] for i in range(max(1, len(text) - B.SHINGLE + 1))} if text else set()


def test_sketch_estimates_and_merges(prose):
    a, b = prose(1, 900), prose(2, 900)
    for x, y in ((a, a[:3000] + b[:1500]), (a, b), (a[:60], a[:50]), (a, a)):
        s, t = shingle_set(x), shingle_set(y)
        like = B.resemblance(B.sketch(x), B.sketch(y))
        assert abs(like - len(s & t) / len(s | t)) < 0.13
        assert abs(B.containment(B.sketch(x), B.sketch(y)) - len(s & t) / len(s)) < 0.2
        assert B.distinct(B.sketch(x)) == pytest.approx(len(s), rel=0.3)
    parts = [a[:2000], a[2000 - B.SHINGLE + 1 :]]
    assert (B.merge(*map(B.sketch, parts)) == B.sketch(a)).all()
    assert (B.from_text(B.to_text(B.sketch(a))) == B.sketch(a)).all()


def test_empty_and_short_texts():
    assert len(B.sketch(None)) == len(B.sketch("")) == 0 and len(B.sketch("abc")) == 1
    assert B.resemblance(B.sketch(""), B.sketch("")) == 1 and B.resemblance(B.sketch(""), B.sketch("a")) == 0
    assert B.to_text(B.sketch("")) == "" and len(B.from_text("")) == 0


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_edited_texts_against_brute_force(spark, prose, buckets):
    texts = [prose(i, 5 * i) for i in range(30)] + [None, "", "a", "ab", "é" * 7, "😀x" * 9, prose(3, 20_000)]
    rows = [(i * 37 % 1009, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    found = {r.doc_id: r for r in B.fingerprint_with_edits(docs, buckets=buckets).collect()}
    order = sorted((d, t or "") for d, t, _ in rows)
    assert sorted(found) == [d for d, _ in order]
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        changed = B.edited(t, following)
        r = found[d]
        assert (r.n_chars, r.edited_text, r.edited_sha256) == (len(t), changed, hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == B.resemblance(B.sketch(t), B.sketch(changed)) and r.near_next == B.resemblance(B.sketch(t), B.sketch(following))
        assert r.fingerprint == B.to_text(B.sketch(t)) and 0 <= r.near_edited <= 1


def in_order(docs):
    """Keys and texts by key, then hash of the text, null keys last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    return [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))]


@pytest.mark.parametrize("buckets", [1, 7, 50])
def test_hot_and_null_keys_keep_their_rows_and_order(spark, prose, buckets):
    rows = [(7 if i % 3 else i, prose(i, i % 11)) for i in range(90)] + [(None, prose(i, 5)) for i in range(40)] + [(2**62 + 1, "x"), (2**62, "y"), (-5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = in_order(docs)
    want = Counter((d, B.edited(t, order[(i + 1) % len(order)][1])) for i, (d, t) in enumerate(order))
    assert Counter((r.doc_id, r.edited_text) for r in B.fingerprint_with_edits(docs, buckets=buckets).collect()) == want
    dealt = Counter(r.bucket for r in B.with_next(docs, buckets=50).where("copied = 0 and doc_id = 7").collect())
    assert len(dealt) > 10 and len({r.bucket for r in B.with_next(docs, buckets=50).where("doc_id is null").collect()}) > 5


def test_repeats_null_keys_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "aaa"), (1, "aaa"), (2, "bb"), (None, "cccc")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.edited_text) for r in B.fingerprint_with_edits(docs).collect()), key=str)
    assert found == [(1, "aaa"), (1, "aab"), (2, "bc"), (None, "ccaa")]
    assert B.fingerprint_with_edits(docs.where("doc_id = 2")).first().edited_text == "bb"
    assert B.fingerprint_with_edits(docs.limit(0)).count() == 0
    assert isinstance(B.sketch("x"), np.ndarray)


def test_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "aaaa", "x"), (2, "bb", "y")], "bucket long, key string, text string")
    assert sorted((r.bucket, r.edited_text) for r in B.fingerprint_with_edits(docs, key="bucket", text="key").collect()) == [(1, "aabb"), (2, "ba")]
