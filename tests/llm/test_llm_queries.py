"""The registered queries over whole tables of the small set, and the pipeline against brute force."""

import hashlib
import re
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle

from quillmark.llm import language_id, line_dedup, mixing
from quillmark.llm.oracles import ORACLE_SQL
from quillmark.llm.queries import QUERIES
from quillmark.llm.shared import tokenizer_file
from test_mixing import highest_quotients, targets

SMALL = "/root/testdata/sf0.001"


def test_names_are_one_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, SMALL), oracle.tables(SMALL), ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_whole_tables(spark, name):
    rows = QUERIES[name](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows.select("doc_id").distinct().count() == docs.count()


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as C
    from test_line_dedup import brute as lines_brute
    from test_minmax import brute as near_brute

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "123 ...", "en", "src1", 7)], docs.schema)
    stages = dict(C.STAGES)
    assert list(stages) == ["language ID", "line dedup", "near dedup", "mixing", "packing"]

    first = stages["language ID"](spark, docs.unionAll(junk), SMALL)
    kept = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == docs.columns and set(kept) == {r.doc_id for r in docs.collect()}

    second = stages["line dedup"](spark, first, SMALL)
    want = {d: t for d, _, _, t in lines_brute([(r.doc_id, r.source, r.text) for r in first.collect()], line_dedup.RATIO, line_dedup.LEAST_PAGES)}
    got = second.collect()
    assert second.columns == docs.columns and {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

    third = stages["near dedup"](spark, second, SMALL)
    want = {d for d, (_, _, k) in near_brute([(r.doc_id, r.text) for r in got], 5, 80).items() if k}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == want

    fourth = stages["mixing"](spark, third, SMALL)
    assert fourth.columns == docs.columns
    mixed = fourth.collect()
    assert Counter(mixed) == Counter(mixed_brute(third.collect()))
    pieces = stages["packing"](spark, fourth, SMALL).collect()
    check_packing(mixed, pieces)
    assert language_id.UNDETERMINED == "und"


def mixed_brute(rows):
    """The mix document by document: words dealt in blocks of a shard's stream, one shard a source at this size."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    draw = lambda text: int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += count(r.text)
    everything = sum(sizes.values())
    block = max(1, min(mixing.BLOCK_WORDS, everything // mixing.LEAST_BLOCKS))
    want = targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    quotas = highest_quotients([want[s] for s in order], round(sum(want.values()) / block))
    out = []
    for place, (source, quota) in enumerate(zip(order, quotas, strict=True)):
        mine = sorted((r for r in rows if r.source == source), key=lambda r: (draw(f"{mixing.SEED}:{r.doc_id}"), r.doc_id))
        stream = [i for i, r in enumerate(mine) for _ in range(count(r.text))]
        blocks = -(-len(stream) // block)
        quota = min(quota, 2 * blocks)
        full, more = divmod(quota, blocks) if blocks else (0, 0)
        first = draw(f"{mixing.SEED}:start:{place}:0") % blocks if blocks else 0
        chosen = {(first + k) % blocks for k in range(more)}
        begin = 0
        for i, r in enumerate(mine):
            n = count(r.text)
            words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
            taken = [(begin + k) // block in chosen for k in range(n)]
            begin += n
            texts = [r.text] * full if n else []
            wraps = first + more > blocks  # two spans of the stream: its end and its start
            spans = [[k for k in range(n) if taken[k] and (not wraps or ((begin - n + k) // block < first) == early)] for early in ((True, False) if wraps else (False,))]
            texts += [r.text if len(s) == n else " ".join(words[k] for k in s) for s in spans if s]
            out += [Row(**(r.asDict() | {"text": t, "n_chars": len(t)})) for t in texts]
        assert len(stream) == sizes[source]
    return out


def check_packing(rows, pieces):
    """Every id of every row lies in one piece, gapless in sequences of 2048, padded only where it may be."""
    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = Counter((r.doc_id, tuple([*(tokenizer.encode(r.text, add_special_tokens=False).ids if r.text else []), 1])) for r in rows)
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at, found, held = 0, Counter(), []
    for p in stream:
        values = struct.unpack(f"<{p.length}I", bytes(p.ids))
        assert p.sequence_id * 2048 + p.offset == at and p.offset + p.length <= 2048 and p.ids_crc32 == zlib.crc32(bytes(p.ids))
        assert p.start == len(held) and p.doc_tokens >= p.start + p.length
        held += values
        at += p.length
        if len(held) == p.doc_tokens:
            found[p.doc_id, tuple(held)] += 1
            held = []
    last = at - (at - 1) // 2048 * 2048
    assert found == ids and not held and stream[-1].padded_length == (last if last & (last - 1) == 0 else 2048)
