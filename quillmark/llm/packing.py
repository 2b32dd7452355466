"""Packing by concatenating and cutting: fixed windows over one stream of all tokens.

Pass 1 tokenizes each partition and notes every document's offset within it; the
table is written to the shared folder, so what a partition holds is settled. A
prefix sum over the partitions' totals (a row each) gives global offsets. Pass 2
cuts the stream into windows; a document that crosses a boundary leaves one
piece, a boundary record, in each window it touches. No tokens are shuffled,
and a document of any length costs a task no more than its own ids.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.byte_bpe import Encoder
from quillmark.llm.shared import map_texts, slices, stash

WINDOW = 2048
END_ID = 1


def tokenize(docs: DataFrame, *, path: str, pattern: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, part, at, n, ids): a document's ids and ``end_id``, and their place in partition ``part``; written to the shared folder.

    A null or empty text has the end id only.
    """

    def work():
        encoder, part, at = Encoder(path, pattern), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize

        def do(texts):
            nonlocal at
            ids = [encoder.packed(t) + end if t else end for t in texts]
            n = [len(i) // width for i in ids]
            starts = [at + int(x) for x in np.cumsum([0, *n[:-1]])] if n else []
            at += sum(n)
            return [[part] * len(ids), starts, n, [width] * len(ids), ids]

        return do

    return stash(map_texts(docs, work, "part int, at long, n long, width int, ids binary", text=text, keep=[key]), "tokens")


def cut(tokens: DataFrame, *, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """Pieces of windows, with their ids as little-endian unsigned 32-bit integers."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("part").alias("_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.sum("total").over(Window.partitionBy()).alias("all")
    )
    # one row for each partition of the scan
    placed = tokens.join(F.broadcast(bases), F.col("part") == F.col("_part")).select(key, (F.col("base") + F.col("at")).alias("g"), "n", "width", "ids", "all")
    kind = placed.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in slices(pc.binary_length(whole.column(4)).to_pylist())):
            rows = {k: [] for k in ("take", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "all")}
            for i, (g, n, width, ids, everything) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 6)), strict=True)):
                values = np.frombuffer(ids, f"<u{width}").astype("<u4")
                lo = 0
                while lo < n:
                    sequence, offset = divmod(g + lo, window)
                    hi = min(n, lo + window - offset)
                    for k, v in (("take", i), ("start", lo), ("length", hi - lo), ("ids", values[lo:hi].tobytes()), ("doc_tokens", n), ("sequence_id", sequence), ("offset", offset), ("all", everything)):
                        rows[k].append(v)
                    lo = hi
            keys = batch.column(0).take(pa.array(rows.pop("take"), pa.int64()))
            arrays = [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names=[key, *rows])

    pieces = placed.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, all long")
    used = F.least(F.lit(window), F.col("all") - F.col("sequence_id") * window)
    padded = F.when(F.bit_count(used) == 1, used).otherwise(F.lit(window))
    return pieces.withColumns({"sequence_length": used.cast("long"), "padded_length": padded.cast("long")}).drop("all")


def pack(docs: DataFrame, *, path: str, pattern: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a piece: key, start, length, ids, doc_tokens, sequence_id, offset, sequence_length, padded_length.

    Every id of every row lies in exactly one piece; all sequences but the last
    are full. The last is padded to ``window`` unless its length is a power of
    two. Repeated rows are packed each; an empty table gives no pieces; other
    columns of ``docs`` are ignored.
    """
    return cut(tokenize(docs, path=path, pattern=pattern, end_id=end_id, text=text, key=key), window=window, key=key)
