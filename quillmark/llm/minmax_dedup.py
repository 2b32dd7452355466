"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

1. One pass makes each document's shingle set, its hash and min-max signature.
   Documents of equal sets are a class; from here on classes stand for documents.
2. Signatures are banded. In each bucket every class is paired with the one next
   to it in a drawn order (large buckets in salted runs); of its partners each component
   has the one of the most similar signature confirmed on full sets. Some rounds of
   this, over the buckets that still hold several components, join nearly all of a group
   with a few checks a class, however large the group is.
3. What buckets still hold besides their commonest component is compared with all of
   the bucket, in blocks of bounded size: pairs of different components whose sizes and
   signatures allow the similarity are confirmed on full sets right there, each in the first
   band it shares. A block gives only the links that join its components. So every
   pair that shares a band, whose signatures agree on the similarity less MARGIN at least, and that
   is not known to be in one component is confirmed; none is dropped for the size of its group,
   and no pairs are listed. Classes have numbers of their own, so rows with one id and different
   texts take part each.

Two texts at the least similarity share no band with a chance of (1 - s^ROWS)^BANDS,
about 1e-7 at 0.8. Signatures of such texts agree less than MARGIN allows with a chance of
about 3e-8 (a binomial of 200 values at 0.8, under 128), and the pair is then not confirmed. Texts are
shuffled only for classes that share a bucket with another.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.components import BLOCK, components
from quillmark.llm.shared import map_texts, slices, stash, unused
from quillmark.llm.shingles import MinMax, Shingler

WIDTH = 5  # words of a shingle
PERCENT = 80  # least 100 * intersection / union
ROWS, BANDS = 5, 40  # ROWS * BANDS values are the minima and maxima of half as many permutations
#: Signatures agree in a share that scatters by 0.03 or less around the resemblance.
MARGIN = 0.16
RUN_ROWS = 10_000  # of a bucket chained in one task
BLOCK_ROWS = 1024  # of a bucket compared with each other in one task
CHAINS = 2  # rounds of chained pairs before buckets are searched exhaustively
BROADCAST_IDS = 1_000_000


def _bodies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, text_hash): of one id, texts are told apart by their hash."""
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))


def signatures(docs: DataFrame, *, key: str, text: str, width: int) -> DataFrame:
    """(id, text_hash, n_shingles, set_hash, signature); set's hash and signature are null for an empty set or a null id."""

    def work():
        shingler, hashing = Shingler(width), MinMax(ROWS * BANDS // 2)

        def do(texts):
            n, hashes, found = [], [], []
            for t in texts:
                s = shingler.set_of(t)
                n.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found.append(hashing.signature(s) or None)
            return [n, hashes, found]

        return do

    made = map_texts(_bodies(docs, key, text), work, "n_shingles long, set_hash binary, signature binary", keep=["id", "text_hash"])
    return made.withColumns({c: F.when(F.col("id").isNotNull(), F.col(c)) for c in ("set_hash", "signature")})


def confirmed(pairs: DataFrame, texts: DataFrame, *, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(width)
        for batch in batches:
            keep, last, mine = [], None, None
            a, ta, tb = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, mine = a[i], shingler.set_of(ta[i].as_py())
                other = shingler.set_of(tb[i].as_py())
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both and 100 * both >= percent * (len(mine) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _relabel(labels: DataFrame, links: DataFrame, block: int, most_bytes: int) -> DataFrame:
    """``labels`` (node, comp) after its components are joined by ``links`` (a, b; nodes)."""
    mapped = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    merged = components(mapped.select(F.col("ca").alias("a"), F.col("cb").alias("b")), block=block, most_bytes=most_bytes)
    moved = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left")
    return stash(moved.select("node", F.coalesce("_to", "comp").alias("comp")), "near-labels", most_bytes)


def _shares(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, ca, cb, share) of pairs (a, b, ca, cb, sa, sb) whose signatures agree in at least ``least`` of their values."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (4, 5))
            share = (one == two).mean(1)
            at = np.flatnonzero(share >= least)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in range(4)), pa.array(share[at])], names=["a", "b", "ca", "cb", "share"])

    return pairs.select("a", "b", "ca", "cb", "sa", "sb").mapInArrow(run, "a long, b long, ca long, cb long, share double")


def _best(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, ca, cb, share) the best of each component, once each."""
    pair = F.struct("share", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    sides = pairs.select(F.col("ca").alias("side"), pair.alias("pair")).unionAll(pairs.select(F.col("cb").alias("side"), pair.alias("pair")))
    return sides.groupBy("side").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with their comp."""
    labelled = buckets.join(labels, "node")
    mixed = labelled.groupBy("band", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "bucket")
    return labelled.join(mixed, ["band", "bucket"])


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows of each bucket dealt to blocks (i, j): in each, few rows (``few``) meet a part of all.

    The bucket's commonest component is left out of the few, as its rows need not
    meet each other. The few of group i meet all rows of part j, so a large component with
    some strangers is copied once for each ``block_rows`` of the strangers.
    """
    per_comp = rows.groupBy("band", "bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = per_comp.groupBy("band", "bucket").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"))
    main = main.select("band", "bucket", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.c")).alias("others"), "all")
    dealt = rows.join(main, ["band", "bucket"])
    groups, parts = (F.ceil(F.col(c) / block_rows).cast("int") for c in ("others", "all"))
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    as_all = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.struct(i.alias("i"), part(parts).alias("j"), F.lit(False).alias("few")))
    as_few = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(part(groups).alias("i"), j.alias("j"), F.lit(True).alias("few")))
    both = F.when(F.col("comp") == F.col("main"), as_all).otherwise(F.concat(as_all, as_few))
    return dealt.withColumn("_at", F.explode(both)).select("band", "bucket", "_at.i", "_at.j", "_at.few", "node", "comp", "main")


def _links(width: int, percent: int, least: float):
    """For rows sorted by block: confirmed links (a, b) that join components within the block.

    A pair is tried in the first band it shares, if sizes and signatures allow it and
    no chain of links of this block joins its components already.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        shingler = Shingler(width)
        held: list[dict] = []

        def links():
            sides = [[r for r in held if r["few"] == few] for few in (True, False)]
            if not all(sides):
                return
            few, all_ = sides
            sig = np.stack([np.frombuffer(r["sig"], "<u2") for r in all_])
            n, comp, nodes = (np.array([r[k] for r in all_]) for k in ("n", "comp", "node"))
            band, main, sets, parent = held[0]["band"], held[0]["main"], {}, {}

            def root(c):
                while (p := parent.get(c, c)) != c:
                    c = p
                return c

            def set_of(row):
                if row["node"] not in sets:
                    sets[row["node"]] = shingler.set_of(row["text"])
                return sets[row["node"]]

            for r in few:
                # two rows outside the main component meet twice; the lesser number asks
                size = r["n"]
                at = np.flatnonzero((comp != r["comp"]) & ((comp == main) | (nodes > r["node"])) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)))
                if not len(at):
                    continue
                same = sig[at] == np.frombuffer(r["sig"], "<u2")
                share = same.mean(1)
                first = same.reshape(len(at), BANDS, ROWS).all(2).argmax(1)
                likely = np.flatnonzero((share >= least) & (first == band))
                for k in likely[np.argsort(-share[likely], kind="stable")]:
                    other = all_[at[k]]
                    ca, cb = root(r["comp"]), root(other["comp"])
                    if ca == cb:
                        continue
                    mine, its = set_of(r), set_of(other)
                    both = len(np.intersect1d(mine, its, assume_unique=True))
                    if both and 100 * both >= percent * (len(mine) + len(its) - both):
                        parent[ca] = cb
                        yield r["node"], other["node"]

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for row in (r for lo, hi in slices(pc.binary_length(texts).to_pylist()) for r in batch.slice(lo, hi - lo).to_pylist()):
                if held and any(row[k] != held[0][k] for k in ("bucket", "band", "i", "j")):
                    if pairs := list(links()):
                        yield batch_of(pairs)
                    held.clear()
                held.append(row)
        if held and (pairs := list(links())):
            yield batch_of(pairs)

    return run


def _groups(docs: DataFrame, key: str, text: str, width: int, percent: int, block_rows: int, run_rows: int, edge_block: int, broadcast_ids: int) -> tuple[DataFrame, int]:
    """((id, text_hash, n_shingles, component_id, kept) for each row of ``docs``, their number); see ``near_groups``."""
    rows = stash(signatures(docs, key=key, text=text, width=width), "near-rows")
    n_rows, two_numbers = rows.count(), 16
    # equal sets have equal signatures, so any row's stands for the class
    classes = rows.where(F.col("set_hash").isNotNull()).groupBy("set_hash").agg(F.min(F.struct("id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("sig"))
    classes = stash(classes.select(F.monotonically_increasing_id().alias("node"), "set_hash", "rep.id", "rep.text_hash", "n", "sig"), "near-classes", n_rows * 4 * ROWS * BANDS)

    width_bytes = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substring("sig", j * width_bytes + 1, F.lit(width_bytes))))
    banded = classes.select("node", F.posexplode(bands).alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = stash(banded.join(shared, ["band", "bucket"]), "near-buckets", n_rows * BANDS * 2 * two_numbers)

    nodes = stash(buckets.select("node").distinct(), "near-nodes", n_rows * two_numbers)
    small = nodes.count() <= broadcast_ids
    bounded = lambda df: F.broadcast(df) if small else df
    meeting = classes.drop("set_hash").join(bounded(nodes), "node", "left_semi")
    sigs = meeting.select("node", "n", "sig")
    texts = stash(_bodies(docs, key, text).join(bounded(meeting.select("node", "id", "text_hash")), ["id", "text_hash"]).select("node", "text"), "near-texts")

    least = percent / 100 - MARGIN
    labels = nodes.select("node", F.col("node").alias("comp"))
    for n in range(CHAINS):
        open_rows = (_mixed(buckets, labels) if n else buckets.withColumn("comp", F.col("node"))).join(sigs.select("node", "sig"), "node")
        salt = F.pmod(F.xxhash64(F.lit(n), "bucket", "node"), F.ceil(F.col("members") / run_rows))
        before = Window.partitionBy("band", "bucket", salt).orderBy(F.xxhash64(F.lit(n), "band", "node"), "node")
        chained = open_rows.select(F.lag(F.struct("node", "comp", "sig")).over(before).alias("p"), "node", "comp", "sig").where("p.comp <> comp")
        pairs = chained.select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.col("p.comp").alias("ca"), F.col("comp").alias("cb"), F.col("p.sig").alias("sa"), F.col("sig").alias("sb"))
        links = stash(confirmed(_best(_shares(pairs, least)), texts, width=width, percent=percent), "near-links", n_rows * two_numbers)
        if links.isEmpty():
            break
        labels = _relabel(labels, links, edge_block, n_rows * two_numbers)

    block = ("band", "bucket", "i", "j")
    # an id may stand on several equal rows
    dealt = _blocks(_mixed(buckets, labels), block_rows).join(sigs, "node").join(texts.dropDuplicates(["node"]), "node")
    sorted_rows = dealt.select(*block, "few", "node", "comp", "main", "n", "sig", "text").repartition(*block).sortWithinPartitions(*block)
    links = stash(sorted_rows.mapInArrow(_links(width, percent, least), "a long, b long"), "near-links")
    if not links.isEmpty():
        labels = _relabel(labels, links, edge_block, n_rows * two_numbers)

    named = labels.join(meeting.select("node", "id"), "node")
    least_id = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    placed = named.join(least_id, "comp").select("node", "component_id")
    known = classes.select("node", "set_hash", "id").join(placed, "node", "left").select("set_hash", F.coalesce("component_id", "id").alias("component_id"))
    found = rows.drop("signature").join(known, "set_hash", "left")
    found = found.select("id", "text_hash", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True))), n_rows


def near_groups(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, block_rows: int = BLOCK_ROWS, run_rows: int = RUN_ROWS, edge_block: int = BLOCK, broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Rows are linked whose shingle sets have 100 * intersection >= percent * union;
    component_id is the least key that links reach, kept marks the row that has it.
    A text without words (or null) has an empty set and is linked with nothing;
    one with fewer words than ``width`` is one shingle. Repeated rows are kept or not
    alike; rows with one key and different texts are judged by their own. A row with a
    null key is linked with nothing and kept, with a null component_id. An empty
    table gives no rows. Other columns are ignored.
    """
    found, _ = _groups(docs, key, text, width, percent, block_rows, run_rows, edge_block, broadcast_ids)
    return found.select(F.col("id").alias(key), "n_shingles", "component_id", "kept")


def deduplicated(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, block_rows: int = BLOCK_ROWS, run_rows: int = RUN_ROWS, edge_block: int = BLOCK, broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """``docs`` with one row for each group: the one with the least key.

    Of rows that share that key, one text stays, once, the one of the least hash; a text without
    words is a group of its own. Rows with a null key stay. All columns come back as they were.
    """
    found, n_rows = _groups(docs, key, text, width, percent, block_rows, run_rows, edge_block, broadcast_ids)
    stays, times, body, nth = (unused(c, docs.columns) for c in ("_stays", "_times", "_body", "_nth"))
    # texts without words are groups of their own
    alone = F.when(F.col("n_shingles") == 0, F.col("text_hash"))
    kept = found.where(F.col("kept") & F.col("id").isNotNull()).groupBy(F.col("id").alias(stays), alone.alias("alone")).agg(F.min("text_hash").alias(body), F.count(F.lit(1)).alias(times))
    kept = stash(kept.drop("alone"), "near-kept", n_rows * 24)
    same = (docs[key].cast("long") == F.col(stays)) & (F.xxhash64(docs[text]) == F.col(body))
    joined = docs.join(kept, same, "left").where(F.col(stays).isNotNull() | docs[key].isNull())
    # rows are told apart only where some repeat; they have one key, so a key's rows are those of one text
    if not kept.where(F.col(times) > 1).isEmpty():
        spread = F.when(F.col(key).isNull(), F.xxhash64(text))  # rows without a key are no group
        first = F.row_number().over(Window.partitionBy(key, body, spread).orderBy(F.lit(1)))
        joined = joined.withColumn(nth, first).where((F.col(nth) == 1) | F.col(key).isNull())
    return joined.select(*docs.columns)
