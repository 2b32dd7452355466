"""What the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: Column | str) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, _AZ, _az)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder of its
    own (also set as its checkpoint folder); on a cluster that is an error, since
    machines do not see each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quillmark-")
    sc.setCheckpointDir(root)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes of a file that a table of known size is written in.
FILE_BYTES = 16 << 20


def stash(df: DataFrame, label: str, most_bytes: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage: what reads the result survives the loss of any
    executor without redoing the work above, and sees the rows of one committed
    attempt only. The files stay until ``clear_stash``, or until the folder is cleaned.

    A table of at most ``most_bytes`` is written in as many files as that asks for, or as there are
    cores, rather than one for each partition of the exchange before it.
    """
    spark = df.sparkSession
    if most_bytes is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most_bytes // FILE_BYTES)))
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _STASHED.append((spark.sparkContext.applicationId, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What was written by this process: (application, path).
_STASHED: list[tuple[str, str]] = []


def clear_stash(spark: SparkSession) -> int:
    """Deletes what the operators of this session wrote to the shared folder, once their results are written elsewhere; the number of tables."""
    own = [x for x in _STASHED if x[0] == spark.sparkContext.applicationId]
    for entry in own:
        place = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _STASHED.remove(entry)
    return len(own)


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; read where it is installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """The pattern that splits text before the merges of the byte-level files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


#: Bytes of text, and rows, that Arrow functions turn into Python values at once.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 2048


def slices(sizes, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS):
    """(start, end) of stretches of rows whose ``sizes`` add up to ``most_bytes`` at most, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most_bytes or i - start >= most_rows):
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def unused(name: str, *taken: list[str]) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it; names match as Spark's do."""
    known = {c.lower() for columns in taken for c in columns}
    while name.lower() in known:
        name = "_" + name
    return name


def map_texts(docs: DataFrame, work, added: str, *, text: str = "text", keep: list[str] | None = None, kind: str = "string") -> DataFrame:
    """Runs ``work`` over Arrow batches of texts.

    ``work()`` is called once a partition and returns a function from a list of
    texts (None for null) to a list of Python lists or Arrow arrays, one for each
    field of the DDL schema ``added``. The columns ``keep`` (all by default) come
    first, without those that ``added`` replaces; names match as Spark's do. A batch is
    worked on in stretches of SLICE_BYTES, so what Python holds of it is bounded
    by that or by one row.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    taken = {f.name.lower() for f in new}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    at_end = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).cast(kind).alias(unused("__text", kept)))
    out = StructType([*(at_end.schema[c] for c in kept), *new.fields])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        do, n = work(), len(kept)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(n)), 0).to_pylist()
            for start, end in slices(sizes):
                batch = whole.slice(start, end - start)
                found = do(batch.column(n).to_pylist())
                arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(batch.columns[:n], schema, strict=False)]
                arrays += [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(found, list(schema)[n:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            pa.default_memory_pool().release_unused()

    return at_end.mapInArrow(run, out)
