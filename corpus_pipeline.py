"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import language_id, line_dedup, minmax_dedup, mixing, packing
from quillmark.llm.shared import stash, tokenizer_file, tokenizer_pattern

#: Not expressible in SQL: learned weights, signatures and tokenizer ids; tests hold it against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, which is when some language is told; those without text or letters go, whether or not anything was labelled."""
    names = ("_lang_pred", "_lang_score")
    model = language_id.fit(docs)
    if model.families is None:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    found = language_id.identify(docs, model, names=names)
    return found.where(F.col(names[0]) != language_id.UNDETERMINED).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many of their source's documents have."""
    cleaned = line_dedup.dedup_lines(docs, counts=("_n_lines", "_n_dropped"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return minmax_dedup.deduplicated(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, parts as documents of their own."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    pieces = packing.pack(docs, path=tokenizer_file("byte_bpe_50k.json"), pattern=tokenizer_pattern())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_boilerplate),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
