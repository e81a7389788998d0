"""The corpus pipeline: quality rules, line dedup, near dedup, mixing and packing over documents, stage after stage.

Each stage gets the documents that the stage before it kept, as stored, and all of its decisions take effect: documents
that the rules reject go, repeated chunks of lines are cut from texts, one document of each group of near duplicates stays,
the mix takes a document as often as its source's target says (a document taken twice is two rows), and the rest is packed.
All stages but the last return the columns of documents. Nulls, empty texts and empty tables go through every stage, as the
operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import linededup, mixing, neardup, packing, quality
from voxframe.llm.q_packing import vocabulary
from voxframe.llm.scratch import Owner, own, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; the model is fitted on a bounded sample of labels."""
    return quality.keep(docs, quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated chunks of lines; n_chars follows the text."""
    out = linededup.dedup(docs)
    if "n_chars" in docs.columns:
        removed = F.col(out.columns[len(docs.columns)])
        out = out.withColumn("n_chars", F.when(removed > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each component of documents alike by 0.8 in shingles of five words."""
    return neardup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.pack(stored(packing.pieces(docs, vocabulary()), "pack-pieces"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

#: A fitted model decides the first stage, so SQL can't state the result; tests compare it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents; each stage's result is stored and read again. What a stage stored
    on its way goes when its result is stored, and that goes when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Owner | None = None
    for name, stage in STAGES[:-1]:
        with Owner(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        made.remove(keep=made.paths[-1:])
        if before is not None:
            before.remove()
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
