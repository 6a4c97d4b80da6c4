"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of the table
documents, and works on all that its predecessor kept. The result of a stage is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import line_dedup, mixing, near_copies, packing, quality
from panelyard.llm.common import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Not expressible in SQL: best-fit packing, near-dedup and byte-level tokens.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.quality(docs).filter("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats as boilerplate go; documents with nothing else go as well. Copies count as one page."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS), once=True).filter((F.col("n_dropped") == 0) | (F.length(F.trim("text")) > 0))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those that operator 9 joins, and those of similar sets of shingles."""
    return near_copies.drop_near_copies(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and the sequences of at most 1024 tokens that hold them."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("near dedup", near_dedup), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
