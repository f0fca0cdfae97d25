"""A corpus in five stages: language, repeated lines, near duplicates, source mixing, pieces.

Every stage is one operator of `racelake.llm`. It gets what the stage before kept and returns the columns of
documents; the last one adds the piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racelake.llm import jaccard, language, lines, mixing, pieces
from racelake.llm.workers import library_on_path
from racelake.sources.scratch import stable


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: nothing to read in them, or no language ahead of the others."""
    library_on_path(spark)
    found = language.identify_languages(docs, language.fit(docs))
    return found.filter(~F.col("rejected")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; every document stays, without those lines."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    gone = jaccard.jaccard_groups(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its piece ids and their number."""
    return pieces.encode_texts(docs).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: Compression, signatures and pieces can't be stated in SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that all stages kept, as often as the mix takes them, with their pieces.

    Null, empty and letterless texts go at the first stage. Rows that repeat an id and a text pass the stages alike. Long
    texts are processed whole. Other columns of documents pass through; an empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        last = name == STAGES[-1][0]
        docs = stage(spark, docs, sf_dir)
        docs = docs if last else stable(docs)
    return docs
