"""A corpus from raw documents: toxic ones go, later matches of lines are cut, one of each group of near duplicates stays, contaminated ones go, the rest is encoded.

Each stage works on all that the stage before it kept, is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm import decontamination, lines, pieces, simhash, toxicity
from duoscope.runtime import materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below their language's threshold."""
    scored = toxicity.mark_toxic(docs, read(spark, sf_dir, "labels"))
    return scored.filter(~F.col(toxicity.MARK)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; those of which no line stays go."""
    return lines.remove_duplicate_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of the benchmark."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of pieces and digests, with whether decoding gives the text again."""
    return pieces.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece", encode),
]

#: Trained scores and merges of pieces are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
