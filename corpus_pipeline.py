"""The corpus pipeline: documents in, packed sequences out.

Every stage works on what the one before kept. It takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexicarta.llm import exact_dedup, mixing, near_dedup, packing, quality_classifier
from lexicarta.llm.common import table
from lexicarta.llm.queries import tokenizer_path
from lexicarta.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of sources."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences, whose ids follow the mix.

    Files keep no order, so the slots of the mix are found again; the stage before dropped no document.
    Documents are tokenised where they lie, and only numbers of their pieces meet the slots.
    """
    keep = {"row": "bigint", "source": "string", "size": "bigint"}
    pieces = packing.pieces(mixing.sized(docs), tokenizer_path(), with_ids=False, keep=keep)
    pieces = materialize(pieces, "pieces")
    rows = pieces.where("piece = 0").select("row", "doc_id", "source", "size")
    slots = mixing.slots_of(rows, mixing.placed(docs))
    return packing.pack_mix(pieces.drop("source", "size").join(slots, "row").drop("row"))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot train the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
