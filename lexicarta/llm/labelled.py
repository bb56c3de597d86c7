"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import only


def held_out(doc_id):
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """``(doc_id, text, quality)`` of at most ``per_class`` documents of each class, and all labels' numbers by class.

    The documents are those with the smallest hash of the id. Labels that are null,
    contradictory, other than 0 and 1, or held out do not count. Of rows that repeat an
    id one text is taken.
    """
    usable = (
        only(labels, doc_id="bigint", quality="int")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .drop("other")
    )
    numbers = {r["quality"]: float(r["count"]) for r in usable.groupBy("quality").count().collect()}
    chosen = None
    for quality in (0, 1):
        part = usable.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = only(docs, doc_id="bigint", text="string").join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows
    return rows.groupBy("doc_id", "quality").agg(F.max("text").alias("text")), numbers
