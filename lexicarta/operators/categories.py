"""All abstracts of a category, joined in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of text after which a category goes on in another chunk.
CHUNK_CHARS = 1 << 24
#: Consecutive ids whose sizes are added up in one task.
BLOCK_IDS = 4096


def category_documents(docs: DataFrame, joiner: str = "", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``(category, chunk, first_id, n_docs, text)``.

    A category can hold a large part of the corpus, more than fits one value. Its text
    therefore comes in chunks, which follow each other by ``chunk``: a document is in
    chunk k if k times ``chunk_chars`` characters of its category, joiners included, begin at
    or before it. A category that fits is one chunk; nothing is left out.
    """
    size = F.char_length("text") + len(joiner)
    blocked = docs.select("category", "doc_id", "text", F.floor(F.col("doc_id") / BLOCK_IDS).alias("block"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy("category", "block")
        .agg(F.sum(size).alias("chars"))
        .select(
            F.col("category").alias("b_category"),
            F.col("block").alias("b_block"),
            F.coalesce(F.sum("chars").over(before.partitionBy("category")), F.lit(0)).alias("earlier"),
        )
    )
    inside = before.orderBy("doc_id").partitionBy("category", "block")
    placed = blocked.withColumn("within", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(
        blocks, F.col("category").eqNullSafe(F.col("b_category")) & (F.col("block") == F.col("b_block"))
    )
    chunk = F.floor((F.col("earlier") + F.col("within")) / chunk_chars)
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", "text")))
    return placed.groupBy("category", chunk.alias("chunk")).agg(
        F.min("doc_id").alias("first_id"),
        F.count("*").alias("n_docs"),
        F.array_join(F.transform(ordered, lambda d: d["text"]), joiner).alias("text"),
    )
