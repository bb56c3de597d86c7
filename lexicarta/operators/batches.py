"""A corpus that grows by batches (K1, G1-G5): texts are counted once, and counts are merged.

A store is a folder with one part per batch of each table::

    documents/batch=N   (doc_id, key columns, text); ids go on from batch to batch
    terms/batch=N       (term, cnt, n_docs) of the cleaned tokens, which the vocabulary is chosen from
    words/batch=N       (term, doc_occurrences, doc_frequency) of the words that represent documents
    counts/batch=N      (doc_id, words array<struct<term, n>>)
    manifest/batch=N    (first_id, n_docs, min_token, clean_docs), written last

All totals are sums, so those of the whole corpus are the sums over its batches. They keep words below any
threshold, because a later batch may bring a word above it. A batch counts once its manifest
is written; what a failed attempt left is overwritten by the next. One batch is added at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.functions.text import clean_text, longer_than, split_words, word_counts
from lexicarta.operators.features import dictionary, tfidf
from lexicarta.operators.ids import contiguous_index
from lexicarta.operators.vocabulary import (
    MIN_DOC_FREQUENCY,
    MIN_SHARE,
    MIN_TOKEN,
    document_words,
    inverse_document_frequency,
    without_stop_words,
)
from lexicarta.session import materialize

MANIFEST = "batch int, first_id bigint, n_docs bigint, min_token int, clean_docs boolean"


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """One row per finished batch."""
    try:
        return spark.read.schema(MANIFEST).option("basePath", f"{store}/manifest").parquet(f"{store}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _stored(spark: SparkSession, store: str, table: str) -> DataFrame:
    """A table of the finished batches."""
    batches = sorted(row["batch"] for row in manifest(spark, store).select("batch").collect())
    if not batches:
        raise ValueError(f"{store} has no batch")
    parts = (spark.read.parquet(f"{store}/{table}/batch={b}") for b in batches)
    return reduce(DataFrame.unionByName, parts)


def add_batch(
    docs: DataFrame, store: str, order_by: list[str], min_token: int = MIN_TOKEN, clean_docs: bool = False
) -> int:
    """Add ``docs(order_by..., text, ...)`` as the next batch and return its number.

    Its documents get ids in the order of ``order_by``, unique among them, after those of all
    batches before. Only their own texts are read.
    """
    spark = docs.sparkSession
    before = manifest(spark, store).collect()
    for row in before:
        if (row["min_token"], row["clean_docs"]) != (min_token, clean_docs):
            raise ValueError("the batches before were counted by other rules")
    batch = max((row["batch"] for row in before), default=-1) + 1
    first_id = sum(row["n_docs"] for row in before)

    def put(table: str, rows: DataFrame) -> DataFrame:
        path = f"{store}/{table}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    ids = contiguous_index(docs.select(*order_by), order_by, "doc_id")
    numbered = docs.join(ids.withColumn("doc_id", F.col("doc_id") + first_id), order_by)
    written = put("documents", numbered)
    tokens = F.filter(split_words(clean_text(F.col("text"))), lambda w: longer_than(w, min_token - 1))
    put(
        "terms",
        written.select(F.inline(word_counts(tokens)).alias("term", "n"))
        .groupBy("term")
        .agg(F.sum("n").cast("bigint").alias("cnt"), F.count("*").alias("n_docs")),
    )
    words = F.filter(document_words(F.col("text"), clean_docs), lambda w: longer_than(w, min_token - 1))
    counts = put("counts", written.select("doc_id", word_counts(words).alias("words")))
    put(
        "words",
        counts.select(F.inline("words"))
        .groupBy("term")
        .agg(F.sum("n").cast("bigint").alias("doc_occurrences"), F.count("*").alias("doc_frequency")),
    )
    told = written.agg(
        F.lit(first_id).cast("bigint").alias("first_id"),
        F.count("*").alias("n_docs"),
        F.lit(min_token).alias("min_token"),
        F.lit(clean_docs).alias("clean_docs"),
    )
    told.write.mode("overwrite").parquet(f"{store}/manifest/batch={batch}")
    return batch


def batch_documents(spark: SparkSession, store: str) -> DataFrame:
    """The documents of all batches with their ids."""
    return _stored(spark, store, "documents")


def merged_vocabulary(
    spark: SparkSession, store: str, stopwords: DataFrame, min_share: float = MIN_SHARE, by: str = "occurrences"
) -> DataFrame:
    """``(term, cnt)`` as :func:`~lexicarta.operators.vocabulary.vocabulary` finds over all batches."""
    if by not in ("occurrences", "documents"):
        raise ValueError(f"unknown threshold rule {by!r}")
    n_docs = manifest(spark, store).agg(F.sum("n_docs")).scalar()
    counted = _stored(spark, store, "terms").groupBy("term").agg(
        F.sum("cnt" if by == "occurrences" else "n_docs").alias("cnt")
    )
    return without_stop_words(counted.where(F.col("cnt") >= n_docs * F.lit(float(min_share))), stopwords)


def merged_statistics(
    spark: SparkSession, store: str, vocab: DataFrame, min_doc_frequency: int = MIN_DOC_FREQUENCY
) -> DataFrame:
    """``(term, doc_occurrences, doc_frequency, idf)`` of the vocabulary's terms over all batches."""
    n_docs = manifest(spark, store).agg(F.sum("n_docs")).scalar()
    return (
        _stored(spark, store, "words")
        .join(vocab.select("term"), "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("doc_occurrences").alias("doc_occurrences"), F.sum("doc_frequency").alias("doc_frequency"))
        .withColumn("idf", inverse_document_frequency(F.col("doc_frequency"), n_docs, min_doc_frequency))
    )


def merged_features(
    spark: SparkSession,
    store: str,
    stopwords: DataFrame,
    min_share: float = MIN_SHARE,
    by: str = "occurrences",
    min_doc_frequency: int = MIN_DOC_FREQUENCY,
) -> tuple[DataFrame, DataFrame]:
    """``weights(doc_id, term, cnt, weight)`` and the dictionary of all batches; no text is read."""
    vocab = materialize(merged_vocabulary(spark, store, stopwords, min_share, by), "vocabulary")
    statistics = materialize(merged_statistics(spark, store, vocab, min_doc_frequency), "statistics")
    counts = _stored(spark, store, "counts").select("doc_id", F.inline("words")).withColumnRenamed("n", "cnt")
    return tfidf(counts, statistics), dictionary(statistics)


def weight_vectors(weights: DataFrame, terms: DataFrame, docs: DataFrame) -> DataFrame:
    """``vectors(doc_id, entries)`` of weights in long form, also for documents without any."""
    entry = F.struct("term_id", "weight")
    every = docs.select("doc_id", F.lit(None).cast("struct<term_id:int,weight:double>").alias("e"))
    return (
        weights.join(terms.select("term", "term_id"), "term")
        .select("doc_id", entry.alias("e"))
        .unionByName(every)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list("e")).alias("entries"))
    )
