"""Parquet tables of documents as input, and tagged lines derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.functions.text import flatten_lines
from lexicarta.operators.records import RecordLayout


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for an input of few file splits; leave larger inputs as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``docs(doc_id, category, text)`` with one line of text per document."""
    rows = spread(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id")
    return rows.select(
        "doc_id", F.col("source").alias("category"), flatten_lines(F.col("text")).alias("text")
    )


def id_block(docs: DataFrame, rows: int = 4096) -> Column:
    """Blocks of about ``rows`` documents by id, the counterpart of file splits.

    The width of a block follows from the ids' span and number, so both dense
    and sparse ids give about the same number of documents per block.
    """
    blocks = F.ceil(F.count("*") / F.lit(rows))
    span = F.max("doc_id") - F.min("doc_id") + 1
    bounds = docs.agg(
        F.struct(
            F.min("doc_id").alias("low"),
            F.greatest(F.lit(1), F.ceil(span / blocks)).alias("width"),
        )
    ).scalar()
    return F.floor((F.col("doc_id") - bounds["low"]) / bounds["width"]).cast("bigint")


def tagged_lines(docs: DataFrame, layout: RecordLayout) -> DataFrame:
    """Documents written as tagged records: ``lines(file, block, pos, line)``.

    First text line under the abstract tag, further lines as continuations, a
    second tagged field that an extraction must leave out, and a closing line.
    """
    text_lines = F.split("text", r"\r\n|\r|\n")
    record = F.concat(
        F.array(F.concat(F.lit(layout.tag.ljust(layout.cut)), F.get(text_lines, F.lit(0)))),
        F.transform(
            F.slice(text_lines, 2, F.greatest(F.size(text_lines) - 1, F.lit(0))),
            lambda line: F.concat(F.lit("   "), line),
        ),
        F.array(F.lit("TI x y zzz"), F.lit("   cont zzzz"), F.lit("")),
    )
    return spread(docs, "doc_id").select(
        F.col("source").alias("file"),
        id_block(docs).alias("block"),
        "doc_id",
        F.posexplode(record).alias("line_no", "line"),
    ).select("file", "block", F.struct("doc_id", "line_no").alias("pos"), "line")
