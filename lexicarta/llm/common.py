"""Helpers the operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.session import materialize

#: Bytes of text that a task works on at once.
TEXT_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns with the given types; other columns, whatever their names, are left out."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))


def worker_memo(name: str, make: Callable):
    """What ``make`` gives, kept by the Python worker from task to task, until another is asked for.

    A worker outlives its stage; so what one stage needs is not kept through the next ones.
    """
    memo = sys.__dict__.setdefault("_lexicarta_memo", {})
    if name not in memo:
        memo.clear()
        memo[name] = make()
    return memo[name]


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TEXT_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def filled(column: pa.Array) -> pa.Array:
    """The texts, null ones empty."""
    return pc.fill_null(column, "")


def unit_interval(*columns: Column) -> Column:
    """A number from 0 up to 1 that depends on the columns alone."""
    return F.xxhash64(*columns) / F.lit(2.0**64) + F.lit(0.5)


def text_check(text: Column) -> Column:
    """A hash of the whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def kept_rows(docs: DataFrame, check: Column, lost: DataFrame, again: DataFrame, rank: Column) -> DataFrame:
    """``docs`` without the rows in ``lost``; of rows in ``again`` one of highest ``rank`` per key.

    Keys are ``(doc_id, check)``, where ``check`` is an expression over a row of ``docs``.
    Only keys of rows that go, or that repeat, meet the documents, in one join.
    """
    keys = lost.select("doc_id", "check", F.lit(False).alias("repeats")).unionByName(
        again.select("doc_id", "check", F.lit(True).alias("repeats"))
    )
    keys = materialize(
        keys.groupBy("doc_id", "check").agg(F.max("repeats").alias("_repeats")), "keys"
    ).withColumnsRenamed({"doc_id": "k_id", "check": "k_check"})
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"),
        F.col("doc_id").cast("bigint").alias("_id"),
        check.alias("_check"),
        rank.alias("_rank"),
    )
    met = keyed.join(
        keys, (F.col("_check") == F.col("k_check")) & F.col("_id").eqNullSafe(F.col("k_id")), "left"
    )
    left = met.where("_repeats IS NULL").select("_doc")
    if not keys.where("_repeats").isEmpty():
        one = met.where("_repeats").groupBy("_id", "_check").agg(F.max_by("_doc", "_rank").alias("_doc"))
        left = left.unionByName(one.select("_doc"))
    return left.select("_doc.*")
