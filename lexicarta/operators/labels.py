"""Documents looked up in the id ranges of the categories.

The lookup is a sweep: range starts and document ids in one order, cut into partitions,
and the last range carried forward to the ids behind it. Its cost follows the number of ids and
ranges, whatever the widths of the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicarta.session import materialize

_INTERVAL = "struct<to_id:bigint,label:int,category:string>"
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def label_intervals(ranges: DataFrame) -> DataFrame:
    """``(from_id, to_id, label, category)``: disjoint intervals, in which an id has its label.

    A label is the 0-based position of a range in the order of the label ids. An id belongs to the first range that
    stops at or after it, so an interval begins behind the last stop of the ranges before.
    """
    in_order = Window.orderBy("label_id")  # one row per category
    reach = F.max("stop_id").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.select(
        F.coalesce(reach + 1, F.col("start_id")).alias("from_id"),
        F.col("stop_id").alias("to_id"),
        (F.row_number().over(in_order) - 1).cast("int").alias("label"),
        "category",
    ).where("from_id <= to_id")


def carried_forward(events: DataFrame, order_by: list[str], value: str) -> DataFrame:
    """``events`` with each null ``value`` replaced by the last one before it in the order.

    Rows are range partitioned and written, because two samplings of a range partitioning need not agree.
    Values are carried inside each partition, and across partitions by one row of each. Pass slim rows.
    """
    placed = materialize(
        events.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id()), "sweep"
    )
    last = placed.groupBy("_part").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order_by))).alias("_last")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order_by)
    own = F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.withColumn(value, own)
        .join(F.broadcast(carry), "_part")  # one row per partition
        .withColumn(value, F.coalesce(value, "_before"))
        .drop("_part", "_before")
    )


def label_by_range(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``split``, ``label`` and ``category`` to ``docs(doc_id, ...)``.

    Below the first range a document is test data. Otherwise its label is the
    0-based position, in the order of the label ids, of the first range that stops
    at or after its id. Documents above the last range, and those without id, get nulls.

    Columns of fixed width go through the sweep with their ids. With others, such as vectors
    or texts, only the ids are swept, and the labels join the documents where they are.
    """
    kept = [c for c in docs.columns if c != "category"]
    payload = [c for c in kept if c != "doc_id"]
    slim = all(isinstance(docs.schema[c].dataType, _FIXED_WIDTH) for c in payload)
    ids = docs.select(*kept) if slim else docs.select("doc_id").distinct()
    carried = payload if slim else []
    starts = label_intervals(ranges).select(
        F.col("from_id").alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct("to_id", "label", "category").cast(_INTERVAL).alias("_interval"),
        F.lit(None).cast("bigint").alias("doc_id"),
        *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in carried),
    )
    asked = ids.select(
        F.col("doc_id").alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast(_INTERVAL).alias("_interval"),
        "doc_id",
        *carried,
    )
    swept = carried_forward(starts.unionByName(asked), ["_at", "_kind"], "_interval").where("_kind = 1")
    interval = F.when(F.col("doc_id") <= F.col("_interval.to_id"), F.col("_interval"))
    first_start = ranges.agg(F.min_by("start_id", "label_id")).scalar()
    found = swept.select("doc_id", *carried, interval.alias("_interval"))
    if not slim:
        found = docs.select(*kept).join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    split = F.when(F.col("doc_id") < first_start, "test").when(F.col("_interval").isNotNull(), "train")
    return found.select(
        *kept,
        split.alias("split"),
        F.col("_interval.label").alias("label"),
        F.col("_interval.category").alias("category"),
    )
