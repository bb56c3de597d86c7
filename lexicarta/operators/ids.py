"""Contiguous document ids (P4) and the id range of each category (P5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def contiguous_index(df: DataFrame, order_by: list, name: str) -> DataFrame:
    """Number rows 0, 1, 2, ... in the order of ``order_by``, which must be unique.

    Rows are range partitioned and sorted, numbered inside their partition, and
    shifted by the rows of the partitions before. No task sees more than one
    partition; the offsets are one row per partition. The placed rows are
    written first, because a range partitioning is sampled and two runs of it
    need not agree. Pass slim rows: keys, not texts.
    """
    placed = materialize(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_row", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_part", F.shiftright("_row", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    in_part = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, (F.col("_offset") + in_part).cast("bigint"))
        .drop("_row", "_part", "_offset")
    )


def ranked_in_groups(df: DataFrame, group: str, order_by: list, name: str = "rank") -> DataFrame:
    """Number the rows of each ``group`` 1, 2, 3, ... in the order of ``order_by``, unique inside a group.

    One order over all groups is range partitioned and numbered; what the groups before take up
    is taken off. So a group of any size is spread over tasks, where a window would sort it in one.
    """
    placed = contiguous_index(df, [group, *order_by], "_index")
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_index").alias("_first"))
    return (
        placed.join(first, F.col(group).eqNullSafe(F.col("_group")))
        .withColumn(name, F.col("_index") - F.col("_first") + 1)
        .drop("_index", "_group", "_first")
    )


def label_ranges(
    docs: DataFrame,
    one_based: bool = False,
    categories: DataFrame | None = None,
    first_id: int | None = None,
) -> DataFrame:
    """``label_ranges(category, label_id, start_id, stop_id)`` of training documents.

    Labels count from 1 in the order of the ranges. ``one_based=True`` is the
    compatible form, whose ranges start at 1 while the ids start at 0.

    ``categories(category, file)`` lists all training files. One without documents has
    a label too, and an empty range: it starts where the next document's id is and
    stops one before. ``first_id`` is where the ranges begin if the first file is empty.
    """
    shift = 1 if one_based else 0
    ranges = docs.groupBy("category").agg(F.min("doc_id").alias("start_id"), F.max("doc_id").alias("stop_id"))
    order = ["start_id", "category"]
    if categories is not None:
        listed = categories.groupBy("category").agg(F.min("file").alias("file"))
        earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
        begin = F.lit(first_id) if first_id is not None else F.min("start_id").over(Window.partitionBy())
        next_id = F.coalesce(F.max("stop_id").over(earlier) + 1, begin, F.lit(0)).cast("bigint")
        ranges = listed.join(ranges, "category", "left").select(
            "category",
            "file",
            F.coalesce("start_id", next_id).alias("start_id"),
            F.coalesce("stop_id", next_id - 1).alias("stop_id"),
        )
        order = ["file"]
    numbered = contiguous_index(ranges, order, "label_index")
    return numbered.select(
        "category",
        (F.col("label_index") + 1).cast("int").alias("label_id"),
        (F.col("start_id") + shift).alias("start_id"),
        (F.col("stop_id") + shift).alias("stop_id"),
    )
