"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal text size. Block k (from 0) of a source of
weight w may not start before slot floor(k / w) and must be done by slot
ceil((k + 1) / w); the earliest deadline goes first. As the weights are multiples of
1 / period and add up to 1, this keeps every source within one block of its weight at
any time, and the schedule repeats after ``period`` slots. So one period, whose size
does not depend on the corpus, is scheduled once, and every document finds its slot by
a lookup. A source that has run out leaves its slots empty; no document is dropped or
repeated.

Defined results: null is a source of its own; a null or empty text has size 1; rows
that repeat id, source and size are copies, each with a place of its own; a null ``doc_id`` is ordinary. More
than ``MAX_SOURCES`` sources are an error, since the driver schedules them. An empty
table gives an empty result. Extra columns are ignored by :func:`placed` and returned by
:func:`mix`, which puts copies of a row where its first one is.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.llm.common import only, unit_interval
from lexicarta.session import materialize

#: Characters of text in a block.
BLOCK = 1 << 16
#: Least number of slots in a period; weights are rounded to its reciprocal.
PERIOD = 4096
#: Without given weights a source weighs its share of the text to this power.
TEMPERATURE = 0.5
#: Average number of documents whose sizes one window adds up.
CHUNK = 8192
#: Copies of a row that are numbered in one task.
SPREAD = 4096
MAX_SOURCES = 100_000


def quantised(weights: Mapping[object, float], period: int = PERIOD) -> tuple[dict, int]:
    """Whole numbers in proportion to the weights, at least 1 each, and their sum, the period."""
    while period < 4 * len(weights):
        period *= 2
    if not weights:
        return {}, period
    total = float(sum(weights.values()))
    if min(weights.values()) <= 0 or total <= 0:
        raise ValueError("target weights must be positive")
    exact = {s: w / total * period for s, w in weights.items()}
    counts = {s: max(1, int(x)) for s, x in exact.items()}
    # Largest remainder: what is missing goes to, what is too much comes from, the worst served.
    while (gap := period - sum(counts.values())) != 0:
        step = 1 if gap > 0 else -1
        able = [s for s in counts if counts[s] + step >= 1]
        able.sort(key=lambda s: (step * (counts[s] - exact[s]), str(s)))
        for s in able[: abs(gap)]:
            counts[s] += step
    return counts, period


def pfair_period(counts: list[int], period: int) -> list[tuple[int, int]]:
    """``(source, block)`` of every slot of one period, earliest deadline first."""
    waiting: list[list[int]] = [[] for _ in range(period)]  # sources by release slot
    for source in range(len(counts)):
        waiting[0].append(source)
    block = [0] * len(counts)
    ready: list[tuple[int, int, int]] = []
    slots = []
    for slot in range(period):
        for source in waiting[slot]:
            k, c = block[source], counts[source]
            deadline = -(-(k + 1) * period // c)
            overlaps = (k + 1) * period % c != 0  # the next window begins before this one ends
            heapq.heappush(ready, (deadline, 0 if overlaps else 1, source))
        deadline, _, source = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        slots.append((source, block[source]))
        block[source] += 1
        if block[source] < counts[source]:
            release = max(slot + 1, block[source] * period // counts[source])
            waiting[release].append(source)
    return slots


def _sizes(docs: DataFrame) -> DataFrame:
    rows = only(docs, doc_id="bigint", source="string", text="string")
    return rows.select(
        "doc_id", "source", F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("bigint").alias("size")
    )


def _copies(counted: DataFrame) -> DataFrame:
    """A row ``(doc_id, source, size, copy)`` for each of the ``copies`` counted.

    Many copies of one row are cut into stretches first, which several tasks number.
    """
    first = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"), F.lit(SPREAD).cast("bigint")))
    stretches = counted.where(f"copies > {SPREAD}").withColumn("first", first)
    stretches = stretches.repartition("doc_id", "source", "size", "first")
    few = counted.where(f"copies <= {SPREAD}").withColumn("first", F.lit(1).cast("bigint"))
    last = F.least(F.col("copies"), F.col("first") + SPREAD - 1)
    return few.unionByName(stretches).select(
        "doc_id", "source", "size", F.explode(F.sequence("first", last)).alias("copy")
    )


def placed(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block: int = BLOCK,
    period: int = PERIOD,
    seed: int = 0,
) -> DataFrame:
    """``(doc_id, source, size, copy, block, slot, place)`` per row; copies of id, source and size count from 1.

    The mix is the order of ``slot``, ``place``. ``place`` counts characters from the
    start of the block; documents longer than a block reach into the source's next ones.
    """
    spark = docs.sparkSession
    counted = materialize(
        _sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes"
    )
    per_source = counted.groupBy("source").agg(
        F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("chars")
    )
    totals = per_source.take(MAX_SOURCES + 1)
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    first_u, further_u = (unit_interval(F.lit(seed), "doc_id", "source", "size", *more) for more in ((), ("copy",)))
    rows = _copies(counted).withColumn("u", F.when(F.col("copy") == 1, first_u).otherwise(further_u))
    if weights is None:
        weights = {r["source"]: r["chars"] ** TEMPERATURE for r in totals}
    else:
        missing = {r["source"] for r in totals} - set(weights)
        if missing:
            raise ValueError(f"no target weight for {sorted(map(str, missing))[:20]}")
    counts, period = quantised(weights, period)
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    slots = pfair_period([counts[s] for s in names], period) if names else []
    sources = spark.createDataFrame(
        [(names.index(r["source"]), r["source"], counts[r["source"]], -(-r["n"] // CHUNK)) for r in totals],
        "source_no int, name string, per_period bigint, chunks bigint",
    )
    schedule = spark.createDataFrame(
        [(source, k, slot) for slot, (source, k) in enumerate(slots)], "source_no int, k bigint, slot_in_period bigint"
    )
    known = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    known = known.withColumn("chunk", F.floor(F.col("u") * F.col("chunks")))
    own = F.col("size")
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        known.groupBy("source_no", "chunk")
        .agg(F.sum(own).alias("chars"))
        .select("source_no", "chunk", F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("chunk_start"))
    )
    inside = (
        Window.partitionBy("source_no", "chunk")
        .orderBy("u", "doc_id", "size", "copy")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    started = known.withColumn("within", F.coalesce(F.sum(own).over(inside), F.lit(0))).join(
        chunks, ["source_no", "chunk"]
    )
    started = started.withColumn("start", F.col("chunk_start") + F.col("within"))
    started = started.withColumn("block", F.floor(F.col("start") / block))
    return (
        started.withColumn("k", F.pmod("block", "per_period"))
        .join(F.broadcast(schedule), ["source_no", "k"])
        .select(
            "doc_id",
            "source",
            "size",
            "copy",
            "block",
            (F.floor(F.col("block") / F.col("per_period")) * period + F.col("slot_in_period")).alias("slot"),
            (F.col("start") - F.col("block") * block).alias("place"),
        )
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block: int = BLOCK,
    period: int = PERIOD,
    seed: int = 0,
) -> DataFrame:
    """``docs`` in the order of the mix: partitions are stretches of slots, sorted inside."""
    spark = docs.sparkSession
    joined, places = _joined(docs, weights, block, period, seed)
    last = places.agg(F.max("slot")).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretch = 1 if last is None else last // parts + 1
    return (
        joined.repartitionById(parts, F.floor(F.col("slot") / stretch).cast("int"))
        .sortWithinPartitions("slot", "place", "_id")
        .select("_doc.*")
    )


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, source, size)`` and a ``row`` number, to be read once."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"),
        F.greatest(F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1)).cast("bigint").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )


def slots_of(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``(row, slot, place)`` of slim rows ``(row, doc_id, source, size)``; copies take the places in turn."""
    turn = Window.partitionBy("doc_id", "source", "size").orderBy("row")
    met = rows.withColumn("copy", F.row_number().over(turn).cast("bigint"))
    at = places.select(
        F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"),
        F.col("copy").alias("p_copy"), "slot", "place",
    )
    return met.join(
        at,
        F.col("doc_id").eqNullSafe(F.col("p_id"))
        & F.col("source").eqNullSafe(F.col("p_source"))
        & (F.col("size") == F.col("p_size"))
        & (F.col("copy") == F.col("p_copy")),
    ).select("row", "slot", "place")


def _joined(
    docs: DataFrame, weights: Mapping[str | None, float] | None, block: int, period: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as ``_doc`` with their ``slot`` and ``place``, and the written places."""
    first = placed(docs, weights, block, period, seed).where("copy = 1")
    places = materialize(first, "places").select(
        F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "slot", "place"
    )
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"),
        F.col("doc_id").cast("bigint").alias("_id"),
        F.col("source").cast("string").alias("_source"),
        F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("bigint").alias("_size"),
    )
    joined = keyed.join(
        places,
        F.col("_id").eqNullSafe(F.col("p_id"))
        & F.col("_source").eqNullSafe(F.col("p_source"))
        & (F.col("_size") == F.col("p_size")),
    )
    return joined, places
