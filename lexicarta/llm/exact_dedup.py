"""Exact duplicates by a tree of merges of sorted digest runs.

Every partition sorts its digests into a run, which is kept in blocks of sorted entries. In round ``r`` run ``i``
takes in the runs ``i + fan_in**r``, ``i + 2 * fan_in**r`` and so on, ``fan_in`` in all (two: a binomial tree): the
blocks of these runs meet in a task and are merged in order. Entries of equal digest, checked by size and a
second hash, become one that keeps the best row. A digest that a third of all rows share is thus
one entry per run before the first exchange and at most ``fan_in`` entries at any later merge.

Blocks are cut at bounds of digest ranges, and a task merges one range of its runs. Ranges become
finer as runs grow, so that no merge, not even the last, holds much more than ``MERGED`` entries. Every level is written.

Defined results: a null text counts as empty, and all empty texts are equal. A null
``doc_id`` ranks behind all others. Of rows that repeat both id and text one stays.
Extra columns are ignored by :func:`duplicates` and returned by :func:`deduplicate`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import kept_rows, only
from lexicarta.session import materialize

#: Characters that the normalised text lacks: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\f\r"
#: Two texts are equal if all three are: digest, size, and a second hash of the normalised text.
KEY = ["digest", "octets", "check"]
FAN_IN = 16
#: Entries that a merge of a range is to hold, on average of the ranges of the largest run.
MERGED = 4096
#: An entry of a run. Keys are digest, size and second hash, high bytes first; the smallest ``BEST`` is the row that stays.
ENTRY = np.dtype([("key", "S44"), ("less", "<i8"), ("no_id", "?"), ("doc_id", "<i8"), ("row", "<i8"), ("rows", "<i8")])
BEST = ["less", "no_id", "doc_id", "row"]
BLOCK = "run bigint, range bigint, entries binary"
GROUP = "digest binary, octets int, check bigint, best_id bigint, best_row bigint, rows bigint"
#: Copies of a group's outcome, so that rows of one group meet it in so many places.
SALTS = 16


def _normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, chars, digest, octets, check, run, row)`` per row; nothing of the text."""
    plain = only(docs, doc_id="bigint", text="string").select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"),
        _normalised(F.col("text")).alias("plain"),
    )
    return plain.select(
        "doc_id",
        "chars",
        F.unhex(F.sha2("plain", 256)).alias("digest"),
        F.octet_length("plain").alias("octets"),
        F.xxhash64("plain").alias("check"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def _bytes_of(entries: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(entries).view(np.uint8).reshape(len(entries), ENTRY.itemsize)


def _batch(batch: pa.RecordBatch) -> np.ndarray:
    """The rows of a batch as entries."""
    n = batch.num_rows
    digest = batch.column("digest").cast(pa.binary(32))
    made = np.zeros((n, ENTRY.itemsize), np.uint8)
    made[:, :32] = np.frombuffer(digest.buffers()[1], np.uint8)[32 * digest.offset :][: 32 * n].reshape(n, 32)
    made[:, 32:36] = batch.column("octets").to_numpy().astype(">i4").view(np.uint8).reshape(n, 4)
    check = batch.column("check").to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    made[:, 36:44] = check.astype(">u8").view(np.uint8).reshape(n, 8)
    entries = made.reshape(-1).view(ENTRY)
    for name in ("less", "no_id", "row"):
        entries[name] = batch.column(name).to_numpy(zero_copy_only=False)
    entries["doc_id"] = batch.column("doc_id").fill_null(0).to_numpy()
    entries["rows"] = 1
    return entries


def _blocks(runs: np.ndarray, entries: np.ndarray, bits: int) -> pa.RecordBatch:
    """The entries, in the order of their runs, cut where the run or the range of the digest changes."""
    heads = np.ascontiguousarray(_bytes_of(entries)[:, :4]).view(">u4").ravel().astype(np.int64)
    ranges = heads >> (32 - bits)
    new = np.append(True, (runs[1:] != runs[:-1]) | (ranges[1:] != ranges[:-1])) if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    parts = [entries[i:j].tobytes() for i, j in zip(at.tolist(), np.append(at[1:], len(runs)).tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(runs[at], pa.int64()), pa.array(ranges[at], pa.int64()), pa.array(parts, pa.binary())],
        names=["run", "range", "entries"],
    )


def _sorted_runs(bits: int):
    """Rows in the order of run, key and rank as blocks; of equal keys the first row stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            entries, runs = _batch(batch), batch.column("run").to_numpy().astype(np.int64)
            key = entries["key"]
            at = np.flatnonzero(np.append(True, (runs[1:] != runs[:-1]) | (key[1:] != key[:-1])))
            first = entries[at]
            first["rows"] = np.diff(np.append(at, len(entries)))
            yield _blocks(runs[at], first, bits)

    return run


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted runs of distinct keys as one; of entries with equal keys the better one, which counts for both."""
    out = np.empty(len(a) + len(b), ENTRY)
    places = np.searchsorted(a["key"], b["key"], side="right") + np.arange(len(b))
    of_a = np.ones(len(out), bool)
    of_a[places] = False
    out[of_a], out[places] = a, b
    same = np.flatnonzero(out["key"][1:] == out["key"][:-1])
    if not len(same):
        return out
    one, two = out[same], out[same + 1]
    better, equal = np.zeros(len(same), bool), np.ones(len(same), bool)
    for name in BEST:
        better |= equal & (two[name] < one[name])
        equal &= two[name] == one[name]
    best = np.where(better, two, one)
    best["rows"] = one["rows"] + two["rows"]
    out[same] = best
    return np.delete(out, same + 1)


def merge_all(runs: list[np.ndarray]) -> np.ndarray:
    """Many sorted runs as one, merged two by two in rounds."""
    while len(runs) > 1:
        odd = runs[len(runs) & ~1 :]
        runs = [merged(a, b) for a, b in zip(runs[::2], runs[1::2])] + odd
    return runs[0]


def _merge(bits: int | None):
    """One range of the runs that meet: again blocks, or in the last round a row per entry."""

    def run(blocks: pa.Table) -> pa.Table:
        entries = merge_all([np.frombuffer(part, ENTRY) for part in blocks.column("entries").to_pylist()])
        if bits is not None:
            to = np.full(len(entries), blocks.column("to")[0].as_py(), np.int64)
            return pa.Table.from_batches([_blocks(to, entries, bits)])
        raw = _bytes_of(entries)
        field = lambda i, j, kind: np.ascontiguousarray(raw[:, i:j]).view(kind).ravel()
        check = (field(36, 44, ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
        digest = pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(32), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw[:, :32]).tobytes())]
        )
        best_id = pa.array(entries["doc_id"].copy(), pa.int64(), mask=entries["no_id"].copy())
        plain = [entries[name].copy() for name in ("row", "rows")]
        return pa.table(
            [digest.cast(pa.binary()), pa.array(field(32, 36, ">i4").astype(np.int32)), pa.array(check), best_id]
            + [pa.array(column, pa.int64()) for column in plain],
            names=["digest", "octets", "check", "best_id", "best_row", "rows"],
        )

    return run


def tree_merge(prints: DataFrame, fan_in: int = FAN_IN, entries: int = MERGED) -> DataFrame:
    """``(digest, octets, check, best_id, best_row, rows)``: the best row of each group and the group's size."""
    sizes = prints.groupBy("run").count().agg(F.max("run"), F.max("count"), F.sum("count")).first()
    runs, largest, total = (sizes[0] or 0) + 1, sizes[1] or 0, sizes[2] or 0

    def bits(level: int) -> int:
        held = min(largest * fan_in**level, total)
        return max(0, math.ceil(math.log2(held / entries))) if held else 0

    ranked = prints.select(
        "run", *KEY, (-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"
    )
    blocks = materialize(
        ranked.sortWithinPartitions("run", *KEY, *BEST).mapInArrow(_sorted_runs(bits(1)), BLOCK), "runs"
    )
    level = 1
    while True:
        runs = -(-runs // fan_in)
        meet = blocks.withColumn("to", F.floor(F.col("run") / fan_in)).groupBy("to", "range")
        if runs == 1:
            return materialize(meet.applyInArrow(_merge(None), GROUP), "groups")
        blocks = materialize(meet.applyInArrow(_merge(bits(level + 1)), BLOCK), "runs")
        level += 1


def duplicates(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` per row of ``docs``."""
    prints = materialize(fingerprints(docs), "prints")
    groups = tree_merge(prints, fan_in)
    repeated = groups.where(F.col("rows") > 1).select(
        *KEY,
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        "best_id",
        "best_row",
        "rows",
    )
    # A singleton meets no group and stays as it is.
    return (
        prints.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        .join(repeated, [*KEY, "salt"], "left")
        .select(
            "doc_id",
            F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
            F.coalesce("rows", F.lit(1)).cast("bigint").alias("group_size"),
            F.coalesce(F.col("row") == F.col("best_row"), F.lit(True)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def deduplicate(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only ids and fingerprints of dropped rows meet the texts. Where the row that
    stays is repeated under its own id, one of the longest is taken.
    """
    found = materialize(
        duplicates(docs, fan_in).where("group_size > 1").withColumnRenamed("text_sha256", "check"), "duplicates"
    )
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    again = found.where(own).groupBy("doc_id", "check").count().where("count > 1")
    text = F.col("text").cast("string")
    digest = F.sha2(_normalised(text), 256)
    return kept_rows(docs, digest, found.where(~own), again, F.char_length(F.coalesce(text, F.lit(""))))
