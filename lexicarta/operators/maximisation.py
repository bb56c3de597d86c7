"""Expectation maximisation of topics, a document's entries kept in its row.

The steps are those of the estimator of ``pyspark.ml`` from the same start, so the weights it ends with are the same up to
rounding. Its graph has an edge per entry, which every iteration builds anew and caches; here a task takes whole
documents, and what goes from one iteration to the next are the weights: one short row per document, and per
task one per term it met.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicarta.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

ETA = 1.1  # what the estimator takes for itself; so is alpha
_WEIGHTS = "id bigint, weights array<double>"
_STEP, _ADD, _MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1  # of java.util.Random


class JavaRandom:
    """The doubles of ``java.util.Random``, many at a time."""

    def __init__(self, seed: int):
        self.state = (seed ^ _STEP) & _MASK

    def doubles(self, n: int) -> np.ndarray:
        states = np.empty(2 * n, np.uint64)
        mask, done, step, add = np.uint64(_MASK), 0, _STEP, _ADD
        if n:
            states[0] = (self.state * _STEP + _ADD) & _MASK
            done = 1
        while done < len(states):  # `step` and `add` lead `done` states on
            more = min(done, len(states) - done)
            states[done : done + more] = (states[:more] * np.uint64(step) + np.uint64(add)) & mask
            done += more
            step, add = (step * step) & _MASK, (step * add + add) & _MASK
        if n:
            self.state = int(states[-1])
        high, low = states[0::2] >> np.uint64(22), states[1::2] >> np.uint64(21)
        return ((high << np.uint64(27)) + low) * 2.0**-53


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of lists without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _as_lists(lengths: np.ndarray, values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=None if mask is None else pa.array(mask))


def _chunks(lengths: np.ndarray, k: int) -> Iterator[tuple[slice, slice]]:
    """Whole documents of about 2^20 weights together, as a slice of the documents and one of their entries."""
    ends = np.cumsum(lengths)
    row = entry = 0
    while row < len(lengths):
        last = max(row + 1, int(np.searchsorted(ends, entry + (1 << 20) // k, "right")))
        yield slice(row, last), slice(entry, int(ends[last - 1]))
        row, entry = last, int(ends[last - 1])


class _Sums:
    """Weights of documents and terms, of the entries' shares."""

    def __init__(self, size: int, k: int):
        self.terms, self.met = np.zeros((k, size)), np.zeros(size, bool)

    def add(self, lengths: np.ndarray, terms: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Adds ``shares``, topics by entries, to their terms; gives their sums by document, none of which is without entries."""
        for j, share in enumerate(shares):
            self.terms[j] += np.bincount(terms, share, self.terms.shape[1])
        self.met[terms] = True
        return np.add.reduceat(shares, np.cumsum(lengths) - lengths, axis=1).T

    def rows(self) -> tuple[np.ndarray, pa.Array]:
        found = np.flatnonzero(self.met)
        k = len(self.terms)
        return -1 - found.astype(np.int64), _as_lists(np.full(len(found), k), self.terms[:, found].T.ravel())


def _started(size: int, k: int, seed: int):
    """Numbered documents with their entries and first weights, then a row per term; random shares, drawn by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, random, names, doc_type = _Sums(size, k), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch["id"].to_numpy()
            random = random or JavaRandom(seed + int(ids[0] >> 33))  # the estimator seeds by partition
            names, doc_type = batch.schema.names, batch["doc_id"].type
            lengths, terms = _lists(batch["terms"])
            values = _lists(batch["amounts"])[1]
            kept = values != 0
            lengths = np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(lengths)])])
            terms, values = terms[kept], values[kept]
            has = lengths > 0
            weights = np.zeros((len(ids), k))
            rows = np.flatnonzero(has)
            for docs, entries in _chunks(lengths[has], k):
                drawn = random.doubles((entries.stop - entries.start) * k).reshape(-1, k)
                shares = (drawn / drawn.sum(axis=1, keepdims=True) * values[entries, None]).T
                weights[rows[docs]] = sums.add(lengths[has][docs], terms[entries], np.ascontiguousarray(shares))
            listed = _as_lists(np.where(has, k, 0), weights[has].ravel(), ~has)
            columns = [batch["id"], batch["doc_id"], _as_lists(lengths, terms), _as_lists(lengths, values), listed]
            yield pa.RecordBatch.from_arrays(columns, [*names, "weights"])
        if names:
            ids, weights = sums.rows()
            none = np.zeros(len(ids), np.int64)
            columns = [pa.array(ids), pa.nulls(len(ids), doc_type), _as_lists(none, np.zeros(0, np.int32)),
                       _as_lists(none, np.zeros(0)), weights]
            yield pa.RecordBatch.from_arrays(columns, [*names, "weights"])

    return run


def _stepped(factors, alpha: float):
    """Weights of documents and terms after a step; ``factors`` is a broadcast array of topics by terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_terms = factors.value
        k, size = of_terms.shape
        sums = _Sums(size, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, terms = _lists(batch["terms"])
            values = _lists(batch["amounts"])[1]
            before = _lists(batch["weights"])[1].reshape(-1, k) + (alpha - 1)
            after = np.empty_like(before)
            for docs, entries in _chunks(lengths, k):
                shares = of_terms[:, terms[entries]]
                shares *= np.repeat(before[docs].T, lengths[docs], axis=1)
                shares *= values[entries] / shares.sum(axis=0)
                after[docs] = sums.add(lengths[docs], terms[entries], shares)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], _as_lists(np.full(len(lengths), k), after.ravel())], ["id", "weights"]
            )
        ids, weights = sums.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids), weights], ["id", "weights"])

    return run


def entries_of(features: str) -> list[Column]:
    """Term ids and amounts of a vector that is read as its struct."""
    amounts = F.col(f"{features}.values")
    return [
        F.coalesce(F.col(f"{features}.indices"), F.transform(amounts, lambda v, i: i)).alias("terms"),
        amounts.alias("amounts"),
    ]


def numbered_start(documents: DataFrame, size: int, k: int, seed: int, partitions: int) -> DataFrame:
    """``(id, doc_id, terms, amounts, weights)`` of ``(doc_id, terms, amounts)``, written: documents by number, and terms as ``-1 - term_id``.

    Entries without amount leave; documents without any have no weights. A term has a row per partition that met it.
    """
    placed = documents.repartition(partitions, "doc_id").sortWithinPartitions("doc_id")
    rows = placed.select(F.monotonically_increasing_id().alias("id"), "doc_id", "terms", "amounts")
    lists = T._parse_datatype_string("terms array<int>, amounts array<double>, weights array<double>")
    schema = T.StructType([T.StructField("id", T.LongType()), documents.schema["doc_id"], *lists.fields])
    return materialize(rows.mapInArrow(_started(size, k, seed), schema), "fit-input")


def _term_sums(vertices: DataFrame, k: int) -> DataFrame:
    """``(id, weights)``: one row per term of those that the tasks made."""
    parts = [F.sum(F.get("weights", F.lit(j))).alias(f"w{j}") for j in range(k)]
    summed = vertices.where("id < 0").groupBy("id").agg(*parts)
    return summed.select("id", F.array(*[f"w{j}" for j in range(k)]).alias("weights"))


def maximised(start: DataFrame, size: int, k: int, max_iter: int, partitions: int) -> tuple[DataFrame, np.ndarray]:
    """``(id, weights)`` of documents and terms after ``max_iter`` steps, and the sums of the terms' weights by topic.

    The entries are dealt once, by document number, and kept with the executors, on their disks where memory is
    short; weights are dealt to them. The weights of the terms, ``size`` by ``k`` numbers, are the model and pass the driver.
    """
    spark = start.sparkSession
    entries = start.where("id >= 0 AND weights IS NOT NULL").select("id", "terms", "amounts")
    entries = entries.repartition(partitions, "id").persist(StorageLevel.MEMORY_AND_DISK)
    vertices = start.where("weights IS NOT NULL").select("id", "weights")
    alpha = 50 / k + 1
    entries.count()  # once they are kept, the planner knows how they are dealt, and does not deal them again
    try:
        for _ in range(max_iter):
            found = _term_sums(vertices, k).toPandas()
            of_terms = np.zeros((k, size))
            if len(found):
                of_terms[:, -1 - found["id"].to_numpy()] = np.stack(found["weights"].to_numpy()).T
            totals = of_terms.sum(axis=1, keepdims=True)
            factors = spark.sparkContext.broadcast((of_terms + (ETA - 1)) / (totals + (ETA - 1) * size))
            weighed = entries.join(vertices.where("id >= 0").hint("shuffle_hash"), "id")
            step = weighed.select("id", "terms", "amounts", "weights").mapInArrow(_stepped(factors, alpha), _WEIGHTS)
            vertices = materialize(step, "fit-step")
            factors.destroy()
    finally:
        entries.unpersist()
    ended = materialize(vertices.where("id >= 0").unionByName(_term_sums(vertices, k)), "fit-end")
    sums = ended.where("id < 0").agg(*[F.sum(F.get("weights", F.lit(j))) for j in range(k)]).head()
    return ended, np.array([s or 0.0 for s in sums])
