"""``pyspark.ml`` vectors from and to plain arrays, without Python workers.

SQL has no cast between the vector type and the struct it is made of, but
Parquet stores a vector as that struct, so a written column can be read as
either.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicarta.session import materialize

_PARTS = "struct<indices:array<int>,values:array<double>>"


def stored_entries(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, entries array<struct<code, value>>)`` of sparse vectors, written once."""
    key_type = vectors.schema[key].dataType.simpleString()
    stored = materialize(
        vectors.select(key, vector), "entries", f"{key} {key_type}, {vector} {_PARTS}"
    )
    pairs = F.arrays_zip(f"{vector}.indices", f"{vector}.values")
    return stored.select(key, pairs.cast("array<struct<code:int,value:double>>").alias("entries"))


def vector_indices(vectors: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """``(keep..., indices array<int>)`` of sparse vectors, written once."""
    kept = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keep)
    stored = materialize(vectors.select(*keep, vector), "indices", f"{kept}, {vector} {_PARTS}")
    return stored.select(*keep, F.col(f"{vector}.indices").alias("indices"))


def stored_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """``(doc_id, features)`` sparse vectors of ``(doc_id, entries)``, written once.

    Entries are ``(term_id, weight)`` sorted by term id.
    """
    features = F.struct(
        F.lit(0).cast("tinyint").alias("type"),  # sparse
        F.lit(size).alias("size"),
        F.transform("entries", lambda e: e["term_id"]).alias("indices"),
        F.transform("entries", lambda e: e["weight"]).alias("values"),
    )
    schema = T.StructType(
        [vectors.schema["doc_id"], T.StructField("features", VectorUDT())]
    )
    return materialize(vectors.select("doc_id", features.alias("features")), "vectors", schema)
