"""Dictionary, TF-IDF weights, vectors and top words of documents.

Weights come in two forms. The long form ``(doc_id, term, weight)`` is made of
joins and aggregates. Vectors have one row per document; while the vocabulary is
small enough for a model to hold it, they are made where the documents are, and
nothing is shuffled.
"""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.functions.text import let
from lexicarta.functions.vectors import stored_entries, vector_indices
from lexicarta.operators.ids import contiguous_index
from lexicarta.operators.vocabulary import (
    MAX_MODEL_TERMS,
    MIN_DOC_FREQUENCY,
    counting_model,
    document_term_counts,
    document_words,
    inverse_document_frequency,
    term_codes,
    term_statistics,
    vocabulary_words,
)
from lexicarta.session import materialize

TOP = 101  # fixed value: words reported per document and per topic

#: Parts in which a group is ranked when more rows are asked for than Spark limits before a shuffle.
SALTS = 32

_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
_TOP_TYPE = "array<struct<term:string,weight:double>>"


def dictionary(statistics: DataFrame) -> DataFrame:
    """Terms numbered by falling count in the documents, ties by term."""
    ranked = statistics.withColumn("_rank", -F.col("doc_occurrences"))
    return (
        contiguous_index(ranked, ["_rank", "term"], "term_id")
        .withColumn("term_id", F.col("term_id").cast("int"))
        .drop("_rank")
    )


def tfidf(counts: DataFrame, statistics: DataFrame) -> DataFrame:
    """``(doc_id, term, cnt, weight)`` with weight = count x idf."""
    return counts.join(statistics.select("term", "idf"), "term").select(
        "doc_id", "term", "cnt", (F.col("cnt") * F.col("idf")).alias("weight")
    )


def count_vectors(docs: DataFrame, model: CountVectorizerModel, clean_docs: bool = False) -> DataFrame:
    words = document_words(F.col("text"), clean_docs)
    return model.transform(docs.select("doc_id", words.alias("words"))).select("doc_id", "tf")


def tfidf_vectors(docs: DataFrame, model: CountVectorizerModel) -> DataFrame:
    """``(doc_id, tf, tfidf)`` with the feature transformers of ``pyspark.ml``."""
    counted = materialize(count_vectors(docs, model), "count-vectors")
    idf = IDF(minDocFreq=MIN_DOC_FREQUENCY, inputCol="tf", outputCol="tfidf").fit(counted)
    return idf.transform(counted)


def indexed_values(df: DataFrame, index: str, *values: str) -> Column:
    """Columns of a small table as an array of structs, at the positions of ``index``."""
    rows = F.sort_array(F.collect_list(F.struct(index, *values)))
    return df.agg(
        F.transform(rows, lambda r: F.struct(*[r[v].alias(v) for v in values]))
    ).scalar()


def document_features(
    docs: DataFrame,
    vocab: DataFrame,
    clean_docs: bool = False,
    min_doc_frequency: int = MIN_DOC_FREQUENCY,
    max_model_terms: int = MAX_MODEL_TERMS,
) -> tuple[DataFrame, DataFrame]:
    """``vectors(doc_id, entries)`` and the dictionary they are numbered by.

    Entries are ``(term_id, weight)`` sorted by term id. A vocabulary of more than
    ``max_model_terms`` terms, which only a threshold far below the default gives, is
    joined instead, and the entries are regrouped by document; so is an empty one.
    """
    n_terms = vocab.count()
    if not 0 < n_terms <= max_model_terms:
        return _joined_features(docs, vocab, clean_docs, min_doc_frequency)
    model = counting_model(vocab, n_terms)
    counted = stored_entries(count_vectors(docs, model, clean_docs), "doc_id", "tf")
    coded = term_codes(vocab, model)
    n_docs = counted.agg(F.count("*")).scalar()
    idf = inverse_document_frequency(F.col("doc_frequency"), n_docs, min_doc_frequency)
    statistics = (
        counted.select(F.inline("entries"))
        .groupBy("code")
        .agg(
            F.sum("value").cast("bigint").alias("doc_occurrences"),
            F.count("*").alias("doc_frequency"),
        )
        .withColumn("idf", idf)
        .join(coded, "code")
    )
    terms = dictionary(statistics)  # its numbering is written already
    numbered = coded.join(terms.select("code", "term_id", "idf"), "code", "left")
    by_code = indexed_values(numbered, "code", "term_id", "idf")
    weighted = F.transform(
        "entries",
        lambda e: F.struct(
            F.get("by_code", e["code"])["term_id"].alias("term_id"),
            (e["value"] * F.get("by_code", e["code"])["idf"]).alias("weight"),
        ),
    )
    vectors = counted.withColumn("by_code", by_code).select(
        "doc_id", F.sort_array(weighted).alias("entries")
    )
    return vectors, terms.drop("code")


def _joined_features(docs, vocab, clean_docs, min_doc_frequency) -> tuple[DataFrame, DataFrame]:
    counts = document_term_counts(docs, vocab, clean_docs, min_token=0, max_model_terms=0)
    counts = materialize(counts, "counts")
    statistics = term_statistics(counts, docs, min_doc_frequency)
    terms = materialize(dictionary(statistics), "dictionary")
    entry = F.struct("term_id", (F.col("cnt") * F.col("idf")).alias("weight"))
    every = docs.select("doc_id", F.lit(None).cast("struct<term_id:int,weight:double>").alias("e"))
    vectors = (
        counts.join(terms.select("term", "term_id", "idf"), "term")
        .select("doc_id", entry.alias("e"))
        .unionByName(every)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list("e")).alias("entries"))
    )
    return vectors, terms


def _ranked_up_to(df: DataFrame, groups: list, order: list, n: int) -> DataFrame:
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def _weight_step(weight: Column) -> Column:
    """A whole number that never falls as the weight rises: eighths of its binary logarithm."""
    size = F.floor(F.least(F.log2(F.abs(weight)), F.lit(2000.0)) * 8).cast("int") + 10_000  # above zero for any double
    return (
        F.when(weight.isNull(), -(1 << 20))
        .when(F.isnan(weight), 1 << 20)
        .when(weight > 0, size)
        .when(weight < 0, -size)
        .otherwise(0)
    )


def heavy_enough(df: DataFrame, group: str, weight: str, n: int) -> DataFrame:
    """The rows that can be among the ``n`` of most weight in their group.

    Weights are counted in steps, which tasks add up before anything is shuffled; in each group the lowest step
    that the first ``n`` reach is found, and rows below it leave where they are.
    """
    stepped = df.withColumn("_step", _weight_step(F.col(weight).cast("double")))
    counts = stepped.groupBy(group, "_step").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(group).orderBy(F.col("_step").desc())  # the steps of a group: some thousands at most
    before = F.sum("_n").over(above.rowsBetween(Window.unboundedPreceding, -1))
    least = (
        counts.withColumn("_before", F.coalesce(before, F.lit(0)))
        .where(F.col("_before") < n)
        .groupBy(F.col(group).alias("_group"))
        .agg(F.min("_step").alias("_least"))
    )
    met = stepped.join(least, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_step") >= F.col("_least")))
    return met.select(*df.columns)


def top_per_group(df: DataFrame, group: str, weight: str, ties: str, n: int, salts: int = SALTS) -> DataFrame:
    """First ``n`` rows of each group by falling weight, with their ``rank``.

    Up to a number that the session sets, Spark keeps the first ``n`` per group of every task
    before the shuffle. Beyond it, rows too light for the first ``n`` leave by their weight (:func:`heavy_enough`);
    the rest, which may be many of equal weight, are ranked in ``salts`` parts of each group, and the
    first ``n`` of each part together. So a group of any size is ranked by several tasks, and the session's
    settings stay as they are.
    """
    order = [F.col(weight).desc(), F.col(ties)]
    if n > int(df.sparkSession.conf.get(_GROUP_LIMIT)):
        salted = heavy_enough(df, group, weight, n).withColumn("_salt", F.expr(f"pmod(xxhash64(`{ties}`), {salts})"))
        df = _ranked_up_to(salted, [group, "_salt"], order, n).drop("_salt", "rank")
    return _ranked_up_to(df, [group], order, n)


def top_terms(weights: DataFrame, n: int = TOP, ties: str = "term") -> DataFrame:
    """Words that describe each document: non-zero weights, highest first."""
    return top_per_group(weights.where("weight > 0"), "doc_id", "weight", ties, n)


def top_term_lists(
    vectors: DataFrame,
    terms: DataFrame,
    n: int = TOP,
    ties: str = "term",
    digits: int | None = None,
    max_model_terms: int = MAX_MODEL_TERMS,
) -> DataFrame:
    """``(doc_id, top array<struct<term, weight>>)``, empty for documents without weights.

    Each list is made in the row of its vector when the dictionary is small, and
    joined and regrouped otherwise. ``digits`` rounds weights before the ranking.
    """

    def weighed(e: Column) -> Column:
        weight = e["weight"] if digits is None else F.round(e["weight"], digits)
        return F.struct(e["term_id"].alias("term_id"), weight.alias("weight"))

    heavy = F.transform(F.filter("entries", lambda e: e["weight"] > 0), weighed)
    if terms.count() > max_model_terms:
        return _joined_top_lists(vectors.select("doc_id", heavy.alias("entries")), terms, n, ties)

    def name(term_id: Column) -> Column:
        return F.get("names", term_id)["term"]

    by_term = ties == "term"
    ranked = F.transform(
        heavy,
        lambda e: F.struct(
            (-e["weight"]).alias("order"),
            (name(e["term_id"]) if by_term else e["term_id"]).alias("tie"),
        ),
    )
    shown = F.transform(
        F.slice(F.sort_array(ranked), 1, n),
        lambda r: F.struct(r["tie"] if by_term else name(r["tie"]), -r["order"]),
    ).cast(_TOP_TYPE)
    return vectors.withColumn("names", indexed_values(terms, "term_id", "term")).select(
        "doc_id", shown.alias("top")
    )


def _joined_top_lists(vectors: DataFrame, terms: DataFrame, n: int, ties: str) -> DataFrame:
    named = vectors.select("doc_id", F.inline("entries")).join(
        terms.select("term_id", "term"), "term_id"
    )
    rows = F.sort_array(F.collect_list(F.struct("rank", "term", "weight")))
    shown = F.transform(rows, lambda r: F.struct(r["term"], r["weight"])).cast(_TOP_TYPE)
    lists = top_terms(named, n, ties).groupBy("doc_id").agg(shown.alias("top"))
    return vectors.select("doc_id").join(lists, "doc_id", "left").select(
        "doc_id", F.coalesce("top", F.array().cast(_TOP_TYPE)).alias("top")
    )


def member_words(
    docs: DataFrame, vocab: DataFrame, clean_docs: bool = False, max_model_terms: int = MAX_MODEL_TERMS
) -> DataFrame:
    """``(doc_id, words)``: vocabulary members in text order, repeats kept.

    A count model finds the members in the row of their document, so nothing is shuffled. The words
    are then filtered in their order. Members are dealt by hash into about as many lists as the square root
    of the number of words, so that a word is compared with few of them. A vocabulary
    beyond ``max_model_terms``, and an empty one, is joined instead, with the same result.
    """
    n_terms = vocab.count()
    if not 0 < n_terms <= max_model_terms:
        return vocabulary_words(docs, vocab, clean_docs)
    model = counting_model(vocab, n_terms)
    named = indexed_values(term_codes(vocab, model), "code", "term")
    words = document_words(F.col("text"), clean_docs)
    counted = model.transform(docs.select("doc_id", words.alias("words")))
    lists = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("words")))).cast("int")
    met = vector_indices(counted, ["doc_id", "words"], "tf").withColumn("names", named).select(
        "doc_id",
        "words",
        lists.alias("lists"),
        F.transform("indices", lambda i: F.get("names", i)["term"]).alias("members"),
    )

    def dealt(word: Column) -> Column:
        return F.pmod(F.hash(word), F.col("lists"))

    by_hash = F.transform(
        F.sequence(F.lit(0), F.col("lists") - 1), lambda b: F.filter("members", lambda m: dealt(m) == b)
    )
    # An argument, since a column would be put into the filter and the members dealt again for each word.
    own = let(by_hash, lambda dealt_lists: F.filter("words", lambda w: F.array_contains(F.get(dealt_lists, dealt(w)), w)))
    return met.select("doc_id", own.alias("words"))


def filled_with_unused(lists: DataFrame, terms: DataFrame, n: int = TOP) -> DataFrame:
    """Lists of ``n`` words: unused ones of weight zero follow in dictionary order.

    The compatible form. A list that needs filling has fewer than ``n`` words,
    so the first ``2 n`` of the dictionary are enough to fill from.
    """
    first = indexed_values(terms.where(F.col("term_id") < 2 * n), "term_id", "term")
    names = F.transform("first", lambda t: t["term"])
    unused = F.array_except(names, F.transform("top", lambda t: t["term"]))
    padding = F.transform(unused, lambda term: F.struct(term, F.lit(0.0))).cast(_TOP_TYPE)
    return lists.withColumn("first", first).select(
        "doc_id", F.slice(F.concat("top", padding), 1, n).alias("top")
    )
