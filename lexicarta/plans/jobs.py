"""The three jobs: abstracts out of record files, features, and topics.

Each reads and writes folders of text lines, so it can be run alone, on the
output of the one before or on lines of another origin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.functions.vectors import stored_vectors
from lexicarta.operators.batches import add_batch, batch_documents, merged_features, weight_vectors
from lexicarta.operators.categories import category_documents
from lexicarta.operators.features import (
    TOP,
    document_features,
    filled_with_unused,
    top_term_lists,
)
from lexicarta.operators.ids import contiguous_index, label_ranges
from lexicarta.operators.labels import label_by_range
from lexicarta.operators.records import (
    LAYOUTS,
    extract_records,
    strip_stop_words,
    strip_stop_words_by_join,
)
from lexicarta.operators.topics import (
    TOP_DOCUMENTS,
    TOPICS,
    document_topics,
    documents_by_topic,
    dominant_topic,
    fit_topics,
    ranked_terms,
    topic_terms,
    topic_top_documents,
    topic_top_terms,
    topic_weights,
    training_fit,
    training_mixtures,
    training_term_weights,
    with_weightless_terms,
)
from lexicarta.operators.vocabulary import MIN_DOC_FREQUENCY, MIN_SHARE, MIN_TOKEN, vocabulary
from lexicarta.session import job_scratch, materialize
from lexicarta.sources import writers as W
from lexicarta.sources.readers import (
    category_of,
    listed_files,
    read_dictionary,
    read_documents,
    read_label_ranges,
    read_lines,
    read_vectors,
    stop_words,
)

#: Stop words up to which a list is part of the plan; a longer one is joined, with the same results.
MAX_LISTED_STOP_WORDS = 10_000
RECORD_KEYS = ["is_train", "file", "block", "record"]


def _records(spark, path, layout, is_train, compat) -> DataFrame:
    records = extract_records(
        read_lines(spark, path),
        layout,
        joiner="" if compat else " ",
        keep_unclosed=not compat,
    )
    return records.withColumn("is_train", F.lit(is_train))


def _stripped(records: DataFrame, stopwords: DataFrame, compat: bool) -> DataFrame:
    joiner = "" if compat else " "
    listed = stopwords.take(MAX_LISTED_STOP_WORDS + 1)
    if len(listed) > MAX_LISTED_STOP_WORDS:
        return strip_stop_words_by_join(records, RECORD_KEYS, stopwords, joiner)
    words = [row["term"] for row in listed]
    return records.withColumn("text", strip_stop_words(F.col("text"), words, joiner))


def numbered_documents(records: DataFrame) -> DataFrame:
    """``docs(doc_id, is_train, category, text)``: source documents first, then training.

    Only the record keys are placed in order; the texts join their ids by key.
    """
    ids = contiguous_index(records.select(*RECORD_KEYS), RECORD_KEYS, "doc_id")
    return records.join(ids, RECORD_KEYS).select(
        "doc_id", "is_train", category_of(F.col("file")).alias("category"), "text"
    )


def extract(
    spark: SparkSession,
    out: str,
    layout: str,
    source: str | None = None,
    train: str | None = None,
    stop_words_path: str | None = None,
    compat: bool = False,
) -> None:
    """Record files to ``documents``, ``train_documents``, ``category_documents``, ``label_ranges``."""
    rules = LAYOUTS[layout]
    with job_scratch(spark, "extract"):
        parts = [
            _records(spark, path, rules, is_train, compat)
            for path, is_train in ((source, False), (train, True))
            if path
        ]
        if not parts:
            raise ValueError("give a source folder, a training folder, or both")
        records = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if rules.strips_stop_words:
            records = _stripped(records, stop_words(spark, stop_words_path), compat)
        docs = materialize(numbered_documents(materialize(records, "records")), "documents")
        training = docs.where("is_train")
        W.write_lines(W.document_lines(docs), f"{out}/documents")
        W.write_lines(W.document_lines(training), f"{out}/train_documents")
        categories = category_documents(training, "" if compat else " ")
        if compat:
            categories = categories.select("first_id", "text").unionByName(_source_headings(docs))
        W.write_lines(W.category_lines(categories, compat), f"{out}/category_documents")
        files = listed_files(spark, train) if train else None
        n_source = docs.where("NOT is_train").count()
        ranges = label_ranges(training, compat, files, n_source)
        W.write_lines(W.label_range_lines(ranges), f"{out}/label_ranges")


def _source_headings(docs: DataFrame) -> DataFrame:
    """An empty category line for each source file."""
    first = docs.where(~F.col("is_train")).groupBy("category").agg(F.min("doc_id").alias("first_id"))
    return first.select("first_id", F.lit("").alias("text"))


def features(
    spark: SparkSession,
    out: str,
    documents: str,
    label_ranges_path: str | None = None,
    stop_words_path: str | None = None,
    min_share: float = MIN_SHARE,
    threshold_by: str = "occurrences",
    clean_docs: bool = False,
    min_token: int = MIN_TOKEN,
    min_doc_frequency: int = MIN_DOC_FREQUENCY,
    top: int = TOP,
    compat: bool = False,
) -> None:
    """Document lines to ``vectors``, ``dictionary``, ``document_terms``.

    ``vectors`` holds every document. With label ranges, ``train_vectors`` and
    ``test_vectors`` are those within and below the ranges. The compatible form writes
    ``vectors`` alone, each without its highest term id, and fills the words of a
    document up with unused ones.
    """
    with job_scratch(spark, "features"):
        docs = materialize(read_documents(spark, documents), "documents")
        stopwords = stop_words(spark, stop_words_path)
        vocab = materialize(
            vocabulary(docs, stopwords, min_share, threshold_by, min_token), "vocabulary"
        )
        vectors, terms = document_features(docs, vocab, clean_docs, min_doc_frequency)
        vectors = materialize(vectors, "vectors")
        W.write_lines(W.vector_lines(vectors, drop_last=compat), f"{out}/vectors")
        if label_ranges_path and not compat:
            labelled = label_by_range(vectors, read_label_ranges(spark, label_ranges_path))
            tests, training = labelled.where("split = 'test'"), labelled.where("split = 'train'")
            W.write_lines(W.vector_lines(tests), f"{out}/test_vectors")
            W.write_lines(W.vector_lines(training, head="label"), f"{out}/train_vectors")
        W.write_lines(W.dictionary_lines(terms), f"{out}/dictionary")
        ties = "term_id" if compat else "term"
        lists = top_term_lists(vectors, terms, top, ties)
        if compat:
            lists = filled_with_unused(lists, terms, top)
        W.write_lines(W.document_term_lines(lists), f"{out}/document_terms")


def topics(
    spark: SparkSession,
    out: str,
    vectors: str,
    dictionary_path: str,
    k: int = TOPICS,
    top: int = TOP,
    top_documents: int = TOP_DOCUMENTS,
    max_iter: int = 20,
    seed: int = 17,
    optimizer: str = "em",
    mixtures: str = "training",
    compat: bool = False,
) -> None:
    """Vector lines and dictionary to the four topic reports below ``out``.

    Reports are of the mixtures that the fit by expectation maximisation ends with. With
    ``mixtures="inferred"``, and always for another optimizer, which keeps none,
    the documents' mixtures are inferred from the fitted topics.
    """
    if mixtures not in ("training", "inferred"):
        raise ValueError(f"unknown mixtures {mixtures!r}")
    with job_scratch(spark, "topics"):
        words = materialize(read_dictionary(spark, dictionary_path), "dictionary")
        n_terms = words.count()
        corpus = stored_vectors(read_vectors(spark, vectors), n_terms)
        if not n_terms or corpus.isEmpty():
            raise ValueError("topics need documents and a dictionary that is not empty")
        if mixtures == "training" and optimizer == "em":
            fit = training_fit(corpus, k=k, max_iter=max_iter, seed=seed)
            mixed, described = training_mixtures(fit), ranked_terms(training_term_weights(fit), words)
        else:
            model = fit_topics(corpus, k=k, max_iter=max_iter, seed=seed, optimizer=optimizer)
            mixed, described = document_topics(model, corpus), topic_terms(model, words)
        mixed = materialize(mixed, "mixtures")
        assigned = mixed.select("doc_id", dominant_topic(F.col("mixture"), compat).alias("topic"))
        described = materialize(described, "topic-terms")
        W.write_lines(
            W.topic_document_lines(documents_by_topic(assigned), k), f"{out}/topic_documents"
        )
        ranked = with_weightless_terms(described, words, k) if compat else described
        W.write_lines(W.topic_word_lines(topic_top_terms(ranked, top)), f"{out}/topic_words")
        W.write_lines(
            W.topic_top_document_lines(topic_top_documents(topic_weights(mixed), top_documents)),
            f"{out}/topic_top_documents",
        )
        W.write_lines(W.topic_description_lines(described), f"{out}/topic_descriptions")


def append(
    spark: SparkSession,
    store: str,
    layout: str,
    source: str,
    stop_words_path: str | None = None,
    min_token: int = MIN_TOKEN,
    clean_docs: bool = False,
    compat: bool = False,
) -> None:
    """A folder of record files as the next batch of ``store``; ids go on, earlier texts are not read."""
    rules = LAYOUTS[layout]
    with job_scratch(spark, "append"):
        records = _records(spark, source, rules, False, compat)
        if rules.strips_stop_words:
            records = _stripped(records, stop_words(spark, stop_words_path), compat)
        records = materialize(records.drop("is_train"), "records")
        add_batch(records, store, ["file", "block", "record"], min_token, clean_docs)


def merge(
    spark: SparkSession,
    store: str,
    out: str,
    stop_words_path: str | None = None,
    min_share: float = MIN_SHARE,
    threshold_by: str = "occurrences",
    min_doc_frequency: int = MIN_DOC_FREQUENCY,
) -> None:
    """``documents``, ``vectors`` and ``dictionary`` of all batches, as one run over all of them writes."""
    with job_scratch(spark, "merge"):
        docs = batch_documents(spark, store)
        weights, terms = merged_features(
            spark, store, stop_words(spark, stop_words_path), min_share, threshold_by, min_doc_frequency
        )
        W.write_lines(W.document_lines(docs), f"{out}/documents")
        W.write_lines(W.vector_lines(weight_vectors(weights, terms, docs)), f"{out}/vectors")
        W.write_lines(W.dictionary_lines(terms), f"{out}/dictionary")


def run(
    spark: SparkSession,
    out: str,
    layout: str,
    source: str | None = None,
    train: str | None = None,
    stop_words_path: str | None = None,
    compat: bool = False,
    feature_options: dict | None = None,
    topic_options: dict | None = None,
) -> None:
    """The three jobs one after the other, all output below ``out``."""
    extract(spark, out, layout, source, train, stop_words_path, compat)
    features(
        spark,
        out,
        f"{out}/documents",
        f"{out}/label_ranges" if train else None,
        stop_words_path,
        compat=compat,
        **(feature_options or {}),
    )
    topics(
        spark, out, f"{out}/vectors", f"{out}/dictionary", compat=compat, **(topic_options or {})
    )
