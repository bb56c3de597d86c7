"""Every operator as a query over the given tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import LDAModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexicarta.functions.text import clean_text, split_words
from lexicarta.functions.vectors import stored_entries, stored_vectors
from lexicarta.operators import batches as B
from lexicarta.operators import features as X
from lexicarta.operators import topics as M
from lexicarta.operators import vocabulary as V
from lexicarta.operators.categories import category_documents
from lexicarta.operators.ids import contiguous_index, label_ranges
from lexicarta.operators.labels import label_by_range
from lexicarta.operators.records import (
    ARTICLE,
    PATENT,
    RecordLayout,
    extract_records,
    strip_stop_words,
)
from lexicarta.session import materialize, scratch_path
from lexicarta.sources import writers as W
from lexicarta.sources.readers import (
    default_stop_words,
    read_dictionary,
    read_documents,
    read_label_ranges,
    read_lines,
    read_vectors,
    stop_words,
)
from lexicarta.sources.tables import documents, table, tagged_lines

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
TOTAL_DIGITS = 3  # of sums of weights
GIVEN_TOPICS = 64  # width of the given matrix
CHUNK_CHARS = 50_000  # small, so that the test tables have categories of several chunks


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Weights to six digits: engines may differ in the last bit of a logarithm."""
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def _written(lines: DataFrame, label: str) -> str:
    path = scratch_path(lines.sparkSession, label)
    W.write_lines(lines, path)
    return path


# --- record files -----------------------------------------------------------


def _tagged(spark: SparkSession, folder: str, layout: RecordLayout) -> DataFrame:
    return tagged_lines(table(spark, folder, "documents").select("doc_id", "source", "text"), layout)


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged lines written as one folder of text files per source, and read back."""
    path = scratch_path(spark, "record-files")
    lines = _tagged(spark, folder, ARTICLE)
    (
        lines.repartitionByRange("file", F.col("pos.doc_id"))
        .sortWithinPartitions("file", "pos")
        .select("file", F.col("line").alias("value"))
        .write.partitionBy("file")
        .text(path)
    )
    source = F.regexp_extract(F.col("file"), "file=([^/]+)/", 1)
    return read_lines(spark, path).select(source.alias("source"), "line")


def _records(layout: RecordLayout, compat: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return extract_records(
            _tagged(spark, folder, layout),
            layout,
            joiner="" if compat else " ",
            keep_unclosed=not compat,
        ).select(F.col("file").alias("source"), "text")

    return query


def _stripped(compat: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        text = strip_stop_words(F.col("text"), default_stop_words(), "" if compat else " ")
        return _records(ARTICLE, compat)(spark, folder).withColumn("text", text)

    return query


# --- documents, ids, categories ---------------------------------------------


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines written and read back."""
    return read_documents(spark, _written(W.document_lines(documents(spark, folder)), "documents"))


def doc_ids(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "documents").select("source", "doc_id")
    return contiguous_index(keys, ["source", "doc_id"], "new_id")


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    """``(old_id, is_train, category, text)``: labelled documents are the training set."""
    docs = documents(spark, folder).withColumnRenamed("doc_id", "old_id")
    labelled = table(spark, folder, "labels").select(
        F.col("doc_id").alias("old_id"), F.lit(True).alias("is_train")
    ).distinct()
    return docs.join(labelled, "old_id", "left").withColumn("is_train", F.coalesce("is_train", F.lit(False)))


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """The same with ``doc_id``, contiguous over the source documents and then the training set."""
    flagged = _flagged(spark, folder)
    docs = documents(spark, folder).withColumnRenamed("doc_id", "old_id")
    ids = contiguous_index(
        flagged.select("is_train", "category", "old_id"), ["is_train", "category", "old_id"], "doc_id"
    )
    return docs.drop("category").join(ids, "old_id")


def _ranges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = materialize(_numbered(spark, folder), "numbered")
    return docs, label_ranges(docs.where("is_train"))


def ranges_read_back(spark: SparkSession, folder: str) -> DataFrame:
    _, ranges = _ranges(spark, folder)
    return read_label_ranges(spark, _written(W.label_range_lines(ranges), "label-ranges"))


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs, ranges = _ranges(spark, folder)
    found = label_by_range(docs.select("doc_id", "old_id"), materialize(ranges, "label-ranges"))
    return found.select("doc_id", "old_id", "label", "category")


def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    docs, ranges = _ranges(spark, folder)
    found = label_by_range(docs.select("doc_id"), materialize(ranges, "label-ranges"))
    return found.groupBy("split", "label").agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


def category_docs(spark: SparkSession, folder: str) -> DataFrame:
    return category_documents(documents(spark, folder), chunk_chars=CHUNK_CHARS)


# --- tokens and vocabulary --------------------------------------------------


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return V.cleaned(documents(spark, folder))


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return V.tokens(documents(spark, folder))


def tokens_no_stop(spark: SparkSession, folder: str) -> DataFrame:
    return V.without_stop_words(tokens(spark, folder), stop_words(spark)).select("doc_id", "word_no", "term")


def tokens_min_len(spark: SparkSession, folder: str) -> DataFrame:
    return V.long_enough(tokens_no_stop(spark, folder))


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return V.term_counts(documents(spark, folder), stop_words(spark))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return V.vocabulary(documents(spark, folder), stop_words(spark))


def vocabulary_by_documents(spark: SparkSession, folder: str) -> DataFrame:
    by_documents = V.vocabulary(documents(spark, folder), stop_words(spark), by="documents")
    return by_documents.withColumnRenamed("cnt", "n_docs")


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(vocabulary(spark, folder), "vocabulary")


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return V.corpus_statistics(documents(spark, folder), vocabulary(spark, folder))


def doc_words(spark: SparkSession, folder: str) -> DataFrame:
    words = X.member_words(documents(spark, folder), _vocabulary(spark, folder))
    return words.select("doc_id", F.array_join("words", " ").alias("words"))


def doc_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return V.document_term_counts(documents(spark, folder), _vocabulary(spark, folder))


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    return V.term_statistics(doc_term_counts(spark, folder), documents(spark, folder))


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(spark, folder).select("term", "doc_frequency")


# --- batches ------------------------------------------------------------------


def _batched(spark: SparkSession, folder: str) -> str:
    """A store of two batches: documents without a label, then those with one."""
    store = scratch_path(spark, "store")
    docs = materialize(_flagged(spark, folder), "flagged", partition_by="is_train")  # each batch reads its rows alone
    for is_train in (False, True):
        batch = docs.where(F.col("is_train") == is_train).select("category", "old_id", "text")
        B.add_batch(batch, store, ["category", "old_id"])
    return store


def batched_ids(spark: SparkSession, folder: str) -> DataFrame:
    return B.batch_documents(spark, _batched(spark, folder)).select("doc_id", "old_id", "category")


def batched_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return B.merged_vocabulary(spark, _batched(spark, folder), stop_words(spark))


def batched_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    _, terms = B.merged_features(spark, _batched(spark, folder), stop_words(spark))
    return terms.select("term", "term_id")


def batched_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """The weights of all batches, by the documents' own ids."""
    store = _batched(spark, folder)
    weights, _ = B.merged_features(spark, store, stop_words(spark))
    own = B.batch_documents(spark, store).select("doc_id", "old_id")
    named = weights.join(own, "doc_id").select(F.col("old_id").alias("doc_id"), "term", "cnt", "weight")
    return rounded(named, "weight")


# --- features ---------------------------------------------------------------


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary written as lines and read back."""
    lines = export_dictionary(spark, folder)
    return read_dictionary(spark, _written(lines, "dictionary"))


def idf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_statistics(spark, folder).select("term", "idf"), "idf")


def _tfidf(spark: SparkSession, folder: str, clean_docs: bool) -> DataFrame:
    docs, vocab = documents(spark, folder), _vocabulary(spark, folder)
    counts = materialize(V.document_term_counts(docs, vocab, clean_docs), "counts")
    statistics = materialize(V.term_statistics(counts, docs), "statistics")
    return rounded(X.tfidf(counts, statistics), "weight")


def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, clean_docs=False)


def tfidf_clean_docs(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, clean_docs=True)


def tfidf_ml(spark: SparkSession, folder: str) -> DataFrame:
    """The weights of the feature transformers, in long form."""
    vocab = _vocabulary(spark, folder)
    n_terms = vocab.count()
    if not n_terms:
        return spark.createDataFrame([], "doc_id bigint, term string, weight double")
    model = X.counting_model(vocab, n_terms)
    weighted = stored_entries(X.tfidf_vectors(documents(spark, folder), model), "doc_id", "tfidf")
    codes = X.term_codes(vocab, model)
    long = weighted.select("doc_id", F.inline("entries")).join(codes, "code")
    return rounded(long.select("doc_id", "term", F.col("value").alias("weight")), "weight")


def _features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return X.document_features(documents(spark, folder), _vocabulary(spark, folder))


def _ranked(lists: DataFrame) -> DataFrame:
    # Of an inner posexplode Spark would infer filters on the lists, and make each list again for each of them.
    exploded = lists.select("doc_id", F.posexplode_outer("top").alias("at", "t")).where("at IS NOT NULL")
    return exploded.select("doc_id", (F.col("at") + 1).alias("rank"), "t.term", "t.weight")


def doc_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    vectors, terms = _features(spark, folder)
    return _ranked(X.top_term_lists(vectors, terms, digits=DIGITS))


def doc_top_terms_filled(spark: SparkSession, folder: str) -> DataFrame:
    vectors, terms = _features(spark, folder)
    lists = X.top_term_lists(vectors, terms, ties="term_id", digits=DIGITS)
    return _ranked(X.filled_with_unused(lists, terms))


# --- text sinks -------------------------------------------------------------


def export_documents(spark: SparkSession, folder: str) -> DataFrame:
    return W.document_lines(_numbered(spark, folder))


def export_train_documents(spark: SparkSession, folder: str) -> DataFrame:
    return W.document_lines(_numbered(spark, folder).where("is_train"))


def export_category_docs(spark: SparkSession, folder: str) -> DataFrame:
    training = _numbered(spark, folder).where("is_train")
    return W.category_lines(category_documents(training, chunk_chars=CHUNK_CHARS))


def export_label_ranges(spark: SparkSession, folder: str) -> DataFrame:
    _, ranges = _ranges(spark, folder)
    return W.label_range_lines(ranges)


def export_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return W.dictionary_lines(X.dictionary(_statistics(spark, folder)))


def export_vector_lines(spark: SparkSession, folder: str) -> DataFrame:
    vectors, _ = _features(spark, folder)
    return W.vector_lines(vectors, digits=DIGITS)


def export_vector_lines_compat(spark: SparkSession, folder: str) -> DataFrame:
    vectors, _ = _features(spark, folder)
    return W.vector_lines(vectors, drop_last=True, digits=DIGITS)


def export_train_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs, ranges = _ranges(spark, folder)
    vocab = materialize(V.vocabulary(docs, stop_words(spark)), "vocabulary")
    vectors, _ = X.document_features(docs, vocab)
    labelled = label_by_range(vectors, materialize(ranges, "label-ranges"))
    return W.vector_lines(labelled.where("split = 'train'"), head="label", digits=DIGITS)


def export_document_terms(spark: SparkSession, folder: str) -> DataFrame:
    vectors, terms = _features(spark, folder)
    return W.document_term_lines(X.top_term_lists(vectors, terms, digits=DIGITS))


def vector_lines_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Vector lines with all digits written, read back, in long form."""
    vectors, _ = _features(spark, folder)
    parsed = read_vectors(spark, _written(W.vector_lines(vectors), "vectors"))
    return rounded(parsed.select("doc_id", F.inline("entries")), "weight")


def stopwords(spark: SparkSession, folder: str) -> DataFrame:
    """Stop words that occur in the documents, with their number of documents."""
    words = documents(spark, folder).select(
        F.explode(F.array_distinct(split_words(clean_text(F.col("text"))))).alias("term")
    )
    return words.groupBy("term").agg(F.count("*").alias("n_docs")).join(
        stop_words(spark), "term", "left_semi"
    )


# --- topics: reports on given mixtures --------------------------------------


def _given_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("mixture")
    )


def dominant_topic(spark: SparkSession, folder: str) -> DataFrame:
    return _given_mixtures(spark, folder).select(
        "doc_id", M.dominant_topic(F.col("mixture"), unassigned_as_first=True).alias("topic")
    )


def docs_by_topic(spark: SparkSession, folder: str) -> DataFrame:
    lists = M.documents_by_topic(dominant_topic(spark, folder))
    return lists.withColumn("doc_ids", F.array_join(F.col("doc_ids").cast("array<string>"), ","))


def topic_top_docs(spark: SparkSession, folder: str) -> DataFrame:
    weights = M.topic_weights(_given_mixtures(spark, folder))
    return rounded(M.topic_top_documents(rounded(weights, "weight")), "weight")


def export_topic_documents(spark: SparkSession, folder: str) -> DataFrame:
    return W.topic_document_lines(M.documents_by_topic(dominant_topic(spark, folder)), GIVEN_TOPICS)


def export_topic_top_documents(spark: SparkSession, folder: str) -> DataFrame:
    top = topic_top_docs(spark, folder)
    return W.topic_top_document_lines(
        top.withColumn("weight", F.format_string(f"%.{DIGITS}f", "weight"))
    )


# --- topics: reports on a given matrix of terms by topics ---------------------


def _given_terms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The terms of each topic, a vector's number taken for a term id, and the dictionary."""
    terms = materialize(X.dictionary(_statistics(spark, folder)).select("term", "term_id"), "dictionary")
    weights = rounded(M.topic_weights(_given_mixtures(spark, folder)), "weight")
    weights = weights.select("topic", F.col("doc_id").cast("int").alias("term_id"), "weight")
    return M.ranked_terms(weights, terms), terms


def topic_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _given_terms(spark, folder)[0]


def topic_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    return M.topic_top_terms(topic_terms(spark, folder))


def topic_top_terms_filled(spark: SparkSession, folder: str) -> DataFrame:
    given, terms = _given_terms(spark, folder)
    return M.topic_top_terms(M.with_weightless_terms(given, terms, GIVEN_TOPICS))


def export_topic_words(spark: SparkSession, folder: str) -> DataFrame:
    return W.topic_word_lines(topic_top_terms(spark, folder))


def export_topic_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    return W.topic_description_lines(topic_terms(spark, folder))


# --- topics: the fitted model -------------------------------------------------
# Rows that do not depend on how the fit turns out, so that they can be compared.

Fitted = tuple[LDAModel, DataFrame, DataFrame]


def fitted(spark: SparkSession, folder: str) -> Fitted:
    """Model, corpus and dictionary."""
    vectors, terms = _features(spark, folder)
    corpus = stored_vectors(vectors, terms.count())
    return M.fit_topics(corpus), corpus, terms


def _mixtures(spark: SparkSession, folder: str, found: Fitted | None) -> DataFrame:
    model, corpus, _ = found or fitted(spark, folder)
    return M.document_topics(model, corpus)


def lda_fit(spark: SparkSession, folder: str, found: Fitted | None = None) -> DataFrame:
    """Per topic: its number of terms, the sum of their weights, which is one, and whether weights fall."""
    model, _, terms = found or fitted(spark, folder)
    summary = M.topic_terms(model, terms).groupBy("topic").agg(
        F.count("*").alias("n_terms"), F.sum("weight").alias("weight"), F.max("rank").cast("bigint").alias("last_rank")
    )
    return rounded(summary, "weight")


def doc_topics(spark: SparkSession, folder: str, found: Fitted | None = None) -> DataFrame:
    """Per document: the number of topics and the sum of its mixture, zero without weights."""
    summed = F.aggregate("mixture", F.lit(0.0), lambda total, w: total + w)
    return rounded(
        _mixtures(spark, folder, found).select(
            "doc_id", F.size("mixture").alias("n_topics"), summed.alias("weight")
        ),
        "weight",
    )


def lda_top_docs(spark: SparkSession, folder: str, found: Fitted | None = None) -> DataFrame:
    """The ranks of each topic, and whether their weights never rise."""
    top = M.topic_top_documents(M.topic_weights(_mixtures(spark, folder, found)))
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("rank"))
    return top.select("topic", "rank", F.coalesce(before >= F.col("weight"), F.lit(True)).alias("falls"))


def lda_docs_by_topic(spark: SparkSession, folder: str, found: Fitted | None = None) -> DataFrame:
    """All documents that are listed under some topic."""
    assigned = _mixtures(spark, folder, found).select(
        "doc_id", M.dominant_topic(F.col("mixture")).alias("topic")
    )
    return M.documents_by_topic(assigned).select(F.explode("doc_ids").alias("doc_id"))


# --- topics: what the fit ends with -------------------------------------------


def trained(spark: SparkSession, folder: str) -> tuple[M.TopicFit, DataFrame]:
    """The fit with its graph, and the dictionary."""
    vectors, terms = _features(spark, folder)
    terms = materialize(terms, "dictionary")
    return M.training_fit(stored_vectors(vectors, terms.count())), terms


Trained = tuple[M.TopicFit, DataFrame]


def training_mixtures(spark: SparkSession, folder: str, found: Trained | None = None) -> DataFrame:
    """Per document with weights: the number of topics, the sum of its mixture, and of what was shared among them."""
    fit, _ = found or trained(spark, folder)

    def summed(values: str) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda total, w: total + w)

    parts = M.training_mixtures(fit).join(M.training_weights(fit), "doc_id")
    return parts.select(
        "doc_id",
        F.size("mixture").alias("n_topics"),
        F.round(summed("mixture"), DIGITS).alias("weight"),
        F.round(summed("weights"), TOTAL_DIGITS).alias("total"),
    )


def training_terms(spark: SparkSession, folder: str, found: Trained | None = None) -> DataFrame:
    """Per term of the graph: the number of topics, and the sum of its occurrences in all of them."""
    fit, terms = found or trained(spark, folder)
    own = fit.vertices.where("id < 0").select((-F.col("id") - 1).cast("int").alias("term_id"), "weights")
    total = F.aggregate("weights", F.lit(0.0), lambda sum_, w: sum_ + w)
    return own.join(terms.select("term_id", "term"), "term_id").select(
        "term", F.size("weights").alias("n_topics"), F.round(total, TOTAL_DIGITS).alias("total")
    )


def training_topic_terms(spark: SparkSession, folder: str, found: Trained | None = None) -> DataFrame:
    """Per topic: its number of terms, the sum of their weights, which is one, and the last rank."""
    fit, terms = found or trained(spark, folder)
    ranked = M.ranked_terms(M.training_term_weights(fit), terms)
    return rounded(
        ranked.groupBy("topic").agg(
            F.count("*").alias("n_terms"), F.sum("weight").alias("weight"), F.max("rank").cast("bigint").alias("last_rank")
        ),
        "weight",
    )


def training_top_docs(spark: SparkSession, folder: str, found: Trained | None = None) -> DataFrame:
    """The ranks of each topic over the training mixtures, and whether their weights never rise."""
    fit, _ = found or trained(spark, folder)
    top = M.topic_top_documents(M.topic_weights(M.training_mixtures(fit)))
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("rank"))
    return top.select("topic", "rank", F.coalesce(before >= F.col("weight"), F.lit(True)).alias("falls"))


def training_docs_by_topic(spark: SparkSession, folder: str, found: Trained | None = None) -> DataFrame:
    """All documents that are listed under some topic by their training mixture."""
    fit, _ = found or trained(spark, folder)
    assigned = M.training_mixtures(fit).select("doc_id", M.dominant_topic(F.col("mixture")).alias("topic"))
    return M.documents_by_topic(assigned).select(F.explode("doc_ids").alias("doc_id"))


QUERIES: dict[str, Query] = {
    "raw_lines": raw_lines,
    "article_records": _records(ARTICLE, compat=False),
    "article_records_compat": _records(ARTICLE, compat=True),
    "patent_records": _records(PATENT, compat=False),
    "patent_records_compat": _records(PATENT, compat=True),
    "article_stopword_strip": _stripped(compat=False),
    "article_stopword_strip_compat": _stripped(compat=True),
    "doc_lines": doc_lines,
    "doc_ids": doc_ids,
    "label_ranges": ranges_read_back,
    "label_by_range": labelled_documents,
    "train_test_split": train_test_split,
    "category_docs": category_docs,
    "stopwords": stopwords,
    "clean_text": cleaned,
    "tokens": tokens,
    "tokens_no_stop": tokens_no_stop,
    "tokens_min_len": tokens_min_len,
    "term_counts": term_counts,
    "vocabulary": vocabulary,
    "vocabulary_by_documents": vocabulary_by_documents,
    "corpus_stats": corpus_stats,
    "batched_ids": batched_ids,
    "batched_vocabulary": batched_vocabulary,
    "batched_dictionary": batched_dictionary,
    "batched_tfidf": batched_tfidf,
    "dictionary": dictionary,
    "doc_words": doc_words,
    "doc_term_counts": doc_term_counts,
    "document_frequency": document_frequency,
    "idf": idf,
    "tfidf": tfidf,
    "tfidf_clean_docs": tfidf_clean_docs,
    "tfidf_ml": tfidf_ml,
    "doc_top_terms": doc_top_terms,
    "doc_top_terms_filled": doc_top_terms_filled,
    "vector_lines_parse": vector_lines_parse,
    "export_documents": export_documents,
    "export_train_documents": export_train_documents,
    "export_category_docs": export_category_docs,
    "export_label_ranges": export_label_ranges,
    "export_dictionary": export_dictionary,
    "export_vector_lines": export_vector_lines,
    "export_vector_lines_compat": export_vector_lines_compat,
    "export_train_vectors": export_train_vectors,
    "export_document_terms": export_document_terms,
    "dominant_topic": dominant_topic,
    "docs_by_topic": docs_by_topic,
    "topic_top_docs": topic_top_docs,
    "export_topic_documents": export_topic_documents,
    "export_topic_top_documents": export_topic_top_documents,
    "lda_fit": lda_fit,
    "doc_topics": doc_topics,
    "topic_terms": topic_terms,
    "topic_top_terms": topic_top_terms,
    "topic_top_terms_filled": topic_top_terms_filled,
    "lda_top_docs": lda_top_docs,
    "lda_docs_by_topic": lda_docs_by_topic,
    "training_mixtures": training_mixtures,
    "training_terms": training_terms,
    "training_topic_terms": training_topic_terms,
    "training_top_docs": training_top_docs,
    "training_docs_by_topic": training_docs_by_topic,
    "export_topic_words": export_topic_words,
    "export_topic_descriptions": export_topic_descriptions,
}
