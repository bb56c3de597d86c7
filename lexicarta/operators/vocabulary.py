"""Tokens, term counts and the vocabulary."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.functions.text import clean_text, longer_than, split_words, word_counts
from lexicarta.functions.vectors import stored_entries
from lexicarta.session import materialize

# A term is kept when it occurs at least 0.005 times per document
# on average; tokens of two characters or fewer are dropped; a term found in
# only one document weighs nothing.
MIN_SHARE = 0.005
MIN_TOKEN = 3
MIN_DOC_FREQUENCY = 2

#: Terms up to which vectors are made by a model in the row of their document. A larger
#: vocabulary is joined instead, with the same results.
MAX_MODEL_TERMS = 1 << 18


def cleaned(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", clean_text(F.col("text")).alias("text"))


def tokens(docs: DataFrame) -> DataFrame:
    """``tokens(doc_id, word_no, term)`` of the cleaned text."""
    return docs.select(
        "doc_id", F.posexplode(split_words(clean_text(F.col("text")))).alias("word_no", "term")
    )


def without_stop_words(terms: DataFrame, stopwords: DataFrame) -> DataFrame:
    return terms.join(stopwords, "term", "left_anti")


def long_enough(terms: DataFrame, min_length: int = MIN_TOKEN) -> DataFrame:
    return terms.where(longer_than(F.col("term"), min_length - 1))


def term_counts(
    docs: DataFrame,
    stopwords: DataFrame,
    by: str = "occurrences",
    min_token: int = MIN_TOKEN,
) -> DataFrame:
    """``(term, cnt)`` of long enough tokens that are no stop words.

    Stop words leave after the counting: once per term, not once per token.
    ``by="documents"`` counts the documents of a term instead.
    """
    if by == "occurrences":
        words = split_words(clean_text(F.col("text")))
    elif by == "documents":
        words = F.array_distinct(split_words(clean_text(F.col("text"))))
    else:
        raise ValueError(f"unknown threshold rule {by!r}")
    counted = (
        long_enough(docs.select(F.explode(words).alias("term")), min_token)
        .groupBy("term")
        .agg(F.count("*").alias("cnt"))
    )
    return without_stop_words(counted, stopwords)


def vocabulary(
    docs: DataFrame,
    stopwords: DataFrame,
    min_share: float = MIN_SHARE,
    by: str = "occurrences",
    min_token: int = MIN_TOKEN,
) -> DataFrame:
    """``(term, cnt)`` of the terms that reach ``min_share`` times the number of documents.

    The vocabulary does not grow with the corpus: at most ``words per document /
    min_share`` terms can reach the threshold.
    """
    n_docs = docs.agg(F.count("*")).scalar()
    counted = term_counts(docs, stopwords, by, min_token)
    return counted.where(F.col("cnt") >= n_docs * F.lit(float(min_share)))


def document_words(text: Column, clean_docs: bool = False) -> Column:
    """Words that represent a document: of the text as it is, or of the cleaned one."""
    return split_words(clean_text(text) if clean_docs else text)


def counting_model(vocab: DataFrame, n_terms: int | None = None) -> CountVectorizerModel:
    """A count model that holds all terms of ``vocab``, at least one."""
    words = vocab.select(F.array("term").alias("words"))
    size = vocab.count() if n_terms is None else n_terms
    return CountVectorizer(inputCol="words", outputCol="tf", vocabSize=size).fit(words)


def term_codes(vocab: DataFrame, model: CountVectorizerModel) -> DataFrame:
    """``(term, code)``: the positions the model gave to the terms."""
    single = model.transform(vocab.select("term", F.array("term").alias("words")))
    codes = stored_entries(single, "term", "tf")
    return codes.select("term", F.get("entries", F.lit(0))["code"].alias("code"))


def document_term_counts(
    docs: DataFrame,
    vocab: DataFrame,
    clean_docs: bool = False,
    min_token: int = MIN_TOKEN,
    max_model_terms: int = MAX_MODEL_TERMS,
) -> DataFrame:
    """``(doc_id, term, cnt)`` of vocabulary terms of at least ``min_token``.

    A count model counts the members of the vocabulary in the row of their document, in one pass over
    its words; only the names of the counted terms are a join. A vocabulary beyond ``max_model_terms``,
    and an empty one, is joined instead, with the same result.
    """
    members = materialize(long_enough(vocab.select("term").distinct(), min_token), "members")
    n_terms = members.count()
    if not 0 < n_terms <= max_model_terms:
        return _joined_term_counts(docs, members, clean_docs, min_token)
    model = counting_model(members, n_terms)
    words = F.coalesce(document_words(F.col("text"), clean_docs), F.array().cast("array<string>"))
    tf = F.unwrap_udt("tf")
    counted = model.transform(docs.select("doc_id", words.alias("words"))).select(
        "doc_id", F.inline(F.arrays_zip(tf["indices"].alias("code"), tf["values"].alias("n")))
    )
    return counted.join(term_codes(members, model), "code").select("doc_id", "term", F.col("n").cast("bigint").alias("cnt"))


def _joined_term_counts(docs: DataFrame, vocab: DataFrame, clean_docs: bool, min_token: int) -> DataFrame:
    """The same for a vocabulary of any size: all words are counted in place and looked up by a join."""
    words = F.filter(
        document_words(F.col("text"), clean_docs), lambda w: longer_than(w, min_token - 1)
    )
    counted = docs.select("doc_id", F.inline(word_counts(words))).withColumnRenamed("n", "cnt")
    return counted.join(vocab, "term", "left_semi").select("doc_id", "term", "cnt")


def vocabulary_words(docs: DataFrame, vocab: DataFrame, clean_docs: bool = False) -> DataFrame:
    """``(doc_id, words)``: vocabulary members in text order, repeats kept.

    Documents without any keep an empty list.
    """
    words = document_words(F.col("text"), clean_docs)
    members = (
        docs.select("doc_id", F.posexplode(words).alias("word_no", "term"))
        .join(vocab.select("term"), "term", "left_semi")
        .select("doc_id", F.struct("word_no", "term").alias("word"))
    )
    every = docs.select("doc_id", F.lit(None).cast("struct<word_no:int,term:string>").alias("word"))
    return (
        members.unionByName(every)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list("word")).alias("words"))
        .select("doc_id", F.transform("words", lambda w: w["term"]).alias("words"))
    )


def inverse_document_frequency(
    doc_frequency: Column, n_docs: Column, min_doc_frequency: int = MIN_DOC_FREQUENCY
) -> Column:
    return F.when(
        doc_frequency >= min_doc_frequency, F.log((n_docs + 1) / (doc_frequency + 1))
    ).otherwise(0.0)


def term_statistics(
    counts: DataFrame, docs: DataFrame, min_doc_frequency: int = MIN_DOC_FREQUENCY
) -> DataFrame:
    """``(term, doc_occurrences, doc_frequency, idf)`` from ``(doc_id, term, cnt)``."""
    n_docs = docs.agg(F.count("*")).scalar()
    return (
        counts.groupBy("term")
        .agg(F.sum("cnt").alias("doc_occurrences"), F.count("*").alias("doc_frequency"))
        .withColumn(
            "idf", inverse_document_frequency(F.col("doc_frequency"), n_docs, min_doc_frequency)
        )
    )


def corpus_statistics(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(n_docs, n_terms)`` as one row."""
    return docs.agg(F.count("*").alias("n_docs")).withColumn(
        "n_terms", vocab.agg(F.count("*")).scalar()
    )
