"""The physical plans that matter at scale."""

import re

import pytest

from lexicarta.operators import features as X
from lexicarta.operators import topics as M
from lexicarta.operators import vocabulary as V
from lexicarta.operators.labels import label_by_range
from lexicarta.plans import catalog as C
from lexicarta.sources import writers as W
from lexicarta.sources.readers import stop_words
from lexicarta.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df, name):
    return len(re.findall(rf"\b{name}\b", plan(df)))


@pytest.fixture
def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


@pytest.fixture
def vocab(spark, folder):
    return C._vocabulary(spark, folder)


def test_term_counting_shuffles_partial_counts_only(spark, docs):
    counted = V.term_counts(docs, stop_words(spark))
    assert nodes(counted, "Exchange") == 1
    assert "partial_count" in plan(counted)
    assert nodes(counted, "BroadcastHashJoin") == 1
    assert "ReadSchema: struct<text:string>" in plan(counted)


def test_document_counts_shuffle_nothing(docs, vocab):
    counts = V.document_term_counts(docs, vocab)
    assert nodes(counts, "Exchange") == 0
    assert nodes(counts, "BroadcastHashJoin") == 1


def test_a_large_vocabulary_is_not_broadcast(spark, docs, vocab):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        counts = V.document_term_counts(docs, vocab)
        assert nodes(counts, "BroadcastHashJoin") == 0
        assert nodes(counts, "SortMergeJoin") == 1
        shuffled = sorted(map(tuple, counts.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert shuffled == sorted(map(tuple, V.document_term_counts(docs, vocab).collect()))


def test_vectors_and_top_words_shuffle_nothing(docs, vocab):
    vectors, terms = X.document_features(docs, vocab)
    # what is aggregated is the dictionary, into one array
    assert nodes(vectors, "hashpartitioning") <= 2
    top = X.top_term_lists(vectors, terms)
    assert "hashpartitioning(doc_id" not in plan(top)


def test_top_per_topic_is_limited_before_the_shuffle(spark, folder):
    top = M.topic_top_documents(M.topic_weights(C._given_mixtures(spark, folder)))
    text = plan(top)
    assert text.index("Partial") > text.index("Exchange hashpartitioning(topic")
    assert nodes(top, "WindowGroupLimit") == 2


def test_top_of_a_large_number_leaves_light_rows_before_the_shuffle_too(spark, folder):
    """Beyond the session's limit rows leave by a join with one row per group, then parts of a group are ranked."""
    top = M.topic_top_documents(M.topic_weights(C._given_mixtures(spark, folder)), 5000)
    assert nodes(top, "WindowGroupLimit") == 0
    text = plan(top)
    assert text.index("Exchange hashpartitioning(topic") < text.index("_salt") < text.index("_least")


def test_id_lists_are_not_dealt_by_topic(spark, folder):
    lists = C.materialize(M.documents_by_topic(C.dominant_topic(spark, folder)), "lists")
    lines = W.topic_document_lines(lists, 64)
    assert not re.search(r"hashpartitioning\(topic[^)]*\)[^\n]*\n[^\n]*ids", plan(lines))
    assert "SortMergeJoin LeftOuter" not in plan(lines)


def test_range_lookup_is_an_equi_join(spark, folder):
    docs, ranges = C._ranges(spark, folder)
    found = plan(label_by_range(docs.select("doc_id"), C.materialize(ranges, "ranges")))
    assert "BroadcastNestedLoopJoin" not in found and "CartesianProduct" not in found
    assert "rangepartitioning" not in found  # the sweep is written already; ids and ranges are not paired
    assert "BroadcastHashJoin Inner" in found or "HashJoin" in found
