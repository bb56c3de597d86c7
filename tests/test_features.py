import random
import math
import time
from collections import Counter

import pytest

from lexicarta.functions import text as T
from lexicarta.operators import features as X
from lexicarta.operators import vocabulary as V
from lexicarta.plans import catalog
from lexicarta.sources.readers import default_stop_words, stop_words
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F


def value(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns))
    return row.select(expression.alias("v")).head()["v"]


def test_split_words_keeps_inner_and_drops_trailing_empties(spark):
    split = T.split_words(F.col("s"))
    assert value(spark, split, s="a  b ") == ["a", "", "b"]
    assert value(spark, split, s=" a") == ["", "a"]
    assert value(spark, split, s="   ") == []
    assert value(spark, split, s="") == [""]


def test_longer_than_counts_utf16_units(spark):
    units = {"ab": 2, "éé": 2, "日本": 2, "😀": 2, "a😀": 3, "😀😀": 4, "": 0}
    df = spark.createDataFrame([(text,) for text in units], "s string")
    for row in df.select("s", *[T.longer_than(F.col("s"), n).alias(str(n)) for n in range(6)]).collect():
        assert [row[str(n)] for n in range(6)] == [units[row["s"]] > n for n in range(6)]


def test_clean_text(spark):
    assert value(spark, T.clean_text(F.col("s")), s="Ab-12 «É» x+y, (z)") == "ab é x+y z"


def test_strip_blanks(spark):
    assert value(spark, T.strip_blanks(F.col("s")), s="\t\x01 a b\x0b \t") == "a b"


def test_word_counts(spark):
    words = "b a b c a b".split()
    counted = value(spark, T.word_counts(F.col("w")), w=words)
    assert {c["term"]: c["n"] for c in counted} == Counter(words)
    empty = F.array().cast("array<string>")
    assert value(spark, T.word_counts(empty), x=1) == []


def test_default_stop_words_are_sparks_own(spark):
    assert default_stop_words() == StopWordsRemover.loadDefaultStopWords("english")
    assert {r["term"] for r in stop_words(spark).collect()} == set(default_stop_words())


def test_own_stop_words(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("eins\nzwei\neins\n")
    assert sorted(r["term"] for r in stop_words(spark, str(tmp_path)).collect()) == ["eins", "zwei"]


def test_vocabulary_threshold_counts_occurrences(docs_of, words_frame):
    docs = docs_of("cells cells cells blood", "blood the a", "other words", "more blood")
    none = words_frame("the")
    by_occurrences = V.vocabulary(docs, none, min_share=0.75)
    assert {r["term"]: r["cnt"] for r in by_occurrences.collect()} == {"cells": 3, "blood": 3}
    by_documents = V.vocabulary(docs, none, min_share=0.75, by="documents")
    assert {r["term"]: r["cnt"] for r in by_documents.collect()} == {"blood": 3}
    with pytest.raises(ValueError):
        V.vocabulary(docs, none, by="weight")


def test_documents_are_counted_uncleaned(docs_of, words_frame):
    docs = docs_of("cells, Cells cells", "cells")
    vocab = V.vocabulary(docs, words_frame("zzz"))
    counts = V.document_term_counts(docs, vocab)
    assert {(r["doc_id"], r["term"]): r["cnt"] for r in counts.collect()} == {
        (0, "cells"): 1,
        (1, "cells"): 1,
    }
    cleaned = V.document_term_counts(docs, vocab, clean_docs=True)
    assert {(r["doc_id"], r["term"]): r["cnt"] for r in cleaned.collect()} == {
        (0, "cells"): 3,
        (1, "cells"): 1,
    }


def test_members_are_counted_by_a_model_or_a_join(spark, words_frame):
    """Without sorting the words of each document, unless the vocabulary is too large or empty."""
    rows = [(0, "ab, Cells cells  ab"), (1, "cells"), (1, "cells"), (2, None), (3, ""), (None, "ab 😀 zzz ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocab = words_frame("cells", "ab", "cells", None, "😀", "unused")
    for clean_docs, min_token in [(True, 3), (False, 3), (True, 0)]:
        want = Counter()
        for at, (_, text) in enumerate(rows):
            words = (text or "").replace(",", "").lower() if clean_docs else text or ""
            units = [(w, len(w.encode("utf-16-le")) // 2) for w in words.split(" ")]
            want.update((at, w) for w, n in units if n >= min_token and w in ("cells", "ab", "😀", "unused"))
        want = sorted(((rows[at][0], w, n) for (at, w), n in want.items()), key=str)
        for limit, sorted_words in [(V.MAX_MODEL_TERMS, False), (1, True)]:
            counts = V.document_term_counts(docs, vocab, clean_docs, min_token, limit)
            assert counts.dtypes == [("doc_id", "bigint"), ("term", "string"), ("cnt", "bigint")]
            assert sorted(map(tuple, counts.collect()), key=str) == want
            assert ("sort_array" in counts._jdf.queryExecution().optimizedPlan().toString()) == sorted_words
    assert V.document_term_counts(docs, vocab.limit(0)).count() == 0


CORPUS = ["red red blue", "red green", "blue blue blue one", "", "single", "red blue, Green"]


def by_hand(texts):
    """Weights by the definitions, from counters."""
    words = [[w for w in t.split(" ") if len(w) > 2] for t in texts]
    vocab = {w for t in texts for w in "".join(c for c in t.lower() if c not in ",.").split() if len(w) > 2}
    per_doc = [Counter(w for w in ws if w in vocab) for ws in words]
    df = Counter(w for c in per_doc for w in c)
    n = len(texts)
    idf = {w: math.log((n + 1) / (df[w] + 1)) if df[w] >= 2 else 0.0 for w in df}
    order = sorted(df, key=lambda w: (-sum(c[w] for c in per_doc), w))
    return per_doc, idf, order


def close(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)


@pytest.fixture(params=["model", "joined"])
def features(request, docs_of, words_frame, monkeypatch):
    if request.param == "joined":
        monkeypatch.setattr(X, "MAX_MODEL_TERMS", 2)
    docs = docs_of(*CORPUS)
    vocab = V.vocabulary(docs, words_frame("zzz"))
    return docs, *X.document_features(docs, vocab)


def test_dictionary_and_vectors(features):
    _, vectors, terms = features
    per_doc, idf, order = by_hand(CORPUS)
    listed = terms.orderBy("term_id").collect()
    assert [r["term"] for r in listed] == order
    assert [r["term_id"] for r in listed] == list(range(len(order)))
    found = {r["doc_id"]: r["entries"] for r in vectors.collect()}
    assert len(found) == len(CORPUS)
    for doc_id, counter in enumerate(per_doc):
        entries = found[doc_id]
        assert [e["term_id"] for e in entries] == sorted(order.index(w) for w in counter)
        assert close(
            {e["term_id"]: e["weight"] for e in entries},
            {order.index(w): n * idf[w] for w, n in counter.items()},
        )


def test_top_terms_and_fill(features):
    docs, vectors, terms = features
    per_doc, idf, order = by_hand(CORPUS)
    lists = {r["doc_id"]: [t["term"] for t in r["top"]] for r in X.top_term_lists(vectors, terms, 2).collect()}
    filled = X.filled_with_unused(X.top_term_lists(vectors, terms, 3, ties="term_id"), terms, 3)
    filled = {r["doc_id"]: [t["term"] for t in r["top"]] for r in filled.collect()}
    for doc_id, counter in enumerate(per_doc):
        weight = {w: n * idf[w] for w, n in counter.items() if n * idf[w] > 0}
        assert lists[doc_id] == sorted(weight, key=lambda w: (-weight[w], w))[:2]
        everything = sorted(order, key=lambda w: (-weight.get(w, 0.0), order.index(w)))
        assert filled[doc_id] == everything[:3]


def test_long_weights(docs_of, words_frame):
    docs = docs_of(*CORPUS)
    vocab = V.vocabulary(docs, words_frame("zzz"))
    counts = V.document_term_counts(docs, vocab)
    per_doc, idf, _ = by_hand(CORPUS)
    found = X.tfidf(counts, V.term_statistics(counts, docs)).collect()
    assert close(
        {(r["doc_id"], r["term"]): r["weight"] for r in found},
        {(d, w): n * idf[w] for d, c in enumerate(per_doc) for w, n in c.items()},
    )
    words = {r["doc_id"]: r["words"] for r in V.vocabulary_words(docs, vocab).collect()}
    assert words == {
        0: ["red", "red", "blue"],
        1: ["red", "green"],
        2: ["blue", "blue", "blue", "one"],
        3: [],
        4: ["single"],
        5: ["red"],
    }


def test_empty_vocabulary(docs_of, words_frame):
    docs = docs_of("a b", "")
    vocab = V.vocabulary(docs, words_frame("zzz"))
    vectors, terms = X.document_features(docs, vocab)
    assert {r["doc_id"]: r["entries"] for r in vectors.collect()} == {0: [], 1: []}
    assert terms.count() == 0
    assert {r["doc_id"]: r["top"] for r in X.top_term_lists(vectors, terms).collect()} == {0: [], 1: []}


def test_ties_are_ordered_by_term(spark):
    weights = spark.createDataFrame(
        [(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0), (1, "d", 0.0)],
        "doc_id bigint, term string, weight double",
    )
    ranked = X.top_terms(weights, 2).orderBy("rank").collect()
    assert [(r["rank"], r["term"]) for r in ranked] == [(1, "c"), (2, "a")]


def test_member_words_keep_order_and_repeats(spark, docs_of, words_frame, monkeypatch):
    texts = ["b a x b  a", "", "x y", "a " * 500 + "q " * 300 + "b", "A a. a"]
    docs, vocab = docs_of(*texts), words_frame("a", "b", "c")
    want = {i: [w for w in t.split(" ") if w in ("a", "b", "c")] for i, t in enumerate(texts)}
    found = X.member_words(docs, vocab)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text  # but for the list of names, which is one row
    assert {r["doc_id"]: r["words"] for r in found.collect()} == want
    for some in (X.member_words(docs, vocab, max_model_terms=2), V.vocabulary_words(docs, vocab)):
        assert {r["doc_id"]: r["words"] for r in some.collect()} == want
    assert all(r["words"] == [] for r in X.member_words(docs, vocab.limit(0)).collect())


def test_members_are_dealt_once_a_document(spark, docs_of, words_frame):
    """Dealt once a word, this took some ten minutes."""
    names = [f"w{i}" for i in range(6000)]
    start = time.perf_counter()
    found = X.member_words(docs_of(" ".join(names)), words_frame(*names[::2])).head()["words"]
    assert found == names[::2]
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize("n", [1, 20, 5000])
def test_top_per_group_of_any_size(spark, n):
    rng = random.Random(n)
    weights = [None, float("nan"), 0.0, -0.0, 5e-324, 1e308, -2.5, float("inf"), float("-inf")]
    rows = [(rng.choice([0, 0, 0, 1, None]), rng.choice(weights + [rng.random()] * 3 + [7.0] * 9), i) for i in range(12_000)]
    df = spark.createDataFrame(rows, "g int, w double, i int").repartition(5)
    before = spark.conf.get(X._GROUP_LIMIT)
    found = X.top_per_group(df, "g", "w", "i", n)
    assert spark.conf.get(X._GROUP_LIMIT) == before and found.columns == ["g", "w", "i", "rank"]
    want = []
    for g in (0, 1, None):
        own = [r for r in rows if r[0] == g]
        own.sort(key=lambda r: (r[1] is None, -math.inf if r[1] is not None and math.isnan(r[1]) else 0, -(r[1] or 0.0) if r[1] is not None and not math.isnan(r[1]) else 0, r[2]))
        want += [(g, i, k + 1) for k, (_, _, i) in enumerate(own[:n])]
    assert sorted(((r["g"], r["i"], r["rank"]) for r in found.collect()), key=str) == sorted(want, key=str)


def test_many_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(200_000).selectExpr("cast(0 AS int) AS g", "pow(2, id % 64) AS w", "id AS i")
    kept = X.heavy_enough(df, "g", "w", 5000).count()
    assert 5000 <= kept < 20_000
    plan = X.top_per_group(df, "g", "w", "i", 5000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_salt") > 0


def test_lists_are_ranked_without_making_them_again(spark):
    rows = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, None)], "doc_id bigint, words array<string>")
    made = F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(1.0).alias("weight")))
    ranked = catalog._ranked(rows.select("doc_id", made.alias("top")))
    assert sorted(ranked.collect()) == [(1, 1, "b", 1.0), (1, 2, "a", 1.0)]
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 1
