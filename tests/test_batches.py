import random

import pytest
from pyspark.sql import functions as F

from lexicarta.__main__ import main
from lexicarta.plans import catalog
from lexicarta.operators import batches as B
from lexicarta.operators import features as X
from lexicarta.operators import vocabulary as V
from lexicarta.sources import readers as R
from test_jobs import lines_of, write_records

WORDS = ["word" + a + b for a in "abcde" for b in "stuvwxyz"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS, range(1, 41), k=rng.randint(0, 12))) + rng.choice(["", " only" + WORDS[i % 40] + ","])) for i in range(90)]
    return spark.createDataFrame(rows, "key int, text string").repartition(3)


@pytest.fixture
def no_stops(spark):
    return spark.createDataFrame([("wordez",)], "term string")


def test_batches_are_one_corpus(spark, corpus, no_stops, tmp_path):
    store = str(tmp_path)
    for number, (low, high) in enumerate([(0, 50), (50, 51), (51, 51), (51, 90)]):
        batch = corpus.where((F.col("key") >= low) & (F.col("key") < high))
        assert B.add_batch(batch, store, ["key"]) == number
    docs = B.batch_documents(spark, store)
    assert {r["doc_id"]: r["key"] for r in docs.collect()} == {i: i for i in range(90)}
    whole = corpus.withColumnRenamed("key", "doc_id")
    for share, by in ((0.005, "occurrences"), (0.2, "documents"), (0.5, "occurrences")):
        vocab = V.vocabulary(whole, no_stops, share, by)
        merged = B.merged_vocabulary(spark, store, no_stops, share, by)
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, vocab.select("term", "cnt").collect()))
        counts = V.document_term_counts(whole, vocab)
        statistics = V.term_statistics(counts, whole)
        weights, terms = B.merged_features(spark, store, no_stops, share, by)
        expected = X.tfidf(counts, statistics)
        assert sorted(map(tuple, weights.collect())) == sorted(map(tuple, expected.collect()))
        columns = ["term", "term_id", "doc_occurrences", "doc_frequency", "idf"]
        assert sorted(map(tuple, terms.select(columns).collect())) == sorted(
            map(tuple, X.dictionary(statistics).select(columns).collect())
        )


def test_earlier_texts_are_not_read(spark, corpus, no_stops, tmp_path):
    store = tmp_path / "store"
    B.add_batch(corpus.where("key < 40"), str(store), ["key"])
    first = store / "documents" / "batch=0"
    hidden = first.rename(tmp_path / "hidden")
    B.add_batch(corpus.where("key >= 40"), str(store), ["key"])
    weights, _ = B.merged_features(spark, str(store), no_stops)
    assert weights.select("doc_id").distinct().count() > 60
    hidden.rename(first)


def test_a_failed_batch_is_written_anew(spark, corpus, no_stops, tmp_path):
    store = tmp_path / "store"
    B.add_batch(corpus.where("key < 40"), str(store), ["key"])
    corpus.selectExpr("key AS doc_id", "text").write.parquet(str(store / "documents" / "batch=1"))
    assert B.batch_documents(spark, str(store)).count() == 40
    assert B.add_batch(corpus.where("key >= 40"), str(store), ["key"]) == 1
    assert B.batch_documents(spark, str(store)).count() == 90


def test_rules_must_agree(spark, corpus, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        B.batch_documents(spark, str(tmp_path / "none"))
    B.add_batch(corpus, str(tmp_path), ["key"])
    with pytest.raises(ValueError, match="other rules"):
        B.add_batch(corpus, str(tmp_path), ["key"], min_token=5)


def test_append_and_merge_are_one_run(spark, tmp_path):
    """Two folders, one after the other, give the lines of a single run over both."""
    for name, ids in (("a", range(0, 12)), ("b", range(12, 20))):
        (tmp_path / name).mkdir()
        write_records(tmp_path / name, f"{name}.txt", ids, "abd   ")
    (tmp_path / "both").mkdir()
    for name in "ab":
        (tmp_path / "both" / f"{name}.txt").write_text((tmp_path / name / f"{name}.txt").read_text())
    store, out, one = (str(tmp_path / n) for n in ("store", "out", "one"))
    for name in "ab":
        main(["append", "--layout", "patent", "--source", str(tmp_path / name), "--store", store])
    main(["merge", "--store", store, "--out", out])
    main(["extract", "--layout", "patent", "--source", str(tmp_path / "both"), "--out", one])
    main(["features", "--documents", f"{one}/documents", "--out", one])
    for table in ("documents", "dictionary"):
        assert sorted(lines_of(tmp_path / "out" / table)) == sorted(lines_of(tmp_path / "one" / table))
    left, right = ({r["doc_id"]: r["entries"] for r in R.read_vectors(spark, f"{f}/vectors").collect()} for f in (out, one))
    assert left == right and len(left) == 20


def test_batches_read_what_is_joined_once(spark, folder, monkeypatch):
    given, add = [], catalog.B.add_batch
    monkeypatch.setattr(catalog.B, "add_batch", lambda docs, *a: given.append(docs) or add(docs, *a))
    catalog._batched(spark, folder)
    assert len(given) == 2
    assert all("Join" not in d._jdf.queryExecution().optimizedPlan().toString() for d in given)
