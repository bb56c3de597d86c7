"""Every query with SQL gives the same rows in a second engine; the others keep their invariants."""

import math
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from lexicarta.operators import topics as M
from lexicarta.plans import catalog, oracle


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(record[i] for i in order) for record in records)


def assert_scales(df):
    """No row multiplying joins and no Python workers in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows(spark, duck, folder, name):
    found = driver.queries()[name](spark, folder)
    assert_scales(found)
    cursor = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    expected = rows(columns, cursor.fetchall())
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == expected
    assert expected


def test_entry(spark):
    assert driver.entry(spark).columns == ["doc_id", "term", "cnt", "weight"]


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(oracle.oracle_sql()) == set(catalog.QUERIES), "every query has its counterpart"


def test_topic_model_reports(spark, folder):
    """Reports of one fit agree with each other and with its mixtures."""
    n_docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    found = catalog.fitted(spark, folder)
    model, corpus, terms = found
    mixed = M.document_topics(model, corpus)
    mixtures = {r["doc_id"]: dict(enumerate(r["mixture"])) for r in mixed.collect()}
    assert len(mixtures) == n_docs
    assert all(len(m) == 7 for m in mixtures.values())
    told = {r["doc_id"]: r["weight"] for r in catalog.doc_topics(spark, folder, found).collect()}
    assert told == {d: round(sum(m.values()), 6) for d, m in mixtures.items()}
    assert set(told.values()) <= {0.0, 1.0}

    listed = M.documents_by_topic(mixed.select("doc_id", M.dominant_topic(F.col("mixture")).alias("topic"))).collect()
    for r in listed:
        assert r["doc_ids"] == sorted(r["doc_ids"])
        assert all(max(mixtures[i].values()) == mixtures[i][r["topic"]] for i in r["doc_ids"])
    ids = sorted(r["doc_id"] for r in catalog.lda_docs_by_topic(spark, folder, found).collect())
    assert ids == sorted(i for r in listed for i in r["doc_ids"]) == sorted(d for d, w in told.items() if w > 0)

    tops = defaultdict(list)
    for r in M.topic_top_documents(M.topic_weights(mixed)).orderBy("topic", "rank").collect():
        tops[r["topic"]].append((r["weight"], -r["doc_id"]))
    for topic, top in tops.items():
        assert top == sorted(((m[topic], -d) for d, m in mixtures.items()), reverse=True)[:20]
    ranks = catalog.lda_top_docs(spark, folder, found).collect()
    assert all(r["falls"] for r in ranks) and len(ranks) == 140

    own = defaultdict(list)
    for r in M.topic_terms(model, terms).orderBy("topic", "rank").collect():
        own[r["topic"]].append(r["weight"])
    assert sorted(own) == list(range(7))
    for r in catalog.lda_fit(spark, folder, found).collect():
        weights = own[r["topic"]]
        assert weights == sorted(weights, reverse=True)
        assert r["n_terms"] == r["last_rank"] == len(weights)
        assert math.isclose(sum(weights), 1.0, abs_tol=1e-6) and r["weight"] == 1.0
