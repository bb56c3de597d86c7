import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicarta.llm import quality_classifier as qc
from lexicarta.llm.labelled import held_out, labelled_sample
from lexicarta.llm.queries import op10_quality_classifier

from .conftest import sentence


def labelled(n=500):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        lines = [sentence(rng, 70) for _ in range(rng.randint(1, 5))]
        bad = i % 5 == 0
        if bad:  # one passage of several tells
            k = rng.randrange(len(lines))
            lines[k] = " ".join([rng.choice(lines[k].split())] * 90)
        rows.append((i, "\n".join(lines)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_rows(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_sample_is_bounded_and_leaves_held_out_labels(spark, make_docs):
    rows, labels = labelled()
    extra = [(3, 0), (4, None), (6, 9), (None, 1)]
    frame = spark.createDataFrame(labels + extra, "doc_id bigint, quality int")
    sample, numbers = labelled_sample(make_docs(rows + rows[:50]), frame, 30)
    got = sample.collect()
    assert len(got) == 60 and len({r.doc_id for r in got}) == 60
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert 3 not in {r.doc_id for r in got}, "contradicting labels do not count"
    assert sum(numbers.values()) < len(labels)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    bags = [rng.random((n, qc.FEATURES)).astype(np.float32) for n in (1, 3, 2)]
    y, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    qc_epochs, qc.EPOCHS = qc.EPOCHS, 1
    try:
        net = qc.fit(bags, y.astype(int), {0: 1.0, 1: 3.0})
    finally:
        qc.EPOCHS = qc_epochs
    x, sizes = np.concatenate(bags).astype(np.float64), np.array([1, 3, 2])

    def loss():
        p = qc._sigmoid(net.forward(x, sizes)["logit"])
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    found = net.gradients(x, sizes, y, weight)
    for name in ("W", "b", "V", "U", "w", "c", "d"):
        part = net.parts[name].reshape(-1)
        for i in rng.integers(0, part.size, 3):
            kept = part[i]
            part[i] = kept + 1e-5
            up = loss()
            part[i] = kept - 1e-5
            down = loss()
            part[i] = kept
            assert found[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_passages_do_not_depend_on_their_neighbours(awkward):
    texts = [t or "" for _, t in awkward]
    x, sizes = qc.passages(pa.array(texts))
    begin = 0
    for text, size in zip(texts, sizes.tolist()):
        alone, n = qc.passages(pa.array([text]))
        assert n.tolist() == [size] == [max(1, -(-len(text.encode().split()) // qc.PASSAGE))]
        assert np.allclose(alone, x[begin : begin + size])
        begin += size
    assert np.isfinite(x).all()


def test_learns_from_document_labels(spark, make_docs):
    rows, labels = labelled()
    net = qc.train(make_docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    got = qc.scored(make_docs(rows), net, "s").select("doc_id", "s").collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.s >= 0.7) == (r.doc_id % 5 != 0) for r in out]) > 0.95
    assert all(0 <= r.s <= 1 for r in got)


def test_awkward_rows_and_missing_labels(spark, make_docs, awkward):
    rows, labels = labelled(100)
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int")
    docs = make_docs(awkward)
    net = qc.train(make_docs(rows), frame)
    assert qc.scored(docs, net, "s").where("s between 0 and 1").count() == len(awkward)
    kept = qc.accepted(docs, frame.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(awkward)
    assert qc.accepted(make_docs(rows), frame.where("quality = 0")).count() == 0
    assert qc.accepted(make_docs([]), frame).count() == 0


def test_query_on_the_given_tables(spark, folder):
    got = op10_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(out) >= 10
    assert np.mean([r.predicted == r.quality for r in out]) > 0.85
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
