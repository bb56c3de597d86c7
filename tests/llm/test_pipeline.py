import random
from collections import Counter

import corpus_pipeline
import pytest
from lexicarta.llm import near_dedup
from lexicarta.session import materialize

from .conftest import sentence
from .test_exact_dedup import brute
from .test_packing import check_packed


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with junk, copies and near copies, and labels of a part of it."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        text = sentence(rng, 120)
        if i % 6 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 2:
            labels.append((i, 0 if i % 6 == 0 else 1, 0))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    labels += [(i, 0, 0) for i in range(0, 300, 12)]
    for i in range(40):  # copies with other white space, then near copies
        rows.append((1000 + i, rows[i][1].replace(" ", "  ", 3), "en", "s0", 0))
        words = rows[i + 50][1].split()
        rows.append((2000 + i, " ".join(words[:-1] + ["end"]), None, None, None))
    rows += [(3000, None, "en", "s1", 0), (None, "", "en", "s1", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_follow_each_other(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    first = Counter(tuple(r) for r in docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        seen[name] = before
        after = materialize(stage(spark, docs, tables), name)
        if name != "packing":
            assert after.columns == docs.columns
            assert not Counter(tuple(r) for r in after.collect()) - first, "stages return rows of documents"
            docs = after
    judged = {r[0] for r in seen["exact_dedup"]}
    assert sum(i in judged for i in range(300) if i % 6) >= 245 and sum(i in judged for i in range(0, 300, 6)) <= 2
    want = brute([(r[0], r[1]) for r in seen["exact_dedup"]])
    assert Counter(r[0] for r in seen["near_dedup"]) == Counter({k for k in (x[1] for x in want)} & {r[0] for r in seen["exact_dedup"]})
    left = {r[0] for r in seen["mixing"]}
    assert not any(2000 + i in left and i + 50 in left for i in range(40))
    classes = near_dedup.classes(docs.sparkSession.createDataFrame([(r[0], r[1]) for r in seen["near_dedup"]], "doc_id bigint, text string"))
    assert len(left) == classes.select("class_id").distinct().count()
    assert Counter(seen["packing"]) == Counter(seen["mixing"])
    rows = after.collect()
    assert {r.doc_id for r in rows} == left
    check_packed(rows, 4096)


def test_sequences_keep_the_mix(spark):
    """Sources of 9 to 1 documents, but by the square root 3 to 1, until one runs out."""
    rng = random.Random(7)
    rows = [(i, sentence(rng, 4000), "en", "a" if i % 10 else "b", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mix = materialize(corpus_pipeline.mixed(spark, docs, ""), "mix").repartition(5)
    got = corpus_pipeline.packed(spark, mix, "").collect()
    check_packed(got, 4096)
    assert {r.doc_id for r in got} == set(range(1200))
    ordered = sorted(got, key=lambda r: r.sequence_id)
    total = {s: sum(r.length for r in got if (r.doc_id % 10 == 0) == (s == "b")) for s in "ab"}
    ids = {"a": 0, "b": 0}
    checked = 0
    for n, (r, after) in enumerate(zip(ordered, ordered[1:])):
        ids["ab"[r.doc_id % 10 == 0]] += r.length
        whole = ids["a"] + ids["b"]
        if ids["b"] > 0.95 * total["b"]:
            break
        if r.sequence_id != after.sequence_id and whole > 0.1 * sum(total.values()):
            assert ids["b"] / whole == pytest.approx(0.25, abs=0.05)
            checked += 1
    assert checked > 20


def test_run_gives_what_the_stages_give(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, tables), name)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, tables).select(columns).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, docs.select(columns).collect()))


def test_no_rows_and_clashing_columns(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clash = docs.selectExpr("*", "'x' AS score", "1 AS row", "'k' AS size", "true AS slot", "0 AS rep")
    for name, rows in (("none", clash.limit(0)), ("clash", clash)):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "clash")).collect()}
    assert found == {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()}
