import pytest

from lexicarta.sources import readers as R
from lexicarta.sources import writers as W
from pyspark.sql import functions as F


def values(lines):
    return sorted(r["value"] for r in lines.collect())


def test_document_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3\tone two\n4\t\n5\tthree\tfour\n6\n")
    docs = R.read_documents(spark, str(tmp_path))
    assert sorted(map(tuple, docs.collect())) == [(3, "one two"), (4, ""), (5, "three"), (6, "")]
    out = str(tmp_path / "out")
    W.write_lines(W.document_lines(docs), out)
    W.write_lines(W.document_lines(docs), out)  # overwrites
    assert sorted(map(tuple, R.read_documents(spark, out).collect())) == sorted(map(tuple, docs.collect()))


def test_category_names(spark):
    df = spark.createDataFrame(
        [("file:/x/first%20class.txt",), ("file:/x/a+b.txt",), ("file:/x/plain",)], "file string"
    )
    names = [r["c"] for r in df.select(R.category_of(F.col("file")).alias("c")).collect()]
    assert names == ["first class", "a+b", "plain"]


def test_vector_lines(spark, tmp_path):
    rows = [(7, [(0, 0.5), (12, 1e-05), (3, 2.0)]), (8, [])]
    vectors = spark.createDataFrame(
        rows, "doc_id bigint, entries array<struct<term_id:int,weight:double>>"
    )
    assert values(W.vector_lines(vectors)) == ["7 0:0.5 12:1.0E-5 3:2.0 ", "8 "]
    assert values(W.vector_lines(vectors, drop_last=True)) == ["7 0:0.5 12:1.0E-5 ", "8 "]
    assert values(W.vector_lines(vectors, digits=2)) == ["7 0:0.50 12:0.00 3:2.00 ", "8 "]
    W.write_lines(W.vector_lines(vectors), str(tmp_path / "v"))
    back = R.read_vectors(spark, str(tmp_path / "v")).orderBy("doc_id").collect()
    assert [(r["doc_id"], [tuple(e) for e in r["entries"]]) for r in back] == rows
    labelled = vectors.withColumn("label", F.lit(2))
    assert values(W.vector_lines(labelled, head="label"))[1].startswith("2 0:0.5 ")


def test_dictionary_lines(spark, tmp_path):
    terms = spark.createDataFrame([("zell\"e", 0), ("b\\c", 1), ("été", 2)], "term string, term_id int")
    W.write_lines(W.dictionary_lines(terms), str(tmp_path / "d"))
    back = R.read_dictionary(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, terms.collect()))


def test_label_range_lines(spark, tmp_path):
    rows = [("first class", 1, 0, 9), ("other", 2, 10, 20)]
    ranges = spark.createDataFrame(
        rows, "category string, label_id int, start_id bigint, stop_id bigint"
    )
    W.write_lines(W.label_range_lines(ranges), str(tmp_path / "r"))
    assert sorted(map(tuple, R.read_label_ranges(spark, str(tmp_path / "r")).collect())) == rows


def test_label_ranges_with_bad_numbers(spark, tmp_path):
    (tmp_path / "r.txt").write_text("one\t1\t1\t20  19\ntwo\t2\t21\t30\t9\n")
    with pytest.raises(ValueError, match="20  19"):
        R.read_label_ranges(spark, str(tmp_path))
    (tmp_path / "r.txt").write_text("two\t2\t21\t30\t9\n")
    assert [tuple(r) for r in R.read_label_ranges(spark, str(tmp_path)).collect()] == [("two", 2, 21, 30)]


def test_document_term_lines(spark):
    top = spark.createDataFrame(
        [(1, [("b", 2.0), ("a", 1.0)]), (2, [])],
        "doc_id bigint, top array<struct<term:string,weight:double>>",
    )
    assert values(W.document_term_lines(top)) == ["1\tb a ", "2\t"]


def test_topic_reports(spark, tmp_path):
    lists = spark.createDataFrame(
        [(0, 0, [1, 2]), (0, 1, [30]), (2, 0, [4])], "topic int, part bigint, doc_ids array<bigint>"
    )
    W.write_lines(W.topic_document_lines(lists, 3).coalesce(1), str(tmp_path / "t"))
    text = next((tmp_path / "t").glob("part-*")).read_text()
    assert text == "Topic0:\t[1, 2]\n\nTopic0:\t[30]\n\nTopic1:\t[]\n\nTopic2:\t[4]\n\n"
    ranked = spark.createDataFrame(
        [(0, 2, "b", 5, 0.25), (0, 1, "a", 9, 0.5), (1, 1, "c", 7, 1.0)],
        "topic int, rank int, term string, doc_id bigint, weight double",
    )
    assert values(W.topic_word_lines(ranked)) == ["Topic0:\ta\tb\t\n", "Topic1:\tc\t\n"]
    assert values(W.topic_description_lines(ranked)) == ["Topic0:\na b \n", "Topic1:\nc \n"]
    assert values(W.topic_top_document_lines(ranked)) == [
        "Topic0:\t9:0.5,\n5:0.25,\n\n",
        "Topic1:\t7:1.0,\n\n",
    ]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from lexicarta import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Session(), "x")
