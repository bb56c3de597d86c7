import random

from lexicarta.operators.categories import category_documents
from lexicarta.operators.ids import contiguous_index, label_ranges, ranked_in_groups
from lexicarta.operators.labels import carried_forward, label_by_range


def test_contiguous_index_follows_the_order(spark):
    rng = random.Random(3)
    keys = [("hot", i) for i in range(500)] + [(rng.choice("abc"), i) for i in range(500)]
    rng.shuffle(keys)
    df = spark.createDataFrame(keys, "file string, pos bigint").repartition(7)
    found = contiguous_index(df, ["file", "pos"], "n").collect()
    assert {(r["file"], r["pos"]): r["n"] for r in found} == {k: i for i, k in enumerate(sorted(keys))}


def test_contiguous_index_of_nothing(spark):
    empty = spark.createDataFrame([], "a bigint")
    assert contiguous_index(empty, ["a"], "n").collect() == []


def test_label_ranges(spark):
    docs = spark.createDataFrame(
        [(5, "x"), (6, "x"), (7, "y"), (8, "z"), (9, "z")], "doc_id bigint, category string"
    )
    rows = [tuple(r) for r in label_ranges(docs).orderBy("label_id").collect()]
    assert rows == [("x", 1, 5, 6), ("y", 2, 7, 7), ("z", 3, 8, 9)]
    rows = [tuple(r) for r in label_ranges(docs, one_based=True).orderBy("label_id").collect()]
    assert rows == [("x", 1, 6, 7), ("y", 2, 8, 8), ("z", 3, 9, 10)]


def test_label_by_range_edges(spark):
    ranges = spark.createDataFrame(
        [("x", 1, 10, 19), ("y", 2, 20, 20), ("z", 3, 25, 30)],
        "category string, label_id int, start_id bigint, stop_id bigint",
    )
    docs = spark.createDataFrame([(i,) for i in range(0, 35)], "doc_id bigint")
    wide = docs.selectExpr("doc_id", "concat('t', doc_id) AS text", "'old' AS category")
    flat = docs.selectExpr("doc_id", "doc_id * 2 AS twice")
    for some in (docs, wide, flat):
        rows = label_by_range(some, ranges).collect()
        found = {r["doc_id"]: (r["split"], r["label"], r["category"]) for r in rows}
        assert len(rows) == len(found) == 35
        assert all(r["text"] == f"t{r['doc_id']}" for r in rows if "text" in r)
        assert all(r["twice"] == 2 * r["doc_id"] for r in rows if "twice" in r)
        assert found[0] == found[9] == ("test", None, None)
        assert found[10] == found[19] == ("train", 0, "x")
        assert found[20] == ("train", 1, "y")
        # in the gap the first range that stops later is meant
        assert found[21] == found[24] == found[25] == found[30] == ("train", 2, "z")
        assert found[31] == found[34] == (None, None, None)


def test_category_documents_come_in_chunks(spark):
    rows = [(i, "hot" if i % 3 else "cold", f"t{i}.") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, category string, text string")
    chunks = category_documents(docs, chunk_chars=20).orderBy("category", "chunk").collect()
    hot = [c for c in chunks if c["category"] == "hot"]
    assert "".join(c["text"] for c in hot) == "".join(t for i, c, t in rows if c == "hot")
    want, size = {}, 0
    for i, c, t in rows:
        if c == "hot":
            want.setdefault(size // 20, i)
            size += len(t)
    assert {c["chunk"]: c["first_id"] for c in hot} == want and len(want) > 3
    assert sum(c["n_docs"] for c in chunks) == 30


def test_a_category_that_fits_is_one_chunk(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "c", "t") for i in range(990, 1010)], "doc_id bigint, category string, text string")
    monkeypatch.setattr("lexicarta.operators.categories.BLOCK_IDS", 7)
    found = category_documents(docs, " ").collect()
    assert [(c["chunk"], c["first_id"], c["n_docs"], c["text"]) for c in found] == [(0, 990, 20, " ".join("t" * 20))]


def test_labels_are_positions(spark):
    ranges = spark.createDataFrame(
        [("x", 5, 0, 3), ("y", 9, 4, 7)], "category string, label_id int, start_id bigint, stop_id bigint"
    )
    docs = spark.createDataFrame([(1,), (4,)], "doc_id bigint")
    assert {r["doc_id"]: r["label"] for r in label_by_range(docs, ranges).collect()} == {1: 0, 4: 1}


def test_files_without_documents_have_a_label(spark):
    docs = spark.createDataFrame([(3, "a"), (4, "a"), (5, "c")], "doc_id bigint, category string")
    files = spark.createDataFrame([(c, f"/t/{c}.txt") for c in "abcd"], "category string, file string")
    rows = [tuple(r) for r in label_ranges(docs, categories=files).orderBy("label_id").collect()]
    assert rows == [("a", 1, 3, 4), ("b", 2, 5, 4), ("c", 3, 5, 5), ("d", 4, 6, 5)]
    found = label_by_range(docs.select("doc_id"), label_ranges(docs, categories=files)).collect()
    assert {r["doc_id"]: (r["label"], r["category"]) for r in found} == {3: (0, "a"), 4: (0, "a"), 5: (2, "c")}
    first = label_ranges(docs.where("category = 'c'"), True, files, first_id=5).orderBy("label_id").collect()
    assert [tuple(r) for r in first] == [("a", 1, 6, 5), ("b", 2, 6, 5), ("c", 3, 6, 6), ("d", 4, 7, 6)]
    nothing = label_ranges(docs.limit(0), categories=files, first_id=9).collect()
    assert {(r["start_id"], r["stop_id"]) for r in nothing} == {(9, 8)}


def test_many_small_ranges_meet_few_documents(spark):
    n = 100_000
    ranges = spark.range(n).selectExpr("'c' AS category", "cast(id + 1 AS int) AS label_id", "id AS start_id", "id AS stop_id")
    found = label_by_range(spark.range(n).withColumnRenamed("id", "doc_id"), ranges)
    assert found.where("label = doc_id").count() == n


def test_uneven_ranges_cost_no_more_than_even_ones(spark):
    """One wide range beside many of one id: each id meets its own range, and no pairs are formed."""
    n = 80_000
    narrow = spark.range(n).selectExpr("'c' AS category", "cast(id + 1 AS int) AS label_id", "id AS start_id", "id AS stop_id")
    wide = spark.createDataFrame(
        [("w", n + 1, n, 100 * n)], "category string, label_id int, start_id bigint, stop_id bigint"
    )
    docs = spark.range(n + 10).withColumnRenamed("id", "doc_id")
    found = label_by_range(docs, narrow.unionByName(wide))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()
    seen = found.selectExpr("count_if(label = least(doc_id, 80000)) AS right", "count(*) AS n").first()
    assert (seen["right"], seen["n"]) == (n + 10, n + 10)


def test_repeated_and_missing_ids_keep_their_rows(spark):
    ranges = spark.createDataFrame([("x", 1, 2, 3)], "category string, label_id int, start_id bigint, stop_id bigint")
    rows = [(2, "a"), (2, "b"), (None, "c"), (None, "d"), (1, "e"), (9, "f")]
    for kind in ("string", "int"):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        docs = docs if kind == "string" else docs.selectExpr("doc_id", "ascii(text) AS text")
        found = sorted((r["doc_id"] or 0, r["split"] or "", r["category"] or "") for r in label_by_range(docs, ranges).collect())
        assert found == [(0, "", ""), (0, "", ""), (1, "test", ""), (2, "train", "x"), (2, "train", "x"), (9, "", "")]


def test_no_ranges_and_no_documents(spark):
    ranges = spark.createDataFrame([], "category string, label_id int, start_id bigint, stop_id bigint")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    assert [tuple(r)[1:] for r in label_by_range(docs, ranges).collect()] == [(None, None, None)] * 2
    assert label_by_range(docs.limit(0), ranges).collect() == []


def test_carried_forward_across_partitions(spark):
    rows = [(i, i if i % 100 == 50 else None) for i in range(1000)]
    events = spark.createDataFrame(rows, "at int, value int").repartition(5)
    found = {r["at"]: r["value"] for r in carried_forward(events, ["at"], "value").collect()}
    want, last = {}, None
    for at, value in rows:
        last = value if value is not None else last
        want[at] = last
    assert found == want


def test_ranks_inside_groups(spark):
    rows = [("hot" if i % 5 else None, i * 7 % 1000) for i in range(1000)]
    found = ranked_in_groups(spark.createDataFrame(rows, "g string, v int").repartition(4), "g", ["v"]).collect()
    for group in ("hot", None):
        own = sorted(v for g, v in rows if g == group)
        assert {r["v"]: r["rank"] for r in found if r["g"] == group} == {v: i + 1 for i, v in enumerate(own)}
