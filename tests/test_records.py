import random

import pytest

from lexicarta.operators.records import (
    ARTICLE,
    PATENT,
    extract_records,
    strip_stop_words,
    strip_stop_words_by_join,
)
from lexicarta.sources.readers import read_lines
from pyspark.sql import functions as F


def frame(spark, lines, block=3, file="f.txt"):
    rows = [(file, i // block, i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, block bigint, pos bigint, line string")


def texts(spark, lines, layout, block=3, **options):
    records = extract_records(frame(spark, lines, block), layout, **options)
    return [r["text"] for r in records.orderBy("file", "block", "record").collect()]


def expected(lines, layout, joiner, keep_unclosed):
    """Records by slicing: cut at closing lines, then look at each piece alone."""
    cuts = [i for i, line in enumerate(lines) if len(line) <= layout.close_length]
    bounds = list(zip([-1] + cuts, cuts + ([len(lines)] if keep_unclosed else [])))
    found = []
    for low, high in bounds:
        piece = [line for line in lines[low + 1 : high] if len(line.rstrip(" ").split(" ")) > 1]
        heads = [line.split(" ")[0] for line in piece]
        starts = [i for i, head in enumerate(heads) if head == layout.tag]
        if not starts:
            continue
        tail = range(starts[-1] + 1, len(piece))
        stop = next((i for i in tail if heads[i] != ""), len(piece))
        body = [line.lower().strip() for line in piece[starts[-1] : stop]]
        text = joiner.join([body[0][layout.cut :]] + body[1:])
        if text:
            found.append(text)
    return found


def test_start_append_and_stop(spark):
    lines = ["AB One two", "   three FOUR", "TI some title", "   more title", ""]
    assert texts(spark, lines, ARTICLE) == ["one two three four"]
    assert texts(spark, lines, ARTICLE, joiner="") == ["one twothree four"]


def test_word_only_line_keeps_the_state(spark):
    assert texts(spark, ["AB one two", "word", "  more here", ""], ARTICLE) == ["one two more here"]


def test_later_start_replaces_the_earlier(spark):
    lines = ["AB first text", "  and more", "TI title x", "AB second text", "  end it", ""]
    assert texts(spark, lines, ARTICLE) == ["second text end it"]


def test_unclosed_last_record(spark):
    lines = ["AB one two", "", "AB three four"]
    assert texts(spark, lines, ARTICLE) == ["one two", "three four"]
    assert texts(spark, lines, ARTICLE, keep_unclosed=False) == ["one two"]


def test_tag_is_case_sensitive(spark):
    assert texts(spark, ["ABD    upper text", "         ", "abd    lower text", "end"], PATENT) == [
        "lower text"
    ]


def test_start_shorter_than_the_cut_does_not_fail(spark):
    lines = ["abd xy     ", "   continued text", "end", "abd    next text", "end"]
    assert texts(spark, lines, PATENT) == ["continued text", "next text"]


@pytest.mark.parametrize("layout", [ARTICLE, PATENT])
@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_any_block_size_gives_the_same_records(spark, layout, block):
    rng = random.Random(block)
    tag = layout.tag.ljust(layout.cut)
    kinds = [
        tag + "start %d of text",
        "    continued %d text line",
        "TI title %d field",
        "single%dwordonly",
        "",
        "x",
        "AU other %d field here",
        "    deep %d   spaced  text   ",
    ]
    weights = [3, 6, 2, 1, 2, 1, 1, 2]
    lines = [
        kind % i if "%d" in kind else kind
        for i, kind in enumerate(rng.choices(kinds, weights, k=300))
    ]
    for joiner, keep in (("", False), (" ", True)):
        assert texts(
            spark, lines, layout, block, joiner=joiner, keep_unclosed=keep
        ) == expected(lines, layout, joiner, keep)


def test_one_record_over_many_blocks(spark):
    lines = ["AB begin here"] + [f"   part {i}" for i in range(50)] + [""]
    whole = "begin here " + " ".join(f"part {i}" for i in range(50))
    assert texts(spark, lines, ARTICLE, block=4) == [whole]


def test_files_are_independent(spark):
    lines = frame(spark, ["AB one two"], file="a").unionByName(
        frame(spark, ["  cont inued", "", "AB b text", ""], file="b")
    )
    found = extract_records(lines, ARTICLE).orderBy("file").collect()
    assert [(r["file"], r["text"]) for r in found] == [("a", "one two"), ("b", "b text")]


def test_large_file_is_read_in_splits(spark, tmp_path):
    """Records cut by split boundaries come out whole, in file order."""
    lines = []
    for i in range(400):
        lines += [f"AB start {i} text", f"   more of {i} here", "TI title of it", ""]
    (tmp_path / "big.txt").write_text("\r\n".join(lines) + "\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        read = read_lines(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 10
        records = extract_records(read, ARTICLE).orderBy("file", "block", "record")
        found = [r["text"] for r in records.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == [f"start {i} text more of {i} here" for i in range(400)]


def test_strip_stop_words(spark):
    records = spark.createDataFrame(
        [(1, "the cat  is a mat"), (2, "the a"), (3, "x 😀 yy")], "id int, text string"
    )
    stripped = records.withColumn("text", strip_stop_words(F.col("text"), ["the", "is"], " "))
    assert [r["text"] for r in stripped.orderBy("id").collect()] == ["cat mat", "", "😀 yy"]
    glued = records.withColumn("text", strip_stop_words(F.col("text"), ["the", "is"], ""))
    assert [r["text"] for r in glued.orderBy("id").collect()] == ["catmat", "", "😀yy"]
    stops = spark.createDataFrame([("the",), ("is",)], "term string")
    joined = strip_stop_words_by_join(records, ["id"], stops, " ")
    assert [r["text"] for r in joined.orderBy("id").collect()] == ["cat mat", "", "😀 yy"]


def test_a_compressed_file_is_read_in_blocks(spark, tmp_path):
    """The rows of a compressed file are those of the plain one, also where blocks cut records."""
    import gzip

    rng = random.Random(6)
    lines = []
    for i in range(400):
        lines += [f"AB start{i} text"] + [f"  more {i} {j}" for j in range(rng.randint(0, 9))]
        lines += ["TI other words"] * rng.randint(0, 2) + [""] * rng.randint(1, 2)
    body = "\n".join(lines) + "\nAB unclosed text\n"
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    (tmp_path / "plain" / "r.txt").write_text(body)
    with gzip.open(tmp_path / "packed" / "r.txt.gz", "wt") as file:
        file.write(body)
    plain = [r["text"] for r in extract_records(read_lines(spark, str(tmp_path / "plain")), ARTICLE).orderBy("file", "block", "record").collect()]
    assert len(plain) == 401
    for block_lines in (7, 100):
        blocks = read_lines(spark, str(tmp_path / "packed"), block_lines)
        assert blocks.select("block").distinct().count() > 20
        found = extract_records(blocks, ARTICLE).orderBy("file", "block", "record")
        assert [r["text"] for r in found.collect()] == plain
        shuffled = found._jdf.queryExecution().executedPlan().toString()
        assert "edge" in shuffled
    compat = extract_records(read_lines(spark, str(tmp_path / "packed"), 7), ARTICLE, keep_unclosed=False)
    assert compat.count() == 400
