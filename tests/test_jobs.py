import re

import pytest

from lexicarta.__main__ import main
from lexicarta.sources import readers as R

WORDS = "robot joint motor sensor blood tissue cell culture matrix layer".split()


def abstract(i):
    group = WORDS[:5] if i % 2 else WORDS[4:]
    return [group[(i + j) % len(group)] for j in range(3)], [group[(i * j) % len(group)] for j in range(4)]


def write_records(path, name, ids, tag):
    lines = []
    for i in ids:
        first, more = abstract(i)
        lines += [f"{tag} {' '.join(first)}", f"   {' '.join(more)}", "TI other field", ""]
    (path / name).write_text("\n".join(lines) + "\n")


def lines_of(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for kind, tag in (("article", "AB"), ("patent", "abd   ")):
        (root / kind / "source").mkdir(parents=True)
        (root / kind / "train").mkdir()
        write_records(root / kind / "source", "new.txt", range(0, 6), tag)
        write_records(root / kind / "train", "first class.txt", range(6, 16), tag)
        write_records(root / kind / "train", "other.txt", range(16, 20), tag)
    return root


@pytest.mark.parametrize("kind", ["article", "patent"])
@pytest.mark.parametrize("compat", [False, True])
def test_all_three_jobs(spark, folders, tmp_path, kind, compat):
    flag = ["--compat"] if compat else []
    out = str(tmp_path)
    source, train = str(folders / kind / "source"), str(folders / kind / "train")
    main(["extract", "--layout", kind, "--source", source, "--train", train, "--out", out, *flag])
    texts = {}
    for line in lines_of(tmp_path / "documents"):
        doc_id, text = line.split("\t")
        texts[int(doc_id)] = text
    joiner = "" if compat and kind == "article" else " "
    glue = "" if compat else " "
    for i in range(20):
        first, more = abstract(i)
        want = (" ".join(first) + glue + " ".join(more)).split(" ")
        assert texts[i] == joiner.join(want)
    assert sorted(texts) == list(range(20))
    train_ids = [int(line.split("\t")[0]) for line in lines_of(tmp_path / "train_documents")]
    assert sorted(train_ids) == list(range(6, 20))
    assert sorted(lines_of(tmp_path / "label_ranges")) == (
        ["first class\t1\t7\t16", "other\t2\t17\t20"]
        if compat
        else ["first class\t1\t6\t15", "other\t2\t16\t19"]
    )
    lines = [line.split("\t") for line in lines_of(tmp_path / "category_documents")]
    if not compat:
        assert [line[:2] for line in lines] == [["first class", "0"], ["other", "0"]]
    categories = {line[-2]: line[-1] for line in lines}
    assert sorted(categories) == (["0", "16", "6"] if compat else ["16", "6"])
    between = "" if compat else " "
    assert categories["16"] == between.join(texts[i] for i in range(16, 20))

    main(
        ["features", "--documents", f"{out}/documents", "--label-ranges", f"{out}/label_ranges",
         "--out", out, "--top", "5", *flag]
    )
    vectors = {r["doc_id"]: r["entries"] for r in R.read_vectors(spark, f"{out}/vectors").collect()}
    terms = {r["term_id"]: r["term"] for r in R.read_dictionary(spark, f"{out}/dictionary").collect()}
    assert sorted(terms) == list(range(len(terms)))
    assert sorted(vectors) == list(range(20))
    if compat:
        assert not (tmp_path / "train_vectors").exists()
    else:
        tests = {r["doc_id"] for r in R.read_vectors(spark, f"{out}/test_vectors").collect()}
        assert tests == set(range(6))
        for i, entries in vectors.items():
            assert {terms[e["term_id"]] for e in entries} == set(texts[i].split(" "))
        labels = [line.split(" ")[0] for line in lines_of(tmp_path / "train_vectors")]
        assert sorted(labels) == ["0"] * 10 + ["1"] * 4
    tops = lines_of(tmp_path / "document_terms")
    assert len(tops) == 20
    assert all(re.fullmatch(r"\d+\t(\S+ ){0,5}", line) for line in tops)
    if compat:
        assert all(len(line.split("\t")[1].split()) == min(5, len(terms)) for line in tops)

    if kind == "article" and compat:
        return  # glued words are too few for a topic model
    main(
        ["topics", "--vectors", f"{out}/vectors", "--dictionary", f"{out}/dictionary", "--k", "2",
         "--max-iter", "5", "--top-documents", "3", "--top", "4", "--out", out, *flag]
    )
    listed = [line for line in lines_of(tmp_path / "topic_documents") if line]
    ids = [int(i) for line in listed for i in re.findall(r"\d+", line.split("\t")[1])]
    assert sorted(ids) == sorted(vectors)
    words = [line for line in lines_of(tmp_path / "topic_words") if line]
    assert [line.split("\t")[0] for line in words] == ["Topic0:", "Topic1:"]
    assert all(len(line.split("\t")) == 6 for line in words)
    tops = "\n".join(lines_of(tmp_path / "topic_top_documents"))
    assert len(re.findall(r"\d+:\d\.\d+(?:E-\d+)?,", tops)) == 6
    assert lines_of(tmp_path / "topic_descriptions")[0] == "Topic0:"


def test_extract_needs_a_folder(spark, tmp_path):
    with pytest.raises(ValueError):
        main(["extract", "--layout", "patent", "--out", str(tmp_path)])


def test_run_does_all_three(spark, folders, tmp_path):
    main(
        ["run", "--layout", "patent", "--source", str(folders / "patent" / "source"), "--train",
         str(folders / "patent" / "train"), "--k", "2", "--max-iter", "3", "--min-token", "6",
         "--out", str(tmp_path)]
    )
    outputs = {p.name for p in tmp_path.iterdir()}
    assert outputs == {
        "documents", "train_documents", "category_documents", "label_ranges", "vectors",
        "train_vectors", "test_vectors", "dictionary", "document_terms", "topic_documents", "topic_words",
        "topic_top_documents", "topic_descriptions",
    }
    words = {line.split("\t")[0] for line in lines_of(tmp_path / "dictionary")}
    assert words == {w for w in WORDS if len(w) > 5}


@pytest.mark.parametrize("given", ["train", "source"])
@pytest.mark.parametrize("compat", [False, True])
def test_run_on_one_folder_keeps_every_document(spark, folders, tmp_path, given, compat):
    flag = ["--compat"] if compat else []
    (folders / "patent" / "train" / "empty.txt").write_text("")
    main(
        ["run", "--layout", "patent", f"--{given}", str(folders / "patent" / given), "--k", "2", "--max-iter", "3",
         "--out", str(tmp_path), *flag]
    )
    n = 14 if given == "train" else 6
    vectors = [r["doc_id"] for r in R.read_vectors(spark, str(tmp_path / "vectors")).collect()]
    assert sorted(vectors) == list(range(n))
    listed = [int(i) for line in lines_of(tmp_path / "topic_documents") if line for i in re.findall(r"\d+", line.split("\t")[1])]
    assert sorted(listed) == list(range(n))
    ranges = sorted(lines_of(tmp_path / "label_ranges"))
    if given == "train":
        shift = int(compat)
        assert ranges == [f"empty\t1\t{shift}\t{shift - 1}", f"first class\t2\t{shift}\t{9 + shift}", f"other\t3\t{10 + shift}\t{13 + shift}"]
    else:
        assert ranges == []


def test_documents_above_the_ranges_are_kept(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    (tmp_path / "documents" / "a.txt").write_text("".join(f"{i}\trobot joint motor\n" for i in range(9)))
    (tmp_path / "ranges").mkdir()
    (tmp_path / "ranges" / "a.txt").write_text("x\t1\t2\t4\n")
    main(["features", "--documents", str(tmp_path / "documents"), "--label-ranges", str(tmp_path / "ranges"), "--out", str(tmp_path)])
    assert len(lines_of(tmp_path / "vectors")) == 9
    assert len(lines_of(tmp_path / "train_vectors")) == 3 and len(lines_of(tmp_path / "test_vectors")) == 2


def test_jobs_delete_their_scratch(spark, folders, tmp_path):
    from lexicarta.session import scratch_path

    scratch = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    import pathlib

    before = {p.name for p in pathlib.Path(scratch).glob("*")}
    source = str(folders / "patent" / "source")
    main(["run", "--layout", "patent", "--source", source, "--k", "2", "--max-iter", "2", "--out", str(tmp_path)])
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        main(["topics", "--vectors", str(tmp_path / "none"), "--dictionary", str(tmp_path / "none"), "--out", str(tmp_path / "o")])
    assert {p.name for p in pathlib.Path(scratch).glob("*")} == before
