import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexicarta.llm import quality_rules

from .conftest import sentence


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
    )


def texts():
    rng = random.Random(4)
    made = ["", " \n\t", "a", "a a a", "a b c a b c", "x\nx\n\nx\ny\n \n ", "#*$ <> |é𝒳", "a\x1cb a\x0bb c d", "\r\nq\r\nq"]
    for _ in range(120):
        made.append("".join(rng.choice(["a", "b", "é ", " ", "\n", "a b c\n", "##", "\t", "\x0c"]) for _ in range(rng.randint(0, 80))))
    return made


def test_base_counts_against_brute_force():
    made = texts()
    counts, statistics = quality_rules.statistics(pa.array(made))
    assert [tuple(r) for r in counts.tolist()] == [base(t) for t in made]
    assert np.isfinite(statistics).all()


def test_judged_rows(make_docs, awkward):
    rows = quality_rules.judged(make_docs(awkward), None).select("doc_id", "text", "rules.*").collect()
    assert len(rows) == len(awkward)
    for r in rows:
        own = base(r.text)
        assert tuple(r[n] for n in quality_rules.BASE) == own
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert r.kept == (not r.base_failed)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.STATISTICS)))
    y = (x[:, 2] + 0.5 * x[:, 0] * x[:, 3] + rng.normal(0, 0.1, 3000) < 0.7).astype(float)
    return x, y


def test_trees_learn_and_stay_monotonic(sample):
    x, y = sample
    signs = np.array(list(quality_rules.STATISTICS.values()))
    forest = quality_rules.grow(x[:2000], y[:2000], np.ones(2000), signs)
    right = (forest.probability(x[2000:]) >= 0.5) == y[2000:]
    assert right.mean() > 0.9
    for j in np.flatnonzero(signs):
        moved = np.repeat(x[:50], 40, axis=0)
        moved[:, j] = np.tile(np.linspace(-0.2, 1.2, 40), 50)
        steps = np.diff(forest.probability(moved).reshape(50, 40), axis=1)
        assert (signs[j] * steps >= -1e-12).all()


def test_flat_nodes_equal_a_walk_down_each_tree(sample):
    x, y = sample
    forest = quality_rules.grow(x[:500], y[:500], np.ones(500), np.zeros(x.shape[1], int))

    def walk(row):
        total = forest.start
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.limit[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert forest.probability(x[:40]) == pytest.approx([walk(r) for r in x[:40]])


def test_trained_on_labels(spark, make_docs):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        text = sentence(rng, 80)
        rows.append((i, " ".join(w + "###" for w in text.split()) if i % 4 == 0 else text))
    labels = spark.createDataFrame(
        [(i, int(i % 4 != 0)) for i in range(600)] + [(None, 0), (5, 0), (7, None), (8, 3)], "doc_id bigint, quality int"
    )
    forest = quality_rules.train(make_docs(rows), labels)
    got = quality_rules.judged(make_docs(rows), forest).select("doc_id", "rules.kept").collect()
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in got) >= 597
    assert quality_rules.train(make_docs(rows), labels.where("quality = 1")) is None
    assert quality_rules.train(make_docs(rows), labels.limit(0)) is None
    assert quality_rules.judged(make_docs([]), forest).count() == 0
