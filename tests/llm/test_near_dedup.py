import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexicarta.llm import near_dedup

from .conftest import sentence


def shingle_counts(text):
    words = (text or "").lower().split()
    n = max(len(words) - 4, 1 if words else 0)
    return Counter(tuple(words[i : i + 5]) for i in range(n))


def jaccard(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[i] / a[d], b[i] / b[d]) for i in a.keys() | b.keys())
    return total


def brute_classes(rows, threshold=0.8):
    sets = [shingle_counts(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            equal = (rows[i][1] or "").lower().split() == (rows[j][1] or "").lower().split()
            if equal or jaccard(sets[i], sets[j]) >= threshold - 1e-12:
                label[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return Counter(tuple(sorted(g, key=lambda x: (x is None, x))) for g in groups.values())


def found_classes(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.class_id, r.class_check)].append(r.doc_id)
    for members in groups.values():
        members.sort(key=lambda x: (x is None, x))
    assert all(r.class_size == len(groups[(r.class_id, r.class_check)]) for r in rows)
    return Counter(map(tuple, groups.values()))


def near_copies(seed=0, groups=12):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = sentence(rng, rng.choice([8, 40, 150])).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(["changed", "other", "new"])
            rows.append((len(rows), " ".join(copy)))
    line = sentence(rng, 60)  # a passage that otherwise different texts share
    rows += [(len(rows) + i, line + " " + sentence(rng, 60)) for i in range(8)]
    rows += [(1000, "w " * 50), (1001, "w " * 60), (1002, "w v " * 30), (1003, None), (1004, " "), (None, "a b"), (5, "a b")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_classes_against_all_pairs(make_docs, seed):
    rows = near_copies(seed)
    got = near_dedup.classes(make_docs(rows).repartition(4)).collect()
    assert found_classes(got) == brute_classes(rows)


def test_awkward_rows(make_docs, awkward):
    docs = make_docs(awkward)
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(awkward)
    assert found_classes(got) == brute_classes([(d, (t or "")[:4000]) for d, t in awkward])
    left = near_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    first = {(r.class_id, r.class_check) for r in got}
    assert len(left.collect()) == len(first)


def test_a_large_group_links_without_pairs_of_all(make_docs):
    rng = random.Random(5)
    words = sentence(rng, 120).split()
    rows = []
    for i in range(600):
        copy = list(words)
        copy[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.classes(make_docs(rows)).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(0, 600)}
    assert sum(r.links for r in got) < 2 * 600 * 10


def test_copies_that_only_their_original_joins(make_docs):
    """1,000 copies of 4 changed words each: 0.82 to the original, mostly less than 0.8 to each other."""
    rng = random.Random(8)
    original = [f"{w}{i}" for i, w in enumerate(sentence(rng, 200).split())]
    texts = [original]
    for i in range(1000):
        copy = list(original)
        for k, at in enumerate(rng.sample(range(200), 4)):
            copy[at] = f"v{i}x{k}"
        texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(196)} for t in texts]
    near = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert min(near) >= 0.8
    among = [len(a & b) / len(a | b) for a, b in zip(sets[1:], sets[2:])]
    assert sum(x < 0.8 for x in among) > 950
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_dedup.classes(make_docs(rows).repartition(4)).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(0, 1001)}


def edited(rng, original, changes, tag):
    copy = list(original)
    for k, at in enumerate(rng.sample(range(len(copy)), changes)):
        copy[at] = f"v{tag}x{k}"
    return copy


def test_links_between_copies_too_far_from_their_original(make_docs, monkeypatch):
    """A group of copies at 0.6 to 0.75 to each other, in which some pairs share most of their edits."""
    monkeypatch.setattr(near_dedup, "FEW", 1)
    rng = random.Random(3)
    original = [f"{w}{i}" for i, w in enumerate(sentence(rng, 300).split())]
    texts = [original]
    for i in range(300):
        copy = edited(rng, original, rng.randint(9, 12), i)
        texts.append(copy)
        if i % 6 == 0:
            texts.append(edited(rng, copy, 2, f"{i}y"))
    sets = [{tuple(t[i : i + 5]) for i in range(296)} for t in texts]
    linked = {
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    }
    assert 45 <= len(linked) < 200
    made = []
    whole = near_dedup.finer
    monkeypatch.setattr(near_dedup, "finer", lambda *a: made.append(whole(*a)) or made[-1])
    got = near_dedup.classes(make_docs([(i, " ".join(t)) for i, t in enumerate(texts)]).repartition(4)).collect()
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in sorted(linked):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in range(len(texts))}
    assert made, "the buckets were made finer"
    pairs = made[0].groupBy("key").count().selectExpr("sum(count * (count - 1) / 2) AS n").first()["n"]
    assert pairs < len(texts) ** 2 / 4


def test_links_that_finer_buckets_miss(make_docs, monkeypatch):
    """Two copies alike, too far from their original, and finer buckets in which nobody meets."""
    monkeypatch.setattr(near_dedup, "FEW", 1)
    rng = random.Random(4)
    original = [f"{w}{i}" for i, w in enumerate(sentence(rng, 300).split())]
    texts = [original] + [edited(rng, original, rng.randint(13, 15), i) for i in range(200)]
    texts += [edited(rng, t, 2, f"{i}y") for i, t in enumerate(texts[::9])]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    missed = []
    monkeypatch.setattr(near_dedup, "finer", lambda held, *a: missed.append(1) or held.select("rep", "key").limit(0))
    got = near_dedup.classes(make_docs(rows).repartition(4)).collect()
    sets = [{tuple(t[i : i + 5]) for i in range(296)} for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    groups = defaultdict(list)
    for i, x in enumerate(label):
        groups[x].append(i)
    assert missed and len(groups) < len(rows) - 10
    assert found_classes(got) == Counter(map(tuple, groups.values()))


@pytest.mark.parametrize("seed", range(2))
def test_classes_by_blocks(make_docs, monkeypatch, seed):
    """All buckets compared in blocks of few members, repeated shingles too; no pair is verified before."""
    monkeypatch.setattr(near_dedup, "PAIRED", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    nothing = "a binary, b binary, similarity double"
    monkeypatch.setattr(
        near_dedup, "linked", lambda pairs, texts, nodes, *a, **k: (
            pairs.sparkSession.createDataFrame([], nothing), nodes.select("rep", near_dedup.F.col("rep").alias("label"))
        )
    )
    rows = near_copies(seed, groups=8)
    rows += [(2000 + i, " ".join(["ring bell toll chime peal"] * (20 + i // 2) + ["end"] * (i % 2))) for i in range(12)]
    got = near_dedup.classes(make_docs(rows).repartition(4)).collect()
    assert found_classes(got) == brute_classes(rows)


def test_private_shingles():
    a, b = np.array([1, 3, 5, 7, 2, 3], np.uint64), np.array([0, 0, 0, 0, 1, 1])
    common = np.array([3, 4, 7, 2, 3], np.uint64), np.array([0, 0, 0, 1, 1])
    owner, item = near_dedup.private(b, a, common[1], common[0], 3)
    assert list(owner) == [0, 0, 0] and len(set(item)) == 3
    again = near_dedup.private(np.array([1]), np.array([4], np.uint64), np.zeros(0, int), np.zeros(0, np.uint64), 2)
    assert list(again[0]) == [1] and again[1][0] not in item  # had, not lacked


def test_all_members_of_a_bucket_meet(spark):
    """A link that is seen in one large bucket alone, where neither end is a hub."""
    rng = random.Random(6)
    texts = [sentence(rng, 60) for _ in range(60)]
    texts[41] = texts[17] + " end"
    rep = [bytes([i]) for i in range(60)]
    buckets = spark.createDataFrame([(r, 1) for r in rep], "rep binary, key bigint")
    table = spark.createDataFrame(list(zip(rep, texts)), "rep binary, text string")
    met = spark.createDataFrame([(rep[0], rep[1], 1)], "a binary, b binary, bands bigint")
    nodes = table.select("rep")
    known = near_dedup.linked(met, table, nodes, 0.8)
    links, labels = near_dedup.settled(buckets, met, table, nodes, 0.8, known)
    assert [(r.a[0], r.b[0]) for r in links.collect()] == [(17, 41)]
    assert {r.rep[0]: r.label[0] for r in labels.collect()} == {i: 17 if i == 41 else i for i in range(60)}


def test_registers_agree_as_often_as_the_index_says():
    rng = random.Random(2)
    a = sentence(rng, 300).split()
    b = a[:230] + sentence(rng, 90).split() + a[:20]
    texts = pa.array([" ".join(a), " ".join(b)])
    owner, value, weight = near_dedup.shingles(texts)
    signed = near_dedup.signatures(owner, value, weight, 2, 6000)
    exact = jaccard(shingle_counts(texts[0].as_py()), shingle_counts(texts[1].as_py()))
    cut = np.searchsorted(owner, 1)
    assert near_dedup.similarity((value[:cut], weight[:cut]), (value[cut:], weight[cut:])) == pytest.approx(exact)
    assert (signed[0] == signed[1]).mean() == pytest.approx(exact, abs=0.03)


@pytest.mark.parametrize("seed", range(20))
def test_exact_index_of_weighted_sets(seed):
    rng = random.Random(seed)
    sets = [{k: rng.randint(1, 5) for k in rng.sample(range(12), rng.randint(1, 9))} for _ in range(2)]
    arrays = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)])) for s in sets]
    assert near_dedup.similarity(*arrays) == pytest.approx(jaccard(Counter(sets[0]), Counter(sets[1])))


def test_chains_are_one_component(spark):
    nodes = spark.createDataFrame([(bytes([i]),) for i in range(40)], "rep binary")
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(30) if i != 20], "a binary, b binary")
    got = {r.rep[0]: r.label[0] for r in near_dedup.components(nodes, links).collect()}
    assert got == {i: 0 if i <= 20 else 21 if i <= 30 else i for i in range(40)}


def test_empty_table(make_docs):
    assert near_dedup.classes(make_docs([])).count() == 0
    assert near_dedup.deduplicate(make_docs([])).count() == 0
