import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexicarta.llm import queries, suffix_dedup, suffixes
from lexicarta.llm.suffixes import classified, leftmost_smaller, permuted_common_prefixes, suffix_array

WINDOW = 50


def plain(rows):
    """Every string of 50 bytes in a dictionary with its smallest document."""
    last = float("inf")
    docs = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    least = {}
    for doc_id, data in docs:
        rank = last if doc_id is None else doc_id
        for i in range(len(data) - WINDOW + 1):
            s = data[i : i + WINDOW]
            least[s] = min(rank, least.get(s, last))
    found = []
    for doc_id, data in docs:
        rank = last if doc_id is None else doc_id
        gone = bytearray(len(data))
        for i in range(len(data) - WINDOW + 1):
            if least[data[i : i + WINDOW]] < rank:
                gone[i : i + WINDOW] = b"\1" * WINDOW
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        found.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_same_as_all_strings(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = queries.op12_suffix_dedup(spark, folder)
    assert found.dtypes == [
        ("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")
    ]
    expected = plain(rows)
    assert sum(r[2] for r in expected) > 10_000
    assert collected(found) == expected


def mosaic(rng, n, pieces):
    """Texts put together from cuts of common passages, from fresh letters and from runs."""
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 8)):
            passage = rng.choice(pieces)
            low = rng.randint(0, len(passage) - 1)
            text.append(rng.choice([passage, passage[low : low + rng.randint(1, 120)], "é" * rng.randint(1, 70), "ab" * rng.randint(1, 60), str(rng.random())]))
        rows.append((rng.choice([i, i, i // 2, None, -i]), "".join(text)))
    return rows


@pytest.mark.parametrize("shard_bytes, part_keys, hot", [(4 << 20, 1 << 20, 2048), (700, 20, 2048), (130, 3, 2)])
def test_mosaics(spark, make_docs, monkeypatch, shard_bytes, part_keys, hot):
    rng = random.Random(shard_bytes)
    pieces = ["".join(rng.choice("abcdeß ") for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = mosaic(rng, 60, pieces)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(suffix_dedup, "PART_KEYS", part_keys)
    monkeypatch.setattr(suffix_dedup, "HOT_UNITS", hot)
    monkeypatch.setattr(suffixes, "FEW", 4)
    assert collected(suffix_dedup.removed(make_docs(rows).repartition(3))) == plain(rows)


def test_awkward_rows(spark, make_docs, awkward):
    extra = [(30, "\x00" * 200), (31, "\x00" * 120), (32, "x" * 49), (33, "x" * 50), (34, "x" * 51), (29, "x" * 50)]
    assert collected(suffix_dedup.removed(make_docs(awkward + extra))) == plain(awkward + extra)


def test_no_rows(spark, make_docs):
    assert suffix_dedup.removed(make_docs([])).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    assert collected(suffix_dedup.removed(make_docs([(1, None), (2, "")]))) == [(1, 0, 0, 0, empty), (2, 0, 0, 0, empty)]


def test_a_passage_in_all_documents(spark, make_docs):
    """Every shard sends a common passage once; what stands around it differs."""
    rng = random.Random(5)
    passage = "".join(rng.choice("klmnop ") for _ in range(300))
    rows = [(i, f"{rng.random()}{passage}{rng.random()}") for i in range(400)]
    found = collected(suffix_dedup.removed(make_docs(rows).repartition(8)))
    assert found == plain(rows)
    assert sum(r[2] >= 300 for r in found) == 399


def test_texts_are_not_shuffled(spark, make_docs):
    plan = suffix_dedup.removed(make_docs([(i, "abc " * 40) for i in range(50)]))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "Bucketed: true" in text
    moved = [line for line in text.splitlines() if "Exchange" in line]
    assert moved and not any("text" in line for line in moved)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.integers(1, 3), st.sampled_from([0, 6, 1 << 17]))
def test_suffix_array(symbols, times, few):
    suffixes.FEW = few
    text = np.array(symbols * times + [0], dtype=np.uint8)
    raw = text.tobytes()
    array = suffix_array(text, 5)
    assert list(array) == sorted(range(len(raw)), key=lambda i: raw[i:])
    common = permuted_common_prefixes(text, array)
    for at, before in zip(array[1:], array[:-1]):
        n = 0
        while raw[at + n : at + n + 1] == raw[before + n : before + n + 1] != b"":
            n += 1
        assert common[at] == n
    smaller = classified(text)
    assert list(smaller) == [raw[i:] < raw[i + 1 :] if i + 1 < len(raw) else True for i in range(len(raw))]
    assert list(leftmost_smaller(smaller)) == [i for i in range(1, len(raw)) if smaller[i] and not smaller[i - 1]]


@pytest.fixture(autouse=True)
def usual_length():
    yield
    suffixes.FEW = 1 << 17


def test_suffix_array_of_many_symbols():
    suffixes.FEW = 10
    rng = np.random.default_rng(2)
    text = np.append(np.tile(rng.integers(1, 70_000, 3000), 3), 0)
    names = np.unique(text, return_inverse=True)[1]
    array = suffix_array(names, int(names.max()) + 1)
    raw = [tuple(names[i : i + 3100]) for i in array]
    assert sorted(array) == list(range(len(names))) and raw == sorted(raw)
