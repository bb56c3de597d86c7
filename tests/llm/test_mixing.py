import random
from collections import Counter
from fractions import Fraction

import pytest

from lexicarta.llm import mixing


@pytest.mark.parametrize("seed", range(6))
def test_every_source_stays_within_a_block_of_its_weight(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.choice([1, 2, 5, 40, 0.01]) * rng.random() + 1e-4 for i in range(rng.randint(1, 40))}
    counts, period = mixing.quantised(weights, 512)
    assert sum(counts.values()) == period and min(counts.values()) >= 1
    total = sum(weights.values())
    assert all(abs(counts[s] - weights[s] / total * period) < len(weights) + 1 for s in weights)
    names = list(counts)
    slots = mixing.pfair_period([counts[s] for s in names], period)
    done = Counter()
    for slot, (source, block) in enumerate(slots, 1):
        assert block == done[source]
        done[source] += 1
        for i, s in enumerate(names):
            assert abs(done[i] - Fraction(counts[s] * slot, period)) < 1
    assert [done[i] for i in range(len(names))] == [counts[s] for s in names]


def test_quantised_edge_cases():
    assert mixing.quantised({}, 8) == ({}, 8)
    assert mixing.quantised({None: 3.0}, 8) == ({None: 8}, 8)
    with pytest.raises(ValueError):
        mixing.quantised({"a": 0.0, "b": 1.0})


def _rows(n):
    rng = random.Random(1)
    sources = ["big"] * 6 + ["a", "b", None, ""]
    return [(i, "x" * rng.randint(0, 90), rng.choice(sources)) for i in range(n)] + [(None, None, None)] * 3


def test_places_match_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    rows = _rows(1500)
    docs = make_docs(rows)
    weights = {"big": 1, "a": 2, "b": 1, None: 1, "": 0.5}
    got = mixing.placed(docs, weights, block=200, period=64).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter(
        (d, s, max(1, len(t or ""))) for d, t, s in rows
    )
    counts, period = mixing.quantised(weights, 64)
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    where = {sk: slot for slot, sk in enumerate(mixing.pfair_period([counts[s] for s in names], period))}
    for source in names:
        own = sorted((r for r in got if r.source == source), key=lambda r: (r.block, r.place))
        start = 0
        for r in own:  # documents of a source follow each other without gaps
            assert r.block * 200 + r.place == start
            start += r["size"]
            turn, k = divmod(r.block, counts[source])
            assert r.slot == turn * period + where[(names.index(source), k)]
    # While every source lasts, shares of text are within a block of the weights.
    end = min(max(r.slot for r in got if r.source == s) for s in names)
    for s in names:
        blocks = len({r.slot for r in got if r.source == s and r.slot < end})
        assert abs(blocks - counts[s] * end / period) <= 1 + 1e-9


def test_mix_returns_all_rows_in_order(make_docs):
    rows = _rows(400)
    docs = make_docs(rows)
    mixed = mixing.mix(docs, block=100, period=64)
    assert mixed.columns == docs.columns
    got = [(r.doc_id, r.text, r.source) for r in mixed.collect()]
    assert Counter(got) == Counter(rows)
    places = mixing.placed(docs, block=100, period=64).where("copy = 1").collect()
    slot = {(r.doc_id, r.source, r["size"]): (r.slot, r.place) for r in places}
    order = [slot[(d, s, max(1, len(t or "")))] for d, t, s in got]
    assert order == sorted(order)


def test_missing_weight_and_empty_table(make_docs):
    with pytest.raises(ValueError):
        mixing.placed(make_docs([(1, "x", "a")]), {"b": 1})
    assert mixing.placed(make_docs([])).count() == 0
    assert mixing.mix(make_docs([])).count() == 0


def test_copies_of_a_row_advance_their_source(make_docs, monkeypatch):
    """A third of all rows are copies of one: they fill blocks one after the other, as other rows do."""
    monkeypatch.setattr(mixing, "SPREAD", 100)
    rows = [(None, "x" * 1000, "a")] * 3000 + [(i, "y" * 1000, "ab"[i % 2]) for i in range(6000)]
    got = mixing.placed(make_docs(rows).repartition(6), {"a": 2, "b": 1}, block=1 << 14, period=64).collect()
    assert Counter((r.doc_id, r.source, r.copy) for r in got if r.doc_id is None) == Counter((None, "a", i + 1) for i in range(3000))
    for source in "ab":
        own = sorted((r.block, r.place) for r in got if r.source == source)
        assert [b * (1 << 14) + p for b, p in own] == [1000 * i for i in range(len(own))]
    per_slot = Counter()
    for r in got:
        per_slot[r.slot] += 1
    assert max(per_slot.values()) <= 17
    counts, _ = mixing.quantised({"a": 2, "b": 1}, 64)
    end = min(max(r.slot for r in got if r.source == s) for s in "ab")
    for s in "ab":
        blocks = len({r.slot for r in got if r.source == s and r.slot < end})
        assert abs(blocks - counts[s] * end / 64) <= 1 + 1e-9


def test_rows_meet_their_slots(make_docs):
    rows = _rows(300) + [(7, "same", "a")] * 5
    docs = make_docs(rows)
    places = mixing.placed(docs, block=100, period=64)
    slim = mixing.sized(docs).select("row", "doc_id", "source", "size")
    met = mixing.slots_of(slim, places).collect()
    assert len(met) == len({r.row for r in met}) == len(rows)
    assert Counter((r.slot, r.place) for r in met) == Counter((r.slot, r.place) for r in places.collect())


def test_too_many_sources_are_an_error(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.placed(make_docs([(i, "x", str(i)) for i in range(3)]))
