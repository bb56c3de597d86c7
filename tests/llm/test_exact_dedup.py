import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexicarta.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[plain].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for plain, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(plain.encode()).hexdigest()
        for m in members:
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), digest))
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_groups_of_equal_texts(make_docs, awkward, parts):
    docs = make_docs(awkward).repartition(parts)
    found = exact_dedup.duplicates(docs, fan_in=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute(awkward)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1}, "one row of each group stays"
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_many_copies_over_many_runs(spark, fan_in):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat(' ', cast(id % 7 AS int)) || 'same' ELSE 'text ' || (id % 500) END AS text"
    ).repartition(9)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = exact_dedup.duplicates(docs, fan_in).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute(rows)


def run_of(keys, first_row):
    entries = np.zeros(len(keys), exact_dedup.ENTRY)
    entries["key"] = [k.to_bytes(44, "big") for k in keys]
    entries["row"] = first_row + np.arange(len(keys))
    entries["doc_id"], entries["rows"] = 1000 - entries["row"], 1
    return entries


@pytest.mark.parametrize("sizes", [[0], [5], [0, 3], [40, 1, 0, 17, 30]])
def test_merging_runs_keeps_order_and_best_rows(sizes):
    draw = np.random.default_rng(3)
    # Keys that end in zero bytes, and neighbours that differ in the last byte only.
    runs = [sorted(draw.choice([k << s for k in range(64) for s in (0, 8, 300)], n, replace=False).tolist()) for n in sizes]
    runs = [sorted(set(r)) for r in runs]
    given = [run_of(r, 100 * i) for i, r in enumerate(runs)]
    found = exact_dedup.merge_all(given)
    best, rows = {}, Counter()
    for run, entries in zip(runs, given):
        for key, e in zip(run, entries):
            rank = tuple(e[name].item() for name in exact_dedup.BEST)
            best[key], rows[key] = min(best.get(key, rank), rank), rows[key] + 1
    expected = [(best[k], rows[k]) for k in sorted(best)]
    assert [(tuple(e[name].item() for name in exact_dedup.BEST), e["rows"].item()) for e in found] == expected


@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_rounds_merge_written_runs_in_many_ranges(spark, monkeypatch, fan_in):
    levels = []
    written = exact_dedup.materialize

    def watched(df, label, *rest):
        out = written(df, label, *rest)
        if label == "runs":
            for r in out.collect():
                keys = np.frombuffer(r.entries, exact_dedup.ENTRY)["key"]
                assert np.all(keys[1:] > keys[:-1]), "a block is sorted and holds a key once"
            levels.append((out.select("run").distinct().count(), out.select("range").distinct().count()))
        return out

    monkeypatch.setattr(exact_dedup, "materialize", watched)
    docs = spark.range(2000).selectExpr("id AS doc_id", "'text ' || (id % 700) AS text").repartition(9)
    prints = written(exact_dedup.fingerprints(docs), "prints")
    groups = exact_dedup.tree_merge(prints, fan_in, entries=50).collect()
    assert len(groups) == 700 and sum(r.rows for r in groups) == 2000
    assert [n for n, _ in levels] == {2: [9, 5, 3, 2], 3: [9, 3], 16: [9]}[fan_in]
    assert levels[-1][1] == 64, "the last merge is dealt over ranges"


def test_deduplicate_keeps_all_columns(make_docs, awkward):
    docs = make_docs(awkward)
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    found = exact_dedup.duplicates(docs).where("kept").collect()
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in found)


def test_empty_table(make_docs):
    assert exact_dedup.duplicates(make_docs([])).count() == 0
    assert exact_dedup.deduplicate(make_docs([])).count() == 0
