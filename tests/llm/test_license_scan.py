import random
import re

import pytest

from lexicarta.llm import license_scan
from lexicarta.llm.licenses import PHRASES, TEMPLATES
from lexicarta.llm.queries import op3_license_scan

from .conftest import sentence


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text):
    words = words_of(text)
    found = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


def mixtures():
    rng = random.Random(9)
    pieces = [*PHRASES, "GNU General", "Public License", "MIT", "license", "cc-by", "CC BY", "apache", "é", "the", "mit licensé", "gnu gnu"]
    made = ["", None, "cc by cc by", "MIT  License, Apache-License (CC/BY)"]
    for _ in range(150):
        made.append(rng.choice([" ", "-", ". "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 14))))
    return made


def test_base_against_brute_force(spark, tmp_path):
    made = mixtures()
    spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op3_license_scan(spark, str(tmp_path)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(made[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize("seed", range(10))
def test_matching_statistics_against_all_substrings(seed):
    rng = random.Random(seed)
    sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(4)]
    automaton = license_scan.Automaton()
    for number, sequence in enumerate(sequences):
        automaton.add(sequence, number)
    automaton.finish([])
    text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
    places = {}
    for number, s in enumerate(sequences):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                places.setdefault(tuple(s[i:j]), set()).add((number, j))
    got = {p: (state, length) for p, state, length in license_scan.statistics(automaton, text)}
    for p in range(len(text)):
        want = next((n for n in range(p + 1, 0, -1) if tuple(text[p - n + 1 : p + 1]) in places), 0)
        state, length = got.get(p, (0, 0))
        assert length == want
        if want:
            assert automaton.places[state] == places[tuple(text[p - want + 1 : p + 1])]


@pytest.mark.parametrize("label", list(TEMPLATES))
def test_templates_are_found_with_gaps_and_among_other_text(label):
    automaton, phrase_labels, labels = license_scan.build()
    rng = random.Random(1)
    before, after = sentence(rng, 200), sentence(rng, 200)
    words = TEMPLATES[label][0].split()
    whole = f"{before} {' '.join(words)} {after}"
    n, _, spans, score = license_scan.scan(whole.encode(), automaton, phrase_labels, labels)
    own = next(s for s in spans if s[0] == label)
    assert n == len(words_of(whole)) and score == 1.0
    assert own[1:] == (200, 200 + len(words_of(" ".join(words))), 1.0)
    broken = words[: len(words) // 2] + ["*", "inserted"] + words[len(words) // 2 :]
    spans = license_scan.scan(" ".join(broken).encode(), automaton, phrase_labels, labels)[2]
    assert next(s for s in spans if s[0] == label)[3] > 0.9
    fragment = " ".join(words[:3])
    assert license_scan.scan(fragment.encode(), automaton, phrase_labels, labels)[2] == []


def test_every_copy_of_a_template_is_found():
    automaton, phrase_labels, labels = license_scan.build()
    rng = random.Random(4)
    mit = words_of(TEMPLATES["mit"][0])
    n = len(mit)

    def spans(words):
        found = license_scan.scan(" ".join(words).encode(), automaton, phrase_labels, labels)
        return [s[1:] for s in found[2] if s[0] == "mit"], found[3]

    other = sentence(rng, 400).split()
    # Repeats of the beginning sum to more words than the complete licence after them.
    assert spans(mit[:50] * 5 + other + mit) == ([(650, 650 + n, 1.0)], 1.0)
    # A stray match far before a licence that matches in several runs.
    cuts = [mit[i : i + 25] for i in range(0, n, 25)]
    edited = [w for cut in cuts for w in [*cut, *["x"] * 12]]
    stray = mit[-7:-1] + sentence(rng, n * 3 // 2).split()
    (only,), score = spans(stray + edited)
    assert only[0] == len(stray) and only[2] == score >= (n - 5) / n
    # Copies in a row and far apart; half a copy is no span.
    assert spans(mit * 3 + other + mit[: n // 2] + other + mit)[0] == [
        (i, i + n, 1.0) for i in (0, n, 2 * n, 3 * n + 800 + n // 2)
    ]


def test_awkward_rows(make_docs, awkward):
    got = license_scan.scanned(make_docs(awkward)).collect()
    assert sorted((r.n_words, len(r.phrases)) for r in got) == sorted(base(t)[:2] for _, t in awkward)
    assert license_scan.scanned(make_docs([])).count() == 0
