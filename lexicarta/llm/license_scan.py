"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds all word sequences of the licence templates. A text runs through it
word by word; at each word it knows the longest run of words, ending there, that also
stands in some template (the matching statistics). From these

* a phrase stands wherever the run is as long as the phrase and ends in it;
* long runs that cannot be extended are matches; for each template the matches that lie
  in the same order in text and template are chained over gaps of at most ``GAP`` templates,
  and the chain's words, as a share of the template's, are its coverage. Every chain of enough
  coverage is a span, given in words of the text; spans of one label do not overlap.

Words outside all templates end every run, so only stretches of licence words cost steps.

Defined results: a null text has no words. A text without a phrase or well covered template has no labels
and the score of its best covered template, 0 if none. Rows that repeat are each scanned.
Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lexicarta.llm.common import filled, only, text_slices
from lexicarta.llm.licenses import PHRASES, TEMPLATES

#: Words of a match, and the share of a template, from which on they count.
MATCH, COVERED = 6, 0.6
#: Words between two matches of a chain, in lengths of the template.
GAP = 2

#: Bytes outside words become spaces, capitals small letters; bytes of other letters stay.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, small letters and characters beyond ASCII."""
    return text.translate(TO_WORDS).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences. State 0 is the start.

    ``place[s]`` is a template and the end in it of an occurrence of the state's words;
    ``ends[s]`` are the phrases among the suffixes of the state's words, longest first.
    """

    word_no: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    places: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])
    ends: list[list[int]] = field(default_factory=list)
    phrase_words: list[int] = field(default_factory=list)
    template_words: list[int] = field(default_factory=list)

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        self.places.append(set())
        return len(self.step) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the current sequence with one more word."""
        if (known := self.step[last].get(word)) is not None:
            if self.longest[known] == self.longest[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._state(self.longest[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at != -1:
            target = self.step[at][word]
            whole = self.longest[target] == self.longest[at] + 1
            self.link[new] = target if whole else self._split(at, word, target)
        return new

    def _split(self, at: int, word: int, target: int) -> int:
        """Parts the shorter words of ``target`` from the longer ones."""
        copy = self._state(self.longest[at] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while at != -1 and self.step[at].get(word) == target:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[bytes], template: int) -> int:
        """Adds a sequence; the state of the whole of it."""
        state = 0
        for end, word in enumerate(words, 1):
            # The sequence so far is the longest of its state and stays there in later splits.
            state = self._extend(state, self.word_no.setdefault(word, len(self.word_no)))
            self.places[state].add((template, end))
        return state

    def finish(self, phrases: list[list[bytes]]) -> None:
        """Hands places down the suffix links, and notes where phrases end."""
        self.phrase_words = [len(p) for p in phrases]
        own: dict[int, list[int]] = {}
        for number, phrase in enumerate(phrases):
            at = 0
            for word in phrase:
                at = self.step[at][self.word_no[word]]
            own.setdefault(at, []).append(number)
        order = sorted(range(len(self.step)), key=self.longest.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]
        self.ends = [[] for _ in self.step]
        for state in order[1:]:
            self.ends[state] = sorted(
                own.get(state, []) + self.ends[max(0, self.link[state])], key=lambda p: -self.phrase_words[p]
            )


def build(phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> tuple:
    """The automaton, the phrases' labels, and the templates' labels."""
    automaton = Automaton()
    split = [words_of(p.encode()) for p in phrases]
    labels = []
    for label, texts in templates.items():
        for text in texts:
            words = words_of(text.encode())
            automaton.add(words, len(labels))
            automaton.template_words.append(len(words))
            labels.append(label)
    for phrase in split:
        automaton.add(phrase, -1)
    automaton.finish(split)
    return automaton, list(phrases.values()), labels


def statistics(automaton: Automaton, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """``(position, state, length)`` of the longest run that ends at each word, where there is one."""
    number = automaton.word_no.get
    step, link, longest = automaton.step, automaton.link, automaton.longest
    state = length = 0
    for position, word in enumerate(words):
        code = number(word)
        if code is None:
            state = length = 0
            continue
        while (after := step[state].get(code)) is None:
            state = link[state]
            length = longest[state]
        state = after
        length += 1
        yield position, state, length


Match = tuple[int, int, int]


def _best(matches: list[Match], gap: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Per match the words, start and number of matches of the best chain that ends in it; and its way back.

    Later matches of a chain end later in text and template and begin at most ``gap`` words
    after the one before. Where two overlap, on either side, only the later one's new words
    count. Among chains of equal words the one that starts later is the tighter.
    """
    best, back = [], []
    ends = [m[0] for m in matches]
    for i, (end, at, length) in enumerate(matches):
        own, way = (length, end - length, 1), (-1, length)
        for j in range(bisect_left(ends, end - length - gap), i):
            e, a, _ = matches[j]
            if e < end and a < at:
                new = min(length, end - e, at - a)
                words, start, n = best[j]
                if (words + new, start) > own[:2]:
                    own, way = (words + new, start, n + 1), (j, new)
        best.append(own)
        back.append(way)
    return best, back


def chains(matches: list[Match], gap: int, least: float) -> list[list[Match]]:
    """Chains of matches ``(text end, template end, length)`` of one template, best first in each stretch.

    The best chain of all is always given, further ones where they have ``least`` words and
    overlap none given. What lies between given chains is chained anew, until no chain is left.
    """
    found: list[list[Match]] = []
    waiting = [sorted(set(matches))]
    while waiting:
        own = waiting.pop()
        best, back = _best(own, gap)
        taken: list[tuple[int, int]] = []  # starts and ends, rising
        for i in sorted(range(len(own)), key=lambda k: (-best[k][0], own[k][0])):
            if best[i][0] < least and found:
                break
            start, end = best[i][1], own[i][0]
            spot = bisect_left(taken, (start, end))
            if (spot and taken[spot - 1][1] > start) or (spot < len(taken) and taken[spot][0] < end):
                continue
            taken.insert(spot, (start, end))
            links = []
            while i != -1:
                links.append((*own[i][:2], back[i][1]))
                i = back[i][0]
            found.append(links[::-1])
        if not taken:
            continue
        between: dict[int, list[Match]] = {}
        for match in own:
            spot = bisect_left(taken, (match[0], 0))  # spans that start before the match ends
            if not spot or taken[spot - 1][1] <= match[0] - match[2]:
                between.setdefault(spot, []).append(match)
        waiting += between.values()
    return found


def scan(text: bytes, automaton: Automaton, phrase_labels: list[str], labels: list[str]) -> tuple:
    """``n_words, phrases [(label, start, words)], spans [(label, start, end, coverage)], score``."""
    words = words_of(text)
    phrases, runs = [], []
    lengths = automaton.phrase_words
    last = (-2, 0, 0)
    for position, state, length in statistics(automaton, words):
        if ends := automaton.ends[state]:
            phrases += [(phrase_labels[p], position - lengths[p] + 1, lengths[p]) for p in ends if lengths[p] <= length]
        # A run that the next word doesn't lengthen is a match.
        if last[2] >= MATCH and not (position == last[0] + 1 and length == last[2] + 1):
            runs.append(last)
        last = (position, state, length)
    if last[2] >= MATCH:
        runs.append(last)
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for position, state, length in runs:
        for template, end in automaton.places[state]:
            if template >= 0:
                by_template.setdefault(template, []).append((position + 1, end, length))
    spans: dict[str, list[tuple[float, int, int]]] = {}
    score = 1.0 if phrases else 0.0
    for template, matches in by_template.items():
        total = automaton.template_words[template]
        for found in chains(matches, GAP * total, COVERED * total):
            coverage = min(1.0, sum(m[2] for m in found) / total)
            score = max(score, coverage)
            if coverage >= COVERED:
                spans.setdefault(labels[template], []).append((coverage, found[0][0] - found[0][2], found[-1][0]))
    told = [(label, *span) for label, own in sorted(spans.items()) for span in _apart(own)]
    return len(words), phrases, told, score


def _apart(spans: list[tuple[float, int, int]]) -> list[tuple[int, int, float]]:
    """``(start, end, coverage)`` of spans in the order of the text; of those that overlap the best covered."""
    kept: list[tuple[int, int, float]] = []
    for coverage, start, end in sorted(spans, key=lambda s: (-s[0], s[1], -s[2])):
        spot = bisect_left(kept, (start,))
        if not (spot and kept[spot - 1][1] > start) and not (spot < len(kept) and kept[spot][0] < end):
            kept.insert(spot, (start, end, coverage))
    return kept


def scanned(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, phrases, spans, score)`` per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, phrase_labels, labels = build()
        place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])
        span = pa.struct(
            [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]
        )
        for batch in text_slices(batches):
            texts = filled(batch.column("text")).cast(pa.binary()).to_pylist()
            found = [scan(text, automaton, phrase_labels, labels) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[dict(zip(("label", "start", "words"), p)) for p in f[1]] for f in found], pa.list_(place)),
                    pa.array(
                        [[dict(zip(("label", "start", "end", "coverage"), s)) for s in f[2]] for f in found],
                        pa.list_(span),
                    ),
                    pa.array([f[3] for f in found], pa.float64()),
                ],
                names=["doc_id", "n_words", "phrases", "spans", "score"],
            )

    return only(docs, doc_id="bigint", text="string").mapInArrow(
        run,
        "doc_id bigint, n_words bigint, phrases array<struct<label string, start bigint, words bigint>>,"
        " spans array<struct<label string, start bigint, end bigint, coverage double>>, score double",
    )
