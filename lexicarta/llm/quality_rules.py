"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts are counted per batch with array operations. The trees are
grown on histograms of a bounded sample of labelled documents, with monotonic
constraints: more symbols, repeated lines or repeated words may only lower a score.
Fitted trees are flattened into arrays of nodes, and all rows of a batch walk down all
trees together.

Base rules fail a document of less than 50 words, or of which more than half the words
lie in three-word windows that occur twice or more.

Defined results: a null text has no words and fails. Without usable labels, or with
labels of one class, the trees keep every document. Rows that repeat are each judged;
a null ``doc_id`` is kept and never learnt from. Extra columns are kept by :func:`judged`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import filled, text_slices
from lexicarta.llm.labelled import labelled_sample

#: Fitting only: labelled documents of each class.
PER_CLASS = 4000
TREES, DEPTH, BINS, RATE, LEAST = 60, 4, 64, 0.15, 20
KEEP = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Statistics that trees see, with the sign of their monotonic constraint (0: none).
STATISTICS = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_lines_share": -1,
    "repeat_words_share": -1,
    "distinct_words_share": 0,
    "same_as_before_share": -1,
    "upper_words_share": 0,
    "mark_words_share": -1,
    "exclamations_per_word": -1,
    "digits_per_char": 0,
    "words_per_line": 0,
    "sentence_ends_per_word": 0,
}


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``BASE`` counts and ``STATISTICS`` of each text."""
    n = len(texts)

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), sizes)[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    v = max(1, len(words))
    n_words = np.bincount(owner, minlength=n)

    def of_words(values: pa.Array) -> np.ndarray:
        values = values.to_numpy(zero_copy_only=False).astype(np.float64)
        return np.bincount(owner, weights=values[index], minlength=n) if len(index) else np.zeros(n)

    word_chars = of_words(pc.utf8_length(words)).astype(np.int64)
    n_symbols = of_words(pc.count_substring_regex(words, r"[#*$%&|<>]")).astype(np.int64)

    repeated = np.zeros(len(index), bool)
    if len(index) > 2:
        inside = owner[2:] == owner[:-2]
        # Two steps of renumbering keep the numbers of windows small, whatever the number of words.
        pair = np.unique(index[:-1] * v + index[1:], return_inverse=True)[1]
        window = pair[:-1] * v + index[2:]
        at = np.flatnonzero(inside)
        order = at[np.lexsort((window[at], owner[at]))]
        equal = (owner[order[1:]] == owner[order[:-1]]) & (window[order[1:]] == window[order[:-1]])
        twice = np.zeros(len(order), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        begin = order[twice]
        for k in range(3):
            repeated[begin + k] = True
    n_repeat = np.bincount(owner[repeated], minlength=n)

    lines = pc.split_pattern(texts, "\n")
    line = lines.flatten()
    line_owner = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64))
    told = pc.match_substring_regex(line, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_owner = line_owner[told]
    line_code = line.filter(pa.array(told)).dictionary_encode()
    key = line_owner * max(1, len(line_code.dictionary)) + line_code.indices.to_numpy(zero_copy_only=False)
    _, first = np.unique(key, return_index=True)
    n_lines = np.bincount(line_owner, minlength=n)
    n_dup = n_lines - np.bincount(line_owner[first], minlength=n)

    base = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1).astype(np.int64)
    per_word = np.maximum(1, n_words)
    before = np.zeros(len(index), bool)
    before[1:] = (index[1:] == index[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.unique(owner * v + index) // v
    upper = pc.and_(pc.equal(pc.utf8_upper(words), words), pc.match_substring_regex(words, r"\pL\pL"))
    shares = {
        "log_words": np.log1p(n_words),
        "mean_word_chars": word_chars / per_word,
        "symbols_per_word": n_symbols / per_word,
        "dup_lines_share": n_dup / np.maximum(1, n_lines),
        "repeat_words_share": n_repeat / per_word,
        "distinct_words_share": np.bincount(distinct, minlength=n) / per_word,
        "same_as_before_share": np.bincount(owner[before], minlength=n) / per_word,
        "upper_words_share": of_words(upper) / per_word,
        "mark_words_share": of_words(pc.match_substring_regex(words, r"^[^\pL\pN]+$")) / per_word,
        "exclamations_per_word": count("!") / per_word,
        "digits_per_char": count("[0-9]") / np.maximum(1, word_chars),
        "words_per_line": n_words / np.maximum(1, n_lines),
        "sentence_ends_per_word": count(r"[.?!](?:\s|$)") / per_word,
    }
    return base, np.stack([shares[name] for name in STATISTICS], axis=1)


@dataclass
class Forest:
    """Trees as arrays of nodes: a leaf is its own child, so that all rows take ``DEPTH`` steps."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[row, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def _grow(binned, edges, gradient, hessian, signs, nodes) -> tuple[int, np.ndarray]:
    """Adds one tree to ``nodes``; its root, and the value it gives each row.

    A split must leave the two sides in the order of the feature's sign, and the sides'
    values stay on their sides of the middle further down, so that the whole tree is monotonic.
    """
    n, f = binned.shape
    out = np.zeros(n)
    cells = binned + np.arange(f) * BINS

    def optimum(g, h, low, high):
        return np.clip(-g / (h + 1.0), low, high)

    def split(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        own = float(optimum(g, h, low, high))
        number = len(nodes)
        nodes.append([0, np.inf, number, number, own])
        best = None
        if depth < DEPTH and len(rows) >= 2 * LEAST:
            at = cells[rows].ravel()
            sums = [
                np.cumsum(np.bincount(at, weights=np.repeat(w, f), minlength=f * BINS).reshape(f, BINS), axis=1)[:, :-1]
                for w in (gradient[rows], hessian[rows], np.ones(len(rows)))
            ]
            gl, hl, nl = sums
            a, b = optimum(gl, hl, low, high), optimum(g - gl, h - hl, low, high)

            def loss(v, gg, hh):
                return gg * v + 0.5 * (hh + 1.0) * v * v

            gain = loss(own, g, h) - loss(a, gl, hl) - loss(b, g - gl, h - hl)
            allowed = (nl >= LEAST) & (len(rows) - nl >= LEAST) & (signs[:, None] * (b - a) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            j, k = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[j, k] > 1e-6:
                best = (int(j), int(k), float(a[j, k]), float(b[j, k]))
        if best is None:
            out[rows] = own
            return number
        j, k, a, b = best
        middle = (a + b) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        goes_left = binned[rows, j] <= k
        (ll, lh), (rl, rh) = bounds[int(signs[j])]
        left = split(rows[goes_left], depth + 1, ll, lh)
        right = split(rows[~goes_left], depth + 1, rl, rh)
        nodes[number] = [j, edges[j][k], left, right, 0.0]
        return number

    return split(np.arange(n), 0, -np.inf, np.inf), out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, signs: np.ndarray) -> Forest:
    """Boosted trees for the weighted log loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    # Bins beyond the last edge of a feature hold no rows to their right and are never split at.
    padded = [np.append(e, np.full(BINS - len(e), np.inf)) for e in edges]
    mean = float(np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6))
    start = np.log(mean / (1 - mean))
    score, nodes, roots = np.full(len(y), start), [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        root, out = _grow(binned, padded, weight * (p - y), weight * p * (1 - p), signs, nodes)
        roots.append(root)
        score += RATE * out
    table = list(zip(*nodes))
    return Forest(
        np.array(roots),
        np.array(table[0]),
        np.array(table[1], float),
        np.array(table[2]),
        np.array(table[3]),
        RATE * np.array(table[4], float),
        float(start),
    )


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        _, x = statistics(filled(batch.column("text")))
        x = pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), x], names=["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Forest | None:
    """Trees fitted on a bounded sample; none where the labels don't show both classes."""
    sample, numbers = labelled_sample(docs, labels, per_class)
    rows = sample.orderBy("doc_id").select("quality", "text").mapInArrow(_sampled, "quality int, x binary").collect()
    y = np.array([r["quality"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack([np.frombuffer(r["x"], np.float64) for r in rows])
    weight = np.where(y == 1, numbers[1] / (y == 1).sum(), numbers[0] / (y == 0).sum())
    return grow(x, y, weight / weight.mean(), np.array(list(STATISTICS.values())))


def judged(docs: DataFrame, forest: Forest | None, keep: float = KEEP) -> DataFrame:
    """``docs`` with a struct ``rules``: base counts, ``base_failed``, ``score``, ``kept``."""
    schema = ", ".join(f"{name} bigint" for name in BASE) + ", base_failed boolean, score double, kept boolean"
    names = [*BASE, "base_failed", "score", "kept"]
    kinds = [pa.int64()] * len(BASE) + [pa.bool_(), pa.float64(), pa.bool_()]

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            done = []
            for part in text_slices(iter([pa.RecordBatch.from_arrays([filled(column)], names=["text"])])):
                base, x = statistics(part.column("text"))
                failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
                score = forest.probability(x) if forest is not None else np.ones(len(x))
                values = [*base.T, failed, score, ~failed & (score >= keep)]
                done.append(pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names))
            empty = pa.StructArray.from_arrays([pa.array([], k) for k in kinds], names=names)
            yield pa.concat_arrays(done) if done else empty

    judge.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("rules", F.arrow_udf(judge, schema)(F.col("text").cast("string")))
