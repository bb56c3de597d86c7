"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words, the last one shorter. A passage is
described by shares of its words (symbols, capitals, repetitions, endings and the like)
and encoded by a small network; a gated attention learns from document labels alone
which passages matter, and the document's score is that of the attention-weighted mean
of its encoded passages:

    h = tanh(W x + b);  a = softmax over passages of w . (tanh(V h) * sigmoid(U h));
    score = sigmoid(c . sum a h + d).

The network is fitted on the driver on a sample of at most ``PER_CLASS`` labelled documents of each
class and ``FIT_PASSAGES`` passages of each, evenly spread. These bounds hold for
fitting only: scores read whole texts. Samples are weighted back to the classes' true shares.

Defined results: a null or empty text is a bag of one passage without words. Without
usable labels every score is 1; with labels of one class every score is that class.
A null ``doc_id`` is never held out nor learnt from. Rows that repeat are each scored.
Extra columns are kept by :func:`scored` and :func:`accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexicarta.llm.common import filled, text_slices
from lexicarta.llm.labelled import labelled_sample

PASSAGE = 64
#: Fitting only: documents of each class, passages of a document, passes over them.
PER_CLASS, FIT_PASSAGES, EPOCHS = 2000, 64, 30
HIDDEN, GATE = 32, 16
ENDINGS = 64
ACCEPT = 0.7

#: Patterns whose matches are counted in each distinct word.
COUNTED = [r"[A-Z]", r"[0-9]", r"[#*$%&|<>]", r"[!?]", r"[.,;:]", r"[^\x00-\x7F]", r"^\W+$"]
FEATURES = len(COUNTED) + 5 + ENDINGS


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages in a row, and the number of passages of each text, at least one."""
    import xxhash

    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), sizes)[real]
    n_words = np.bincount(owner, minlength=len(texts))
    coded = flat.filter(pa.array(real)).dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    total, first = int(n_passages.sum()), np.cumsum(n_passages) - n_passages
    position = np.arange(len(owner)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = first[owner] + position // PASSAGE

    out = np.zeros((total, FEATURES), np.float32)
    if not len(index):
        return out, n_passages
    length = np.maximum(1, pc.utf8_length(words).to_numpy(zero_copy_only=False))

    def summed(of_word: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=of_word[index], minlength=total)

    count = np.bincount(passage, minlength=total)
    per_word = np.maximum(1, count)
    for k, pattern in enumerate(COUNTED):
        out[:, k] = summed(pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False) / length) / per_word
    k = len(COUNTED)
    out[:, k] = summed(np.log(length)) / per_word
    same = np.zeros(len(index))
    same[1:] = (index[1:] == index[:-1]) & (passage[1:] == passage[:-1])
    out[:, k + 1] = np.bincount(passage, weights=same, minlength=total) / per_word
    distinct = np.unique(passage * len(words) + index) // len(words)
    out[:, k + 2] = np.bincount(distinct, minlength=total) / per_word
    out[:, k + 3] = np.log1p(count)
    shape = pc.equal(pc.utf8_upper(words), words).to_numpy(zero_copy_only=False)
    out[:, k + 4] = summed(shape.astype(np.float64)) / per_word
    endings = pc.utf8_slice_codeunits(words, start=-2, stop=None).dictionary_encode()
    bucket = np.array([xxhash.xxh32_intdigest(e) % ENDINGS for e in endings.dictionary.to_pylist()], np.int64)
    cell = passage * ENDINGS + bucket[endings.indices.to_numpy(zero_copy_only=False)][index]
    out[:, k + 5 :] = np.bincount(cell, minlength=total * ENDINGS).reshape(total, ENDINGS) / per_word[:, None]
    return out, n_passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights of encoder, gated attention and classifier; ``constant`` is the score without them."""

    parts: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        z = (x - p["mean"]) / p["scale"]
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        bag = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "bag": bag, "owner": owner, "logit": bag @ p["c"] + p["d"]}

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.parts, self.forward(x, sizes)
        owner, h, a = f["owner"], f["h"], f["a"]
        g = weight * (_sigmoid(f["logit"]) - y) / weight.sum()
        starts = np.cumsum(sizes) - sizes
        to_bag = g[:, None] * p["c"]
        to_a = (to_bag[owner] * h).sum(1)
        to_e = a * (to_a - np.add.reduceat(a * to_a, starts)[owner])
        to_t = to_e[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        to_s = to_e[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        to_h = a[:, None] * to_bag[owner] + to_t @ p["V"].T + to_s @ p["U"].T
        to_z = to_h * (1 - h**2)
        return {
            "W": f["z"].T @ to_z,
            "b": to_z.sum(0),
            "V": h.T @ to_t,
            "U": h.T @ to_s,
            "w": (f["t"] * f["s"]).T @ to_e,
            "c": f["bag"].T @ g,
            "d": g.sum(keepdims=True),
        }

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant)
        x, sizes = passages(texts)
        return _sigmoid(self.forward(x, sizes)["logit"])


def fit(bags: list[np.ndarray], quality: np.ndarray, numbers: dict[int, float], seed: int = 7) -> Network:
    """A network for bags of passage features, by Adam on the weighted log loss."""
    present = [q for q in (0, 1) if numbers.get(q) and (quality == q).any()]
    if len(present) < 2:
        return Network({}, float(present[0]) if present else 1.0)
    random = np.random.default_rng(seed)
    flat = np.concatenate(bags)

    def start(*shape: int) -> np.ndarray:
        return random.normal(0, shape[0] ** -0.5, shape)

    net = Network(
        {
            "mean": flat.mean(0),
            "scale": flat.std(0) + 1e-3,
            "W": start(FEATURES, HIDDEN),
            "b": np.zeros(HIDDEN),
            "V": start(HIDDEN, GATE),
            "U": start(HIDDEN, GATE),
            "w": start(GATE),
            "c": start(HIDDEN),
            "d": np.zeros(1),
        }
    )
    share = {q: numbers[q] / (quality == q).sum() for q in present}
    weight = np.array([share[q] for q in quality.tolist()])
    weight /= weight.mean()
    first = {k: np.zeros_like(v) for k, v in net.parts.items()}
    second = {k: np.zeros_like(v) for k, v in net.parts.items()}
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for begin in range(0, len(order), 64):
            chosen = order[begin : begin + 64]
            own = [bags[i] for i in chosen]
            found = net.gradients(
                np.concatenate(own), np.array([len(b) for b in own]), quality[chosen].astype(float), weight[chosen]
            )
            step += 1
            for k, g in found.items():
                if k in ("W", "V", "U", "c"):
                    g = g + 1e-4 * net.parts[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.parts[k] = net.parts[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return net


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        x, sizes = passages(filled(batch.column("text")))
        ends = np.cumsum(sizes)
        bags = []
        for end, size in zip(ends.tolist(), sizes.tolist()):
            own = np.unique(np.linspace(end - size, end - 1, min(size, FIT_PASSAGES)).astype(np.int64))
            bags.append(x[own].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(bags, pa.binary())], names=["quality", "bag"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """Fits the network on a bounded sample of the labelled documents."""
    sample, numbers = labelled_sample(docs, labels, per_class)
    rows = sample.orderBy("doc_id").select("quality", "text").mapInArrow(_bags, "quality int, bag binary").collect()
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(bags, np.array([r["quality"] for r in rows], int), numbers)


def scored(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """``docs`` with the score of each row's whole text in a last column."""

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([filled(column)], names=["text"])
            parts = [net.scores(s.column("text")) for s in text_slices(iter([batch]))]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    score.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(score, DoubleType())(F.col("text").cast("string")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)
