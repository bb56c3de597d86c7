"""Near duplicates by ProbMinHash, banding and verification.

A document is the multiset of its shingles of five words; a shingle weighs as often as
it occurs. Two documents are similar to the degree of the probability Jaccard index

    J(v, w) = sum over common d of 1 / sum over i of max(v_i / v_d, w_i / w_d),

which is the Jaccard index of the shingle sets where every shingle occurs once.

* Texts with equal words are one class from the start.
* Every shingle sends arrivals of a Poisson process of the rate of its weight to random
  registers; a register keeps the shingle that came first. A shingle is done when its
  next arrival comes later than all registers have had one. Registers agree with probability J.
* Registers are banded. In a bucket every member is first paired with two of the bucket's
  members: the one that meets most others over all bands, and the last in an order of the
  band's own. So the members of one class are joined by pairs that grow with their number.
* Pairs are verified with the exact index on the whole texts: first each document's pair
  with the most bands in common, then all pairs whose ends are not yet in one class.
  Classes are the connected components of verified pairs.
* Buckets that still hold several classes are paired with new hubs, as long as that joins
  classes. If many pairs are left, their members are edits of common texts, but too far from them and
  from each other. They get finer buckets (:func:`finer`): what tells a member from its fellows, the shingles it has
  and most have not, or has not and most have, is banded. Two members of similarity 0.8, both below it to what most
  have, mostly share a third of that, and others next to nothing. These rounds only join classes sooner.
* In the end all pairs of different classes in a bucket of the first kind are compared, whatever rounds were before: in small buckets
  as rows, in larger ones by blocks (:func:`linking`), where a bound on the index passes over what cannot be similar.

Defined results: a null text counts as empty. Texts with equal words are one class,
texts without words too. A text of less than five words has one shingle, all its words.
The class of a document is the smallest ``doc_id`` in it, null ids last. Extra columns are ignored by
:func:`classes` and returned by :func:`deduplicate`. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import filled, kept_rows, only, text_check, text_slices
from lexicarta.session import materialize

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^6)^24 = 0.9993.
BANDS, ROWS = 24, 6
#: Rounds in which each document's best pair is verified before all others, and the share of
#: those pairs that a round must link for another one to follow.
ROUNDS, WORTH = 2, 0.1
#: New hubs of a bucket in a further round, and the pairs a member up to which no such round is needed.
HUBS, FEW = 4, 256
#: Members of a bucket up to which its pairs are rows, those of a block of a larger one, and the shingles of a step there.
PAIRED, BLOCK, COLUMNS = 16, 256, 4096
#: Members that share a third of what tells them apart have a finer bucket in common with probability
#: 1 - (1 - 1/27)^100 = 0.977, those of a half with 1 - (1 - 1/8)^100 = 0.999998.
FINE_BANDS, FINE_ROWS = 100, 3
#: Times that buckets are made finer.
LEVELS = 1
#: Shuffle partitions whose rows share a file in tables without texts.
PER_FILE = 8

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word of all texts in a row, and the number of words of each text."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = words.flatten()
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), sizes)[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    of_word = np.array([digest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    return of_word[index] if len(index) else np.zeros(0, np.uint64), np.bincount(owner, minlength=len(texts))


def _sorted_within(owner: np.ndarray, value: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Both, in the order of owner and value; the leading bits of the value nearly always decide."""
    bits = _U(max(1, int(owners).bit_length()))
    key = owner.astype(np.uint64) << (_U(64) - bits) | value >> bits
    order = np.argsort(key)
    key, own, val = key[order], owner[order], value[order]
    if np.any((key[1:] == key[:-1]) & (val[1:] != val[:-1])):
        order = np.lexsort((value, owner))
        own, val = owner[order], value[order]
    return own, val


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``owner, shingle, weight``: distinct shingles of each text, owners and shingles rising."""
    hashes, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Windows that begin at each word, cut at the end of the text: of short texts only the first.
    n = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    value = np.full(len(first), _U(0x9E3779B97F4A7C15))
    last = ends[owner] if len(owner) else first
    for k in range(words):
        at = first + k
        inside = at < last
        value = mixed(value + np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))], _U(k + 1)))
    owner, value = _sorted_within(owner, value, len(texts))
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash: per text and register the shingle that arrives first.

    All shingles still running draw their next arrival together. The i-th arrival of a
    shingle depends on the shingle and i alone.
    """
    time = np.full(texts * registers, np.inf)
    value = np.zeros(texts * registers, np.uint64)
    arrival = np.zeros(len(owner))
    own, item, rate = owner, shingle, weight.astype(np.float64)
    step = 0
    while len(own):
        step += 1
        draw = mixed(item + _U((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        uniform = ((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        arrival = arrival - np.log(uniform) / rate
        register = (mixed(draw ^ _U(0xD1B54A32D192ED03)) % _U(registers)).astype(np.int64)
        cell = own * registers + register
        # The first arrival of each cell in this step; among equal times the smaller shingle.
        first = time.copy()
        np.minimum.at(first, cell, arrival)
        lead = np.flatnonzero((arrival == first[cell]) & (arrival < time[cell]))
        lead = lead[np.argsort(item[lead])[::-1]]  # the last one written stays
        time, value[cell[lead]] = first, item[lead]
        latest = time.reshape(texts, registers).max(axis=1)
        going = arrival < latest[own]
        own, item, rate, arrival = own[going], item[going], rate[going], arrival[going]
    return value.reshape(texts, registers)


def slim(df: DataFrame, label: str) -> DataFrame:
    """``df``, of digests and numbers only, written in a file for every ``PER_FILE`` shuffle partitions.

    Otherwise its tasks would mostly create files. There are never fewer files than cores, and
    a task goes through its partitions one after the other.
    """
    spark = df.sparkSession
    partitions = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // PER_FILE)
    return materialize(df.coalesce(max(partitions, spark.sparkContext.defaultParallelism)), label)


def _digest(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """128 bits per text for the words in their order."""
    import xxhash

    ends = np.cumsum(sizes)
    return [
        xxhash.xxh3_128_digest(hashes[end - size : end].tobytes()) for end, size in zip(ends.tolist(), sizes.tolist())
    ]


def _same_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows ``(rep, text)`` whose text has the words that ``rep`` stands for."""
    for batch in text_slices(batches):
        found = pa.array(_digest(*word_hashes(filled(batch.column("text")))), pa.binary())
        yield batch.filter(pc.equal(found, batch.column("rep")))


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2 << 20):
            texts = filled(batch.column("text"))
            hashes, sizes = word_hashes(texts)
            found = signatures(*shingles(texts), len(texts), bands * rows)
            keys = np.zeros((len(texts), bands), np.uint64)
            for r in range(rows):
                keys = mixed(keys + found[:, r::rows] + _U(r))
            keys = mixed(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
            offsets = np.arange(0, len(texts) * bands + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("check"),
                    pa.array(_digest(hashes, sizes), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ],
                names=["doc_id", "check", "rep", "keys"],
            )

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard index of two weighted sets ``(shingles, weights)``, shingles rising.

    Sorted by the ratio of the weights, the sum of maxima is a prefix of one and a suffix of the other.
    """
    common, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    v, w = a[1][at_a].astype(np.float64), b[1][at_b].astype(np.float64)
    order = np.argsort(v / w)
    v, w = v[order], w[order]
    only_a, only_b = a[1].sum() - v.sum(), b[1].sum() - w.sum()
    # For d, the i with a larger ratio v_i / w_i take v_i / v_d, the others w_i / w_d.
    v_above = v.sum() - np.cumsum(v) + only_a
    w_upto = np.cumsum(w) + only_b
    return float((1.0 / (v_above / v + w_upto / w)).sum())


def _verify(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "a_text", limit=2 << 20):
            n = batch.num_rows
            texts = pa.concat_arrays([filled(batch.column("a_text")), filled(batch.column("b_text"))])
            owner, value, weight = shingles(texts, words)
            cut = np.searchsorted(owner, np.arange(2 * n + 1))
            sets = [(value[i:j], weight[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            found = [similarity(sets[i], sets[n + i]) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
            )

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(a, b, similarity)`` of the pairs ``(a, b)`` whose ``texts(rep, text)`` are similar."""
    with_a = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("a_text")), "a")
    both = with_a.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("b_text")), "b")
    found = both.select("a", "b", "a_text", "b_text").mapInArrow(
        _verify(WORDS), "a binary, b binary, similarity double"
    )
    return found.where(F.col("similarity") >= threshold - 1e-12)


def components(nodes: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(rep, label)``: the smallest node that links ``(a, b)`` connect each node with; without ``nodes`` that of all ends.

    Labels start as the least of a node and those next to it. They fall to the least label next to them,
    then to the label of that label, until none changes; the rounds grow with the logarithm of
    the longest chain. Labels are written each round.
    """
    both = slim(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links"
    )
    start = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("rep"), F.least("a", "near").alias("label"))
    if nodes is not None:
        start = nodes.select("rep").join(start, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    labels = slim(start, "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["rep"]).groupBy("a").agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, labels["rep"] == near["a"], "left").select(
            "rep", "label", F.least("label", "near").alias("next")
        )
        jump = stepped.select(F.col("rep").alias("j_rep"), F.col("next").alias("jumped"))
        after = slim(
            stepped.join(jump, F.col("next") == F.col("j_rep"), "left").select(
                "rep", F.least("next", "jumped").alias("label"), (F.col("label") != F.least("next", "jumped")).alias("changed")
            ),
            "labels",
        )
        labels = after.select("rep", "label")
        if after.where("changed").isEmpty():
            return labels


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(rep, label)`` after further links ``(a, b)``: only the labels that they connect are looked at."""
    ends = labels.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
    between = (
        links.select("a", "b")
        .join(labels.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a")
        .join(ends, "b")
        .where("la != lb")
        .select(F.col("la").alias("a"), F.col("lb").alias("b"))
    )
    merged = components(None, between).select(F.col("rep").alias("old"), F.col("label").alias("new"))
    merged = merged.where("old != new")
    return slim(
        labels.join(merged, F.col("label") == F.col("old"), "left").select(
            "rep", F.coalesce("new", "label").alias("label")
        ),
        "labels",
    )


def linked(
    pairs: DataFrame,
    texts: DataFrame,
    nodes: DataFrame,
    threshold: float,
    known: tuple[DataFrame, DataFrame] | None = None,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """Verified links, and the label of each node's component, after those already ``known``.

    ``pairs`` are distinct. First each node's pair with the most bands is verified, ``rounds`` times over among
    the pairs whose ends are still apart, unless a round links few; then all pairs that are apart. Pairs within a
    component need no text, so large groups cost each member a few comparisons.
    """
    spark = pairs.sparkSession
    if known:
        links, labels = known
    else:
        labels = nodes.select("rep", F.col("rep").alias("label"))
        links = spark.createDataFrame([], "a binary, b binary, similarity double")
    apart = pairs
    while True:
        last = rounds == 0
        chosen = apart.select("a", "b")
        if not last:
            ends = apart.select(F.explode(F.array("a", "b")).alias("end"), "a", "b", "bands")
            best = ends.groupBy("end").agg(F.max(F.struct("bands", "a", "b")).alias("p"))
            chosen = slim(best.select("p.a", "p.b").distinct(), "chosen")
        found = materialize(verified(chosen, texts, threshold), "links")
        links = links.unionByName(found)
        joined = found.count()
        if joined:
            labels = joined_labels(labels, found)
        if last:
            return links, labels
        rounds = rounds - 1 if joined >= WORTH * chosen.count() else 0
        label_a = labels.select(F.col("rep").alias("a"), F.col("label").alias("la"))
        label_b = labels.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
        apart = slim(
            apart.join(label_a, "a")
            .join(label_b, "b")
            .where("la != lb")
            .join(chosen, ["a", "b"], "left_anti")
            .select("a", "b", "bands"),
            "apart",
        )
        if apart.isEmpty():
            return links, labels


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(home, shingle, n)``: in how many texts of a home a shingle occurs, added up within a slice."""
    for batch in text_slices(batches, limit=2 << 20):
        owner, value, _ = shingles(filled(batch.column("text")))
        home = batch.column("home").to_numpy()[owner]
        order = np.lexsort((value, home))
        home, value = home[order], value[order]
        at = np.flatnonzero(np.append(True, (home[1:] != home[:-1]) | (value[1:] != value[:-1]))) if len(home) else order
        yield pa.RecordBatch.from_arrays(
            [pa.array(home[at]), pa.array(value[at].view(np.int64)), pa.array(np.diff(np.append(at, len(home))))],
            names=["home", "shingle", "n"],
        )


def private(
    owner: np.ndarray, value: np.ndarray, common_owner: np.ndarray, common: np.ndarray, owners: int
) -> tuple[np.ndarray, np.ndarray]:
    """What each text alone has, and what it lacks, of shingles next to those common around it."""
    both = np.concatenate([owner, common_owner])
    item = np.concatenate([value, common])
    lacking = np.concatenate([np.zeros(len(owner), bool), np.ones(len(common), bool)])
    order = np.lexsort((item, both))
    both, item, lacking = both[order], item[order], lacking[order]
    with_next = np.zeros(len(both), bool)
    with_next[:-1] = (both[1:] == both[:-1]) & (item[1:] == item[:-1])
    single = ~with_next
    single[1:] &= ~with_next[:-1]
    return both[single], mixed(item[single] + np.where(lacking[single], _U(0x9E3779B97F4A7C15), _U(1)))


def _private_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, limit=1 << 20):
        texts = filled(batch.column("text"))
        owner, value, _ = shingles(texts)
        common = batch.column("common")
        flat = pc.list_flatten(common).to_numpy(zero_copy_only=False).view(np.uint64)
        around = pc.list_parent_indices(common).to_numpy(zero_copy_only=False).astype(np.int64)
        owner, item = private(owner, value, around, flat, len(texts))
        found = signatures(owner, item, np.ones(len(owner)), len(texts), FINE_BANDS * FINE_ROWS)
        keys = np.zeros((len(texts), FINE_BANDS), np.uint64)
        for r in range(FINE_ROWS):
            keys = mixed(keys + found[:, r::FINE_ROWS] + _U(r))
        keys = mixed(keys + np.arange(FINE_BANDS, dtype=np.uint64)).view(np.int64)
        offsets = np.arange(0, len(texts) * FINE_BANDS + 1, FINE_BANDS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
            names=["rep", "keys"],
        )


def finer(held: DataFrame, several: DataFrame, texts: DataFrame) -> DataFrame:
    """``(rep, key)``: new buckets of the members ``(rep, key)``, by what tells them from their fellows.

    The fellows of a member are those of its largest bucket. The shingles that most of them have are at most
    twice as many as a text of theirs has on average.
    """
    homes = (
        held.join(several.select("key", "n"), "key")
        .groupBy("rep")
        .agg(F.max(F.struct("n", "key")).alias("largest"))
        .select("rep", F.col("largest.key").alias("home"))
    )
    fellows = materialize(homes.join(texts, "rep").select("rep", "home", "text"), "fellows")
    sizes = fellows.groupBy("home").agg(F.count("*").alias("size"))
    counts = (
        fellows.select("home", "text")
        .mapInArrow(_shingle_counts, "home bigint, shingle bigint, n bigint")
        .groupBy("home", "shingle")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
    )
    common = counts.join(sizes, "home").where("2 * n > size").groupBy("home").agg(F.collect_list("shingle").alias("common"))
    nothing = F.array().cast("array<bigint>")
    around = fellows.join(common, "home", "left").select("rep", "text", F.coalesce("common", nothing).alias("common"))
    keyed = around.mapInArrow(_private_keys, "rep binary, keys array<bigint>")
    banded = materialize(keyed.select("rep", F.explode("keys").alias("key")), "finer")
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return slim(banded.join(shared, "key").select("rep", "key"), "buckets")


def _linking(threshold: float):
    """Links that join the labels of a group of members, found among all pairs of its two blocks, or of its one.

    Let c and d be the shares of the weights of two texts that fall on shingles of both. Their index is 1 / (1 / c +
    1 / d - 1) at most, and just that if all weights are equal; so only pairs that reach the threshold by it are looked at.
    """

    def run(members: pa.Table) -> pa.Table:
        texts = filled(members.column("text").combine_chunks())
        n = len(texts)
        owner, value, weight = shingles(texts)
        cut = np.searchsorted(owner, np.arange(n + 1))
        share = weight / np.bincount(owner, weight, minlength=n)[owner]
        _, code, times = np.unique(value, return_inverse=True, return_counts=True)
        met = times[code] > 1
        column, at, share = np.unique(code[met], return_inverse=True)[1], owner[met], share[met].astype(np.float32)
        order = np.argsort(column, kind="stable")
        column, at, share = column[order], at[order], share[order]
        block = members.column("own").to_numpy()
        first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        c = np.zeros((len(first), len(second)), np.float32)
        d = np.zeros((len(second), len(first)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            i, j = np.searchsorted(column, [start, start + COLUMNS])
            part = np.zeros((n, COLUMNS), np.float32)
            part[at[i:j], column[i:j] - start] = share[i:j]
            has = (part > 0).astype(np.float32)
            c += part[first] @ has[second].T
            d += part[second] @ has[first].T
        least = np.float32(1e-6)
        label = members.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        near = 1 / np.maximum(c, least) + 1 / np.maximum(d.T, least) - 1 <= 1 / threshold + 1e-3
        near &= label[first][:, None] != label[second][None, :]
        if first[0] == second[0]:
            near = np.triu(near)
        rep = members.column("rep").to_pylist()
        root = list(range(n))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for x, y in zip(*(k.tolist() for k in np.nonzero(near))):
            x, y = int(first[x]), int(second[y])
            if (p := top(label[x])) != (q := top(label[y])):
                s, t = slice(cut[x], cut[x + 1]), slice(cut[y], cut[y + 1])
                index = similarity((value[s], weight[s]), (value[t], weight[t]))
                if index >= threshold - 1e-12:
                    root[p] = q
                    found.append((min(rep[x], rep[y]), max(rep[x], rep[y]), index))
        columns = list(zip(*found)) or [[], [], []]
        return pa.table(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.float64())],
            names=["a", "b", "similarity"],
        )

    return run


def linking(held: DataFrame, sizes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, similarity)``: links enough to join the members ``(rep, key, label)`` that any links in a bucket join.

    All pairs of different labels in a bucket are compared. The members of a bucket of ``sizes(key, n)`` are dealt into blocks, and a task
    compares two blocks; so neither a task nor the number of rows grows with the pairs.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = held.join(sizes.select("key", "n"), "key").select(
        "key",
        "rep",
        "label",
        F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
    )
    found = (
        dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .join(texts, "rep")
        .select("key", "i", "j", "own", "rep", "label", "text")
        .groupBy("key", "i", "j")
        .applyInArrow(_linking(threshold), "a binary, b binary, similarity double")
    )
    return found.groupBy("a", "b").agg(F.first("similarity").alias("similarity"))


def unsettled(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Members ``(rep, key, label)`` of the buckets of several classes, those ``(key, n, left)``, their members and pairs apart."""
    held = buckets.select("rep", "key").join(labels, "rep")
    square = F.col("n") * F.col("n")
    several = slim(
        held.groupBy("key", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.sum(square).alias("joined"))
        .select("key", "n", ((square - F.col("joined")) / 2).alias("left"))
        .where("left > 0"),
        "several",
    )
    members, left = several.agg(F.sum("n"), F.sum("left")).first()
    if left:
        held = slim(held.join(several.select("key"), "key").select("rep", "key", "label"), "held")
    return held, several, members or 0, left or 0


def settled(
    buckets: DataFrame,
    met: DataFrame,
    texts: DataFrame,
    nodes: DataFrame,
    threshold: float,
    known: tuple[DataFrame, DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Links and labels once any two members ``(rep, key)`` of a bucket have been compared or are in one class.

    ``met`` are the pairs of the links and labels ``known``. If more than a few pairs a member are left over, a round
    pairs members with few new hubs, and as long as it halves what is left, the next one does. What is still too much
    is paired in finer buckets, ``LEVELS`` times at most. These only join classes sooner: in the end all pairs of
    different classes in each of ``buckets`` are compared, in small buckets as rows and in larger ones by blocks.
    """
    some, before, level = buckets, None, 0
    for turn in itertools.count():
        held, several, members, left = unsettled(some, known[1])
        few = left <= FEW * members
        stuck = before is not None and 2 * left > before
        if stuck and not few and level < LEVELS:
            some, before, level = finer(held, several, texts), None, level + 1
            continue
        if few or stuck:
            break
        before = left
        ranks = [F.xxhash64("rep", "key", F.lit(HUBS * turn + i)).alias("by") for i in range(HUBS)]
        hubs = held.groupBy("key").agg(F.array(*(F.max(F.struct(rank, "rep", "label")) for rank in ranks)).alias("hubs"))
        others = hubs.select("key", F.explode("hubs").alias("hub")).select(
            "key", F.col("hub.rep").alias("other"), F.col("hub.label").alias("other_label")
        )
        pairs = _apart(held, others, met, F.lit(True))
        if not pairs.isEmpty():
            # In finer buckets few of the pairs are links.
            known = linked(pairs, texts, nodes, threshold, known, rounds=0 if level else 1)
            met = met.select("a", "b").unionByName(pairs.select("a", "b"))
    if level:
        held, several, members, left = unsettled(buckets, known[1])
    if not left:
        return known
    small = held.join(several.where(F.col("n") <= PAIRED).select("key"), "key")
    others = small.select("key", F.col("rep").alias("other"), F.col("label").alias("other_label"))
    pairs = _apart(small, others, met, F.col("rep") < F.col("other"))
    if not pairs.isEmpty():
        known = linked(pairs, texts, nodes, threshold, known, rounds=0)
    links, labels = known
    large = several.where(F.col("n") > PAIRED)
    if large.isEmpty():
        return known
    again = held.select("rep", "key").join(large.select("key"), "key").join(labels, "rep")
    found = materialize(linking(again, large, texts, threshold), "links")
    if not found.isEmpty():
        links, labels = links.unionByName(found), joined_labels(labels, found)
    return links, labels


def _apart(held: DataFrame, others: DataFrame, met: DataFrame, once: Column) -> DataFrame:
    """``(a, b, bands)``: pairs of members and ``others`` of a bucket that have different labels and have not met."""
    return slim(
        held.join(others, "key")
        .where((F.col("label") != F.col("other_label")) & once)
        .groupBy(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
        .agg(F.count("*").alias("bands"))
        .join(met.select("a", "b"), ["a", "b"], "left_anti"),
        "pairs",
    )


def _rows(docs: DataFrame) -> DataFrame:
    return only(docs, doc_id="bigint", text="string").withColumn("check", text_check(F.col("text")))


def _texts_of(rows: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(rep, text)`` of the nodes. Where rows repeat an id, the text with the right words is taken."""
    wanted = reps.join(nodes, "rep").select(F.col("doc_id").alias("w_id"), "rep")
    near = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id"))).select("rep", "text")
    return near.mapInArrow(_same_words, "rep binary, text string").groupBy("rep").agg(F.first("text").alias("text"))


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(doc_id, check, class_id, class_check, class_size, links)`` per row.

    ``links`` counts the verified pairs of the row's text. ``check`` is a hash of the
    text; with the id it tells rows apart that repeat an id.
    """
    rows = _rows(docs)
    signed = materialize(
        rows.mapInArrow(_bands(BANDS, ROWS), "doc_id bigint, check bigint, rep binary, keys array<bigint>"),
        "signatures",
    )
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "check")
    reps = slim(
        signed.groupBy("rep").agg(
            F.min("doc_id").alias("doc_id"),
            F.min(member).alias("first"),
            F.count("*").alias("copies"),
            F.first("keys").alias("keys"),
        ),
        "representatives",
    )
    banded = reps.select("rep", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = slim(banded.join(shared, "key").select("rep", "key", "n"), "buckets")
    # Who meets most others over all bands is likely near to most members of its buckets.
    central = buckets.groupBy("rep").agg(F.sum("n").alias("met"))
    hubs = (
        buckets.join(central, "rep")
        .groupBy("key")
        .agg(
            F.max(F.struct("met", F.xxhash64("rep").alias("by"), "rep")).alias("first"),
            F.max(F.struct(F.xxhash64("rep", "key").alias("by"), "rep")).alias("last"),
        )
        .select("key", F.col("first.rep").alias("first"), F.col("last.rep").alias("last"))
    )
    pairs = slim(
        buckets.join(hubs, "key")
        .select("rep", F.explode(F.array_distinct(F.array("first", "last"))).alias("hub"))
        .where("rep != hub")
        .groupBy(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        .agg(F.count("*").alias("bands")),
        "pairs",
    )
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    texts = materialize(_texts_of(rows, reps.select("rep", "doc_id"), nodes), "texts")
    nodes = texts.select("rep")

    known = linked(pairs, texts, nodes, threshold)
    links, labels = settled(buckets, pairs, texts, nodes, threshold, known)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    joined = (
        reps.select("rep", "first", "copies")
        .join(labels, "rep", "left")
        .join(degree, "rep", "left")
        .withColumn("label", F.coalesce("label", "rep"))
    )
    groups = joined.groupBy("label").agg(F.sum("copies").alias("class_size"), F.min("first").alias("leader"))
    told = (
        joined.join(groups.where("class_size > 1"), "label")
        .select("rep", "leader", "class_size", F.coalesce("links", F.lit(0)).alias("links"))
    )
    alone = F.col("class_size").isNull()
    return (
        signed.select("doc_id", "check", "rep")
        .join(told, "rep", "left")
        .select(
            "doc_id",
            "check",
            F.when(alone, F.col("doc_id")).otherwise(F.col("leader.doc_id")).alias("class_id"),
            F.when(alone, F.col("check")).otherwise(F.col("leader.check")).alias("class_check"),
            F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
            F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        )
    )


def deduplicate(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The first row of each class of ``docs``, with all its columns."""
    found = materialize(classes(docs, threshold).where("class_size > 1"), "classes")
    own = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("check") == F.col("class_check"))
    again = found.where(own).groupBy("doc_id", "check").count().where("count > 1")
    return kept_rows(docs, text_check(F.col("text").cast("string")), found.where(~own), again, F.lit(0))
