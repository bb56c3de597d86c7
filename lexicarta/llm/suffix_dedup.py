"""Repeated passages by suffix arrays: bytes of strings of 50 that an earlier document has too go.

Earlier is the document with the smaller ``doc_id``. The text is held in shards of a few
megabytes, in a table bucketed by shard, so that no later step moves it.

* Every string of 50 bytes has one anchor: of its 27 strings of 24 bytes the one of smallest
  hash. Strings with the same anchor that follow each other are a unit. Shards send the hashes of
  their anchors to parts by range of hash, and learn which another document has too.
* Only text around such anchors can repeat. Each shard sorts its suffixes by induced sorting
  (:mod:`~lexicarta.llm.suffixes`) and computes the permuted common prefixes. Suffixes next to each
  other that have 50 bytes in common are a class: equal strings of the shard. A string
  goes if its class has a smaller document.
* Classes give the units that differ inside a shard, each with its smallest document. Their
  keys meet in parts: a unit that another shard holds in a smaller document goes as a whole.
  If the anchor stands in no other unit, nothing more can be found.
* The texts of the remaining units, at the ends of common passages, meet in parts, once for each
  shard and unit. Strings of the same bytes have the same anchor, so there they are told apart. Strings
  around an anchor of more than ``HOT_UNITS`` units meet by keys of their own instead.

Whatever a passage's number of copies, a shard sends one key for it. Parts are ranges of hashes
of about ``PART_KEYS`` keys. Keys have 128 bits; hashes of anchors only choose what is looked at.

Defined results: a null text counts as empty and keeps nothing. Rows with a null id come after
all others and, among themselves, like rows that share an id, remove nothing from each other. Repeated
rows are rows of their own. A text longer than a shard is looked at in several shards that
overlap by 49 bytes. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import only, text_slices
from lexicarta.llm.suffixes import permuted_common_prefixes, suffix_array
from lexicarta.session import materialize, scratch_path

WINDOW = 50
GRAM = 24
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Keys of anchors in a part, about.
PART_KEYS = 1 << 20
#: Units of an anchor up to which they meet in one part; those of more frequent ones meet string by string.
HOT_UNITS = 2048
#: Strings of 24 bytes for each anchor.
SPACING = (WINDOW - GRAM + 2) / 2
MAX_BUCKETS = 100_000

LAST = np.iinfo(np.int64).max
POSITION_BITS = 24
MESSAGE = "shard bigint, part int, kind string, data binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
#: A number for each byte.
_BYTES = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


# --- hashes -------------------------------------------------------------------


def mixed(a: np.ndarray, b: np.ndarray, odd: int = 0) -> np.ndarray:
    """A hash of two arrays of 64 bits, element by element."""
    x = a * _ODD[odd]
    x ^= x >> np.uint64(29)
    x += b
    x *= _ODD[odd + 1]
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position, by joining hashes of halves."""
    hashes = _BYTES[data]
    three = hashes[:-1] * _ODD[0] + hashes[1:]
    three = three[:-1] * _ODD[1] + hashes[2:]
    length = 3
    while length < GRAM:
        three = three[:-length] * _ODD[length % 4] + three[length:]
        length *= 2
    return mixed(three, np.uint64(GRAM))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_keys(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the ``WINDOW`` bytes at each position, of overlapping words of eight bytes."""
    first = np.full(len(at), 1, dtype=np.uint64)
    second = np.full(len(at), 2, dtype=np.uint64)
    for offset in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        word = words[at + offset]
        first, second = mixed(first, word), mixed(second, word, 2)
    return first, second


# --- messages -----------------------------------------------------------------


def message(shard: int, part: int, kind: str, **arrays) -> tuple:
    return shard, part, kind, zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def opened(data: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.decompress(data))


def table_of(messages: list[tuple]) -> pa.Table:
    columns = zip(*messages) if messages else ([], [], [], [])
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary())
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["shard", "part", "kind", "data"])


def read_messages(table: pa.Table, kind: str) -> list[tuple[int, int, dict]]:
    """``(shard, part, arrays)`` of a kind, in order of part and shard."""
    table = table.rename_columns(["shard", "part", "kind", "data"])
    rows = table.filter(pc.equal(table["kind"], kind)).sort_by([("part", "ascending"), ("shard", "ascending")])
    return [
        (s, p, opened(d))
        for s, p, d in zip(rows["shard"].to_pylist(), rows["part"].to_pylist(), rows["data"].to_pylist())
    ]


def by_part(shard: int, kind: str, parts: np.ndarray, **arrays) -> list[tuple]:
    """A message to each part; ``parts`` are in order."""
    found = []
    cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
    for start, stop in zip(cuts, [*cuts[1:], len(parts)]):
        found.append(message(shard, int(parts[start]), kind, **{k: v[start:stop] for k, v in arrays.items()}))
    return found


def answers(table: pa.Table, kind: str) -> np.ndarray:
    """The answers to a shard, in the order in which it sent its keys."""
    found = [arrays["answer"] for _, _, arrays in read_messages(table, kind)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint8)


def spans_of(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    first = np.append(True, starts[1:] > reach[:-1])
    return starts[first], reach[np.append(first[1:], True)]


def cover(at: np.ndarray, length: int | np.ndarray = 1) -> tuple[np.ndarray, np.ndarray]:
    """The runs of bytes of ``length`` strings from each position."""
    return spans_of(at.astype(np.int64), at.astype(np.int64) + length - 1 + WINDOW)


# --- shards -------------------------------------------------------------------


class Shard:
    """The documents of a shard, one after the other with a byte between them."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("at")
        self.ids = table["doc_id"].combine_chunks()
        self.rank = pc.fill_null(self.ids, LAST).to_numpy(zero_copy_only=False)
        self.texts = table["text"].cast(pa.large_binary()).combine_chunks()
        if isinstance(self.texts, pa.ChunkedArray):
            self.texts = pa.concat_arrays(self.texts.chunks)
        self.lengths = pc.binary_length(self.texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        offsets = np.frombuffer(self.texts.buffers()[1], np.int64)[self.texts.offset :][: len(self.texts) + 1]
        raw = self.texts.buffers()[2]
        flat = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
        self.data = np.zeros(int(self.lengths.sum()) + len(self.lengths) + 8, dtype=np.uint8)
        self.data[np.arange(len(flat)) + np.repeat(np.arange(len(self.lengths)), self.lengths)] = flat
        self.words = np.ndarray(shape=(len(self.data) - 7,), dtype="<u8", buffer=self.data.data, strides=(1,))

    def ranks(self, at: np.ndarray) -> np.ndarray:
        return self.rank[np.searchsorted(self.starts, at, side="right") - 1]

    def units(self) -> dict[str, np.ndarray]:
        """Strings with the same anchor: first position, number, anchor's hash, and 128 bits of them all."""
        found: list[dict] = []
        most = int(self.starts[-1] + self.lengths[-1]) if len(self.starts) else 0
        for low in range(0, most, SHARD_BYTES):
            data = self.data[low : min(most, low + SHARD_BYTES + WINDOW - 1)]
            if len(data) >= WINDOW:
                found.append(self._units(low, data))
        if not found:
            found = [{"first": np.zeros(0, np.int64), "count": np.zeros(0, np.int64),
                      **{k: np.zeros(0, np.uint64) for k in ("anchor", "a", "b")}}]
        return {k: np.concatenate([f[k] for f in found]) for k in found[0]}

    def _units(self, low: int, data: np.ndarray) -> dict[str, np.ndarray]:
        hashes = gram_hashes(data)
        mask = np.uint64((1 << POSITION_BITS) - 1)
        marked = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        spots = sliding_least(marked, WINDOW - GRAM + 1)
        edges = np.zeros(len(data) + 1, dtype=np.int32)
        inside = self.lengths >= WINDOW
        begin = np.clip(self.starts[inside] - low, 0, len(spots))
        end = np.clip(self.starts[inside] + self.lengths[inside] - WINDOW + 1 - low, 0, len(spots))
        np.add.at(edges, begin, 1)
        np.add.at(edges, end, -1)
        at = np.flatnonzero(np.cumsum(edges[: len(spots)]) > 0)
        anchor = (spots[at] & mask).astype(np.int64)
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
        cuts = np.flatnonzero(new)
        first, count = at[cuts], np.diff(np.append(cuts, len(at)))
        last, shift = first + count - 1, WINDOW - GRAM
        return {
            "first": first + low,
            "count": count,
            "anchor": mixed(hashes[anchor[cuts]], np.uint64(3), 2),
            "a": mixed(hashes[first], hashes[last + shift]),
            "b": mixed(hashes[first + shift], hashes[last], 2) + count.astype(np.uint64),
        }


def anchor_codes(units: dict[str, np.ndarray], parts: int) -> np.ndarray:
    """The part of an anchor above 32 bits of its hash."""
    part = (units["anchor"] >> np.uint64(32)) % np.uint64(parts)
    return part << np.uint64(32) | units["anchor"] & np.uint64(0xFFFFFFFF)


def least_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, LAST, dtype=np.int64)
    np.minimum.at(least, index, values)
    return least


def sent_anchors(shard: int, text: Shard, parts: int) -> list[tuple]:
    """Hashes of anchors, and whether several documents of the shard have them."""
    units = text.units()
    codes, index = np.unique(anchor_codes(units, parts), return_inverse=True)
    doc = np.searchsorted(text.starts, units["first"], side="right")
    several = least_by(index, doc, len(codes)) != -least_by(index, -doc, len(codes))
    return by_part(shard, "anchors", codes >> np.uint64(32), key=codes.astype(np.uint32), several=several)


def common_anchors(table: pa.Table) -> pa.Table:
    """For the anchors that shards sent to a part, whether they stand in several documents."""
    sent = read_messages(table, "anchors")
    keys, index = np.unique(np.concatenate([m["key"] for *_, m in sent]), return_inverse=True)
    several = np.concatenate([m["several"] for *_, m in sent])
    common = (np.bincount(index, minlength=len(keys)) > 1) | (np.bincount(index, several, minlength=len(keys)) > 0)
    return _answered(sent, "key", common[index].astype(np.uint8))


def _answered(sent: list[tuple], key: str, answer: np.ndarray, kind: str = "answers") -> pa.Table:
    cuts = np.cumsum([0, *(len(m[key]) for *_, m in sent)])
    return table_of([
        message(shard, part, kind, answer=answer[low:high])
        for (shard, part, _), low, high in zip(sent, cuts[:-1], cuts[1:])
    ])


def classes_of(text: Shard, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the strings of the units, in order, and the class of each by the suffix array."""
    starts, stops = cover(first, count)
    lengths = stops - starts
    to = np.cumsum(lengths + 1) - lengths - 1
    gathered = np.full(int(lengths.sum()) + len(lengths) + 1, 1, dtype=np.uint8)  # 1 between stretches
    steps = np.arange(int(lengths.sum()))
    before = np.cumsum(lengths) - lengths
    gathered[steps + np.repeat(to - before, lengths)] = text.data[steps + np.repeat(starts - before, lengths)] + 2
    gathered[-1] = 0  # UTF-8 has no byte above 0xF4, so 0 and 1 are free
    array = suffix_array(gathered, 256)
    common = permuted_common_prefixes(gathered, array)
    class_of = np.empty(len(array), dtype=np.int64)
    class_of[array] = np.cumsum(common[array] < WINDOW)
    at = strings_of(first, count)
    stretch = np.searchsorted(starts, at, side="right") - 1
    return at, class_of[at - starts[stretch] + to[stretch]]


def sorted_shard(shard: int, text: Shard, told: pa.Table, parts: int) -> list[tuple]:
    """What the suffix array of a shard finds, and the units that other shards may hold."""
    units = text.units()
    codes, index = np.unique(anchor_codes(units, parts), return_inverse=True)
    common = answers(told, "answers")[index] > 0 if len(codes) else np.zeros(0, bool)
    units = {k: v[common] for k, v in units.items()}
    if not len(units["first"]):
        return []
    code = codes[index[common]]
    numbers, starts, stops = [], [], []
    made = 0
    low = 0
    while low < len(code):  # a text longer than a shard has several
        high = int(np.searchsorted(units["first"], units["first"][low] + SHARD_BYTES))
        first, count = units["first"][low:high], units["count"][low:high]
        at, class_of = classes_of(text, first, count)
        rank = text.ranks(at)
        least = least_by(class_of, rank, int(class_of.max()) + 1)
        begin, end = cover(at[rank > least[class_of]])
        starts.append(begin)
        stops.append(end)
        ends = np.cumsum(count)
        unit = (class_of[ends - count] << 36) + (class_of[ends - 1] << 8) + count
        _, number = np.unique(unit, return_inverse=True)
        numbers.append(number + made)
        made += int(number.max()) + 1
        low = high
    number = np.concatenate(numbers)
    one = np.empty(made, dtype=np.int64)
    one[number] = np.arange(len(number))
    least = least_by(number, text.ranks(units["first"]), made)
    a, b, code = units["a"][one], units["b"][one], code[one]
    order = np.lexsort((b, a, code))
    place = np.empty(made, dtype=np.int32)
    place[order] = np.arange(made)
    sent = by_part(
        shard, "units", code[order] >> np.uint64(32),
        key=code[order].astype(np.uint32), a=a[order], b=b[order], least=least[order],
    )
    sent.append(message(shard, -1, "rest", first=units["first"], count=units["count"].astype(np.uint8), unit=place[number]))
    sent.append(message(shard, -1, "spans", start=np.concatenate(starts), stop=np.concatenate(stops)))
    return sent


def judged_units(table: pa.Table) -> pa.Table:
    """For each unit: 1 if a smaller document of another shard has it, 2 if only its anchor stands elsewhere too.

    3 if that anchor has too many units to meet in one part.
    """
    sent = read_messages(table, "units")
    key, a, b, least = (np.concatenate([m[k] for *_, m in sent]) for k in ("key", "a", "b", "least"))
    order = np.lexsort((b, a, key))
    key, a, b = key[order], a[order], b[order]
    other_key = np.append(True, key[1:] != key[:-1])
    other_unit = other_key | np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    unit, anchor = np.cumsum(other_unit) - 1, np.cumsum(other_key) - 1
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(other_unit))
    units = np.bincount(anchor, other_unit)[anchor]
    answer = np.empty(len(order), dtype=np.uint8)
    contested = np.where(units > HOT_UNITS, 3, np.where(units > 1, 2, 0))
    answer[order] = np.where(smallest[unit] < least[order], 1, contested)
    return _answered(sent, "key", answer)


def strings_of(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions of the strings of units."""
    return np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def contested_strings(shard: int, text: Shard, told: pa.Table, parts: int) -> list[tuple]:
    """Units that go as a whole, and those to be compared string by string."""
    rest = read_messages(told, "rest")
    if not rest:
        return []
    first, count, unit = (rest[0][2][k] for k in ("first", "count", "unit"))
    count = count.astype(np.int64)
    replies = read_messages(told, "answers")
    answer = np.concatenate([m["answer"] for *_, m in replies])
    part_of = np.repeat([part for _, part, _ in replies], [len(m["answer"]) for *_, m in replies])
    gone = answer[unit] == 1
    start, stop = cover(first[gone], count[gone])
    sent = [message(shard, -1, "spans", start=start, stop=stop)]
    # Of a unit the smallest document's strings are enough: those of others are gone by their class.
    rank = text.ranks(first)
    least = least_by(unit, rank, len(answer))
    own = rank == least[unit]
    asks = np.flatnonzero(own & (answer[unit] == 2))
    if len(asks):
        units, one, number = np.unique(unit[asks], return_index=True, return_inverse=True)
        begin, length = first[asks[one]], count[asks[one]] + WINDOW - 1
        bounds = np.append(0, np.cumsum(length))
        bytes_ = text.data[strings_of(begin, length)]
        cuts = np.flatnonzero(np.append(True, part_of[units][1:] != part_of[units][:-1]))
        for low, high in zip(cuts, [*cuts[1:], len(units)]):
            sent.append(message(
                shard, int(part_of[units[low]]), "snippets", text=bytes_[bounds[low] : bounds[high]],
                count=count[asks[one[low:high]]].astype(np.uint8), least=least[units[low:high]],
            ))
        sent.append(message(shard, -1, "asked", first=first[asks], unit=number.astype(np.int32)))
    asks = own & (answer[unit] == 3)
    if asks.any():
        at, rank = strings_of(first[asks], count[asks]), np.repeat(rank[asks], count[asks])
        a, b = window_keys(text.words, at)
        part = (a >> np.uint64(32)) % np.uint64(parts)
        order = np.lexsort((b, a, part))
        a, b, part, at, rank = a[order], b[order], part[order], at[order], rank[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        smallest = np.minimum.reduceat(rank, np.flatnonzero(new))
        sent += by_part(shard, "strings", part[new], a=a[new], b=b[new], least=smallest)
        sent.append(message(shard, -1, "places", at=at, string=(np.cumsum(new) - 1).astype(np.int32)))
    return sent


def earlier_elsewhere(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether another row with the same key has a smaller ``least``."""
    order = np.lexsort((b, a))
    other = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(other))
    answer = np.empty(len(order), dtype=bool)
    answer[order] = smallest[np.cumsum(other) - 1] < least[order]
    return answer


def judged_strings(table: pa.Table) -> pa.Table:
    """For the units and strings sent to a part, what a smaller document of another shard has too.

    A unit is answered by one bit per string.
    """
    found = []
    sent = read_messages(table, "snippets")
    if sent:
        count, least = (np.concatenate([m[k] for *_, m in sent]) for k in ("count", "least"))
        count = count.astype(np.int64)
        data = np.concatenate([*(m["text"] for *_, m in sent), np.zeros(8, np.uint8)])
        words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
        begin = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)
        at = strings_of(begin, count)
        gone = earlier_elsewhere(*window_keys(words, at), np.repeat(least, count))
        bits = gone.astype(np.uint32) << (at - np.repeat(begin, count)).astype(np.uint32)
        found.append(_answered(sent, "count", np.bitwise_or.reduceat(bits, np.cumsum(count) - count), "masks"))
    sent = read_messages(table, "strings")
    if sent:
        a, b, least = (np.concatenate([m[k] for *_, m in sent]) for k in ("a", "b", "least"))
        found.append(_answered(sent, "a", earlier_elsewhere(a, b, least).astype(np.uint8)))
    return pa.concat_tables(found)


def placed_strings(table: pa.Table) -> pa.Table:
    """The spans of the strings that go."""
    shard = table["shard"][0].as_py()
    found = []
    for _, _, asked in read_messages(table, "asked"):
        masks = answers(table, "masks")[asked["unit"]]
        for k in range(WINDOW - GRAM + 1):
            found.append(asked["first"][(masks >> np.uint32(k)) & np.uint32(1) > 0] + k)
    for _, _, places in read_messages(table, "places"):
        found.append(places["at"][answers(table, "answers")[places["string"]] > 0])
    if not found:
        return table_of([])
    start, stop = cover(np.concatenate(found))
    return table_of([message(shard, -1, "spans", start=start, stop=stop)])


def kept_documents(text: Shard, told: pa.Table) -> pa.Table:
    found = [m for *_, m in read_messages(told, "spans")]
    start, stop = (np.concatenate([m[k] for m in found]) if found else np.zeros(0, np.int64) for k in ("start", "stop"))
    start, stop = spans_of(start, stop)
    doc = np.searchsorted(text.starts, start, side="right") - 1
    n = len(text.lengths)
    spans = np.bincount(doc, minlength=n)
    removed = np.bincount(doc, (stop - start).astype(np.float64), minlength=n).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(spans)])
    data = memoryview(text.data)
    digests = []
    for i in range(n):
        at, end = int(text.starts[i]), int(text.starts[i] + text.lengths[i])
        digest = hashlib.sha256()
        for k in range(bounds[i], bounds[i + 1]):
            digest.update(data[at : start[k]])
            at = int(stop[k])
        digest.update(data[at:end])
        digests.append(digest.hexdigest())
    return pa.table({
        "doc_id": text.ids, "n_bytes": text.lengths, "n_removed": removed, "n_spans": spans.astype(np.int64),
        "kept_sha256": pa.array(digests, pa.string()),
    })


# --- the job ------------------------------------------------------------------


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """``(shard, at, doc_id, text)``, written in buckets by shard: each shard is in one task wherever it is read."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, limit=SHARD_BYTES):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard)), pa.array(np.arange(n, dtype=np.int32)), part.column("doc_id"),
                 pc.fill_null(part.column("text"), "")],
                names=["shard", "at", "doc_id", "text"],
            )
            shard += 1

    spark = docs.sparkSession
    name = f"lexicarta_shards_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(numbered, "shard bigint, at int, doc_id bigint, text string")
    writer = rows.write.bucketBy(min(MAX_BUCKETS, max(1, shards)), "shard").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "shards")).saveAsTable(name)
    return spark.table(name)


def removed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: :data:`RESULT`."""
    rows = only(docs, doc_id="bigint", text="string")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / SPACING / PART_KEYS))
    texts = sharded(rows, math.ceil(size / SHARD_BYTES))

    def sends(make: Callable[[int, Shard, pa.Table, int], list[tuple]]):
        def run(key: tuple, text: pa.Table, told: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            return table_of(make(shard, Shard(text), told, parts) if text.num_rows else [])

        return run

    def anchors(key: tuple, text: pa.Table) -> pa.Table:
        return table_of(sent_anchors(key[0].as_py(), Shard(text), parts))

    def kept(text: pa.Table, told: pa.Table) -> pa.Table:
        return kept_documents(Shard(text), told)

    def judged(sent: DataFrame, judge: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return sent.groupBy("part").applyInArrow(judge, MESSAGE)

    def of_shards(told: DataFrame):
        return texts.groupBy("shard").cogroup(told.withColumnRenamed("shard", "to_shard").groupBy("to_shard"))

    asked = texts.groupBy("shard").applyInArrow(anchors, MESSAGE)
    found = of_shards(judged(asked, common_anchors)).applyInArrow(sends(sorted_shard), MESSAGE)
    found = materialize(found, "units")
    told = judged(found.where("kind = 'units'"), judged_units).unionByName(found.where("kind = 'rest'"))
    more = materialize(of_shards(told).applyInArrow(sends(contested_strings), MESSAGE), "strings")
    told = judged(more.where("kind IN ('snippets', 'strings')"), judged_strings).unionByName(
        more.where("kind IN ('asked', 'places')")
    )
    last = told.groupBy("shard").applyInArrow(placed_strings, MESSAGE)
    spans = last.unionByName(found.where("kind = 'spans'")).unionByName(more.where("kind = 'spans'"))
    return of_shards(spans).applyInArrow(kept, RESULT)
