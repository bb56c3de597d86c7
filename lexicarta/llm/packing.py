"""Best-fit-decreasing packing of tokenised documents into sequences.

Documents are tokenised where they lie; only the lengths of their pieces travel. The
pieces are dealt by a hash, of the row too, into groups of bounded size, each with the whole mixture of
lengths, and every group is packed on its own: pieces by falling length, each into the
open bin with the least room that still takes it. A segment tree over the remaining
capacities finds that bin in logarithmic time. A group leaves few bins that are not well
filled; the pieces of those bins of all groups are packed once more together.

Pieces that carry the slot of a mix (:func:`pack_mix`) are packed in stretches of slots
instead, and sequence ids rise with the slots, so that the order of the sequences is the mix.

Defined results: a null text is empty and has the closing id alone; a document longer
than the capacity is cut into full pieces and a rest; every row is packed, also rows
that repeat; a null ``doc_id`` is kept. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from lexicarta.llm.common import filled, only, text_slices, worker_memo
from lexicarta.session import materialize

CAPACITY = 4096
CLOSING_ID = 1
#: Pieces that one group packs together.
GROUP = 1 << 16
#: Share of the capacity from which a bin stays as its group has packed it.
WELL_FILLED = 15 / 16
#: Slots of a mix that are packed together.
STRETCH = 64
#: Words whose ids a Python worker remembers before it forgets them.
MEMO_WORDS = 250_000
#: A byte that no text has, behind the last one of a word: where it ends, a vocabulary has letters of its own.
WORD_END = b"\xff"
#: What the tokenizer parts from letters before it, whatever follows: none begins a contraction.
TRAILING = ".,!?;:*$%&#|\"()[]{}<>/-+=_~^@"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordIds:
    """Token ids of texts, found word by word.

    The tokenizer drops white space and never joins across it, so that the ids of a text
    are those of its words in a row. Each distinct word of a slice is encoded once, and remembered
    if it occurs there more than once; the ids of all of them lie in one array. Words are looked up in ASCII lower case, as
    the tokenizer lowers them anyway; only those with ``<|`` as they are spelt, as special
    tokens are matched before.
    """

    #: Letters that normalisation changes in no other way than by lowering each alone.
    SIMPLE = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.merger = self._merger(path)
        self._clear()

    def _merger(self, path: str):
        """The merges on bytes, if the vocabulary is letters, letters at the end of words, and merges in order."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        byte = {c: bytes([b]) for b, c in enumerate(self.letters)}
        first = 2 * len(byte)
        ordered = all(vocab.get(a + b) == first + i for i, (a, b) in enumerate(merges))
        lettered = all(vocab.get(c, first) < first and vocab.get(c + end, first) < first for c in byte)
        if not (end and ordered and lettered) or model.get("dropout") or model.get("ignore_merges"):
            return None
        ranks = {}
        for token, number in vocab.items():
            if number < first + len(merges):
                stem = token.removesuffix(end) if token not in byte else token
                ranks[b"".join(byte[c] for c in stem) + (WORD_END if token != stem else b"")] = number
        # Letters at the end have ranks below all merges, so they are joined with it first; the mark alone is no id.
        ranks[WORD_END] = len(vocab) + 1
        return tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _add(self, word: str, ids: Iterable[int]) -> None:
        self.known[word] = len(self.ends) - 1
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def _of(self, word: str) -> array:
        number = self.known[word]
        return self.ids[self.ends[number] : self.ends[number + 1]]

    def _encode(self, words: list[str]) -> None:
        """Adds words; those of simple letters go to the model directly."""
        tokenize, letters, other = self.tokenizer.model.tokenize, self.letters, []
        merged = self.merger and self.merger._core_bpe.encode_single_piece
        for word in words:
            if self.SIMPLE.fullmatch(word):
                if merged:
                    self._add(word, merged(word.lower().encode() + WORD_END))
                elif not word.isascii():
                    mapped = "".join(letters[b] for b in word.lower().encode())
                    self._add(word, [t.id for t in tokenize(mapped)])
                else:
                    self._add(word, [t.id for t in tokenize(word)])
            else:
                other.append(word)
        for word, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self._add(word, found.ids)

    def _learn(self, words: list[str]) -> None:
        """Adds words; marks after simple letters are encoded apart from them."""
        parts = []
        for word in words:
            stem = word.rstrip(TRAILING)
            if len(stem) < len(word) and self.SIMPLE.fullmatch(stem):
                # A special token may begin within the marks, but not end there.
                if "<|" not in word or not any(s in word for s in self.specials):
                    parts.append((word, stem, word[len(stem) :]))
        whole = set(words).difference(p[0] for p in parts)
        pieces = dict.fromkeys(p for _, *pair in parts for p in pair)
        self._encode([w for w in {**dict.fromkeys(whole), **pieces} if w not in self.known])
        for word, stem, marks in parts:
            self._add(word, self._of(stem) + self._of(marks))

    def of_words(self, words: list[str], often: np.ndarray | None = None) -> list[int]:
        """The numbers of distinct words; only those that are ``often`` seen stay known after :meth:`forget`."""
        if len(self.known) > MEMO_WORDS:
            self._clear()
        found = list(map(self.known.get, words))
        new = [w for w, number in zip(words, found) if number is None]
        if new:
            kept = {w for w, many in zip(words, often) if many} if often is not None else set(new)
            self._learn([w for w in new if w in kept])
            self.lasting = len(self.known), len(self.ends), len(self.ids)
            self._learn([w for w in new if w not in kept])
            found = list(map(self.known.__getitem__, words))
        else:
            self.lasting = len(self.known), len(self.ends), len(self.ids)
        return found

    def forget(self) -> None:
        """Drops what the last words added that were not often seen."""
        n_known, n_ends, n_ids = self.lasting
        while len(self.known) > n_known:
            self.known.popitem()  # the last one added
        del self.ends[n_ends:], self.ids[n_ids:]

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and where each text ends."""
        words = pc.ascii_split_whitespace(texts)
        spelt = words.flatten()
        flat = pc.ascii_lower(spelt)
        if pc.any(pc.match_substring(texts, "<|")).as_py():
            flat = pc.if_else(pc.match_substring(spelt, "<|"), spelt, flat)
        coded = flat.dictionary_encode()
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        index = coded.indices.to_numpy(zero_copy_only=False)
        often = np.bincount(index, minlength=len(coded.dictionary)) > 1
        numbers = np.array(self.of_words(coded.dictionary.to_pylist(), often), np.int64)
        number = numbers[index]
        flat, all_ends = np.array(self.ids, "<u4"), np.array(self.ends, np.int64)
        begins = all_ends[number]
        counts = all_ends[number + 1] - begins
        ends = np.cumsum(counts)
        where = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
        where += np.repeat(begins - (ends - counts), counts)
        self.forget()
        return flat[where], np.concatenate(([0], ends))[np.cumsum(per_text)]


def _cut(path: str, capacity: int, with_ids: bool, keep: tuple[str, ...]) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_memo(f"ids {path}", lambda: WordIds(path))
        for batch in text_slices(batches):
            ids, ends = coder.of_texts(filled(batch.column("text")))
            rows, begin, owner = [], 0, []
            closing = np.array([CLOSING_ID], "<u4")
            for row, (doc_id, end) in enumerate(zip(batch.column("doc_id").to_pylist(), ends.tolist())):
                own = np.concatenate((ids[begin:end], closing))
                begin = end
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    raw = part.tobytes()
                    owner.append(row)
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(raw), raw if with_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) if rows else [()] * 6
            n = 6 if with_ids else 5
            kept = [batch.column(c).take(pa.array(owner, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(columns[:n], kinds[:n])), *kept], names=[*names[:n], *keep]
            )

    return cut


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True, keep: dict[str, str] | None = None
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``; ``ids`` are little-endian unsigned 32-bit numbers.

    The document's columns ``keep``, names and types, follow.
    """
    keep = keep or {}
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += (", ids binary" if with_ids else "") + "".join(f", {name} {kind}" for name, kind in keep.items())
    rows = only(docs, doc_id="bigint", text="string", **keep)
    return rows.mapInArrow(_cut(tokenizer, capacity, with_ids, tuple(keep)), schema)


class CapacityTree:
    """Open bins by remaining capacity, in a segment tree that counts them.

    Leaf c holds the bins with exactly c left; an inner node the number of bins below.
    """

    def __init__(self, capacity: int):
        self.width = 1
        while self.width <= capacity:
            self.width *= 2
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self.width + room
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Takes out the bin with the least room of at least ``length``: its number and room."""
        count, node = self.count, self.width + length
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.width
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, given in falling order."""
    tree, opened = CapacityTree(capacity), 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        found = tree.take(length)
        if found is None:
            number, room, opened = opened, capacity, opened + 1
        else:
            number, room = found
        bins[i], offsets[i] = number, capacity - room
        if room > length:
            tree.put(room - length, number)
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, which are written once.

    Rows are numbered as they were written, so that equal ones are dealt to all groups.
    """
    parts = materialize(parts, "pieces")
    columns = parts.columns

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = frame["length"].to_numpy()
        bins, frame["offset"] = best_fit_decreasing(lengths, capacity)
        frame["sequence_id"] = (int(frame["part"].iloc[0]) << 40) + bins
        frame["well_filled"] = (np.bincount(bins, lengths) >= WELL_FILLED * capacity)[bins]
        return frame.drop(columns="part")

    schema = StructType([*parts.schema.fields]).add("row", LongType())
    schema = schema.add("offset", LongType()).add("sequence_id", LongType()).add("well_filled", BooleanType())

    def packed(rows: DataFrame, first: int) -> tuple[DataFrame, int]:
        groups = max(1, -(-rows.count() // group))
        part = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("bigint") + F.lit(first)
        return rows.withColumn("part", part).groupBy("part").applyInPandas(place, schema), first + groups

    once, groups = packed(parts.withColumn("row", F.monotonically_increasing_id()), 0)
    kept = [*columns, "offset", "sequence_id"]
    if groups == 1:  # one group is one packing already
        return once.select(*kept)
    once = materialize(once, "packed")
    again, _ = packed(once.where("NOT well_filled").select(*columns, "row"), groups)
    return once.where("well_filled").select(*kept).unionByName(again.select(*kept))


def pack_mix(parts: DataFrame, capacity: int = CAPACITY, stretch: int = STRETCH) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``slot`` and ``place``, which go.

    Each stretch of slots is packed on its own. Its sequences are numbered by the mean slot
    of their ids, so that sequences in the order of their ids follow the mix.
    """

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(
            ["length", "slot", "place", "doc_id", "piece"], ascending=[False, True, True, True, True], kind="stable"
        )
        lengths = frame["length"].to_numpy()
        bins, frame["offset"] = best_fit_decreasing(lengths, capacity)
        mean = np.bincount(bins, frame["slot"].to_numpy() * lengths) / np.bincount(bins, lengths)
        rank = np.empty(len(mean), np.int64)
        rank[np.argsort(mean, kind="stable")] = np.arange(len(mean))
        frame["sequence_id"] = (int(frame["part"].iloc[0]) << 40) + rank[bins]
        return frame.drop(columns=["part", "slot", "place"])

    fields = [f for f in parts.schema.fields if f.name not in ("slot", "place")]
    schema = StructType(fields).add("offset", LongType()).add("sequence_id", LongType())
    dealt = parts.withColumn("part", F.floor(F.col("slot") / stretch).cast("bigint"))
    return dealt.groupBy("part").applyInPandas(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, doc_ids, ids)`` of packed pieces with ids; at most a capacity of ids each."""
    entry = F.struct("offset", "doc_id", F.hex("ids").alias("ids"))
    rows = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(entry)).alias("parts")
    )
    return rows.select(
        "sequence_id",
        "length",
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), "")).alias("ids"),
    )
