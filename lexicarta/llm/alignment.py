"""Alignment of the tokens of two tokenizers by the bytes they cover.

Both tokenizers read the same bytes, a space and the text: A is a byte-level BPE, B a
sentencepiece model that adds the space itself. Where a token of A and one of B end at the
same byte, the text is cut into groups; a pair of tokens whose bytes overlap is a link.

* A task takes a few megabytes of documents at a time and encodes every distinct word of
  them once. Ids are one Arrow list column per tokenizer: flattened, with the row of each token as parent index, and with the cumulative
  sum of the byte lengths, less what came before the row, as end of each token.
* An Acero hash join of both sides on row and end finds the cuts.
* Two neighbouring ends, of either side, enclose bytes of one token of A and one of B, and
  no other piece of text belongs to that pair; so links are the distinct ends.
* ``Table.group_by`` counts the pairs of ids of a slice. Spark merges these partial counts,
  finds the highest count of every id of B, and hands the counts back to the slices they
  came from, where a document adds up its own links.

A document keeps its links as numbers of its slice's pairs, the most frequent first, so that
they compress well; texts and tokens are written nowhere. A slice is a group of bounded size,
and a pair is one row per slice, so no id, however frequent, gathers in one task.

Defined results: a null or empty text has no tokens, and so has one whose tokens do not spell
a space and the text, byte by byte, in both tokenizers: its numbers are zeros, its digest is
empty. Rows that repeat, and rows with null ids, are rows of their own, and all their links
count. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import only, text_slices, worker_memo
from lexicarta.session import materialize

#: Bytes of text whose pairs are counted together.
SLICE_BYTES = 4 << 20
#: Bytes of text given to a tokenizer at once; its own records are many times as large.
ENCODE_BYTES = 64 << 10
#: What a sentencepiece model reads as a space.
SPACE_MARK = "\u2581"
#: The first character behind the Latin blocks, in which all versions of Unicode have the same letters.
BEYOND_LATIN = "\u0250"
#: Fixed value: how a byte-level vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Documents of a slice in one row, or one pair of a slice.
SCHEMA = (
    "slice bigint, doc_id array<bigint>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, "
    "groups_sha256 array<string>, links binary, pair int, a int, b int, n bigint, kind string"
)
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
FIELDS = [
    (name, pa.list_(ARROW[kind[6:-1]]) if kind.startswith("array") else ARROW[kind])
    for name, kind in (field.split(" ") for field in SCHEMA.split(", "))
]
RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string"
)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of every token, and its id as it is written into the text of the groups."""

    def __init__(self, spelt: list[bytes]):
        self.spelt = pa.array(spelt, pa.large_binary())
        self.lengths = np.array([len(s) for s in spelt], dtype=np.int64)
        names = [str(i) for i in range(len(spelt))]
        #: Ids followed by each separator, one block after the other.
        self.followed = [*names, *(n + "," for n in names), *(n + "|" for n in names), *(n + ";" for n in names)]


class Tokenizers:
    """Both tokenizers; one of each in a worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            told = json.load(file)
        known = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
        alphabet = byte_alphabet()
        spelt = [b""] * (max(known.values()) + 1)
        for token, number in known.items():
            spelt[number] = bytes(alphabet[c] for c in token)
        self.of_a = Vocabulary(spelt)
        self.of_b = Vocabulary([self._piece(i) for i in range(self.b.get_piece_size())])
        self.followed = pa.array(self.of_a.followed + self.of_b.followed, pa.large_string())
        self.merger = self._merger(told, spelt)

    def _merger(self, told: dict, spelt: list[bytes]):
        """The merges of A on bytes, if it is a byte-level BPE whose ids are the ranks of its merges."""
        import tiktoken

        model, split = told["model"], told["pre_tokenizer"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(model["vocab"]) - len(merges)
        ranked = all(model["vocab"].get(a + b) == first + i for i, (a, b) in enumerate(merges))
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if not (ranked and plain) or told["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            return None
        ranks = {spelt[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    def encoded(self, texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """The ids of both as list columns; words that texts share are encoded once.

        Neither tokenizer joins across a space that stands between two other characters, so the ids of
        a text are those of its words, each with the space before it. A text with other spaces
        is one piece as it is.
        """
        words = pc.split_pattern(texts, " ")
        coded = pc.list_flatten(words).dictionary_encode()
        odd = np.array([not w or w[0].isspace() or SPACE_MARK in w for w in coded.dictionary.to_pylist()], dtype=bool)
        other = np.zeros(len(texts), dtype=bool)
        if odd.any():
            at = odd[coded.indices.to_numpy(zero_copy_only=False)]
            other[pc.list_parent_indices(words).to_numpy()[at]] = True
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)
            words = pc.if_else(pa.array(other), whole, words)
            coded = pc.list_flatten(words).dictionary_encode()
        pieces = coded.dictionary
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        found = []
        for encode in (self._encode_a, self._encode_b):
            lists = _bounded(pieces, encode)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(lists).to_numpy()
            counts = sizes[index]
            reach = np.cumsum(counts)
            at = np.arange(int(counts.sum())) + np.repeat((np.cumsum(sizes) - sizes)[index] - (reach - counts), counts)
            offsets = np.concatenate([[0], np.concatenate([[0], reach])[ends]]).astype(np.int32)
            found.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[at])))
        return found[0], found[1]

    def _encode_a(self, pieces: list[str]) -> pa.ListArray:
        """Words are encoded as one text, and parted by their bytes, which the tokens spell.

        Where letters, digits and white space are those of the Latin blocks, a merger of the same vocabulary
        that is faster gives the same ids; the others go through the tokenizer itself.
        """
        if any(not p or " " in p or p[0].isspace() for p in pieces):
            lists = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
            return pa.array(lists, pa.list_(pa.int32()))
        latin = np.array([p.isascii() or max(p) < BEYOND_LATIN for p in pieces])
        found, sizes = [], np.zeros(len(pieces), dtype=np.int64)
        for merged in (True, False):
            some = np.flatnonzero(latin == merged)
            if not len(some):
                continue
            joined = "".join(" " + pieces[i] for i in some)
            if merged and self.merger:
                ids = self.merger.encode_ordinary(joined)
            else:
                ids = self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype=np.int32)
            stops = np.cumsum([1 + len(pieces[i].encode()) for i in some])
            ends = np.searchsorted(np.cumsum(self.of_a.lengths[ids]), stops, side="right")
            sizes[some] = np.diff(ends, prepend=0)
            found.append((some, ids, ends))
        offsets = np.append(0, np.cumsum(sizes))
        flat = np.empty(int(offsets[-1]), dtype=np.int32)
        for some, ids, ends in found:
            n = sizes[some]
            flat[np.arange(len(ids)) + np.repeat(offsets[some] - (ends - n), n)] = ids
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))

    def _encode_b(self, pieces: list[str]) -> pa.ListArray:
        return pa.array(self.b.encode(pieces, num_threads=1), pa.list_(pa.int32()))


def _bounded(pieces: pa.Array, encode: Callable[[list[str]], pa.ListArray]) -> pa.ListArray:
    """The ids of the pieces, a bounded number of bytes at a time."""
    reach = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    found, at = [], 0
    while at < len(pieces):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + ENCODE_BYTES, side="right")))
        found.append(encode(pieces.slice(at, stop - at).to_pylist()))
        at = stop
    return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))


class Side:
    """The tokens of one tokenizer over a slice of documents, all as flat arrays."""

    def __init__(self, lists: pa.ListArray, vocabulary: Vocabulary):
        self.ids = pc.list_flatten(lists)
        self.parent = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        self.counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        #: The byte where each token ends, counted over the whole slice.
        self.reach = np.cumsum(vocabulary.lengths[self.ids.to_numpy()])

    def before(self) -> np.ndarray:
        """For each document, and after the last: the bytes of all tokens before it."""
        return np.concatenate([[0], self.reach])[self.starts]

    def ends(self) -> np.ndarray:
        """The byte of its document where each token ends."""
        return self.reach - self.before()[self.parent]


def _spelt(side: Side, vocabulary: Vocabulary) -> memoryview:
    joined = vocabulary.spelt.take(side.ids)
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
    return memoryview(joined.buffers()[2]).cast("B")[offsets[0] : offsets[-1]] if len(joined) else memoryview(b"")


def spelling(texts: list[str], a: Side, b: Side, tools: Tokenizers) -> np.ndarray:
    """Whether both sides spell a space and the text, for each document."""
    same = np.zeros(len(texts), dtype=bool)
    bytes_a, bytes_b = _spelt(a, tools.of_a), _spelt(b, tools.of_b)
    from_a, from_b = a.before(), b.before()
    for i, text in enumerate(texts):
        wanted = (" " + text).encode() if text else None
        same[i] = (
            wanted is not None
            and bytes_a[from_a[i] : from_a[i + 1]] == wanted
            and bytes_b[from_b[i] : from_b[i + 1]] == wanted
        )
    return same


def cuts(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """``(document, end over the slice)`` of the bytes where tokens of both sides end, in order."""
    left, right = (
        pa.table({"doc": side.parent.astype(np.int32), "end": side.ends().astype(np.int32)}) for side in (a, b)
    )
    met = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
    doc = met["doc"].to_numpy()
    stops = a.before()[doc] + met["end"].to_numpy()
    order = np.argsort(stops)
    return doc[order], stops[order]


def linked(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of both sides that hold the bytes before each end of either, in order.

    Tokens are not empty, so ends over the slice tell documents apart.
    """
    both = np.concatenate([a.reach, b.reach])
    if not len(both):
        return both, both
    order = np.argsort(both, kind="stable")  # two rising runs are merged
    reach, of_a = both[order], order < len(a.reach)
    first = np.flatnonzero(np.append(True, reach[1:] != reach[:-1]))
    ends_a = of_a[first]
    ends_b = ~of_a[np.append(first[1:], len(reach)) - 1]
    return np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b


def written_groups(a: Side, b: Side, tools: Tokenizers, stops: np.ndarray, n_docs: int) -> list[str]:
    """The digest of ``a1,a2|b1;a3|b2,b3`` for each document; empty without tokens.

    Every id is taken with the separator that follows it, in the order of the text, so that
    the taken strings lie one after the other in memory as the text to be hashed.
    """
    digests = [""] * n_docs
    if not len(a.ids):
        return digests
    group_a, group_b = (np.searchsorted(stops, side.reach) for side in (a, b))
    last_a, last_b = (np.append(group[1:] != group[:-1], True) for group in (group_a, group_b))
    upto_a, upto_b = (np.searchsorted(group, np.arange(len(stops)), side="right") for group in (group_a, group_b))
    # A token of A follows all tokens of groups before its own, one of B those of A of its own too.
    at_a = np.arange(len(a.ids)) + np.concatenate([[0], upto_b])[group_a]
    at_b = np.arange(len(b.ids)) + upto_a[group_b]
    ends_doc = np.append(b.parent[1:] != b.parent[:-1], True)
    size_a, size_b = len(tools.of_a.lengths), len(tools.of_b.lengths)
    taken = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
    taken[at_a] = a.ids.to_numpy() + size_a * np.where(last_a, 2, 1)
    taken[at_b] = 4 * size_a + b.ids.to_numpy() + size_b * np.where(ends_doc, 0, np.where(last_b, 3, 1))
    text = tools.followed.take(pa.array(taken))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
    data = memoryview(text.buffers()[2])
    from_token = offsets[a.starts + b.starts]
    for i in np.flatnonzero(a.counts):
        digests[i] = hashlib.sha256(data[from_token[i] : from_token[i + 1]]).hexdigest()
    return digests


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by bytes of equal weight, compressed; high bytes are mostly zero."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.decompress(blob[8:], decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").reshape(-1).astype(np.int64)


def _batch(number: int, kind: str, rows: int, **columns) -> pa.RecordBatch:
    columns |= {"slice": pa.array(np.full(rows, number)), "kind": pa.array([kind] * rows)}
    return pa.RecordBatch.from_arrays(
        [columns[name].cast(field) if name in columns else pa.nulls(rows, field) for name, field in FIELDS],
        names=[name for name, _ in FIELDS],
    )


def aligned_slice(number: int, part: pa.RecordBatch, tools: Tokenizers) -> Iterator[pa.RecordBatch]:
    """A row with the documents of a slice, and a row for each of its pairs."""
    column = pc.fill_null(part.column("text"), "")
    texts = column.to_pylist()
    lists = tools.encoded(column)
    a, b = Side(lists[0], tools.of_a), Side(lists[1], tools.of_b)
    same = spelling(texts, a, b, tools)
    if not same.all():
        none = pa.scalar([], pa.list_(pa.int32()))
        a, b = (Side(pc.if_else(pa.array(same), side, none), v) for side, v in zip(lists, (tools.of_a, tools.of_b)))
    n = len(texts)
    cut_doc, stops = cuts(a, b)
    digests = written_groups(a, b, tools, stops, n)
    at_a, at_b = linked(a, b)
    key = a.ids.to_numpy()[at_a].astype(np.int64) << 32 | b.ids.to_numpy()[at_b]
    coded = pa.array(key).dictionary_encode()
    counted = pa.table({"pair": coded.indices}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    pairs, counts = coded.dictionary.to_numpy()[counted["pair"].to_numpy()], counted["count_all"].to_numpy()
    order = np.lexsort((pairs, -counts))
    place = np.empty(len(pairs), dtype=np.int64)
    place[counted["pair"].to_numpy()[order]] = np.arange(len(pairs))
    pairs, counts = pairs[order], counts[order]
    links = place[coded.indices.to_numpy(zero_copy_only=False)] if len(key) else key
    per_doc = {
        "doc_id": part.column("doc_id"),
        "n_a": pa.array(a.counts),
        "n_b": pa.array(b.counts),
        "n_groups": pa.array(np.bincount(cut_doc, minlength=n)),
        "n_links": pa.array(np.bincount(a.parent[at_a], minlength=n)),
        "groups_sha256": pa.array(digests, pa.string()),
    }
    whole = pa.array([0, n], pa.int32())
    yield _batch(
        number, "docs", 1, links=pa.array([packed(links)], pa.binary()),
        **{name: pa.ListArray.from_arrays(whole, values) for name, values in per_doc.items()},
    )
    for start in range(0, len(pairs), 10_000):
        some = slice(start, start + 10_000)
        yield _batch(
            number, "pairs", len(pairs[some]), pair=pa.array(np.arange(len(pairs))[some]), n=pa.array(counts[some]),
            a=pa.array(pairs[some] >> 32), b=pa.array(pairs[some] & 0xFFFFFFFF),
        )


def rated_documents(docs: pa.Table, rated: pa.Table) -> pa.Table:
    """The documents of a slice, with the counts of its pairs."""
    counts = np.zeros(rated.num_rows, dtype=np.int64)
    best = np.zeros(rated.num_rows, dtype=np.int64)
    at = rated["pair"].to_numpy()
    counts[at] = rated["count"].to_numpy()
    best[at] = rated["best"].to_numpy()
    parts = []
    for row in range(docs.num_rows):
        flat = {name: pc.list_flatten(docs[name].slice(row, 1)).combine_chunks() for name in docs.column_names
                if pa.types.is_list(docs.schema.field(name).type)}
        links = unpacked(docs["links"][row].as_py())
        stops = np.concatenate([[0], np.cumsum(flat["n_links"].to_numpy())])
        sums = {}
        for name, values in (("n_best", best), ("count_sum", counts)):
            running = np.concatenate([[0], np.cumsum(values[links])])
            sums[name] = pa.array(running[stops[1:]] - running[stops[:-1]])
        wide = {name: column.cast(pa.int64()) for name, column in flat.items() if name.startswith("n_")}
        parts.append(pa.table(
            {"doc_id": flat["doc_id"], **wide, **sums, "groups_sha256": flat["groups_sha256"]}
        ).select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
    return pa.concat_tables(parts)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs``: the columns of :data:`RESULT`.

    ``a_path`` is a ``tokenizers`` file of a byte-level BPE, ``b_path`` a sentencepiece model; every
    executor has both.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = worker_memo(f"alignment {a_path} {b_path}", lambda: Tokenizers(a_path, b_path))
        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, limit=SLICE_BYTES):
            yield from aligned_slice(number, part, tools)
            number += 1

    rows = only(docs, doc_id="bigint", text="string")
    written = materialize(rows.mapInArrow(sliced, SCHEMA), "aligned", partition_by="kind")
    pairs = written.where("kind = 'pairs'").select("slice", "pair", "a", "b", "n")
    totals = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    # An id of B has at most as many pairs as A has ids.
    highest = totals.groupBy(F.col("b").alias("best_b")).agg(F.max("count").alias("highest"))
    ranked = totals.join(highest, F.col("b") == F.col("best_b")).select(
        "a", "b", "count", (F.col("count") == F.col("highest")).cast("int").alias("best")
    )
    rated = pairs.withColumnRenamed("slice", "owner").join(ranked, ["a", "b"]).select("owner", "pair", "count", "best")
    lists = written.where("kind = 'docs'").drop("kind", "pair", "a", "b", "n")
    return lists.groupBy("slice").cogroup(rated.groupBy("owner")).applyInArrow(rated_documents, RESULT)
