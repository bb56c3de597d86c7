import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexicarta.llm import packing
from lexicarta.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def coder():
    return packing.WordIds(tokenizer_path())


def direct(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


ALPHABET = st.sampled_from(list("abzTHE'sdm.,!*|<>0 9\n\t\x0b\x1c  éÉßİΣσñ漢") + ["<|endoftext|>", "'re ", "é", "<|", "|>", "the "])


@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_tokenizer(tokenizer, coder, texts):
    ids, ends = coder.of_texts(pa.array(texts, pa.string()))
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[begin:end].tolist() == direct(tokenizer, text)
        begin = end


def test_special_tokens_are_matched_as_they_are_spelt(tokenizer, coder):
    texts = ["a <|EndOfText|> b", "<|ENDOFTEXT|>", "The<|endoftext|>END", "É<| <|startofTEXT|>. <|startoftext|>A", "No MARKS"]
    for text in texts:
        assert coder.of_texts(pa.array([text]))[0].tolist() == direct(tokenizer, text)
    together = [i for text in texts for i in direct(tokenizer, text)]
    assert coder.of_texts(pa.array(texts))[0].tolist() == together


def test_memory_of_words_is_bounded(tokenizer, coder, monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 5)
    texts = [f"word{i}, other{i}. the a of" for i in range(9)]
    for text in texts:
        assert coder.of_texts(pa.array([text]))[0].tolist() == direct(tokenizer, text)


def naive(lengths, capacity):
    rooms, where = [], []
    for length in lengths:
        fit = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if not fit:
            rooms.append(capacity)
            fit = [(capacity, len(rooms) - 1)]
        room = min(fit)[0]
        i = next(i for r, i in fit if r == room)
        where.append(room)
        rooms[i] -= length
    return where, len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_against_a_search_of_all_bins(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 4096])
    lengths = sorted((rng.randint(1, capacity) for _ in range(300)), reverse=True)
    bins, offsets = packing.best_fit_decreasing(np.array(lengths), capacity)
    rooms, n = naive(lengths, capacity)
    assert (capacity - offsets).tolist() == rooms  # always the tightest bin
    assert bins.max() + 1 == n


def check_packed(rows, capacity):
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


def test_pieces_and_sequences(make_docs, awkward, tokenizer):
    docs = make_docs(awkward)
    capacity = 64
    packed = packing.pack(packing.pieces(docs, tokenizer_path(), capacity), capacity, group=500)
    rows = packed.collect()
    want = Counter()
    for doc_id, text in awkward:
        ids = direct(tokenizer, text or "") + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4").tobytes()
            want[(doc_id, piece, start, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
    n = check_packed(rows, capacity)
    total = sum(r.length for r in rows)
    assert n <= math.ceil(total / capacity) * 1.02 + math.ceil(len(rows) / 500)
    whole = packing.sequences(packed).collect()
    assert len(whole) == n
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.sequence_id].append((r.offset, bytes(r.ids)))
    for s in whole:
        assert bytes(s.ids) == b"".join(b for _, b in sorted(by_id[s.sequence_id]))
        assert s.length * 4 == len(s.ids)


def test_empty_table(make_docs):
    packed = packing.pack(packing.pieces(make_docs([]), tokenizer_path()))
    assert packed.count() == 0 and packing.sequences(packed).count() == 0


def test_equal_rows_are_dealt_to_all_groups(make_docs):
    docs = make_docs([(None, "one two three")] * 3000 + [(i, "four five") for i in range(1000)]).repartition(4)
    packed = packing.pack(packing.pieces(docs, tokenizer_path(), 64, with_ids=False), 64, group=500).collect()
    check_packed(packed, 64)
    parts = Counter(r.sequence_id >> 40 for r in packed if r.doc_id is None)
    assert len(parts) >= 8 and max(parts.values()) < 600


@pytest.mark.parametrize("group", [50, 200, 1000])
def test_leftovers_of_groups_are_packed_together(spark, group):
    rng = random.Random(group)
    rows = [(i, 0, 0, rng.choice([rng.randint(1, 100), rng.randint(1, 9)]), i) for i in range(3000)]
    parts = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    n = check_packed(packing.pack(parts, 100, group).collect(), 100)
    single = check_packed(packing.pack(parts, 100, 1 << 16).collect(), 100)
    assert single <= n <= single + max(1, (0.03 if group == 50 else 0.02) * single)


def test_words_are_those_of_the_tokenizer(folder, tokenizer, coder):
    """Every word of the documents, lower case letters through the merges on bytes."""
    import pyarrow.parquet as pq

    assert coder.merger is not None
    words = sorted({w for t in pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist() for w in t.split()})
    ids, ends = coder.of_texts(pa.array(words))
    begins = [0, *ends.tolist()]
    direct_ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == direct_ids
    known = len(coder.known)
    coder.of_texts(pa.array(["qzxv unheardof", "twice twice"]))
    assert "unheardof" not in coder.known and "twice" in coder.known and len(coder.known) == known + 1
