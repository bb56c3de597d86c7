import bisect
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from lexicarta.llm import alignment, queries

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def byte_of_characters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in own}
    for b in range(256):
        if b not in own:
            shown[chr(256 + len(shown) - len(own))] = b
    return shown


def spans(pieces):
    at, found = 0, []
    for number, spelt in pieces:
        found.append((number, at, at + len(spelt)))
        at += len(spelt)
    return found


def plain(rows, models):
    """Token by token: all pairs of tokens compared, groups cut where both end."""
    a, b = models
    shown = byte_of_characters()
    docs = []
    for doc_id, text in rows:
        wanted = b" " + (text or "").encode()
        of_a = of_b = []
        if text:
            of_a = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            of_b = [
                (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                for i in b.encode(text)
            ]
            if b"".join(s for _, s in of_a) != wanted or b"".join(s for _, s in of_b) != wanted:
                of_a = of_b = []
        of_a, of_b = spans(of_a), spans(of_b)
        both = sorted({t[2] for t in of_a} & {t[2] for t in of_b})
        groups = [([], []) for _ in both]
        for side, tokens in enumerate((of_a, of_b)):
            for i, _, e in tokens:
                groups[bisect.bisect_left(both, e)][side].append(str(i))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in groups]
        links, first = [], 0
        for i, s, e in of_a:
            while first < len(of_b) and of_b[first][2] <= s:
                first += 1
            j = first
            while j < len(of_b) and of_b[j][1] < e:
                links.append((i, of_b[j][0]))
                j += 1
        docs.append((doc_id, len(of_a), len(of_b), groups, links))
    count = Counter(pair for *_, links in docs for pair in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(n, best.get(j, 0))
    return sorted(
        (
            (
                doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            )
            for doc_id, n_a, n_b, groups, links in docs
        ),
        key=str,
    )


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_same_as_token_by_token(spark, folder, models):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = queries.op13_alignment(spark, folder)
    assert found.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for _, t in found.dtypes[:7]} == {"bigint"}
    assert collected(found) == plain(rows, models)


def test_awkward_rows(spark, make_docs, awkward, models, monkeypatch):
    rows = awkward + [
        (20, " leading"), (21, "two  spaces   three"), (22, "▁under"), (23, "<0x41> <s> </s> <unk>"), (24, "\x00\x01"),
        (25, "​﻿  x"), (26, "日本語テキスト"), (27, "a" * 5000), (28, "🙂👩‍👩‍👧"), (29, "\n"), (30, " "), (31, "ﬁ ① Å"),
    ]
    expected = plain(rows, models)
    assert any(r[1] == 0 and r[7] == "" for r in expected) and sum(r[1] > 0 for r in expected) > 10
    docs = make_docs(rows)
    assert collected(alignment.aligned(docs, A_PATH, B_PATH)) == expected
    monkeypatch.setattr(alignment, "SLICE_BYTES", 40)
    monkeypatch.setattr(alignment, "ENCODE_BYTES", 50)
    assert collected(alignment.aligned(docs.repartition(3), A_PATH, B_PATH)) == expected


def test_no_rows(spark, make_docs):
    assert alignment.aligned(make_docs([]), A_PATH, B_PATH).collect() == []
    assert collected(alignment.aligned(make_docs([(1, None), (2, "")]), A_PATH, B_PATH)) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")
    ]


def test_words_alone_are_the_whole_text(models):
    """Spaces of every kind, between words and marks of every kind."""
    tools = alignment.Tokenizers(A_PATH, B_PATH)
    rng = random.Random(9)
    parts = [" ", " ", " ", "  ", "\n", " \n", "\n ", "\t", "\u00a0", "\u2003", "a", "it's", "'s", "é", "12", "3a", "...", "日本", "▁", "<|endoftext|>", "\x1f", "word"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(3000)]
    a, b = tools.encoded(alignment.pa.array(texts))
    assert a.to_pylist() == [models[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert b.to_pylist() == models[1].encode(texts)


def test_merges_are_those_of_the_tokenizer(folder, models):
    """Every word of the documents, and random ones of the Latin blocks."""
    import pyarrow.parquet as pq

    tools = alignment.Tokenizers(A_PATH, B_PATH)
    assert tools.merger is not None
    rng = random.Random(4)
    words = {w for t in pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist() for w in t.split(" ")}
    words |= {"".join(chr(rng.choice([rng.randint(33, 127), rng.randint(0, 0x24F)])) for _ in range(rng.randint(1, 12))) for _ in range(30_000)}
    words = sorted(w for w in words if w and " " not in w and not w[0].isspace())
    found = alignment._bounded(alignment.pa.array(words), tools._encode_a)
    assert found.to_pylist() == [models[0].encode(" " + w, add_special_tokens=False).ids for w in words]


def test_packed_numbers():
    for numbers in ([], [0], [5, 1 << 31, 70_000, 3]):
        found = alignment.unpacked(alignment.packed(alignment.np.array(numbers, dtype="int64")))
        assert list(found) == numbers


def test_a_frequent_pair_is_one_row_per_slice(spark, make_docs, monkeypatch):
    """All copies of one text: their links meet as counts, not as rows."""
    docs = make_docs([(i, "one two three") for i in range(500)])
    found = collected(alignment.aligned(docs, A_PATH, B_PATH))
    assert len(found) == 500 and len({r[1:] for r in found}) == 1
    assert found[0][6] == 500 * found[0][4]
