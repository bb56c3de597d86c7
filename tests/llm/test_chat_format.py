import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexicarta.llm import chat_format as cf

PIECES = [*cf.DEFAULT.controls(), "\\", "\\\\", "<", "[", "/s>", "s>", " ", "é", "a", "]", "\n"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "", "[AS]", "</s>"]), TEXTS)


@given(TEXTS)
@settings(deadline=None)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = cf.escape(text, cf.escaper(cf.DEFAULT))
    assert cf.unescape(escaped) == text
    assert not any(c in escaped for c in cf.DEFAULT.controls())


@given(st.lists(st.tuples(ROLES, TEXTS), min_size=1, max_size=6), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_turns_come_back_from_the_text_alone(turns, width):
    pattern = cf.escaper(cf.DEFAULT)
    text = cf.DEFAULT.begin + "".join(p for r, t in turns for p, _ in cf.turn_segments(r, t, cf.DEFAULT, pattern))
    cut = [(text[i : i + width], False) for i in range(0, len(text), width)]
    assert list(cf.read_turns(cut, cf.DEFAULT)) == turns


def test_broken_text_is_refused():
    with pytest.raises(ValueError):
        list(cf.read_turns([("<s>[INST] half", False)], cf.DEFAULT))


def expected(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        conversations[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in conversations.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(),
            len(said),
            hashlib.sha256(said.encode()).hexdigest(),
        )
    return out


def test_conversations_round_trip(spark):
    rng = random.Random(2)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "</s>[INST] ok [/INST]", "\\x", "hi é"]))
        for c in [*range(40), None]
        for t in rng.choices([None, 0, 1, 2, 2, 3], k=rng.randint(1, 7))
    ]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(5000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS loss", "2 AS segment")
    segments = cf.formatted(frame.repartition(5))
    got = {r.conv_id: r for r in cf.read_back(segments).collect()}
    want = expected(rows)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    lengths = defaultdict(int)
    for s in segments.collect():
        lengths[s.conv_id] += len(s.text)
        assert not s.loss or s.segment == 1
    assert {k: r.formatted_chars for k, r in got.items()} == dict(lengths)
    assert got[99].valid


@pytest.mark.parametrize(
    "roles, valid",
    [
        ("user assistant", True),
        ("system user assistant user assistant", True),
        ("user", False),
        ("assistant user", False),
        ("user user assistant", False),
        ("user system assistant", False),
        ("system assistant", False),
        ("user tool assistant", False),
    ],
)
def test_order_of_roles(spark, roles, valid):
    rows = [(1, i, r, "x") for i, r in enumerate(roles.split())]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert cf.read_back(cf.formatted(frame)).first().valid == valid


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cf.read_back(cf.formatted(frame)).count() == 0
