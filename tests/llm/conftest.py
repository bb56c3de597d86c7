import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ha", "lo", "mi", "nu", "pe") for b in ("ran", "tel", "ser", "n", "x")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows, with columns that clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).selectExpr(
            "*", "'x' AS score", "1 AS label", "'k' AS `_doc`", "true AS kept", "'b' AS block", "0 AS `a.b`"
        )

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null ids and texts, empty and white texts, repeats, a very long text and ties."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    return [
        (1, "one two three four five six"),
        (2, "one two three four five six"),
        (2, "one two three four five six"),
        (3, "one  two\tthree four\nfive six"),
        (None, "one two three four five six"),
        (None, None),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b\f\r "),
        (7, long),
        (8, long + " end"),
        (9, "Überß ñandú ελλΣ İstanbul     𝒳 é"),
        (10, "</s>[INST] <|endoftext|> it's we'll 's"),
        (11, "a"),
    ]
