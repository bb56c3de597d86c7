"""Column expressions for strings and word lists. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters removed at both ends of a line (U+0000 to
# U+0020), and the marks removed when a text is cleaned (ASCII digits and
# Unicode punctuation).
BLANKS = "".join(chr(c) for c in range(0x21))
CLEANED_AWAY = r"[\d\p{P}]+"
WITHIN_BMP = r"[^\x{10000}-\x{10FFFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def flatten_lines(text: Column) -> Column:
    """One line per document: line breaks and tabs become one space."""
    return F.trim(F.regexp_replace(text, r"[\r\n\t]+", " "))


def longer_than(text: Column, limit: int) -> Column:
    """Whether ``text`` has more than ``limit`` UTF-16 code units.

    ``length`` counts code points. Characters beyond the basic plane count
    twice; they take four bytes each, so a string with few bytes has too few of
    them and only the others are looked at closely.
    """
    length = F.length(text)
    wide = F.length(F.regexp_replace(text, WITHIN_BMP, ""))
    may_exceed = F.octet_length(text) + 2 * length >= 3 * (limit + 1)
    return (length > limit) | (may_exceed & (length + wide > limit))


def split_words(text: Column) -> Column:
    """Split on single spaces; empty words stay, except at the end."""

    def split(whole: Column) -> Column:
        body = F.rtrim(whole)
        only_spaces = (body == "") & (whole != "")
        return F.when(only_spaces, F.array().cast("array<string>")).otherwise(F.split(body, " "))

    return let(text, split)


def clean_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), CLEANED_AWAY, "")


def word_counts(words: Column) -> Column:
    """``array<struct<term, n>>`` of one word list.

    A document's words are all in its own row, so they are counted in place:
    sort the list and measure its runs. Nothing is shuffled for it.
    """

    def runs(ordered: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(
            positions,
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda first: F.transform(
                first,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(first, k + 1), F.size(ordered)) - start)
                    .cast("bigint")
                    .alias("n"),
                ),
            ),
        )

    return let(
        words,
        lambda w: F.when(F.size(w) > 0, let(F.sort_array(w), runs)).otherwise(
            F.array().cast("array<struct<term:string,n:bigint>>")
        ),
    )
