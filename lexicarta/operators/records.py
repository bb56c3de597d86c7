"""Abstracts out of tagged record files.

A record is a run of lines closed by a short line. Inside it, a line with the
abstract tag starts the abstract, lines with a leading space continue it, any
other field ends it, and a second tagged line starts it anew.

The unit of work is one block of a file (a file split), never a whole file:
records are numbered inside their block, which takes the one shuffle of the
lines. Their pieces are written; after that only the first and the last piece of
each block take part in a second step that joins records cut by a block
boundary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.functions.text import let, longer_than, split_words, strip_blanks
from lexicarta.session import materialize

CLOSE, START, CONTINUE, OTHER = "T", "S", "C", "O"


@dataclass(frozen=True)
class RecordLayout:
    """``close_length``: longest closing line; ``cut``: characters before the text."""

    tag: str
    cut: int
    close_length: int
    strips_stop_words: bool


# Fixed values of the two record formats.
ARTICLE = RecordLayout(tag="AB", cut=3, close_length=2, strips_stop_words=True)
PATENT = RecordLayout(tag="abd", cut=7, close_length=8, strips_stop_words=False)
LAYOUTS = {"article": ARTICLE, "patent": PATENT}


def classify_lines(lines: DataFrame, layout: RecordLayout) -> DataFrame:
    """``(file, block, pos, kind, text)``; only abstract lines carry their text.

    Lines of fewer than two words change nothing and are left out here, before
    any shuffle.
    """
    line = F.col("line")
    first = F.substring_index(line, " ", 1)
    two_words = F.contains(F.rtrim(line), F.lit(" "))
    text = strip_blanks(F.lower(line))
    kind = (
        F.when(~longer_than(line, layout.close_length), CLOSE)
        .when(~two_words, F.lit(None))
        .when(first == layout.tag, START)
        .when(first == "", CONTINUE)
        .otherwise(OTHER)
    )
    return (
        lines.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "file",
            "block",
            "pos",
            "kind",
            F.when(F.col("kind") == START, F.substring(text, layout.cut + 1, 2**31 - 1))
            .when(F.col("kind") == CONTINUE, text)
            .alias("text"),
        )
    )


def _kinds(parts: Column) -> Column:
    return F.transform(parts, lambda p: p["kind"])


def _last_island(parts: Column) -> Column:
    """From the last start (or the first line) to the next other field.

    Applied to the pieces of a cut record and then to their concatenation it
    gives the same lines as applied to the whole record.
    """

    def up_to_other(tail: Column) -> Column:
        end = F.array_position(_kinds(tail), OTHER).cast("int")
        return F.when(end > 0, F.slice(tail, 1, end)).otherwise(tail)

    back = F.array_position(F.reverse(_kinds(parts)), START).cast("int")
    start = F.when(back > 0, F.size(parts) - back + 1).otherwise(1)
    return let(F.slice(parts, start, F.size(parts)), up_to_other)


def _abstract(island: Column, joiner: str) -> Column:
    """The joined lines. A joiner stands between texts only, not beside an empty one."""
    kept = F.filter(island, lambda p: (p["kind"] != OTHER) & ((F.lit(joiner) == "") | (p["text"] != "")))
    return F.when(
        F.get(island, F.lit(0))["kind"] == START,
        F.array_join(F.transform(kept, lambda p: p["text"]), joiner),
    )


def extract_records(
    lines: DataFrame, layout: RecordLayout, joiner: str = " ", keep_unclosed: bool = True
) -> DataFrame:
    """``records(file, block, record, text)``, ordered by those three keys.

    ``joiner=""`` and ``keep_unclosed=False`` give the compatible behaviour:
    continuation lines are glued on, and a last record that no short line closes
    is lost.
    """
    marked = classify_lines(lines, layout)
    is_close = (F.col("kind") == CLOSE).cast("bigint")
    earlier = (
        Window.partitionBy("file", "block")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = F.sort_array(
        F.collect_list(F.when(F.col("kind") != CLOSE, F.struct("pos", "kind", "text")))
    )
    bare = F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text")))
    pieces = materialize(
        marked.withColumn("record", F.coalesce(F.sum(is_close).over(earlier), F.lit(0)))
        .groupBy("file", "block", "record")
        .agg(F.max(is_close).alias("closed"), bare.alias("parts"))
        .withColumn("parts", _last_island(F.col("parts")))
        .withColumn("edge", ((F.col("record") == 0) | (F.col("closed") == 0)).cast("int")),
        "pieces",
        partition_by="edge",
    )
    whole, edges = pieces.where("edge = 0"), pieces.where("edge = 1")
    joined = (
        edges.join(_record_before(pieces), ["file", "block"])
        .select(
            "file",
            F.when(F.col("record") > 0, F.col("block"))
            .otherwise(F.col("before.block"))
            .alias("first_block"),
            F.when(F.col("record") > 0, F.col("record"))
            .otherwise(F.col("before.record"))
            .alias("record"),
            F.struct("block", "parts").alias("piece"),
            "closed",
        )
        .groupBy("file", F.col("first_block").alias("block"), "record")
        .agg(
            F.max("closed").alias("closed"),
            F.flatten(
                F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["parts"])
            ).alias("parts"),
        )
        .withColumn("parts", _last_island(F.col("parts")))
    )
    if not keep_unclosed:
        joined = joined.where(F.col("closed") == 1)
    columns = ["file", "block", "record", _abstract(F.col("parts"), joiner).alias("text")]
    return whole.select(*columns).unionByName(joined.select(*columns)).where(F.col("text") != "")


def _record_before(pieces: DataFrame) -> DataFrame:
    """For each block, the record that is open where the block begins.

    That is the record after the last closing line of the nearest earlier block
    that has one. One small row per block, from two columns of the pieces.
    """
    by_block = Window.partitionBy("file").orderBy("block")
    closing = F.when(
        F.col("closes") > 0, F.struct(F.col("block"), F.col("closes").alias("record"))
    )
    return (
        pieces.groupBy("file", "block")
        .agg(F.sum("closed").alias("closes"))
        .select(
            "file",
            "block",
            F.coalesce(
                F.last(closing, ignorenulls=True).over(
                    by_block.rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.struct(
                    F.first("block").over(by_block).alias("block"),
                    F.lit(0).cast("bigint").alias("record"),
                ),
            ).alias("before"),
        )
    )


def strip_stop_words(text: Column, stop_words: list[str], joiner: str = " ") -> Column:
    """Drop stop words and one-character words of an abstract.

    ``joiner=""`` is the compatible behaviour: the words are glued together.
    """
    kept = F.filter(
        split_words(text), lambda w: longer_than(w, 1) & ~F.coalesce(w.isin(stop_words), F.lit(False))
    )
    return F.array_join(kept, joiner)


def strip_stop_words_by_join(
    records: DataFrame, keys: list[str], stopwords: DataFrame, joiner: str = " "
) -> DataFrame:
    """The same for a stop list too large for literals in the plan."""
    words = records.select(*keys, F.posexplode(split_words(F.col("text"))).alias("at", "term"))
    kept = (
        words.where(longer_than(F.col("term"), 1))
        .join(stopwords, "term", "left_anti")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("at", "term"))).alias("kept"))
    )
    rebuilt = F.array_join(F.transform("kept", lambda k: k["term"]), joiner)
    return (
        records.drop("text")
        .join(kept, keys, "left")
        .withColumn("text", F.coalesce(rebuilt, F.lit("")))
        .drop("kept")
    )
